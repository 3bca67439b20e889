"""Continuous ingest of a folder. The upsert is by content, so a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.engine import Engine
from lodestone.functions.text import basename
from lodestone.plans.runtime import scratch
from lodestone.sources.files import load_chunks

FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(engine: Engine, folder: str, checkpoint: str, once: bool = True, pattern: str = "*") -> StreamingQuery:
    """Add each new file of the folder to the engine's store; with `once` stop when all there is has been read.

    Files of one trigger are ordered by their paths, which order their chunks; the files themselves do not move.
    """
    files = engine.spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder)

    def add(batch: DataFrame, _: int) -> None:
        with scratch():
            _, kept = load_chunks(batch.select(F.col("path").alias("file_no"), basename("path").alias("source"), "content"), engine.settings, engine.ocr)
            engine.store.add(kept)

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
