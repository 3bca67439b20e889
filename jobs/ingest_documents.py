"""Incremental ingest: new files of a documents table become chunks of a knowledge base, each text once.

A file stream with a checkpoint takes the files that no earlier run has taken. Each of its batches is cleaned, cut into
chunks and hashed; of equal chunks the first stays, and those that an earlier batch wrote are left out. Chunks are written
by batch and language. A batch that failed is run again under its number, into its own folder, so a rerun adds nothing
twice and loses nothing.

    python -m jobs.ingest_documents --documents /data/documents.parquet --out /kb --checkpoint /kb/checkpoint
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.config import load
from lodestone.functions.chunking import chunk_documents
from lodestone.functions.text import estimate_tokens
from lodestone.log import get_logger
from lodestone.operators.dedup import first_wins
from lodestone.plans.runtime import materialize, prepare, scratch

DOCUMENTS = "doc_id long, text string, lang string, source string"
CHUNKS = "doc_id long, source string, chunk_index int, text string, content_hash string, tokens int, batch long, lang string"
#: Hashes of a batch that are sent to the chunks there are, which then do not move; more meet them by a shuffle.
BROADCAST_HASHES = 1_000_000

log = get_logger("lodestone.jobs.ingest")


@dataclass(frozen=True)
class Config:
    """Sizes in units of the strategy ("token" or "char"); files_per_batch: how many files a batch takes, null for all."""

    chunk_size: int = 200
    chunk_overlap: int = 40
    strategy: str = "token"
    files_per_batch: int | None = None


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """All chunks of the knowledge base."""
    return spark.read.schema(CHUNKS).parquet(f"{out}/chunks")


def pattern(path: str) -> str:
    """path as a pattern that only it matches: a stream takes no path to a single file, but one it finds by a pattern."""
    return path if set(path) & set("*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"


def unseen(own: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The n rows of own whose content_hash is not in known."""
    if n > BROADCAST_HASHES:
        return own.join(known, "content_hash", "left_anti")
    met = known.join(F.broadcast(own.select("content_hash")), "content_hash", "left_semi").distinct()
    return own.join(F.broadcast(met), "content_hash", "left_anti")  # no more rows than own


def add(spark: SparkSession, docs: DataFrame, batch: int, out: str, config: Config) -> dict[str, int]:
    """Write the chunks of docs that no earlier batch has."""
    with scratch():
        cut = chunk_documents(docs, config.chunk_size, config.chunk_overlap, config.strategy, keep=("doc_id", "lang"))
        own = materialize(first_wins(cut, ["content_hash"], ["doc_id", "chunk_index", "source", "lang"]), "batch-chunks")
        n = own.count()
        fresh = unseen(own, chunks(spark, out).where(F.col("batch") < batch).select("content_hash"), n)
        fresh = fresh.select("doc_id", "source", "chunk_index", "text", "content_hash", estimate_tokens("text").alias("tokens"), "lang")
        at = f"{out}/chunks/batch={batch}"
        fresh.hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(at)
    return {"batch": batch, "read": docs.count(), "chunks": n, "written": chunks(spark, out).where(F.col("batch") == batch).count()}


def ingest(spark: SparkSession, documents: str, out: str, checkpoint: str, config: Config = Config()) -> list[dict[str, int]]:
    """Take the new files of the table in `documents` (a folder, a file or a pattern) into out/chunks. Returns, for each batch of this run, its number, the
    documents read, their different chunks, and those written; no new file gives no batch.

    documents: doc_id, text, lang and source are read. Null texts give no chunk; null languages have a folder of their
    own. A file that was taken is not read again, whatever becomes of it; files may be older than those taken before.
    """
    prepare(spark)
    spark.createDataFrame([], CHUNKS).write.mode("append").partitionBy("batch", "lang").parquet(f"{out}/chunks")  # a folder to read
    stream = spark.readStream.schema(DOCUMENTS).option("maxFileAge", "36500d")
    if config.files_per_batch:
        stream = stream.option("maxFilesPerTrigger", config.files_per_batch)
    done: list[dict[str, int]] = []

    def each(batch: DataFrame, number: int) -> None:
        done.append(add(spark, batch, number, out, config))
        log.info("%s: batch %d, %d documents read, %d chunks, %d written", out, *done[-1].values())

    query = stream.parquet(pattern(documents)).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches, %d documents read from %s, %d chunks written", out, len(done), sum(d["read"] for d in done), documents, sum(d["written"] for d in done))
    return done


def main() -> None:
    own = Path(__file__)
    say = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        say.add_argument(f"--{name}", required=True)
    say.add_argument("--config", default=str(own.with_suffix(".json")))
    said = say.parse_args()
    spark = SparkSession.builder.appName(own.stem).getOrCreate()
    try:
        ingest(spark, said.documents, said.out, said.checkpoint, load(Config, said.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
