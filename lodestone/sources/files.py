"""Files to documents and chunks. Reading, cleaning, hashing and dedup are plans; only parsers run in Python workers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import Settings
from lodestone.functions.chunking import chunk_documents
from lodestone.functions.text import basename, extension
from lodestone.operators.dedup import first_wins
from lodestone.plans.runtime import materialize
from lodestone.sources.ocr import OCRProvider
from lodestone.sources.parsers import parse
from lodestone.sources.registry import family_of, supported_frame


#: Paths or names of a request that are sent to every task; more meet the files by a shuffle.
BROADCAST_NAMES = 100_000


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_NAMES else rows


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, source, content) of files, in the order given. A missing file is an error."""
    if not paths:
        raise ValueError("no files given")
    found = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).select("path", basename("path").alias("source"), "content")
    order = spark.createDataFrame([(i, _qualified(spark, p)) for i, p in enumerate(paths)], "file_no int, path string")
    return found.join(_few(order, len(paths)), "path").select("file_no", "source", "content")


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toString()


def uploads(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """The same for contents in memory; the source is the name given."""
    return spark.createDataFrame([(i, name, bytearray(content)) for i, (name, content) in enumerate(files)], "file_no int, source string, content binary")


def unsupported(files: DataFrame) -> DataFrame:
    """Files whose extension no parser reads."""
    known = supported_frame(files.sparkSession).select("extension")
    return files.withColumn("extension", extension("source")).join(F.broadcast(known), "extension", "left_anti")


def parse_files(files: DataFrame, settings: Settings, provider: OCRProvider | None = None) -> DataFrame:
    """files (file_no, source, content) to (file_no, source, text, error). error: why a file could not be read, or null."""
    provider = provider if settings.enable_ocr else None
    limits = {"ocr_pages": settings.ocr_max_pages, "ocr_dpi": settings.ocr_dpi, "ocr_least": settings.ocr_pdf_min_text_chars}

    @F.pandas_udf("text string, error string")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for name, content in zip(names, contents, strict=True):
            try:
                rows.append((parse(name, bytes(content), provider, **limits), None))
            except Exception as e:  # noqa: BLE001  reported as the file's error
                rows.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "error"])

    once = run.asNondeterministic()  # else filters on the text would parse, or ask the provider, a second time
    return files.withColumn("got", once("source", "content")).select("file_no", "source", "got.text", "got.error")


def load_chunks(files: DataFrame, settings: Settings, provider: OCRProvider | None = None, size: int | None = None, overlap: int | None = None, names: list[str] | None = None, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(all chunks, chunks that stay): equal content stays where it comes first, by file_no, then place in the file.

    Files are parsed here and once: their chunks are written to the shared folder, so nothing that is done with them parses
    a file, or asks an OCR provider, again. Any file that cannot be read fails the whole batch. names: sources by file
    number, instead of the files' own; files without a name are left out. seen: is told the number of all chunks while
    they are written.
    """
    for r in unsupported(files).limit(1).collect():
        family_of(r["extension"])
    parsed = parse_files(files, settings, provider)
    if names is not None:
        pairs = files.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("file_no", T.IntegerType()), T.StructField("name", T.StringType())]))
        parsed = parsed.join(_few(pairs, len(names)), "file_no").withColumn("source", F.col("name")).drop("name")
    parsed = parsed.withColumn("text", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "source", "error"))).otherwise(F.col("text")))
    size, overlap = settings.resolve_chunking(size, overlap)
    chunks = chunk_documents(parsed, size, overlap, settings.chunk_strategy, keep=("file_no",))
    chunks = materialize(chunks.observe(seen, F.count(F.lit(1)).alias("chunks")) if seen else chunks, "chunks")
    return chunks, first_wins(chunks, ["content_hash"], ["file_no", "chunk_index"])
