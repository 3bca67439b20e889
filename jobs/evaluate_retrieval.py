"""Evaluation of hybrid retrieval: every benchmark passage that documents hold is asked for, and what comes back is judged.

Writes, under a label, a row for each question (did the sources and the keyword come back, what came first, and the
context an assistant would be shown, without personal data), misses apart from hits, and a row of totals. A run replaces
what was written under its label and leaves other labels alone, so evaluations of different days stand side by side.

    python -m jobs.evaluate_retrieval --documents /data/documents.parquet --questions /data/benchmark.parquet --out /eval
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.config import load
from lodestone.functions import pii
from lodestone.log import get_logger
from lodestone.operators import bm25
from lodestone.operators.embed import HashingEmbedder, embed
from lodestone.operators.evaluate import containing, hit_rates, hits
from lodestone.operators.retrieval import Collection, format_context, hybrid_retrieve
from lodestone.plans.runtime import materialize, prepare, scratch, spread

QUESTIONS = "query_id long, expected int, keyword_hit boolean, best_source string, context string, label string, source_hit boolean"
TOTALS = "total long, source_hits long, keyword_hits long, passed boolean, label string"

MARK = "state string, n long"
#: Goes up when the index is made in another way.
INDEX_VERSION = 1

log = get_logger("lodestone.jobs.evaluate")


@dataclass(frozen=True)
class Config:
    """label: the name that results are written under; dims: of the bundled embedder; keyword_chars: how much of a passage
    is the keyword that must come back."""

    label: str = "nightly"
    top_k: int = 5
    threshold: float = 0.3
    dims: int = 64
    keyword_chars: int = 30


def cases(docs: DataFrame, asked: DataFrame, keyword_chars: int) -> DataFrame:
    """query_id, text, expected_sources, expected_keywords of the questions whose passage some document holds."""
    found = containing(docs, asked).groupBy("query_id").agg(F.collect_set("source").alias("expected_sources"))
    return found.join(asked, "query_id").select("query_id", "text", "expected_sources", F.array(F.left("text", F.lit(keyword_chars))).alias("expected_keywords"))


def _replace(rows: DataFrame, at: str, label: str, *by: str) -> None:
    """Write rows as the label's partition, in place of all it held; dynamic overwrite would keep the old misses of a run
    that has none."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{at}/label={label}")


def questions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).parquet(f"{out}/questions")


def totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(TOTALS).parquet(f"{out}/totals")


def _index(spark: SparkSession, documents: str, docs: DataFrame, at: str, embedder: HashingEmbedder) -> Collection:
    """What the search reads, kept in `at` for as long as the files of documents stay as they are. The mark says of which
    files it is; it is taken away first and written last."""
    files = spark.read.parquet(documents).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, same, size = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("*")), F.sum("file_size")).first()
    state, empty = f"{INDEX_VERSION}/{embedder.dims}/{n}/{same}/{size}", spark.createDataFrame([], MARK)
    empty.write.mode("append").parquet(f"{at}/mark")  # a folder to read
    held = lambda: spark.read.schema(MARK).parquet(f"{at}/mark").where(F.col("state") == state).first()
    postings = spark.read.schema(bm25.POSTINGS)
    if not held():
        empty.write.mode("overwrite").parquet(f"{at}/mark")
        docs.select("id", embed(embedder, F.col("text")).alias("vector")).write.mode("overwrite").parquet(f"{at}/vectors")
        bm25.invert(docs).write.mode("overwrite").parquet(f"{at}/postings")
        bm25.counts_of(postings.parquet(f"{at}/postings")).write.mode("overwrite").parquet(f"{at}/counts")
        spark.createDataFrame([(state, docs.count())], MARK).coalesce(1).write.mode("overwrite").parquet(f"{at}/mark")
        log.info("%s: index of %s written", at, documents)
    counts = spark.read.schema("tok string, df long, total long").parquet(f"{at}/counts")
    index = bm25.Index.of(postings.parquet(f"{at}/postings"), counts, held()["n"])
    return Collection(docs, spark.read.schema("id long, vector array<double>").parquet(f"{at}/vectors"), index)


def evaluate(spark: SparkSession, documents: str, asked: str, out: str, config: Config = Config()) -> dict:
    """Evaluate the questions of `asked` (item_id, text) over `documents` (doc_id, text, source) into out/questions and
    out/totals, each by label. Returns the totals. The label's index of the documents is kept in out/index, and made again
    when a file of theirs has changed.

    Questions that no document holds expect nothing and are left out. Null texts are in no document and ask nothing.
    """
    prepare(spark)
    if not config.label.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a label has letters, digits, - and _ only: {config.label!r}")
    with scratch():
        docs = spread(spark.read.parquet(documents).select(F.col("doc_id").alias("id"), "text", "source"))
        passages = spark.read.parquet(asked).select(F.col("item_id").alias("query_id"), "text").where("text IS NOT NULL")
        wanted = materialize(cases(docs, passages, config.keyword_chars), "cases")
        embedder = HashingEmbedder(config.dims)
        found = materialize(hybrid_retrieve(_index(spark, documents, docs, f"{out}/index/label={config.label}", embedder), wanted.select("query_id", "text"), embedder, config.top_k, config.threshold), "found")
        first = found.where("rank = 1").select("query_id", F.col("source").alias("best_source"))
        rows = hits(wanted, found).join(wanted.select("query_id", F.size("expected_sources").alias("expected")), "query_id")
        rows = rows.join(first, "query_id", "left").join(format_context(found, mask=pii.mask), "query_id", "left")
        _replace(rows.select("query_id", "expected", "source_hit", "keyword_hit", "best_source", "context"), f"{out}/questions", config.label, "source_hit")
    written = questions(spark, out).where(F.col("label") == config.label)
    _replace(hit_rates(written), f"{out}/totals", config.label)
    got = totals(spark, out).where(F.col("label") == config.label).first().asDict()
    log.info("%s: read %s and %s; %d questions written under %s, %d with a source, %d with the keyword", out, documents, asked, got["total"], config.label, got["source_hits"], got["keyword_hits"])
    return got


def main() -> None:
    own = Path(__file__)
    say = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "questions", "out"):
        say.add_argument(f"--{name}", required=True)
    say.add_argument("--config", default=str(own.with_suffix(".json")))
    said = say.parse_args()
    spark = SparkSession.builder.appName(own.stem).getOrCreate()
    try:
        evaluate(spark, said.documents, said.questions, said.out, load(Config, said.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
