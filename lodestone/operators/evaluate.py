"""Hit rates of retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "question string, expected_sources array<string>, expected_keywords array<string>"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to query_id, text, expected_sources, expected_keywords; missing lists are empty."""
    rows = spark.read.schema(CASE).json(path).where("question IS NOT NULL")
    none = F.array().cast("array<string>")
    return rows.select(F.monotonically_increasing_id().alias("query_id"), F.col("question").alias("text"), F.coalesce("expected_sources", none).alias("expected_sources"), F.coalesce("expected_keywords", none).alias("expected_keywords"))


def hits(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, source_hit, keyword_hit: any expected source is among the results; any keyword is in their joined texts.
    Nothing expected is a hit."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    got = ranked.groupBy("query_id").agg(F.collect_set("source").alias("sources"), texts.alias("joined"))
    x = cases.join(got, "query_id", "left")
    source = (F.size("expected_sources") == 0) | F.coalesce(F.arrays_overlap("expected_sources", "sources"), F.lit(False))
    keyword = (F.size("expected_keywords") == 0) | F.exists("expected_keywords", lambda k: F.coalesce(F.contains(F.col("joined"), k), F.lit(False)))
    return x.select("query_id", source.alias("source_hit"), keyword.alias("keyword_hit"))


def hit_rates(found: DataFrame) -> DataFrame:
    """total, source_hits, keyword_hits, passed (all hit)."""
    one = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    out = found.agg(F.count(F.lit(1)).alias("total"), one("source_hit").alias("source_hits"), one("keyword_hit").alias("keyword_hits"))
    return out.withColumn("passed", (F.col("source_hits") == F.col("total")) & (F.col("keyword_hits") == F.col("total")))


def top1_check(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, hit: the first result is from the expected source (cases: query_id, expected); no result is a miss."""
    first = ranked.where("rank = 1").select("query_id", "source")
    return cases.join(first, "query_id", "left").select("query_id", F.coalesce(F.col("source") == F.col("expected"), F.lit(False)).alias("hit"))


#: Characters of the passages that one automaton holds (some 50 bytes each in a worker); more take several passes.
AUTOMATON_CHARS = 2_000_000


def _automaton(passages: list[tuple[int, str]]):
    """An automaton that finds all passages in one reading of a text, and the query_ids of empty passages."""
    found = ahocorasick.Automaton()
    for query_id, text in passages:
        if text:
            found.add_word(text, [*found.get(text, ()), query_id])
    if len(found):
        found.make_automaton()
    return found, [q for q, text in passages if text == ""]


def _find(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, empty = _automaton(sent.value)
        for batch in batches:
            out: list[tuple] = []
            for i, source, text in zip(*(batch.column(c).to_pylist() for c in ("id", "source", "text")), strict=True):
                if text is not None:
                    held = {q for _, own in automaton.iter(text) for q in own} if len(automaton) else set()
                    out += [(q, i, source) for q in (*empty, *held)]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["query_id", "id", "source"])

    return run


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, id, source) of documents (id, text, source) that contain a passage (query_id, text), once for each two.

    The passages are sent to every task as an automaton, and each document is read once, where it is, for all of them; only
    hits go on. Passages of more than AUTOMATON_CHARS together are dealt to as many automata as that takes, each of which
    reads the documents. An empty passage is in every text; null passages are in none, and null texts hold none.
    """
    spark = docs.sparkSession
    asked = passages.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = -(-size // AUTOMATON_CHARS) or 1
    rows = docs.select(F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    out = None
    for i in range(parts):
        own = asked.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(parts)) == i) if parts > 1 else asked
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about AUTOMATON_CHARS
        found = rows.mapInArrow(_find(sent), "query_id long, id long, source string")
        out = found if out is None else out.unionByName(found)
    return out
