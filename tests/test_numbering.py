import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.engine import Engine
from lodestone.operators.dedup import numbered
from lodestone.plans import catalog
from lodestone.sources.files import load_chunks, uploads
from tests.conftest import DATA


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_numbers_have_no_gaps(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        ids = random.Random(1).sample(range(10**6), 900)
        got = numbered(spark.createDataFrame([(i, f"x{i}") for i in ids], "id long, x string").repartition(5), "id").collect()
        assert sorted((r["id"], r["x"], r["no"]) for r in got) == [(i, f"x{i}", n) for n, i in enumerate(sorted(ids), 1)]
        assert numbered(spark.createDataFrame([], "id long"), "id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["store_rows", "sources_listed"])
def test_no_task_numbers_all_rows(spark, name):
    plan = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_chunks_are_counted_while_they_are_written(spark, tmp_path):
    """One job writes and counts; what an ingest skipped follows from it."""
    seen, texts = Observation(), ["one two three", "one two three", "four five", "one  two three"]
    files = uploads(spark, [(f"{i}.txt", t.encode()) for i, t in enumerate(texts)])
    every, kept = load_chunks(files, Settings(), seen=seen)
    assert seen.get["chunks"] == every.count() == 4 and kept.count() == 2
    got = Engine(spark, str(tmp_path / "s"), Settings()).ingest_bytes([(f"{i}.txt", t.encode()) for i, t in enumerate(texts)])
    assert (got.added, got.skipped_duplicates, got.total_chunks) == (2, 2, 2)


def test_rewritten_table_is_read_anew(spark, tmp_path):
    """The same path, size and number of files, but another table."""
    where = f"file://{tmp_path}/documents.parquet"
    for word in ("alpha", "gamma"):
        spark.range(40).select(F.col("id").alias("doc_id"), F.lit(f"{word} text").alias("text"), F.lit("s").alias("source")).coalesce(1).write.mode("overwrite").parquet(where)
        assert word in {r["tok"] for r in catalog.bm25_idf(spark, f"file://{tmp_path}").collect()}
