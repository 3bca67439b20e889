import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25
from lodestone.plans import catalog
from tests.oracle import differences

#: Tokens of a block in this test; the longest document has more.
MOST = 300


@pytest.fixture
def data(spark, tmp_path):
    """Documents of very different lengths, equal ones among them, and passages of some as questions."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 5, 40, 250, 900]))) for _ in range(70)]
    texts += texts[:10]
    docs = [(i, t, "en", f"src{i % 7}", len(t)) for i, t in enumerate(texts)]
    asked = [(i, " ".join(texts[3 * i].split()[:8])) for i in range(20)] + [(20, "absent words")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/made/documents")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made/benchmark")
    (tmp_path / "data").mkdir()
    for name in ("documents", "benchmark"):
        next((tmp_path / "made" / name).glob("*.parquet")).rename(tmp_path / "data" / f"{name}.parquet")
    return tmp_path / "data"


@pytest.mark.parametrize("name", ["eval_hits", "bm25_search"])
def test_what_a_task_of_the_query_holds_is_bounded_by_tokens(spark, monkeypatch, data, name):
    """The query reads an index whose blocks do not grow with the documents' lengths, and many blocks give the SQL's rows."""
    monkeypatch.setattr(bm25, "BLOCK_TOKENS", MOST, raising=False)
    assert not differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], data)
    index = catalog._collection(spark, str(data)).index  # the one the query has made
    sizes = [r["held"] for r in index.postings.groupBy("block").agg(F.sum("total").alias("held")).collect()]
    longest = max(len(r["toks"]) for r in spark.read.parquet(f"{data}/documents.parquet").select(bm25.tokens(F.col("text")).alias("toks")).collect())
    assert sum(sizes) == index.length and max(sizes) <= max(MOST, longest) and len(sizes) > 16
