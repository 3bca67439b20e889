from lodestone.plans import catalog
from tests.oracle import differences


def test_ties_of_a_store_go_by_the_order_of_insertion(spark, tmp_path):
    """Twenty documents of one score, more than are fetched, whose sources are in another order than they."""
    docs = [(i, f"alpha w{i}", "en", f"src{(7 * i) % 10}", 8) for i in range(40)] + [(40 + i, f"other v{i} u{i}", "en", "src0", 11) for i in range(80)]
    docs += [(121, "alpha  w6", "en", "src9", 9)]  # an equal chunk of the second batch: keeps its place
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/made/documents")
    spark.createDataFrame([(1, "alpha"), (2, "other alpha")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made/benchmark")
    (tmp_path / "data").mkdir()
    for name in ("documents", "benchmark"):
        next((tmp_path / "made" / name).glob("*.parquet")).rename(tmp_path / "data" / f"{name}.parquet")
    assert not differences(spark, catalog.QUERIES["store_bm25_search"], catalog.ORACLES["store_bm25_search"], tmp_path / "data")
