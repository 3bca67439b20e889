import corpus_pipeline
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.mixing import mix_sources, source_group
from lodestone.llm.quality_rules import quality_rules
from lodestone.plans.runtime import materialize
from tests.conftest import DATA
from tests.llm.test_dedup import reach
from tests.llm.test_whole_rows import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def first_of_similar(docs):
    """By brute force: of the rows that pairs of Jaccard similarity 0.8 of five-word shingles connect, the first."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.select("doc_id", "text").collect()}
    root = reach(list(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    return docs.where(docs["doc_id"].isin([i for i in sets if root[i] == i]))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, decide in (
        ("quality_rules", lambda d: quality_rules(d).where("kept")),
        ("exact_dedup", lambda d: exact_dedup(d).where("kept")),
        ("simhash_dedup", first_of_similar),
        ("mixing", lambda d: mix_sources(d, source_group(), corpus_pipeline.BUDGET, corpus_pipeline.MIXTURE).where("selected")),
    ):
        out = materialize(stages[name](spark, docs, ""), name)
        assert out.columns == COLUMNS and ids(out) == ids(decide(docs)) and 0 < out.count() <= docs.count()
        docs = out
    pieces = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert sorted({r["doc_id"] for r in pieces.collect()}) == ids(docs)


def test_edges(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, text, "en", "src1", 1), (1, text, "en", "src1", 1), (2, text, None, None, None), (None, text + " more", "en", "src1", 1), (3, None, "en", "src2", 0), (4, "", "en", "src2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    exact = materialize(dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, ""), "edges")
    assert sorted(((r["doc_id"] or -1) for r in exact.collect())) == [-1, 1, 3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0
        assert stage(spark, docs.limit(0), "").count() == 0


def test_columns_that_cannot_be_compared(spark):
    """A map, an array of maps and a name that needs quoting, beside repeated rows."""
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, text, "en", "s", 1, {"a": 1}, [{"b": 2}], ("x",)), (1, text, "en", "s", 1, {"a": 1}, [{"b": 2}], ("x",)), (1, text, "de", "s", 1, {}, [], ("y",)), (2, text, "en", "s", 1, None, None, None), (3, text + " and more", "en", "s", 1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, l array<map<string,int>>, o struct<`odd name, `: string>")
    stages = dict(corpus_pipeline.STAGES)
    got = stages["exact_dedup"](spark, docs, "").collect()
    assert sorted((r["doc_id"], r["lang"], r["m"]) for r in got) == [(1, "de", {}), (3, "en", None)]
    assert stages["quality_rules"](spark, docs, "").columns == docs.columns and stages["quality_rules"](spark, docs, "").count() == 5
