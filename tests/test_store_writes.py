from lodestone.operators.embed import HashingEmbedder
from lodestone.operators.store import ChunkStore


def test_only_replaced_chunks_are_put_in_order(spark, tmp_path, monkeypatch):
    """New chunks are numbered as they are sorted, so their texts are not dealt out again by id."""
    rows = lambda numbers, source: spark.createDataFrame([(f"text {i}", source, i, f"h{i}") for i in numbers], "text string, source string, chunk_index int, content_hash string")
    store = ChunkStore(spark, f"file://{tmp_path}", HashingEmbedder(4))
    kind, moved = type(rows([0], "a")), []
    whole = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *by: moved.append(df.count()) or whole(df, *by))
    assert store.add(rows(range(40), "a")) == 40 and moved == []
    assert store.add(rows(range(35, 60), "b")) == 25 and moved == [5]
    got = [(r["id"], r["content_hash"], r["source"]) for r in store.read().orderBy("id").collect()]
    assert [h for _, h, _ in got] == [f"h{i}" for i in range(60)] and [s for *_, s in got] == ["a"] * 35 + ["b"] * 25
    assert len({i for i, *_ in got}) == 60
