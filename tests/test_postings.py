import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import bm25


def _docs(seed):
    rng = random.Random(seed)
    return {i * 3: [rng.choice(["the", "a", "é", "汉", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([0, 1, 5, 30, 400]))] for i in range(60)}


def _found(rows):
    """{(tok, id): (tf, length)} and the tokens of each block, from rows of postings."""
    got, tokens = {}, Counter()
    for r in rows:
        ids, tfs, lens = (np.frombuffer(r[c], kind) for c, kind in (("ids", "<i8"), ("tfs", "<i4"), ("lens", "<i4")))
        assert len(ids) == len(tfs) == len(lens) == r["n"] and tfs.sum() == r["total"]
        assert not {(r["tok"], i) for i in ids.tolist()} & set(got)
        got |= {(r["tok"], i): (t, n) for i, t, n in zip(ids.tolist(), tfs.tolist(), lens.tolist(), strict=True)}
        tokens[r["block"]] += r["total"]
    return got, tokens


def _want(docs):
    return {(w, i): (n, len(t)) for i, t in docs.items() for w, n in Counter(t).items()}


@pytest.mark.parametrize(("docs_of_block", "most"), [(8192, 500), (8192, 1), (7, 10**6)])
def test_blocks_are_bounded_by_tokens(spark, monkeypatch, docs_of_block, most):
    """A task holds one block, so long documents must not make it large; one document of more tokens is a block."""
    monkeypatch.setattr(bm25, "BLOCK", docs_of_block)
    monkeypatch.setattr(bm25, "BLOCK_TOKENS", most, raising=False)
    docs = _docs(most)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "id long, text string").repartition(2)
    want = {(w, i): x for (w, i), x in _want({i: bm25_tokens(t) for i, t in docs.items()}).items()}
    got, tokens = _found([r.asDict() for r in bm25.invert(table).collect()])
    assert got == want
    assert max(tokens.values()) <= max(most, max(map(len, docs.values()))) and len(tokens) > 4


def bm25_tokens(words):
    import re

    return re.findall(bm25.TOKENS, " ".join(words))


@pytest.mark.parametrize("pairs", [1, 9, 1 << 18])
def test_postings_leave_in_parts(monkeypatch, pairs):
    monkeypatch.setattr(bm25, "ROW_PAIRS", pairs)
    docs = list(_docs(pairs).items())
    batches = [pa.RecordBatch.from_pydict({"id": [i for i, _ in docs[a:b]], "toks": [t for _, t in docs[a:b]]}, pa.schema([("id", pa.int64()), ("toks", pa.list_(pa.string()))])) for a, b in ((0, 20), (20, 20), (20, 60))]
    parts = list(bm25._rows(5, [bm25._pairs(b) for b in (batches[0].slice(3), *batches[1:])]))
    got, tokens = _found([r for p in parts for r in p.to_pylist()])
    assert got == _want(dict(docs[3:])) and set(tokens) == {5}
    assert (len(parts) > 1) == (pairs < 1 << 18)
