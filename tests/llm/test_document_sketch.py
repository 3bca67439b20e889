"""Threshold-scaled sketches against plain Python."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import document_sketch as sketch
from lodestone.llm.document_sketch import RANGE, contained, containment, merge_sketches, neighbour_fingerprints, sketch_documents
from tests.conftest import DATA

KIND = "doc_id long, text string"


def plain(text, scale=sketch.SCALE, floor=sketch.FLOOR):
    w = (text or "").encode().lower().split()
    shingles = {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    h = sorted({xxhash.xxh64_intdigest(s, 42) >> 1 for s in shingles})
    low = [x for x in h if x < RANGE // scale]
    return low if len(low) >= floor else h[:floor]


def part(x, y, scale=sketch.SCALE, floor=sketch.FLOOR):
    if not x or not y:
        return float(len(x) == len(y))
    top = min(RANGE if len(s) < floor else RANGE // scale if s[floor - 1] < RANGE // scale else s[-1] + 1 for s in (x, y))
    own = [h for h in x if h < top]
    return sum(h in set(y) for h in own) / len(own) if own else 0.0


def expected(rows):
    """rows in order"""
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        own, other, following = plain(t), plain(changed), plain(after)
        digits = lambda s: "".join(f"{h:016x}" for h in s)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), digits(own), digits(other), part(own, other), part(own, following)))
    return out


def check(df, rows):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_neighbours(spark, ranges):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    rows = [*rows[:300], (10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n"), (10**9 + 3, "é"), (10**9 + 4, "汉字🙂 " * 40), (10**9 + 5, "汉字🙂 " * 40)]
    mixed = rows[:]
    random.Random(ranges).shuffle(mixed)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in mixed], f"{KIND}, bucket int, h string").repartition(5)
    check(neighbour_fingerprints(docs, ranges=ranges), rows)


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sketch, "SLICE_BYTES", 1 << 12)
    monkeypatch.setattr("lodestone.llm.simhash.SLICE_BYTES", 1 << 12)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Aé", "b", "cc", "dddd", "e\n"]) + str(rng.randrange(50)) for _ in range(n))) for i, n in enumerate([5, 9000, 3, 12000, 1, 0, 800])]
    data = "".join(t for _, t in rows).encode()
    off = np.append(0, np.cumsum([len(t.encode()) for _, t in rows]))
    assert [x.tolist() for x in sketch.sketches(np.frombuffer(data, np.uint8), off)] == [plain(t) for _, t in rows]


def test_hot_and_missing_ids(spark):
    """A third of the rows without an id, a third with one id: ranges are cut inside, and every row has a next one."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(30))
    rows = [(None, text()) for _ in range(60)] + [(5, text()) for _ in range(60)] + [(i, text()) for i in range(10, 70)] + [(80, "same")] * 40
    docs = spark.createDataFrame(rows, KIND)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    check(neighbour_fingerprints(docs, ranges=9), [(r["doc_id"], r["text"]) for r in order])
    cuts = sketch._cuts(docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place")), 9)
    assert cuts.count(5) > 1 and cuts.count(-(1 << 63)) > 1


def test_edges(spark):
    assert neighbour_fingerprints(spark.createDataFrame([], KIND)).count() == 0
    check(neighbour_fingerprints(spark.createDataFrame([(1, "one two")], KIND)), [(1, "one two")])
    check(neighbour_fingerprints(spark.createDataFrame([(2, None), (1, None)], KIND)), [(1, None), (2, None)])


def test_containment_of_unequal_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60000)]
    texts = [" ".join(words), " ".join(words[20000:23000]), " ".join(words[:1500] + [f"v{i}" for i in range(1500)]), "few words here", None, ""]
    made = sketch_documents(spark.createDataFrame(list(enumerate(texts)), KIND)).cache()
    got = {r["doc_id"]: r["sketch"] for r in made.collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    pairs = made.alias("a").join(made.alias("b"), F.col("b.doc_id") >= 0).select("a.doc_id", F.col("b.doc_id").alias("other"), containment(F.col("a.sketch"), F.col("b.sketch")).alias("c"))
    found = {(r[0], r[1]): r[2] for r in pairs.collect()}
    assert all(abs(c - contained(np.array(got[i], np.uint64), np.array(got[j], np.uint64))) < 1e-12 and abs(c - part(got[i], got[j])) < 1e-12 for (i, j), c in found.items())
    assert found[1, 0] == 1.0 and abs(found[2, 0] - 0.5) < 0.08 and abs(found[0, 1] - 0.05) < 0.02 and found[4, 5] == 1.0 and found[3, 4] == 0.0


def test_sketch_of_a_union(spark):
    rng = random.Random(5)
    rows = [(i % 3, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 9 if i % 3 == 1 else 200)))) for i in range(30)] + [(None, "no key at all here"), (4, None)]
    made = sketch_documents(spark.createDataFrame(rows, KIND))
    got = {}
    for r in merge_sketches(made, "doc_id").collect():
        got.setdefault(r["doc_id"], []).append(r["hash"])
    for key in (0, 1, 2, None):
        every = sorted({h for i, t in rows if i == key for h in plain(t, scale=1, floor=0)})
        low = [h for h in every if h < RANGE // sketch.SCALE]
        assert sorted(got[key]) == (low if len(low) >= sketch.FLOOR else every[: sketch.FLOOR])
    assert 4 not in got
