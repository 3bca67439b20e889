"""The pipeline's filters decide each row by its own text."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestone.llm import near_dedup, simhash
from lodestone.llm.batches import utf8
from tests.llm.test_dedup import print_of, reach

KIND = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in rows], KIND)


def kept(spark, stage, rows):
    got = STAGES[stage](spark, table(spark, rows), "").collect()
    return sorted(((r["doc_id"], r["text"]) for r in got), key=repr)


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_stage(spark):
    rng, rows = random.Random(7), []
    for i in range(60):
        base = prose(rng, rng.randrange(100, 400))
        copy = list(base)
        for at in rng.sample(range(5, len(base) - 5), len(base) // 20 if i < 5 else rng.randrange(1, max(2, len(base) // 45))):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy).upper())]
    big = prose(rng, 300)  # a group of copies that each differ in one or two places
    for i in range(60):
        own = list(big)
        for at in rng.sample(range(300), 3):
            own[at] = f"x{i}"
        rows.append((1000 + i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    close = [p for p, s in share.items() if s >= 0.8]
    root = reach(list(sets), close)
    assert kept(spark, "simhash_dedup", rows) == sorted(((i, t) for i, t in rows if root[i] == i), key=repr)
    assert sum(0.8 <= share[2 * i, 2 * i + 1] < 0.95 for i in range(60)) > 20 and any(share[2 * i, 2 * i + 1] < 0.8 for i in range(60))


def test_wide_prints_tell_the_similarity_of_sets():
    rng = random.Random(9)
    far = []
    for _ in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.choice([60, 400]))]
        common = int(len(base) * 0.889)  # similarity 0.8
        other = base[:common] + [rng.getrandbits(64) for _ in range(len(base) - common)]
        x, y = near_dedup.wide_prints([np.unique(np.array(s, np.uint64)) for s in (base, other)])
        far.append(int(simhash.distance(x[None], y[None])[0]))
    assert max(far) <= near_dedup.reach(0.8) == 111 and 70 < np.mean(far) < 90


def test_repetition_and_crowds(spark, monkeypatch):
    rng, rows = random.Random(10), []
    for i in range(40):  # the same shingles, some of them many times over
        base = prose(rng, 60)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:20] * 9 + base))]
    line = prose(rng, 55)
    rows += [(1000 + i, " ".join(line + prose(rng, 30))) for i in range(80)]  # a common passage, similarity under 0.8
    rows += [(2000 + i, " ".join(line + [f"z{i}"])) for i in range(30)]
    sets = {i: shingles(t) for i, t in rows}
    root = reach(list(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    want = sorted(i for i, _ in rows if root[i] == i)
    for crowd, members in ((simhash.CROWD, 4096), (8, 4096), (simhash.CROWD, 12)):  # the last: families in parts
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        monkeypatch.setattr(near_dedup, "PIVOTS", 3)
        got = near_dedup.near_dedup(table(spark, rows), crowd=crowd).where("kept").collect()
        assert sorted(r["doc_id"] for r in got) == want and 100 < len(want) < 190


def test_large_family_in_parts(spark, monkeypatch):
    """Copies changed in few to many places: some belong together, others are alone, and no part holds them all."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 10)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rng = random.Random(12)
    base, rows = prose(rng, 150), []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 5, 7])):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    root = reach(list(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    want = sorted(i for i, _ in rows if root[i] == i)
    got = near_dedup.near_dedup(table(spark, rows)).where("kept").collect()
    assert sorted(r["doc_id"] for r in got) == want and 3 < len(want) < 140


def test_common_shingles():
    rng = np.random.default_rng(4)
    for nx, ny, room in ((1, 1, 5), (30, 50, 40), (60, 70, 5000), (5, 400, 300)):
        x, y = ([np.unique(rng.integers(0, room, rng.integers(1, 200)).astype(np.uint64)) for _ in range(n)] for n in (nx, ny))
        plain = [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
        assert near_dedup.common_shingles(x, y).tolist() == plain
        i, j = near_dedup.similar(x, y, 0.5)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(nx) for b in range(ny) if 2 * plain[a][b] >= len(set(x[a].tolist()) | set(y[b].tolist()))}


@pytest.mark.parametrize("keys", [3_000_000, 0])
def test_repeated_and_null_ids(spark, monkeypatch, keys):
    """Also with more dropped rows than are sent to every task."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", keys)
    monkeypatch.setattr(near_dedup, "BROADCAST_MEMBERS", keys)
    rng = random.Random(8)
    x, y = (" ".join(prose(rng, 60)) + "." for _ in range(2))
    assert kept(spark, "exact_dedup", [(3, y), (5, x), (5, y)]) == [(3, y), (5, x)]
    assert kept(spark, "exact_dedup", [(None, y), (3, y), (None, x), (None, x)]) == [(3, y), (None, x)]
    bad = "# $ % & | " * 40
    assert kept(spark, "quality_rules", [(5, x), (5, bad), (None, bad), (None, y)]) == [(5, x), (None, y)]
    almost = x.replace(x.split()[0], "changed")
    assert kept(spark, "simhash_dedup", [(2, x), (3, almost), (3, y), (None, almost + " end")]) == [(2, x), (3, y)]


@pytest.mark.parametrize("size", [1, 3, 5])
def test_long_words_in_pieces(monkeypatch, size):
    monkeypatch.setattr(simhash, "SLICE_BYTES", 40)
    monkeypatch.setattr(near_dedup, "SLICE_BYTES", 40)
    few = [f"w{i}" for i in range(9)]
    for text in (["a" * 300, *few], [*few, "b" * 300, *few], [*few, "c" * 300], ["d" * 300] * 3, ["e" * 300, "f"], [" " * 200, *few, " " * 200]):
        data, off = utf8(pa.array([" ".join(text)]))
        whole, _ = simhash.shingle_hashes(data, off, size)
        parts = [simhash.shingle_hashes(p, np.array([0, len(p)]), size)[0] for p in simhash.long_pieces(data, size)]
        assert np.concatenate(parts).tolist() == whole.tolist()
        assert size != 3 or simhash.fingerprints(data, off).tolist() == [print_of(" ".join(text))]
