import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from lodestone.llm import exact_dedup as exact
from lodestone.llm import simhash, suffix_dedup
from lodestone.llm.batches import utf8
from lodestone.llm.catalog import ORACLES, QUERIES
from lodestone.llm.exact_dedup import Polynomial, exact_dedup
from lodestone.llm.graph import components
from lodestone.llm.xxh import xxh64
from tests.conftest import DATA
from tests.oracle import differences

KIND = "doc_id long, text string"


def documents(sf):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def extra(spark, rows):
    """With columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 0) for i, t in rows], f"{KIND}, uid int, fp string, keep_id string, batch_id int")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert not differences(spark, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001")


# ---- exact ----


def test_fingerprints_compose():
    poly, rng = Polynomial(), random.Random(1)
    for size in (0, 1, 511, 512, 513, 5000):
        raw = bytes(rng.randrange(256) for _ in range(size))
        data = np.frombuffer(raw, np.uint8)
        whole = [int(x) for x in poly.many(data, np.array([0, size]))[0]]
        assert whole == [int.from_bytes(raw, "big") and sum(b * pow(base, size - 1 - i, m) for i, b in enumerate(raw)) % m for m, base in zip(poly.moduli, poly.bases, strict=True)]
        for cut in {0, size // 3, size}:
            left, right = (([int(x) for x in poly.many(p, np.array([0, len(p)]))[0]], len(p)) for p in (data[:cut], data[cut:]))
            assert poly.combine(left, right) == (whole, size)


CASES = [(5, "a b"), (2, "a \t\n b"), (9, "a b "), (1, None), (0, ""), (7, " "), (8, "\x0b"), (3, "x" * 9000), (4, "x" * 9000), (6, "x" * 8999 + "y"), (2, "a b"), (None, "a b"), (None, "only"), (None, "only"), (11, "a\xa0b"), (12, "é")]


@pytest.mark.parametrize(("moduli", "broadcast"), [((2147483647, 2147483629), 200_000), ((3, 2), 200_000), ((2147483647, 2147483629), 0), ((3, 2), 0)])
def test_exact_edges(spark, monkeypatch, moduli, broadcast):
    """Also with fingerprints that collide, and with more groups than are sent to every task."""
    monkeypatch.setattr(exact, "BROADCAST_GROUPS", broadcast)
    got = exact_dedup(extra(spark, CASES), moduli).collect()
    groups = {}
    for i, t in CASES:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(CASES)
    kept = {}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert r["keep_id"] == (min(named) if named else None) and r["group_size"] == len(ids)
        kept.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(k) == 1 for k in kept.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert exact_dedup(none).count() == simhash.simhash_dedup(none).count() == suffix_dedup.suffix_dedup(none).count() == 0


# ---- simhash ----


def print_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        votes = [v + (h >> b & 1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if 2 * v > len(shingles))


def reach(ids, close):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in close:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_xxh64():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2000) for _ in range(500)])
    size = np.array([rng.choice([0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 64, 100, 900]) for _ in range(500)])
    got = xxh64(np.frombuffer(raw + bytes(8), np.uint8), start, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(start, size, strict=True)]


def test_fingerprints(monkeypatch):
    texts = [t for _, t in documents("sf0.001")][:60] + [None, "", " ", "a", "A b", "a  B\tc"]
    data, off = utf8(pa.array(texts))
    assert simhash.fingerprints(data, off).tolist() == [print_of(t) for t in texts]
    monkeypatch.setattr(simhash, "SLICE_BYTES", 40)
    for t in texts[:5]:  # in pieces
        assert simhash.fingerprints(*utf8(pa.array([t]))).tolist() == [print_of(t)]


@pytest.mark.parametrize(("n", "groups", "radius"), [(400, 3, 3), (1500, 20, 3), (300, 1, 1), (300, 2, 2), (200, 1, 5), (1, 1, 3), (0, 1, 3)])
def test_forest(n, groups, radius):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 4))]
    fp = np.array([rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(n)], np.uint64)
    group = np.sort(np.array([rng.randrange(groups) for _ in range(n)], np.int64))
    close = [(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and bin(int(fp[i]) ^ int(fp[j])).count("1") <= radius]
    want = list(reach(range(n), close).values())
    assert simhash.forest(fp[:, None], group, radius).tolist() == want
    wide = np.column_stack((fp, fp, fp))  # three times the distance
    assert simhash.forest(wide, group, 3 * radius + 2).tolist() == want
    found = list(zip(*(x.tolist() for x in simhash.links(wide, group, 3 * radius)), strict=True))
    assert len(found) < max(n, 1) and set(found) <= {(j, i) for i, j in close} and list(reach(range(n), found).values()) == want


@pytest.mark.parametrize("crowd", [simhash.CROWD, 6])
def test_simhash(spark, crowd):
    rng = random.Random(2)
    rows = documents("sf0.001")
    for i in range(120):  # chains of near copies
        words = rows[rng.randrange(len(rows))][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, "Words"), (5003, "words"), (0, "words")]
    prints = {}
    for i, t in rows:
        prints.setdefault(print_of(t), []).append(i)
    nodes = {f: min(ids) for f, ids in prints.items()}
    close = [(nodes[a], nodes[b]) for a in nodes for b in nodes if a < b and bin(a ^ b).count("1") <= 3]
    root = reach(list(nodes.values()), close)
    want = sorted((i, f"{f:016x}", root[nodes[f]]) for f, ids in prints.items() for i in ids)
    got = simhash.simhash_dedup(extra(spark, rows), crowd=crowd)
    assert sorted(map(tuple, got.collect())) == want
    assert len(close) > 20


def test_simhash_without_ids(spark):
    got = simhash.simhash_dedup(spark.createDataFrame([(None, "a b c d"), (None, "x"), (3, "x")], KIND)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3)]


def test_rows_without_ids_link_others(spark):
    """A fingerprint that only rows without doc_id have is linked, and is a bridge between others."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    chain = [words]
    while len(chain) < 60:
        more = chain[-1][:]
        more[rng.randrange(400)] = f"v{len(chain)}"
        chain.append(more)
    texts = {print_of(" ".join(c)): " ".join(c) for c in chain}
    near = lambda a, b: bin(a ^ b).count("1") <= 3
    a, b, c = next((a, b, c) for a in texts for b in texts for c in texts if near(a, b) and near(b, c) and not near(a, c))
    got = simhash.simhash_dedup(spark.createDataFrame([(2, texts[c]), (None, texts[b]), (1, texts[a])], KIND)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 1), (1, 1), (2, 1)]
    got = simhash.simhash_dedup(spark.createDataFrame([(None, texts[b]), (7, texts[a])], KIND)).collect()
    assert {r["component_id"] for r in got} == {7}


def test_tables_cover_every_pair():
    for nodes, radius in ((10, 3), (10**9, 3), (3 * 10**10, 3), (10**6, 2)):
        tables = simhash._tables(nodes, radius)
        rng = random.Random(nodes)
        for _ in range(300):
            flipped = rng.sample(range(64), radius)
            assert any(not any(a <= b < c for b in flipped for a, c in ranges) for ranges, _ in tables)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [e for e in edges if None not in e]
    root = reach({x for e in real for x in e}, real)
    assert dict(map(tuple, components(df).collect())) == {k: v for k, v in root.items() if k != v}


# ---- suffixes ----


def test_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(120):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(256)), b"\0\1\2"])
        parts = [bytes(rng.choice(letters) for _ in range(rng.randrange(50, 77))) for _ in range(rng.randrange(1, 10))]
        parts += [p[rng.randrange(5) :] for p in parts if len(p) > 56]
        text, cut = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))
        raw = text.tobytes()
        windows = [raw[i : i + 50] for i in suffix_dedup.sorted_suffixes(text, cut)]
        every = [raw[i : i + 50] for a, b in zip(cut[:-1], cut[1:], strict=True) for i in range(a, b - 49)]
        assert windows == sorted(every)


def test_common_prefixes():
    rng = random.Random(6)
    for window in (32, 50, 64):
        raw = bytes(rng.choice(b"ab") for _ in range(400)) * 2
        order = np.array(sorted(range(len(raw) - window), key=lambda i: raw[i : i + window]))
        plain = [0] + [next((k for k in range(window) if raw[a + k] != raw[b + k]), window) for a, b in zip(order, order[1:], strict=False)]
        assert suffix_dedup.common_prefixes(np.frombuffer(raw, np.uint8), order, window).tolist() == plain


def cut_down(rows, window=50):
    first = {}
    top = 2**63 - 1
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            first[raw[k : k + window]] = min(first.get(raw[k : k + window], top), top if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1):
            if first[raw[k : k + window]] < (top if i is None else i):
                gone[k : k + window] = True
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [2 << 20, 2500])
def test_suffix_dedup(spark, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rng = random.Random(6)
    chunks = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    rows = [(rng.choice([rng.randrange(100), None]) if rng.random() < 0.1 else i, "".join(rng.choice(chunks)[rng.randrange(10) :] for _ in range(rng.randrange(6)))) for i in range(100)]
    rows += [(900, None), (901, ""), (902, "x" * 49), (903, "x" * 300), (904, "x" * 50), (905, "ab" * 100), (906, "ab" * 60), (907, "x" * 300)]
    rng.shuffle(rows)
    got = suffix_dedup.suffix_dedup(extra(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == cut_down(rows)


def test_suffix_dedup_table(spark):
    got = QUERIES["op4_suffix_dedup"](spark, f"{DATA}/sf0.001")
    assert sorted(map(tuple, got.collect()), key=repr) == cut_down(documents("sf0.001"))


@pytest.mark.parametrize(("crowd", "window"), [(20_000, 50), (5, 50), (5, 37)])
def test_one_phrase_in_many_surroundings(spark, monkeypatch, crowd, window):
    """A common phrase alone is no repeat; with enough of its surroundings it is. Crowded leaders go window by window."""
    monkeypatch.setattr(suffix_dedup, "BATCH", 3000)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(8)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, longer = "a phrase of thirty bytes, as is", "a passage of some seventy bytes that stands in ever new surroundings, too"
    rows = [(i, words(rng.randrange(60)) + phrase + words(rng.randrange(60))) for i in range(300)]
    rows += [(300 + i, words(30) + longer + words(30)) for i in range(120)] + [(500, rows[7][1]), (501, rows[9][1] + "x")]
    split = []
    plain = suffix_dedup._answer_segments

    def watched(window):
        split.append(window)
        return plain(window)

    monkeypatch.setattr(suffix_dedup, "_answer_segments", watched)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df, window).collect()), key=repr) == cut_down(rows, window)
    assert split == [window]


def test_crowded_leaders_are_found():
    rng = random.Random(9)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = "a passage of some seventy bytes that stands in ever new surroundings, too"
    rows = []
    for b in range(8):
        texts = [(words(30) + phrase + words(30)).encode() for _ in range(6)] + [b"the same text in all of the batches, and hence one segment for each leader"]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        ids = np.arange(len(texts)) + 10 * b
        first, count, place, _, h, low, high = suffix_dedup._leaders(data, off, ids, 50)
        kinds, sign = suffix_dedup._variety(data, first, count, place, len(h), 50)
        rows.append(suffix_dedup._row(b, 0, 0, suffix_dedup._squeeze(h, low, high - low, kinds, sign)))
    full = {}
    for crowd in (3, 20, 1000):
        flags = []
        for out in suffix_dedup._answer_leaders(crowd)(iter(rows)):
            r = out.to_pylist()[0]
            n = len(suffix_dedup._expand(rows[r["batch_id"]].column("blob")[0].as_py(), "<u8", "<i8", "<i8", "u1", "u1")[0])
            bits = np.unpackbits(np.frombuffer(suffix_dedup.zstandard.decompress(r["blob"]), np.uint8), count=2 * n)
            flags.append((int(bits[:n].sum()), int(bits[n:].sum())))
        full[crowd] = [f for _, f in flags]
        assert all(many > 0 for many, _ in flags)
    assert all(0 < x < 8 for x in full[20]) and not any(full[1000])  # leaders of the passage's ends; copies are no crowd


def test_rows_grow_in_proportion(spark):
    """(batches x buckets) for each byte of input, from 10 GB to 1 TB, and the sizes' limits."""
    def rows(total):
        return total / (suffix_dedup.BATCH * suffix_dedup.growth(total, suffix_dedup.GROWTH[0])) * total / (suffix_dedup.LEADERS * suffix_dedup.growth(total, suffix_dedup.GROWTH[1]))

    assert suffix_dedup.growth(30 << 30, 32) == 1 and suffix_dedup.growth(1 << 50, 32) == 32
    assert abs(rows(1 << 40) / (1 << 40) / (rows(128 << 30) / (128 << 30)) - 1) < 0.01
    assert 0 < suffix_dedup.expected_bytes(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")) < 1 << 30
    assert suffix_dedup.expected_bytes(spark.createDataFrame([(1, "a")], KIND)) < 1 << 30


def test_buckets_have_partitions_of_their_own(spark):
    for n in (1, 7, 60):
        labels = suffix_dedup.even_labels(spark, n)
        df = spark.createDataFrame([(int(x),) for x in labels], "part long").repartition(n, "part")
        assert df.select(suffix_dedup.F.spark_partition_id().alias("p")).distinct().count() == n == len(set(labels.tolist()))
    assert suffix_dedup.even_labels(spark, 10**6) is None
