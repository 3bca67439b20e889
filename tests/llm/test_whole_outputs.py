"""Operators give what is left of the data itself, at any number of sources."""

import random

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm import packing, suffix_dedup
from lodestone.llm.catalog import tokenizer_path

KIND = "doc_id long, text string, source string"


def text(rng):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "Y."]) for _ in range(rng.randrange(1, 60)))


def sequences(pieces):
    out = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        own = out.setdefault(r["sequence_id"], [])
        assert len(own) == r["offset"] and len(r["ids"]) == 4 * r["length"]
        own += np.frombuffer(r["ids"], "<u4").tolist()
    return out


def test_pieces_hold_their_ids(spark):
    rng = random.Random(1)
    rows = [(i, text(rng), f"s{i % 3}") for i in range(80)]
    pieces = packing.pack(spark.createDataFrame(rows, KIND), tokenizer_path(), None, 64).collect()
    plain, docs = Tokenizer.from_file(tokenizer_path()), {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        docs.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert docs == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows}
    assert all(len(s) == 64 or not len(s) & (len(s) - 1) for s in sequences(pieces).values())


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    rng = random.Random(2)
    rows = [(i, text(rng), f"s{i * 6 // 600}") for i in range(600)]  # sources one after another
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    for weights in (None, {"s0": 3.0, "s1": 1.0, "s2": 1.0, "s3": 1.0}):
        pieces = packing.pack(docs, tokenizer_path(), weights, 256).collect()
        full = sequences(pieces)
        assert sum(map(len, full.values())) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
        starts = {}
        for r in pieces:
            starts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        for own in starts.values():
            end = 0
            for at, n in sorted(own):
                assert at == end
                end += n
        early = [r for r in pieces if r["sequence_id"] < 20]
        share = {s: sum(r["length"] for r in early if r["source"] == s) / (20 * 256) for s in ("s0", "s1", "s2", "s3", "s4", "s5")}
        if weights:
            assert abs(share["s0"] - 0.5) < 0.06 and all(abs(share[s] - 1 / 6) < 0.06 for s in ("s1", "s2", "s3"))
            assert share["s4"] + share["s5"] < 0.02
        else:
            assert all(abs(x - 1 / 6) < 0.05 for x in share.values())


def test_cut_repeats_gives_text_and_spans(spark):
    rng = random.Random(3)
    chunks = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(60, 150))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(chunks) for _ in range(rng.randrange(4)))) for i in range(40)] + [(90, None), (91, "x" * 200)]
    texts, gone = {i: (t or "").encode() for i, t in rows}, 0
    for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        raw, at, left = texts[r["doc_id"]], 0, b""
        for s in r["spans"]:
            assert at <= s["start"] < s["stop"] <= len(raw)
            left, at = left + raw[at : s["start"]], s["stop"]
            gone += 1
        assert left + raw[at:] == r["kept"] and r["n_bytes"] == len(raw)
    assert gone > 20


def test_bases_in_ranges_or_by_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, text(rng), f"s{i % 2}") for i in range(700)], KIND).repartition(520, "doc_id").cache()
    want = sorted(map(tuple, packing.pack(docs, tokenizer_path(), None, 256).drop("ids").collect()))
    for most in (400, 3):  # three ranges of partitions; no range fits a broadcast
        monkeypatch.setattr(packing, "BASE_ROWS", most)
        assert sorted(map(tuple, packing.pack(docs, tokenizer_path(), None, 256).drop("ids").collect())) == want
