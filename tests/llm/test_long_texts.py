"""Every operator on texts longer than one slice, through Spark, against what plain Python makes of them."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lodestone.llm import language_id, near_dedup, packing
from lodestone.llm.batches import SLICE_BYTES
from lodestone.llm.catalog import tokenizer_path
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.mixing import Weights, mix_sources, source_group
from lodestone.llm.quality_classifier import quality_classifier
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.sharding import shard
from lodestone.llm.simhash import simhash_dedup
from lodestone.llm.suffix_dedup import cut_repeats
from tests.llm.test_text_operators import counted

KIND = "doc_id long, text string, lang string, source string"


def prose(seed, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 12))) for _ in range(5000)] + ["é", "汉字", "x.", "B!"]
    out, held = [], 0
    while held < size:
        w = rng.choice(words) + rng.choice([" ", " ", " ", ". ", ".\n"])
        out.append(w)
        held += len(w)
    return "".join(out)


LONG = prose(1, 5 << 20)
OTHER = prose(2, 5 << 20)
assert len(LONG) > 2 * SLICE_BYTES
SHORT = prose(3, 3000)


def table(spark, rows):
    return spark.createDataFrame([(*r, "en", "s1")[:4] for r in rows], KIND).cache()


def test_exact(spark):
    rows = [(5, LONG), (2, LONG.replace(" ", "  \t")), (9, LONG[:-2] + "x"), (7, SHORT)]
    got = {r["doc_id"]: r for r in exact_dedup(table(spark, rows)).collect()}
    assert (got[5]["keep_id"], got[5]["kept"], got[2]["kept"], got[9]["keep_id"]) == (2, False, True, 9)
    assert got[5]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", LONG).encode()).hexdigest()


@pytest.mark.parametrize("word", ["", "w" * (5 << 20)])
def test_simhash(spark, word):
    half = len(LONG) // 2
    text = (LONG[:half] + word + " " + LONG[half:]).lower()
    got = simhash_dedup(table(spark, [(1, text), (2, SHORT)])).where("doc_id = 1").first()["fingerprint"]
    words = text.encode().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    assert got == f"{sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(h)):016x}"


def test_near_duplicates(spark):
    words = LONG.split(" ")
    copy = list(words)
    for i in random.Random(4).sample(range(len(words)), len(words) // 200):
        copy[i] = "changed"
    got = near_dedup.near_dedup(table(spark, [(4, LONG), (8, " ".join(copy)), (6, OTHER), (9, SHORT)])).where("kept").collect()
    assert sorted(r["doc_id"] for r in got) == [4, 6, 9]


def test_substrings(spark):
    at = len(LONG) // 2
    text = LONG[:at] + SHORT[100:1100] + LONG[at:]
    windows = {SHORT.encode()[i : i + 50] for i in range(len(SHORT.encode()) - 49)}
    raw = text.encode()
    gone = np.zeros(len(raw), bool)
    for i in range(len(raw) - 49):
        if raw[i : i + 50] in windows:
            gone[i : i + 50] = True
    got = {r["doc_id"]: r for r in cut_repeats(table(spark, [(1, SHORT), (7, text), (9, text[:5000])])).collect()}
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    assert bytes(got[7]["kept"]) == left and 900 < gone.sum() < 1100 and len(got[7]["spans"]) == 1
    assert bytes(got[1]["kept"]) == SHORT.encode() and bytes(got[9]["kept"]) == b""


def test_packing(spark):
    rows = [(1, LONG), (2, SHORT), (3, None)]
    plain = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    assert len(ids[1]) > packing.RUN
    pieces = packing.pack(table(spark, rows), tokenizer_path()).drop("ids").collect()
    ends = dict.fromkeys(ids, 0)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == ends[r["doc_id"]] and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        ends[r["doc_id"]] += r["length"]
    assert ends == {i: len(x) for i, x in ids.items()}


def test_language(spark):
    german = "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. "
    english = "The quick brown fox jumps over the lazy dog near the river bank. "
    rows = [(i, (german if i % 2 else english) * 3, "de" if i % 2 else "en") for i in range(40)] + [(100, german * (5 << 14), None), (101, english * (5 << 14), None), (102, "1 2 3 " * (1 << 20), None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], KIND)
    got = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    assert (got[100]["lang_pred"], got[101]["lang_pred"], got[102]["lang_pred"]) == ("de", "en", "und")
    assert got[100]["nats"] < 2 and got[100]["score"] > 0.5


def test_counts_scores_sizes_and_mixture(spark):
    rows = [(1, LONG), (2, SHORT), (3, None), (4, LONG + SHORT)]
    docs = table(spark, rows)
    rules = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, t in rows:
        assert [rules[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == counted(t)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality_classifier(docs, labels).collect())
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shard(docs).collect()}
    assert sizes == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    mixed = {r["doc_id"]: r["tokens"] for r in mix_sources(docs, source_group(), 0.5, Weights()).collect()}
    assert mixed == {i: len((t or "").split()) for i, t in rows}
