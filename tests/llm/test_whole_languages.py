"""Every language in the table is learnt, from texts of any length."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import language_id
from lodestone.llm.batches import utf8

KIND = "doc_id long, text string, lang string"


def test_more_languages_than_a_table_holds(spark):
    rng = random.Random(1)
    rows, n = [], 70
    for k in range(n):  # each language has its own words
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8)]
        rows += [(100 * k + i, " ".join(rng.choice(words) for _ in range(40)), f"l{k:02d}") for i in range(12 if k else 4)]
    got = language_id.language_id(spark.createDataFrame(rows, KIND)).collect()
    lang = {i: x for i, _, x in rows}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in got) and len({r["lang_pred"] for r in got}) == n


def test_long_texts_are_fitted(spark, monkeypatch):
    rows = [(i, "alpha beta gamma " * 80, "a") for i in range(8)] + [(10 + i, "zwölf boxkämpfer jagen " * 60000, "b") for i in range(4)]
    got = language_id.language_id(spark.createDataFrame(rows, KIND)).collect()
    assert {(r["doc_id"] >= 10, r["lang_pred"]) for r in got} == {(False, "a"), (True, "b")}


def test_tables_do_not_change_probabilities():
    rng = random.Random(2)
    texts = {x: [" ".join("".join(rng.choice(x * 3 + "abcde") for _ in range(5)) for _ in range(40))] for x in "pqrst"}
    counts = {x: np.unique(language_id.top_grams(*language_id._joined(texts[x]), 3), axis=0, return_counts=True) for x in texts}
    one = language_id.fit_models(texts, 3)
    more = [language_id.fit_counts({x: counts[x] for x in part}, language_id.alphabet(counts)) for part in ("pq", "rst")]
    data, off = utf8(pa.array([t for own in texts.values() for t in own] + ["unseen pqr wörter"]))
    assert np.allclose(one.entropy(*language_id.symbols(data, off), 6)[0], language_id._entropies(more, data, off)[0], atol=1e-5)


def plain_letters(t):
    return list(re.sub(" +", " ", "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t + " ")))


def plain_model(texts, order, alphabet, d=0.75):
    """Interpolated Kneser-Ney by dictionaries: a function from (context, letter) to a probability."""
    count = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        s = [" "] * (order - 1) + plain_letters(t)
        for i in range(order - 1, len(s)):
            count[order]["".join(s[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g in count[n + 1]:
            count[n][g[1:]] += 1
    total, kinds = defaultdict(int), defaultdict(int)
    for n in range(2, order + 1):
        for g, c in count[n].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
    first = sum(count[1].values())

    def chance(context, letter):
        if not context:
            return max(count[1][letter] - d, 0) / first + d * len(count[1]) / first / (alphabet + 1)
        if context not in total:
            return chance(context[1:], letter)
        own = count[len(context) + 1][context + letter]
        return max(own - d, 0) / total[context] + d * kinds[context] / total[context] * chance(context[1:], letter)

    return chance


def test_three_languages_by_dictionaries(spark):
    rng, order = random.Random(3), 4
    words = {"a": ["lorem", "ipsum", "Dolor", "sit"], "b": ["zwölf", "Boxer", "jagen", "Viktor"], "c": ["un", "deux", "trois", "été"]}
    rows = [(i, " ".join(rng.choice(words["abc"[i % 3]] + ["le", "in"]) for _ in range(12)) + ".", "abc"[i % 3]) for i in range(90)]
    rows += [(1000, "lorem deux zwölf unseen", None), (1001, "𰀀𰀁", None), (1002, "12 !", None), (1003, None, None)]
    got = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, KIND), order, 10**6, 0).collect()}
    seen = defaultdict(list)
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            seen[lang].append((i, t))
    # a quarter of the rows calibrates: read which were fitted from the operator's own order of hashed rows
    assert all(len(x) > 10 for x in seen.values())
    picked = {(r["lang"], r["text"]) for r in language_id._sample(spark.createDataFrame(rows, KIND), 10**6, 10**6, 42).where("fit").collect()}
    fitted = {lang: [t for _, t in own if (lang, t) in picked] for lang, own in seen.items()}
    alphabet = len({c for own in fitted.values() for t in own for c in plain_letters(t)} | {" "})
    models = {lang: plain_model(own, order, alphabet) for lang, own in fitted.items()}
    for i, t, _ in rows[:30] + rows[-4:-2]:
        s = [" "] * (order - 1) + plain_letters(t)
        nats = {k: -sum(np.log(m("".join(s[j - order + 1 : j]), s[j])) for j in range(order - 1, len(s))) / (len(s) - order + 1) for k, m in models.items()}
        assert abs(got[i]["nats"] - min(nats.values())) < 1e-4
        if sorted(nats.values())[1] - min(nats.values()) > 1e-3:
            assert got[i]["lang_pred"] == min(nats, key=nats.get)
    assert got[1001]["lang_pred"] in "abc" and got[1002]["lang_pred"] == got[1003]["lang_pred"] == "und"


@pytest.mark.parametrize("size", [7, 16])
def test_long_texts_in_slices(monkeypatch, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("aé汉 .𰀀b") for _ in range(rng.randrange(200))) for _ in range(40)] + [" " * 60, "a" * 60, "é " * 40]
    m = language_id.fit_models({"x": texts[:9], "y": texts[9:15]}, 4)
    whole = [language_id._entropies([m], *utf8(pa.array([t]))) for t in texts]
    rows = [language_id.top_grams(*language_id._joined([t]), 4).tolist() for t in texts]
    monkeypatch.setattr(language_id, "SLICE_BYTES", size)
    monkeypatch.setattr(language_id, "TILE", 5)
    for t, (entropy, count, letters), own in zip(texts, whole, rows, strict=True):
        data, off = utf8(pa.array([t]))
        got = language_id._entropies([m], data, off)
        assert np.allclose(got[0], entropy) and got[1].tolist() == count.tolist() and got[2].tolist() == letters.tolist()
        assert sum((language_id.top_grams(s, text, 4, lead).tolist() for s, text, lead in language_id.symbol_slices(data, off, 4)), []) == own


def test_repeated_ids_do_not_grow_the_sample(spark):
    rows = [(7, f"word{i} and more text", "a") for i in range(1500)] + [(7, "the same text", "a")] * 500 + [(i, f"letters {i} xy", "b") for i in range(10, 100)]
    found = language_id._sample(spark.createDataFrame(rows, KIND).repartition(3), 800, 600, 42).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in found} == {"a": 800, "b": sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(10, 100))}
