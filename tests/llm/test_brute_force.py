"""Operators that SQL cannot express, against plain Python on small tables."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodestone.llm import mixing, quality_classifier, quality_rules
from lodestone.llm.batches import utf8
from lodestone.llm.mixing import Weights, budget_tree, keep_mixed, mix_sources
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string"


def leaves(rng, n):
    rows, i = [], 0
    for _ in range(n):
        leaf = rng.choice(["en", "de", None]), f"s{rng.randrange(12)}"
        rows.append((i, " ".join("w" for _ in range(rng.randrange(30))), *leaf))
        i += rng.randrange(1, 3)
    return rows


def key_of(spark, rows, epoch, seed=42):
    """Place of every row in its leaf's epoch, by the function that the operator's docstring names."""
    df = spark.createDataFrame([(k, i, t, epoch[k]) for k, (i, t, *_) in enumerate(rows)], "k int, doc_id long, text string, epoch long")
    return {r["k"]: r["p"] for r in df.selectExpr("k", f"shiftrightunsigned(xxhash64({seed}, epoch, doc_id, xxhash64(text)), 1) AS p").collect()}


@pytest.mark.parametrize(("budget", "epochs"), [(0.37, 1), (0.9, 2), (1700, 3)])
def test_mixture_takes_the_prefix_of_the_seeded_order(spark, budget, epochs):
    rng = random.Random(epochs)
    rows = leaves(rng, 260)
    hot = (9000, " ".join(["same"] * 7), "en", "s0")
    rows += [hot] * 40  # copies of one row share a place
    weights = Weights(lang={"en": 3.0, "de": 1.0}, source={"s1": 5.0})
    docs = spark.createDataFrame(rows, DOCS).repartition(3, "source").cache()
    domain = mixing.source_group(3)
    got = mix_sources(docs, domain, budget, weights, epochs).toPandas()
    held = defaultdict(list)
    of = lambda r: (f"d{int(r[3][1:]) % 3}", r[2] or "", r[3])
    for k, r in enumerate(rows):
        held[of(r)].append(k)
    size = {k: len(r[1].split()) for k, r in enumerate(rows)}
    tokens = {leaf: sum(size[k] for k in ks) for leaf, ks in held.items()}
    want = int(sum(tokens.values()) * budget) if isinstance(budget, float) else budget
    quota = budget_tree(tokens, want, weights, epochs)
    assert got.groupby(["domain", "lang", "source"]).taken_tokens.sum().to_dict() == quota
    epoch = {k: quota[of(r)] // tokens[of(r)] if tokens[of(r)] else 0 for k, r in enumerate(rows)}
    place = key_of(spark, rows, epoch)
    expect = []
    for leaf, ks in held.items():
        rest = quota[leaf] - epoch[ks[0]] * tokens[leaf]
        for k in sorted(ks, key=lambda k: place[k]):  # copies are alike, so their order does not show
            part = min(size[k], rest)
            rest -= part
            expect.append((rows[k][0], *leaf, size[k], part, epoch[k] * size[k] + part))
    columns = ["doc_id", "domain", "lang", "source", "tokens", "part_tokens", "taken_tokens"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(expect)
    if epochs == 1:
        kept = keep_mixed(docs, domain, budget, weights).groupBy("doc_id").count().toPandas()
        assert dict(kept.itertuples(index=False, name=None)) == got[got.selected].groupby("doc_id").size().to_dict()


def test_any_number_of_leaves(spark, monkeypatch):
    rng = random.Random(7)
    docs = spark.createDataFrame(leaves(rng, 300), DOCS).cache()
    weights = Weights(lang={"en": 2.0, "de": 0.0}, source={"s1": 5.0, "s2": 0.0})
    few = mix_sources(docs, mixing.source_group(3), 0.6, weights).toPandas()
    monkeypatch.setattr(mixing, "MOST_LEAVES", 3)
    many = mix_sources(docs, mixing.source_group(3), 0.6, weights).toPandas()
    assert many.taken_tokens.sum() == few.taken_tokens.sum() == int(few.tokens.sum() * 0.6)
    leaf = ["domain", "lang", "source"]
    assert (few.groupby(leaf).taken_tokens.sum() - many.groupby(leaf).taken_tokens.sum()).abs().max() <= 6
    kept = keep_mixed(docs, mixing.source_group(3), 0.6, weights).toPandas()
    assert sorted(kept.doc_id) == sorted(many[many.selected].doc_id)


def test_mixture_and_clashing_columns(spark):
    rows = [(i, "a b c", "en", "s1", 1, 2, 3, 4, 5, 6) for i in range(20)]
    names = ("_epoch", "_edge", "_leaf_domain", "epoch", "key", "domain")
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {c} int" for c in names))
    kept = keep_mixed(docs, mixing.source_group(), 0.5, Weights())
    assert kept.columns == docs.columns and kept.count() == 10


# ---- rules ----


def test_posterior_by_plain_bayes(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = quality_rules.quality_rules(docs).toPandas()
    patterns = got.votes.map(tuple).value_counts()
    model = quality_rules.fit_votes(np.array([list(p) for p in patterns.index]), patterns.to_numpy(float))
    for r in got.itertuples():
        weight = [share * math.prod(chance[k][v] for k, v in enumerate(r.votes)) for share, chance in zip(model.share, model.chance, strict=True)]
        assert abs(r.posterior - weight[0] / sum(weight)) < 1e-9
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    votes = {}
    for rule in quality_rules.RULES:  # each vote by evaluating the rule's SQL in another engine
        import duckdb

        facts = got[list(quality_rules.COUNTS)]  # noqa: F841
        sql = f"SELECT CASE WHEN {rule.bad} THEN 2 WHEN {rule.good} THEN 1 ELSE 0 END AS v FROM facts"
        votes[rule.name] = duckdb.sql(sql).df().v.tolist()
    assert [list(v) for v in got.votes] == [list(v) for v in zip(*votes.values(), strict=True)]


def test_em_step_by_plain_counts():
    """Shares and chances are one plain update away from the memberships they give, with faults tied to the good class."""
    rng = np.random.default_rng(1)
    good = rng.random(6000) < 0.8
    kind = rng.integers(0, 3, 6000)
    bad = np.array([np.where(good, rng.random(6000) < 0.02, (kind == k) | ((kind == 2) & (rng.random(6000) < 0.7))) for k in range(4)]).T
    votes = np.where(rng.random((6000, 4)) < 0.1, 0, np.where(bad, 2, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.fit_votes(patterns, counts.astype(float), rounds=4000, trust=0.0)
    assert len(m.share) > 2 and abs(m.share[0] - 0.8) < 0.05
    member = []
    for p in patterns:
        w = [share * math.prod(chance[k][v] for k, v in enumerate(p)) for share, chance in zip(m.share, m.chance, strict=True)]
        member.append([x / sum(w) for x in w])
    for c in range(len(m.share)):
        total = sum(n * x[c] for n, x in zip(counts, member, strict=True))
        assert abs(m.share[c] - (total + 0.5) / (counts.sum() + 0.5 * len(m.share))) < 1e-3
        for k in range(4):
            alike = [0, *(d for d in range(len(m.share)) if m.tied[d][k])] if c == 0 or m.tied[c][k] else [c]
            of = lambda v: sum(n * sum(x[d] for d in alike) for n, x, p in zip(counts, member, patterns, strict=True) if p[k] == v) + 0.5  # noqa: B023, E731
            plain = of(2) / (of(1) + of(2))
            if m.tied[c].any() and not m.tied[c][k]:
                plain = quality_rules.SURE
            assert abs(m.chance[c][k][2] - plain) < 2e-3


@pytest.mark.parametrize("seen", [0.9, 0.8])
@pytest.mark.parametrize("n", [2000, 20000])
def test_em_finds_a_rule_that_votes_at_random(n, seen):
    """Three rules that see bad documents and one that votes against 30 % of all: its votes count for nothing."""
    rng = np.random.default_rng(n)
    bad = rng.random(n) < 0.2
    against = np.column_stack([*(rng.random(n) < np.where(bad, seen, 0.02) for _ in range(3)), rng.random(n) < 0.3])
    votes = np.where(rng.random((n, 4)) < 0.1, 0, np.where(against, 2, 1))
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = quality_rules.fit_votes(patterns, counts.astype(float))
    assert abs(m.chance[0, 3, 2] - 0.3) < 0.05 and abs(m.share[0] - 0.8) < 0.04
    weight = np.array([[share * math.prod(chance[k][v] for k, v in enumerate(p)) for share, chance in zip(m.share, m.chance, strict=True)] for p in patterns])
    kept = (weight[:, 0] / weight.sum(axis=1) >= 0.5)[place]
    assert kept[~bad].mean() > 0.95 and kept[bad].mean() < 0.2


def test_verdicts_do_not_hang_on_the_size(spark):
    """Of the documents that some rule votes against and the base lets pass, as many stay at both sizes, within 5 points."""
    share = []
    for sf in ("sf0.01", "sf0.1"):
        got = quality_rules.quality_rules(spark.read.parquet(f"{DATA}/{sf}/documents.parquet")).where("NOT base_failed AND array_contains(votes, 2)").select("kept").toPandas()
        share.append(got.kept.mean())
    assert abs(share[0] - share[1]) < 0.05, share


# ---- quadratic discriminant ----


def plain_features(t):
    """The statistics by name, by loops over one text."""
    raw = (t or "").encode()
    spaces = b" \t\n\x0b\x0c\r"
    words = raw.split()
    chars = sum(b & 0xC0 != 0x80 for b in raw) - sum(b in spaces for b in raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    rate = lambda a, b: a / max(b, 1)
    root = lambda a, b: math.sqrt(min(rate(a, b), 1))
    size = [len(w) for w in words]
    mean = sum(size) / max(n, 1)
    upper, lower = (sum(lo <= b <= hi for b in raw) for lo, hi in ((65, 90), (97, 122)))
    digits, wide = sum(48 <= b < 58 for b in raw), sum(b >= 0xC0 for b in raw)
    windows = defaultdict(int)
    for i in range(n - 7):
        windows[tuple(words[i : i + 8])] += 1
    again = {k for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    ends = tuple(x.encode() for x in ".!?\"':;)。！？…")
    ended = sum(x.rstrip().endswith(ends) for x in lines)
    bare = sum(not any(chr(b).isalnum() and b < 128 or b >= 128 for b in w) for w in words)
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in (raw.count(b) for b in set(raw))) if raw else 0.0
    return [
        math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(max(sum(s * s for s in size) / max(n, 1) - mean**2, 0))), math.log1p(len(set(words))) / max(math.log1p(n), 0.5),
        root(sum(b in b"#*$%&|<>" for b in raw), chars), root(upper, upper + lower), root(digits, chars), root(raw.count(b"!"), n), root(max(chars - upper - lower - digits - wide, 0), chars),
        root(wide, chars), root(len(again), n), root(len(lines) - len(set(lines)), len(lines)), math.log1p(rate(n, len(lines))), root(ended, len(lines)), root(bare, n),
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), root(max((words.count(w) for w in set(words)), default=0), n), root(sum(b in spaces for b in raw), len(raw)),
        root(sum(65 <= w[0] <= 90 for w in words), n), entropy,
    ]


def test_features_by_loops():
    texts = ["", " \n", None, "A!! b 12 é\n\nA!! b 12 é\n汉字。 #x", "word " * 40 + "end.", "x"] + list(pd.read_parquet(f"{DATA}/sf0.001/documents.parquet").text[:40])
    got = quality_classifier.features(*utf8(pa.array(texts)))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-9)


def test_scores_by_plain_algebra(spark):
    """The whole query with its shrinkage: moments by numpy.cov, densities by inverse and determinant."""
    import zlib

    docs = pd.read_parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = pd.read_parquet(f"{DATA}/sf0.01/labels.parquet")
    sp = lambda n: spark.read.parquet(f"{DATA}/sf0.01/{n}.parquet")
    got = quality_classifier.quality_classifier(sp("documents"), sp("labels")).toPandas().sort_values("doc_id")
    x = quality_classifier.features(*utf8(pa.array(docs.sort_values("doc_id").text)))
    joined = pd.DataFrame({"doc_id": sorted(docs.doc_id), "row": range(len(docs))}).merge(labels[labels.quality.isin([0, 1])], on="doc_id")
    train = joined[[zlib.crc32(str(i).encode()) % 4 != 2 for i in joined.doc_id]]
    xt, y = x[train.row], train.quality.to_numpy()
    center, scale = xt.mean(axis=0), xt.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z, zt = (x - center) / scale, (xt - center) / scale
    covs, n = [np.cov(zt[y == k].T, bias=True) for k in (0, 1)], [(y == k).sum() for k in (0, 1)]
    common = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    density = []
    for k in (0, 1):
        weight = n[k] / (n[k] + 0.1 * x.shape[1])
        cov = 0.9 * (weight * covs[k] + (1 - weight) * common) + 0.1 * common
        cov = 0.95 * cov + 0.05 * np.diag(np.maximum(np.diag(common), 1e-3)) + 1e-4 * np.eye(len(cov))
        off = z - zt[y == k].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1])
    lead = np.clip(density[1] - density[0], -500, 500)
    # the score is one logistic map of the difference of densities
    inner = (got.score > 1e-6) & (got.score < 1 - 1e-6) & (np.abs(lead) < 190)
    odds = np.log(got.score / (1 - got.score))
    slope, shift = np.polyfit(lead[inner], odds[inner], 1)
    assert slope > 0 and np.allclose(slope * lead[inner] + shift, odds[inner], atol=1e-4)
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and inner.sum() > 50
