"""Quality by regularised quadratic discriminant analysis.

Each document is a vector of transformed statistics of its text. For each label the mean and covariance are fitted;
covariances shrink towards the pooled one and towards its diagonal. Cholesky factors of the two are computed once and
cached with their inverses, so the triangular solve of every row is one matrix product; a score is the difference of the
Gaussian log densities from the Mahalanobis distances, mapped to a probability by a logistic fit on the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import WS, text_slices, tidy, words
from lodestone.llm.quality_rules import count_text
from lodestone.llm.xxh import xxh64
from lodestone.plans.runtime import materialize, prepare

#: Pull towards the pooled covariance, and towards its diagonal.
POOLED, DIAGONAL = 0.1, 0.05
#: Bins of the training scores from which the logistic map is fitted.
BINS = 400

FEATURES = (
    "log_words", "word_length", "word_spread", "variety", "symbols", "upper", "digits", "marks", "other_ascii", "wide", "repeated", "dup_lines",
    "line_words", "ended", "bare", "pair_repeat", "top_word", "blank", "capital_words", "byte_entropy",
)


def _rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text. Shares go through a square root and lengths through a logarithm, which brings both
    nearer to a Gaussian; all are finite for empty texts."""
    n = len(off) - 1
    c = count_text(data, off).astype(np.float64)
    n_words, chars, symbols, dup, rep, lines, ended, upper, lower, marks, unique, bare = c.T
    hist = np.zeros((n, 256))
    size = np.diff(off)
    for lo in range(0, len(data), 1 << 20):
        hi = min(lo + (1 << 20), len(data))
        own = np.diff(np.clip(off, lo, hi))  # bytes of each text in this part
        hist += np.bincount(np.repeat(np.arange(n) * 256, own) + data[lo:hi], minlength=n * 256).reshape(n, 256)
    start, end, text = words(data, off)
    length = (end - start).astype(np.float64)
    square = np.bincount(text, weights=length**2, minlength=n)
    mean = np.bincount(text, weights=length, minlength=n) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(n_words, 1) - mean**2, 0))
    capital = np.bincount(text[(data[start] >= 65) & (data[start] <= 90)], minlength=n) if len(start) else np.zeros(n)
    # neighbouring equal words, and words that appear most
    code = xxh64(np.concatenate((data, np.zeros(8, np.uint8))), start, end - start)
    twice = np.bincount(text[1:][(code[1:] == code[:-1]) & (text[1:] == text[:-1])], minlength=n) if len(start) else np.zeros(n)
    top = np.zeros(n)
    if len(start):
        order = np.lexsort((code, text)) if n > 1 else np.argsort(code)
        t, k = text[order], code[order]
        at = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
        np.maximum.at(top, t[at], np.diff(np.append(at, len(t))))
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    blank = hist[:, WS].sum(axis=1)
    letters = upper + lower
    digits = hist[:, 48:58].sum(axis=1)
    wide = hist[:, 0xC0:].sum(axis=1)
    other = np.maximum(chars - letters - digits - wide, 0)
    root = lambda a, b: np.sqrt(np.minimum(_rate(a, b), 1))
    return np.column_stack(
        (
            np.log1p(n_words), np.log1p(mean), np.log1p(spread), np.log1p(unique) / np.maximum(np.log1p(n_words), 0.5), root(symbols, chars), root(upper, letters), root(digits, chars),
            root(marks, n_words), root(other, chars), root(wide, chars), root(rep, n_words), root(dup, lines), np.log1p(_rate(n_words, lines)), root(ended, lines), root(bare, n_words),
            root(twice, n_words), root(top, n_words), root(blank, size), root(capital, n_words), entropy,
        )
    )


def _measure(batches):
    for rows, data, off in text_slices(batches, "text"):
        x = features(data, off)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), flat], names=["doc_id", "x"])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _moments(batches):
    """Count, sums and products of the rows of each label, as (label, position, value)."""
    d = len(FEATURES)
    total = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        x, y = _matrix(batch.column("x")), batch.column("label").to_numpy()
        one = np.column_stack((np.ones(len(x)), x))
        for k in (0, 1):
            own = one[y == k]
            total[k] += own.T @ own
    for k in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.full((d + 1) ** 2, k, np.int32)), pa.array(np.arange((d + 1) ** 2, dtype=np.int32)), pa.array(total[k].reshape(-1))], names=["label", "place", "value"])


@dataclass(frozen=True)
class Discriminant:
    """Log density difference x -> log p(x | 1) - log p(x | 0); `slope` and `shift` make it a log odds."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverses of the lower Cholesky factors
    log_dets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        part = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * s for m, f, s in zip(self.means, self.factors, self.log_dets, strict=True)]
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -500, 500) + self.shift, -40, 40)))


def fit_discriminant(moments: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """From the products of rows (1, x) with themselves, summed for labels 0 and 1.

    The pooled covariance has the part `pooled` in each class's, and as much more as pooled * d rows would add to the
    class's n, for d features; so a class's own fades out as it has fewer rows than features. `diagonal` pulls on both.
    """
    d = moments.shape[1] - 1
    n = moments[:, 0, 0]
    all_ = moments.sum(axis=0)
    count = max(all_[0, 0], 1.0)
    center = all_[0, 1:] / count
    scale = np.sqrt(np.maximum(np.diag(all_)[1:] / count - center**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        if n[k]:
            m = moments[k, 0, 1:] / n[k]
            means[k] = (m - center) / scale
            covs[k] = (moments[k, 1:, 1:] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
    common = (n[0] * covs[0] + n[1] * covs[1]) / count
    factors, dets = [], []
    for k in (0, 1):
        own = (1 - pooled) * n[k] / (n[k] + pooled * d) if n[k] else 0.0
        cov = own * covs[k] + (1 - own) * common
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.maximum(np.diag(common), 1e-3)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(center, scale, means, np.array(factors), np.array(dets))


def fit_logistic(at: np.ndarray, ones: np.ndarray, zeros: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, shift) of P(1) = 1 / (1 + exp(-(slope * at + shift))) for counts at scores; slope is at least 0."""
    unit = max(1.0, np.abs(at).max(initial=0))
    x = np.column_stack((at / unit, np.ones(len(at))))
    w, total, target = np.zeros(2), ones + zeros, (ones + 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (total * p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (target - total * p) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0] / unit), 0.0), float(w[1])


def held_out(parts: int = 4, part: int = 2):
    """Whether crc32 of the doc_id as text leaves that remainder; a null doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, pooled: float = POOLED, diagonal: float = DIAGONAL) -> DataFrame:
    """Score every row of docs (doc_id long, text string): doc_id, held_out, score, predicted.

    labels: doc_id long, quality 0 or 1; only rows that are not held out and have a doc in docs are learnt from, all of
    them (their moments are sums, so no sample is needed). Only the text enters a score.

    - A null or empty text has the features of a text without words and is scored like any other.
    - Labels that are null or not 0 or 1 are ignored. A doc_id that labels repeats counts once for each label row.
    - With no labels of one kind every score is the share of label 1, or 0.5 without labels.
    - No rows give no rows. A text is measured whole: memory grows to some ten times the longest one.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = materialize(rows.mapInArrow(tidy(_measure), "doc_id long, x array<double>"), "quality-features")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    train = materialize(facts.join(marked, "doc_id").select("x", "label"), "quality-train")  # read twice
    sums = train.mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    d = len(FEATURES) + 1
    moments = np.zeros((2, d * d))
    for r in sums:  # 2 * (features + 1)^2 rows
        moments[r["label"], r["place"]] = r["value"]
    moments = moments.reshape(2, d, d)
    n = moments[:, 0, 0]
    model = fit_discriminant(moments, pooled, diagonal)
    if not n.all():
        constant = float(n[1] / n.sum()) if n.sum() else 0.5
        scored = facts.select("doc_id", F.lit(constant).alias("score"))
    else:
        def differences(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(model.difference(_matrix(batch.column("x"))), -200, 200)), batch.column("label")], names=["at", "label"])

        bins = train.select("x", "label").mapInArrow(differences, "at double, label int").groupBy((F.floor((F.col("at") + 200) * BINS / 400)).alias("bin"))
        seen = bins.agg(F.avg("at").alias("at"), F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")).orderBy("bin").collect()  # at most BINS + 1 rows
        slope, shift = fit_logistic(*(np.array([r[c] for r in seen], np.float64) for c in ("at", "ones", "zeros")))
        final = Discriminant(model.center, model.scale, model.means, model.factors, model.log_dets, slope, shift)

        def scores(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(final.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

        scored = facts.mapInArrow(scores, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
