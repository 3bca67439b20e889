"""Quality rules as weak supervision.

Each rule votes good, bad or abstains. A document's votes form one of 3^rules patterns; the patterns are counted over the
whole corpus, and expectation-maximisation over those counts estimates, without labels, each rule's chance of each vote
on good documents and on each of a few kinds of bad ones. How many kinds there are, and whether a rule's lone bad votes
are faults or false alarms, is chosen by likelihood. A document is kept when the posterior probability that it is good
reaches the threshold, instead of when it passes every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.batches import WS, text_slices, tidy, words
from lodestone.llm.xxh import xxh64
from lodestone.plans.runtime import materialize, prepare

#: The characters counted as symbols, and the words of a repeated window.
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_lower", "n_marks", "n_unique", "n_bare")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", mark long"


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _UPPER, _LOWER = _flags(bytes(SYMBOLS)), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_LETTER = _UPPER | _LOWER
_LETTER[128:] = True  # a byte of a longer code point
_NAMED = _LETTER | _flags(b"0123456789")
_ENDS = tuple(x.encode() for x in ".!?\"':;)。！？…")


def _per_text(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    out = np.zeros(len(off) - 1, np.int64)
    some = off[:-1] < off[1:]
    if some.any():
        out[some] = np.add.reduceat(flag, off[:-1][some], dtype=np.int64)
    return out


def repeated_words(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each text, the words inside windows of WINDOW words that occur twice or more in that text. h: a 64-bit hash of
    each word; windows are equal if the hashes of their words are, one by one."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        roll = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            roll *= np.uint64(0x9E3779B97F4A7C15)
            roll += h[k : k + m]
        roll ^= roll >> np.uint64(29)
        roll *= np.uint64(0xBF58476D1CE4E5B9)
        roll += text[:m].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    inside = np.flatnonzero(text[:m] == text[WINDOW - 1 :])
    order = inside[np.argsort(roll[inside], kind="stable")]
    same = roll[order[1:]] == roll[order[:-1]]
    at = np.flatnonzero(same)
    differ = text[order[at]] != text[order[at + 1]]
    for k in range(WINDOW):
        differ |= h[order[at] + k] != h[order[at + 1] + k]
    twice = np.append(same, False) | np.append(False, same)
    if differ.any():  # windows that share a mixed hash by chance: decided word by word
        odd = np.isin(roll, roll[order[at[differ]]])
        twice &= ~odd[order]
        seen: dict[tuple, list[int]] = {}
        for w in inside[odd[inside]].tolist():
            seen.setdefault((int(text[w]), *h[w : w + WINDOW].tolist()), []).append(w)
        extra = [w for own in seen.values() if len(own) > 1 for w in own]
    else:
        extra = []
    cover = np.zeros(len(h) + 1, np.int8)  # windows start once at a word, so at most WINDOW cover one
    for hit in (order[twice], np.array(extra, np.int64)):
        cover[hit] += 1
        cover[hit + WINDOW] -= 1
    covered = np.cumsum(cover[:-1], dtype=np.int8) > 0
    return np.bincount(text[covered], minlength=n)


def count_text(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The COUNTS of many texts, one row each."""
    n = len(off) - 1
    start, end, text = words(data, off)
    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = np.bincount(text, minlength=n)
    out[:, 1] = _per_text((data & 0xC0) != 0x80, off) - _per_text(WS[data], off)
    out[:, 2] = _per_text(_SYMBOL[data], off)
    out[:, 7], out[:, 8] = _per_text(_UPPER[data], off), _per_text(_LOWER[data], off)
    out[:, 9] = _per_text(data == 0x21, off)
    if len(start):
        out[:, 11] = np.bincount(text[~np.logical_or.reduceat(_NAMED[data], start)], minlength=n)  # white space is not named
        h = xxh64(np.concatenate((data, np.zeros(8, np.uint8))), start, end - start)
        del start, end
        out[:, 4] = repeated_words(text, h, n)
        order = np.lexsort((h, text)) if n > 1 else np.argsort(h)
        new = np.append(True, (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]]))
        out[:, 10] = np.bincount(text[order[new]], minlength=n)
        del h, order, new
    raw = data.tobytes()
    for i in range(n):
        lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x and not x.isspace()]
        out[i, 3], out[i, 5] = len(lines) - len(set(lines)), len(lines)
        out[i, 6] = sum(x.rstrip().endswith(_ENDS) for x in lines)
    return out


def _count(batches):
    for rows, data, off in text_slices(batches, "text"):
        got = count_text(data, off)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(got[:, k]) for k in range(len(COUNTS))), rows.column("mark")], names=["doc_id", *COUNTS, "mark"])


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains. Both are SQL over COUNTS."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), 2).when(F.expr(self.good), 1).otherwise(0)


RULES = (
    Rule("symbols", "10 * n_symbols > word_chars", "50 * n_symbols <= word_chars AND n_words > 0"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    Rule("repetition", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= n_words AND n_words >= 16"),
    Rule("word_length", "word_chars > 14 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 11 * n_words AND n_words > 0"),
    Rule("capitals", "n_upper > n_lower AND n_upper >= 20", "4 * n_upper <= n_lower AND n_lower > 0"),
    Rule("endings", "n_lines > 0 AND n_ended = 0", "2 * n_ended >= n_lines AND n_lines > 0"),
    Rule("variety", "n_words >= 20 AND pow(n_unique, 3) < 2 * pow(n_words, 2)", "n_words >= 20 AND pow(n_unique, 3) >= 8 * pow(n_words, 2)"),
    Rule("bare", "10 * n_bare > n_words", "50 * n_bare <= n_words AND n_words > 0"),
    Rule("marks", "10 * n_marks > n_words", "50 * n_marks <= n_words AND n_words > 0"),
)


@dataclass(frozen=True)
class VoteModel:
    """share[c]: of the corpus in class c, 0 good, others bad; chance[c][rule][vote] with vote 0 abstain (always 1), 1 good,
    2 bad. tied[c][rule]: the class's chances are those of good documents."""

    share: np.ndarray
    chance: np.ndarray
    tied: np.ndarray

    def posterior(self, votes: list[Column]) -> Column:
        """The probability of class 0."""
        weight = np.log(self.chance)

        def likelihood(c: int) -> Column:
            total = F.lit(math.log(self.share[c]))
            for k, v in enumerate(votes):
                total = total + F.element_at(F.array(*(F.lit(float(x)) for x in weight[c, k])), v + 1)
            return F.exp(total)

        good, bad = likelihood(0), F.lit(0.0)
        for c in range(1, len(self.share)):
            bad = bad + likelihood(c)
        return good / (good + bad)


#: Classes at most; shared kinds of bad documents tried at each step, by what they would explain.
MOST_CLASSES, SEEDS = 8, 4
#: Good votes on good documents that every rule is credited with (at most a fifth of the documents), which decides between
#: explanations that the votes hardly tell apart; added to no estimate. In the choice of classes a rule can lose CREDIT at
#: most, less than a class costs, so that an unreliable rule is not made a fault of its own.
TRUST, CREDIT = 200.0, 5.0
#: The chance that a rule votes bad on a document that has its fault alone, which the votes cannot tell from its share.
SURE = 0.95


@dataclass
class _Fit:
    chance: np.ndarray  # classes, rules, (good, bad)
    share: np.ndarray
    tied: np.ndarray
    member: np.ndarray
    missed: np.ndarray  # -log likelihood of each pattern
    value: float  # log likelihood with the smoothing's

    def score(self, n: float, trust: float) -> float:
        """Bayesian information criterion, to be maximised, less what the rules' false alarms cost."""
        alarms = np.minimum(-trust * np.log(self.chance[0, :, 0]), CREDIT).sum()
        free = self.tied.shape[1] * int((~self.tied.any(axis=1)).sum())
        return self.value - alarms - 0.5 * (free + len(self.share) - 1) * math.log(max(n, 2))


class _Votes:
    """EM over vote patterns (rows of 0, 1, 2) and their counts. An abstention says nothing of a document."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, smooth: float):
        self.hot = np.stack([patterns == v for v in (1, 2)], axis=2).astype(np.float64)
        self.flat, self.counts, self.smooth, self.rules = self.hot.reshape(len(patterns), 2 * patterns.shape[1]), counts, smooth, patterns.shape[1]

    def chances(self, member: np.ndarray, tied: np.ndarray, trust: float) -> np.ndarray:
        sums = ((member * self.counts[:, None]).T @ self.flat).reshape(-1, self.rules, 2)
        sums[0] += (sums[1:] * tied[1:, :, None]).sum(axis=0)
        sums += self.smooth
        sums[0, :, 0] += trust
        sums /= sums.sum(axis=2, keepdims=True)
        fault = tied.any(axis=1)[:, None] & ~tied
        return np.where(tied[:, :, None], sums[:1], np.where(fault[:, :, None], np.array([1 - SURE, SURE]), sums))

    def members(self, chance: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = self.flat @ np.log(chance).reshape(len(share), -1).T + np.log(share)
        top = score.max(axis=1, keepdims=True, initial=-np.inf)
        part = np.exp(score - top)
        total = part.sum(axis=1, keepdims=True)
        return part / total, np.log(total[:, 0]) + top[:, 0]

    def shares(self, member: np.ndarray) -> np.ndarray:
        held = member.T @ self.counts + self.smooth
        return held / held.sum()

    def run(self, chance: np.ndarray, share: np.ndarray, tied: np.ndarray, rounds: int, trust: float = 0.0) -> _Fit:
        last = -np.inf
        for _ in range(rounds):
            member, each = self.members(chance, share)
            prior = self.smooth * np.log(chance[~tied.any(axis=1)]).sum() + self.smooth * np.log(share).sum() + trust * np.log(chance[0, :, 0]).sum()
            value = float(self.counts @ each + prior)
            if value - last < 1e-9 * abs(value):
                break
            last = value
            chance, share = self.chances(member, tied, trust), self.shares(member)
        member, each = self.members(chance, share)
        return _Fit(chance, share, tied, member, -each, value)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400, smooth: float = 0.5, trust: float = TRUST) -> VoteModel:
    """A good class, and as many bad ones as the likelihood pays for.

    A bad class is either a shared kind, with chances of its own for every rule, begun from documents that two rules or
    more vote against; or one rule's fault, in which that rule votes bad and all others vote as on good documents. At each
    step the one that raises the information criterion most is added, until none does. So rules that agree make a kind
    of bad documents, faults that keep apart make classes, and bad votes that fall on good and bad documents alike are a
    rule's false alarms, however many there are. Then EM goes on with `trust` in the rules, and the chances are estimated
    once more without it.
    """
    n, n_rules = float(counts.sum()), patterns.shape[1]
    trust = min(trust, n / 5)
    votes = _Votes(patterns, counts, smooth)
    every = np.ones((len(patterns), 1))
    free = np.zeros((1, n_rules), bool)
    best = votes.run(votes.chances(every, free, 0.0), np.ones(1), free, rounds)
    against = patterns == 2

    def grown(by: list[tuple[np.ndarray, np.ndarray, float]], start: _Fit, rounds: int) -> _Fit:
        """start with further classes: the chances of bad votes, which of them are tied, and the share."""
        chance, share, tied = start.chance, start.share, start.tied
        for bad, own, part in by:
            chance = np.concatenate((chance, np.stack((1 - bad, bad), axis=1)[None]))
            share, tied = np.append(share * (1 - part), part), np.vstack((tied, own))
        return votes.run(chance, share, tied, rounds)

    while len(best.share) <= MOST_CLASSES and n:
        tries = []
        odd = np.argsort(-(counts * best.missed) * (against.sum(axis=1) >= 2), kind="stable")[:SEEDS]
        for p in odd[against[odd].sum(axis=1) >= 2]:
            tries.append([(np.where(against[p], 0.8, 0.05), free[0], 0.05)])
        faults = []
        for r in range(n_rules):
            others = np.arange(n_rules) != r
            if not (best.tied[1:] == others).all(axis=1).any():
                faults.append((np.where(others, best.chance[0, :, 1], SURE), others, max(0.5 * float(counts @ against[:, r]) / n, 1e-3)))
        tries += [[x] for x in faults] + ([faults] if len(faults) > 1 else [])  # that faults exclude one another shows in two of them
        if len(best.share) == 1:
            many = (against.sum(axis=1) >= 2).astype(float)[:, None]
            tries.append([(votes.chances(many, free, 0.0)[0, :, 1], free[0], min(max(float(counts @ many[:, 0]) / n, 0.01), 0.9))])
        better = max((grown(by, best, rounds // 8) for by in tries), key=lambda f: f.score(n, trust))
        better = grown([], better, rounds)
        if better.score(n, trust) <= best.score(n, trust) + 1e-6:
            break
        best = better
    while len(best.share) > 2:  # without the classes that others have made needless
        kept = [np.arange(len(best.share)) != c for c in range(1, len(best.share))]
        fewer = max((votes.run(best.chance[k], best.share[k] / best.share[k].sum(), best.tied[k], rounds // 8) for k in kept), key=lambda f: f.score(n, trust))
        if fewer.score(n, trust) < best.score(n, trust):
            break
        best = grown([], fewer, rounds)
    best = votes.run(best.chance, best.share, best.tied, rounds, trust)
    chance, share = votes.chances(best.member, best.tied, 0.0), votes.shares(best.member)
    order = np.append(0, 1 + np.argsort(-share[1:], kind="stable"))
    return VoteModel(share[order], np.concatenate((np.ones((len(share), n_rules, 1)), chance[order]), axis=2), best.tied[order])


def _carry(batches, text: str):
    """Whole rows, with the COUNTS of their texts beside them."""
    for rows, data, off in text_slices(batches, text):
        got = count_text(data, off)
        yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(got[:, k]) for k in range(len(COUNTS)))], names=[*rows.schema.names, *COUNTS])


def _verdict(facts: DataFrame, rules: tuple[Rule, ...], threshold: float) -> DataFrame:
    """facts (COUNTS and any others) with votes, base_failed, posterior and kept."""
    voted = facts.withColumn("votes", F.array(*(r.vote() for r in rules)))
    found = voted.groupBy("votes").count().collect()  # at most 3^len(rules) rows
    model = fit_votes(np.array([r["votes"] for r in found], np.int64).reshape(-1, len(rules)), np.array([r["count"] for r in found], np.float64))
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    posterior = model.posterior([F.col("votes")[k] for k in range(len(rules))])
    return voted.withColumn("base_failed", base).withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns.

    Counts are written beside the rows, which are then filtered where they stand: no row moves. Columns may have any names.
    """
    prepare(docs.sparkSession)
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))
    kinds = StructType([*plain.schema.fields, *(StructField(c, LongType()) for c in COUNTS)])
    facts = materialize(plain.mapInArrow(tidy(lambda batches: _carry(batches, text)), kinds), "rule-rows")
    return _verdict(facts, rules, threshold).where("kept").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, mark (xxhash64 of the text), base_failed, posterior, kept and votes for every row of docs (doc_id long,
    text string).

    Other columns are not read. Words are `[^\\x20\\x09-\\x0D]+`; a null text has none. base_failed: under 20 words, or
    over 30 % of the words in windows of 8 words that the text holds twice or more. kept is false where base_failed,
    else whether the posterior reaches the threshold. An empty text fails the base. Rows that repeat a doc_id, or have
    none, each give a row. No rows give no rows. A text is counted whole: memory grows to some ten times the longest one.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    facts = materialize(rows.mapInArrow(tidy(_count), SCHEMA), "rule-counts")
    return _verdict(facts, rules, threshold)
