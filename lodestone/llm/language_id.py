"""Language identification by interpolated Kneser-Ney character models.

A text is read as letters in lower case, with one boundary mark for every run of other characters. For each language an
order-N model is fitted: the top order has discounted counts of N-grams, lower orders discounted continuation counts,
each interpolated with the order below. The probability of every known N-gram in every language is worked out once; the
hashes of the N-grams of all languages form one sorted array for each order, found by binary search, with a row of log
probabilities (one for each language) beside each hash. A text gets the language with the lowest cross-entropy for each
character. A logistic fit on rows kept from training turns the lead over the second into a score, below which the
prediction counts as rejected.

N-grams of the sampled rows are counted where the rows are; the driver gets the distinct ones of each language with their
counts. Texts are read and scored in slices, so memory does not grow with a text's length.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import SLICE_BYTES, text_slices, tidy, utf8
from lodestone.llm.quality_classifier import fit_logistic
from lodestone.plans.runtime import materialize, prepare

ORDER = 4
DISCOUNT = 0.75
#: Rows of each language fitted on, and kept to calibrate; those whose hashed doc_id and text are least.
FIT_ROWS, CALIBRATE_ROWS = 600, 200
REJECT = 0.5
#: Languages whose log probabilities stand side by side in one table; more languages take more tables.
TOGETHER = 16
#: Languages up to which the rows to sample (800 short keys for each) are sent to every task; more meet texts by a shuffle.
BROADCAST_LANGUAGES = 500
#: Symbols scored at once: bounds the memory of a task at about 12 bytes for each of these and each language.
TILE = 1 << 17


def _letters() -> np.ndarray:
    """For every code point, the lower-case letter it stands for, or 0 for a boundary."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(len(out)):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_TABLE: list[np.ndarray] = []


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, text of each): letters and single boundaries, and a boundary behind every text."""
    if not _TABLE:
        _TABLE.append(_letters())
    # a newline behind every text keeps texts apart
    n = len(off) - 1
    joined = np.full(len(data) + n, 0x0A, np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))] = data
    code = np.frombuffer(joined.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    size = np.add.reduceat(((joined & 0xC0) != 0x80).astype(np.int64), off[:-1] + np.arange(n)) if n else np.zeros(0, np.int64)
    text = np.repeat(np.arange(n, dtype=np.int32), size)
    s = _TABLE[0][code] if len(code) else np.zeros(0, np.uint32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (text[1:] != text[:-1])
    return s[keep], text[keep]


def symbol_slices(data: np.ndarray, off: np.ndarray, order: int):
    """(symbols, text of each, how many of the first ones are context only) of slices of texts.

    A long text comes in pieces cut between code points: each after the first begins with the order - 1 symbols before
    it, boundaries standing before the text. A piece that ends in a letter has no boundary behind it unless the text ends.
    """
    if len(off) != 2 or len(data) <= 2 * SLICE_BYTES:
        yield *symbols(data, off), 0
        return
    lo, before, last = 0, np.zeros(order - 1, np.uint32), None
    while lo < len(data):
        hi = min(lo + SLICE_BYTES, len(data))
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        own, _ = symbols(data[lo:hi], np.array([0, hi - lo]))
        if hi < len(data) and data[lo:hi][-4:].tobytes().decode("utf-8", "ignore")[-1:].isalpha():
            own = own[:-1]
        if last == 0 and len(own) and own[0] == 0:
            own = own[1:]
        s = np.concatenate((before, own))
        yield s, np.zeros(len(s), np.int32), order - 1
        before, last, lo = s[len(s) - (order - 1) :], own[-1] if len(own) else last, hi


def grams(s: np.ndarray, text: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to `order`-grams that end at each symbol; before a text's first symbol stand boundaries."""
    with np.errstate(over="ignore"):
        base = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out, h = [base ^ (base >> np.uint64(31))], base
        mark = np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, order):
            earlier = np.full(len(s), mark, np.uint64)
            if len(s) > k:
                same = text[k:] == text[:-k]
                earlier[k:] = np.where(same, base[:-k], mark)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + earlier
            out.append((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(k))
    return out


class SortedHashes:
    """Sorted hashes, with the place at which each prefix of them begins, so that a search starts next to its end."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys), 1).bit_length() + 1
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each of h stands or would stand, whether it is there)"""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        prefix = (h >> self.shift).astype(np.int64)
        at, end = self.first[prefix].astype(np.int64), self.first[prefix + 1]
        last = len(self.keys) - 1
        found = self.keys[np.minimum(at, last)]
        todo = np.flatnonzero((at < end) & (found < h))
        while len(todo):
            at[todo] += 1
            now = self.keys[np.minimum(at[todo], last)]
            found[todo] = now
            todo = todo[(at[todo] < end[todo]) & (now < h[todo])]
        return np.minimum(at, last), (at < end) & (found == h)


@dataclass
class Models:
    """keys[n]: sorted hashes of the (n + 1)-grams known to any language; logs[n]: a row of natural log probabilities for
    each; backs[n]: log weights of the lower order after each (n + 1)-gram as context; floor: log probability of a
    character unknown to all."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    back_keys: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray

    def __post_init__(self):
        self.known, self.contexts = ([SortedHashes(k) for k in x] for x in (self.keys, self.back_keys))

    def nats(self, s: np.ndarray, text: np.ndarray, lead: int = 0) -> np.ndarray:
        """-log probability of every symbol from `lead` on, in each language."""
        order = len(self.keys)
        hashes = grams(s, text, order)
        opening = [h[0] for h in grams(np.zeros(1, np.uint32), np.zeros(1, np.int32), order)]  # the context before a text
        value = np.empty((len(s), len(self.languages)), np.float32)
        todo = np.arange(lead, len(s))
        owed = np.zeros((len(s), len(self.languages)), np.float32)
        for k in range(order - 1, -1, -1):
            at, hit = self.known[k].find(hashes[k][todo])
            own = todo[hit]
            value[own] = self.logs[k][at[hit]]
            if k < order - 1:  # nothing is owed yet at the top
                value[own] += owed[own]
            todo = todo[~hit]
            if k and len(todo):
                before = todo - 1  # the context of an unknown gram ends one symbol earlier
                inside = (before >= 0) & (text[np.maximum(before, 0)] == text[todo])
                c = np.where(inside, hashes[k - 1][np.maximum(before, 0)], opening[k - 1])
                at, known = self.contexts[k - 1].find(c)
                owed[todo[known]] += self.backs[k - 1][at[known]]
        value[todo] = self.floor + owed[todo]
        return -value[lead:]

    def sums(self, s: np.ndarray, text: np.ndarray, n: int, lead: int = 0) -> np.ndarray:
        """Nats of n texts in each language, from symbol `lead` on, in tiles of TILE symbols."""
        reach = len(self.keys) - 1
        total = np.zeros((n, len(self.languages)))
        for lo in range(lead, len(s), TILE):
            hi, back = min(lo + TILE, len(s)), max(lo - reach, 0)
            found, own = self.nats(s[back:hi], text[back:hi], lo - back), text[lo:hi]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            total[own[starts]] += np.add.reduceat(found, starts, axis=0, dtype=np.float64)
        return total

    def entropy(self, s: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(nats for each character and language, characters) of n texts."""
        count = np.bincount(text, minlength=n)
        return self.sums(s, text, n) / np.maximum(count, 1)[:, None], count


@dataclass
class Grams:
    """Distinct n-grams: rows of n symbols, the oldest first, sorted by hash; hashes as grams() gives them."""

    rows: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> tuple[Grams, np.ndarray]:
        """(distinct grams, the number of each row's gram among them)"""
        n, order = rows.shape
        hashes = grams(rows.reshape(-1), np.repeat(np.arange(n, dtype=np.int32), order), order)[order - 1][order - 1 :: order]
        hash_, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        return cls(rows[first], hash_), where

    def find(self, other: Grams) -> np.ndarray:
        """Where other's grams stand, all of which are known here."""
        return np.searchsorted(self.hash, other.hash)


def _kneser_ney(rows: np.ndarray, count: np.ndarray, discount: float, letters: int):
    """For one language, from its distinct grams of the top order and their counts: per order, (grams, log
    probabilities); per order below the top, (contexts, log weights); and the log probability of a character it has not
    seen. letters: different symbols of all languages."""
    order = rows.shape[1]
    top, where = Grams.of(rows)
    counted = {order: (top, np.bincount(where, count))}
    for n in range(order - 1, 0, -1):  # continuation counts: how many different symbols stand before the gram
        own, where = Grams.of(counted[n + 1][0].rows[:, 1:])
        counted[n] = own, np.bincount(where).astype(np.float64)
    probs, backs, lower = [], [], None
    floor = -np.inf
    for n in range(1, order + 1):
        own, count = counted[n]
        if n == 1:
            spread = discount * len(count) / count.sum() / (letters + 1)
            floor = float(np.log(spread))
            p = np.maximum(count - discount, 0) / count.sum() + spread
        else:
            ctx, where = Grams.of(own.rows[:, :-1])
            sums = np.bincount(where, weights=count)
            weight = discount * np.bincount(where) / sums
            tail, at = Grams.of(own.rows[:, 1:])
            low = lower[1][lower[0].find(tail)][at]
            p = np.maximum(count - discount, 0) / sums[where] + weight[where] * low
            backs.append((ctx, np.log(weight)))
        lower = (own, p)
        probs.append((own, np.log(p)))
    return probs, backs, floor


def top_grams(s: np.ndarray, text: np.ndarray, order: int, lead: int = 0) -> np.ndarray:
    """The `order`-gram that ends at each symbol from `lead` on, a row of symbols each; boundaries stand before a text."""
    out = np.zeros((len(s), order), np.uint32)
    out[:, -1] = s
    for k in range(1, order):
        if len(s) > k:
            out[k:, -1 - k] = np.where(text[k:] == text[:-k], s[:-k], 0)
    return out[lead:]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return symbols(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))


def fit_models(texts: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT) -> Models:
    """Models of the languages named, from their texts."""
    counts = {name: np.unique(top_grams(*_joined(texts[name]), order), axis=0, return_counts=True) for name in sorted(texts)}
    return fit_counts(counts, discount=discount)


def alphabet(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> int:
    """Different symbols, the boundary among them."""
    return len(np.unique(np.concatenate([np.zeros(1, np.uint32), *(rows[:, -1] for rows, _ in counts.values())])))


def fit_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]], letters: int | None = None, discount: float = DISCOUNT) -> Models:
    """Models of the languages named, from distinct grams (rows of symbols) and their counts. A language's probabilities
    depend on the others only by `letters`, the number of different symbols of all."""
    names, letters = sorted(counts), alphabet(counts) if letters is None else letters
    fitted = [_kneser_ney(*counts[name], discount, letters) for name in names]
    order = counts[names[0]][0].shape[1]
    floor = np.array([f[2] for f in fitted], np.float32)

    def union(parts, blank):
        every, _ = Grams.of(np.concatenate([g.rows for g, _ in parts]))
        row = np.full((len(every.hash), len(names)), blank, np.float32)
        for j, (g, v) in enumerate(parts):
            row[every.find(g), j] = v
        return every, row

    contexts = [union([f[1][k] for f in fitted], 0.0) for k in range(order - 1)]  # an unknown context leaves the lower order whole
    tables: list[tuple[Grams, np.ndarray]] = []
    for k in range(order):
        own, row = union([f[0][k] for f in fitted], np.nan)
        # a gram known to some languages only: for the others, the lower order times the weight of its context
        if k == 0:
            low = np.tile(floor, (len(own.hash), 1))
        else:
            tail, at = Grams.of(own.rows[:, 1:])
            ctx, to = Grams.of(own.rows[:, :-1])
            low = tables[k - 1][1][tables[k - 1][0].find(tail)][at] + contexts[k - 1][1][contexts[k - 1][0].find(ctx)][to]
        tables.append((own, np.where(np.isnan(row), low, row).astype(np.float32)))
    return Models(names, [g.hash for g, _ in tables], [r for _, r in tables], [g.hash for g, _ in contexts], [r for _, r in contexts], floor)


def learnt(parts: int = 3, part: int = 1):
    """Whether a row may be learnt from: crc32 of the doc_id as text does not leave that remainder."""
    return ~F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def _lead(entropy: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How far the best language leads the second, in nats, damped for short and long texts alike."""
    if entropy.shape[1] < 2:
        return np.full(len(entropy), 10.0)
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return (two[:, 1] - two[:, 0]) * np.sqrt(count)


def _entropies(models: list[Models], data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nats for each character and language, characters, letters) of texts."""
    n = len(off) - 1
    total = np.zeros((n, sum(len(m.languages) for m in models)))
    count, letters = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s, text, lead in symbol_slices(data, off, len(models[0].keys)):
        total += np.hstack([m.sums(s, text, n, lead) for m in models])
        count += np.bincount(text[lead:], minlength=n)
        letters += np.bincount(text[lead:][s[lead:] != 0], minlength=n)
    return total / np.maximum(count, 1)[:, None], count, letters


def _count_grams(order: int):
    """Each batch's grams of the top order by language: lang, gram (its symbols as characters), n."""

    def run(batches):
        for rows, data, off in text_slices(batches, "text"):
            names = rows.column("lang").to_pylist()
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            lang = np.array([known[x] for x in names])
            for s, text, lead in symbol_slices(data, off, order):
                if len(s) == lead:
                    continue
                own, where = Grams.of(np.column_stack((lang[text[lead:]].astype(np.uint32), top_grams(s, text, order, lead))))
                n = np.bincount(where)
                gram = np.ascontiguousarray(own.rows[:, 1:], "<u4")
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * 4 * order).astype(np.int32)), pa.py_buffer(gram)])
                label = pa.array(list(known), pa.string()).take(pa.array(own.rows[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([label, blob, pa.array(n)], names=["lang", "gram", "n"])

    return run


def _leads(models: list[Models]):
    """The lead of every row's best language, and whether it is the row's own."""

    def run(batches):
        names = np.array([x for m in models for x in m.languages], object)
        for rows, data, off in text_slices(batches, "text"):
            entropy, count, _ = _entropies(models, data, off)
            right = names[entropy.argmin(axis=1)] == np.array(rows.column("lang").to_pylist(), object)
            yield pa.RecordBatch.from_arrays([pa.array(_lead(entropy, count)), pa.array(right.astype(bool))], names=["lead", "right"])

    return run


def _predict(models: list[Models], slope: float, shift: float, reject: float):
    def run(batches):
        names = np.array([x for m in models for x in m.languages], object)
        for rows, data, off in text_slices(batches, "text"):
            entropy, count, letters = _entropies(models, data, off)
            score = 1 / (1 + np.exp(-np.clip(slope * _lead(entropy, count) + shift, -40, 40)))
            some = letters > 0
            pick = np.where(some, names[entropy.argmin(axis=1)], "und")
            score = np.where(some, score, 0.0)
            best = np.where(some, entropy.min(axis=1), np.nan)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pick.tolist(), pa.string()), pa.array(score), pa.array(some & (score >= reject)), pa.array(best, from_pandas=True)], names=["doc_id", "lang_pred", "score", "accepted", "nats"])

    return run


def _sample(rows: DataFrame, need: int, fit_rows: int, seed: int) -> DataFrame:
    """(lang, fit, text): for every language `need` different rows to learn from (fewer where there are fewer), those of
    least hashed doc_id and text. fit: to fit on, else to calibrate on.

    Only keys are ranked, and each task passes on its best `need` of each language; the texts are then found by their
    keys. Copies of one row have one key and are combined where they are, so neither they nor a doc_id that many rows
    share make the sample larger.
    """
    named = rows.where(learnt()).where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.length(F.trim("text")) >= 1)
    keyed = named.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")))
    # the share of each language's hash range that holds about twice the rows needed: what is dealt out stays small
    keys = materialize(keyed.select("lang", "key"), "language-rows")
    share = F.least(F.lit(1.0), F.lit(float(2 * need + 50)) / F.approx_count_distinct("key"))
    reach = materialize(keys.groupBy("lang").agg((F.lit(-float(2**63)) + share * float(2**64)).alias("reach")), "language-reach")
    few = reach.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    some = keys.join(F.broadcast(reach) if few else reach, "lang").where(F.col("key").cast("double") <= F.col("reach")).select("lang", "key").distinct()
    pick = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("r") <= need)
    pick = materialize(pick, "language-keys")
    held = pick.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
    fit = F.least(F.lit(fit_rows), F.greatest(F.lit(1), F.floor(F.col("held") * 3 / 4)))
    pick = pick.join(held, "lang").select("lang", "key", (F.col("r") <= fit).alias("fit"), (F.col("held") == 1).alias("only"))
    met = keyed.join(F.broadcast(pick) if few else pick, ["lang", "key"])
    return materialize(met.groupBy("lang", "key", "fit", "only").agg(F.first("text").alias("text")).drop("key"), "language-sample")


def language_id(docs: DataFrame, order: int = ORDER, fit_rows: int = FIT_ROWS, calibrate_rows: int = CALIBRATE_ROWS, reject: float = REJECT, seed: int = 42) -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score, accepted, nats.

    docs: doc_id long, text string, lang string; other columns are not read. Learns only from the text and the non-null
    lang of rows that are not held out: for every language, the fit_rows rows of least hashed doc_id and text (the bound
    of the sample), then calibrate_rows more for the score. Sampled texts are learnt whole, whatever their length; a
    language with one row is calibrated on it, too.

    - lang_pred is `und` and score 0 if the text is null or has no letter; otherwise it is a learnt language. Letters are
      those of all of Unicode.
    - accepted is false for `und` and where the score is below `reject`.
    - Without rows to learn from, every lang_pred is `und`.
    - Rows that repeat a doc_id or have none each give a row. A null doc_id is never held out, nor learnt from. Rows that
      repeat doc_id and text are learnt from once.
    - Texts of any length are read in slices: memory does not grow with a text beyond the text itself.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = _sample(rows, fit_rows + calibrate_rows, fit_rows, seed)
    fitted = chosen.where("fit").select("lang", "text").mapInArrow(_count_grams(order), "lang string, gram binary, n long")
    found = fitted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # distinct grams of the sample
    if not len(found):
        blank = rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("nats"))
        return blank.withColumn("held_out", ~learnt()).select("doc_id", "held_out", "lang_pred", "score", "accepted", "nats")
    lang = found.column("lang").combine_chunks().dictionary_encode()
    data, _ = utf8(found.column("gram").combine_chunks())
    cells = np.frombuffer(data.tobytes(), "<u4").reshape(-1, order)
    own, n = lang.indices.to_numpy(), found.column("n").to_numpy()
    counts = {x: (cells[own == i], n[own == i]) for i, x in enumerate(lang.dictionary.to_pylist())}
    names, letters = sorted(counts), alphabet(counts)
    models = [fit_counts({x: counts[x] for x in names[k : k + TOGETHER]}, letters) for k in range(0, len(names), TOGETHER)]
    shared = spark.sparkContext.broadcast(models)  # of the sample's size; a task has it once

    def with_models(make):
        return lambda batches: make(shared.value)(batches)

    seen = chosen.where("NOT fit OR only").select("lang", "text").mapInArrow(with_models(_leads), "lead double, right boolean").collect()  # calibrate_rows for each language
    lead, right = np.array([r["lead"] for r in seen]), np.array([r["right"] for r in seen], np.float64)
    # one right and one wrong answer at no lead keep the map rising where all answers are right
    slope, shift = fit_logistic(np.append(lead, [0.0, 0.0]), np.append(right, [0.5, 0.0]), np.append(1 - right, [0.0, 0.5]))
    scored = rows.select("doc_id", "text").mapInArrow(tidy(with_models(lambda m: _predict(m, slope, shift, reject))), "doc_id long, lang_pred string, score double, accepted boolean, nats double")
    return scored.select("doc_id", (~learnt()).alias("held_out"), "lang_pred", "score", "accepted", "nats")
