"""Mixture-controlled packing by deficit round-robin over source queues.

A phase is a stretch of windows in which the same source queues share each window. Queue k is due x_k tokens of every
window, a real number; its share ends where the next one's begins, so shares are ranges between edges X_0 = 0 to
X_m = window. In window w every edge stands at floor(X + t(w)), where the carry t(w), the same for all queues, runs
through the van der Corput sequence: a queue gets its due rounded down or up, a window is always full, and what a queue
was owed in one window it gets in the next ones (deficits stay below a few tokens). How often an edge was rounded up
before window w has a closed form over the bits of w, so the tokens a queue gave before any window follow from w alone.
That makes the round-robin parallel: a document's place in its queue (sums over partitions, then within one) tells its
windows and offsets, and deficits carry across partitions without a task waiting for another.

A queue that runs dry leaves at the end of a phase and the others' shares are rescaled; of queues that would run dry one
soon after the other, all fade out over one phase. The few tokens a queue could not place fill windows of their own, the
last of which are powers of two long, so nothing is padded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import LOWER, SLICE_BYTES, text_slices, tidy, utf8, word_end
from lodestone.plans.runtime import materialize, prepare

WINDOW = 2048
#: Fractional bits of an edge; windows of a phase stay below 2^BITS.
BITS = 40
#: Tokens held back when a queue's last phase is planned: more than rounding can ever be off.
SPARE = 32
#: Queues that run dry within this part of the windows so far fade out together, which bounds the number of phases.
TOGETHER = 1 / 16
#: More sources than this share queues by hash; slices of the order within such a queue.
QUEUES = 16384
SLICES = 4096
#: Bases (source and partition) sent to every task at once; more go in several ranges of partitions.
BASE_ROWS = 400_000
#: Tokens of a document in one row of the token table.
RUN = 1 << 20
END = 1


# ---- tokens ----


_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def simplify(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z and the capitals of Latin-1 in lower case, and a space between a letter of these alphabets and punctuation.

    Left alone if the text may hold a special token, which is matched before case is lowered.
    """
    if len(data) < 2 or b"<|" in data.tobytes():
        return data, off
    data = LOWER[data]
    lead = data[:-1] == 0xC3  # U+00C0 to U+00FF
    second = data[1:]
    latin = lead & (second != 0x97) & (second != 0xB7)
    second[latin & (second < 0x9F)] += 0x20
    letter = _ASCII[data]
    letter[1:] |= latin
    cut = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
    cut = cut[off[np.searchsorted(off, cut)] != cut]
    return np.insert(data, cut, 0x20), off + np.searchsorted(cut, off)


class WordIds(dict):
    """Token ids of words by a tokenizer that never joins across white space; code -> ids in two arrays.

    Words are looked up in lower case and without the punctuation that follows a letter: the tokenizer lowers case and
    begins a new piece there anyway. Words of plain letters need only its model.
    """

    #: Bytes of remembered words, at about 150 for each besides its letters.
    ROOM = 64 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.simple = self.alike()
        self.reset()

    def alike(self) -> bool:
        """Whether the tokenizer lowers case and parts letters from punctuation, so that simplify() changes no ids."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        probe = "Thing, ÀÉ\xdf! it's x.Y_z #End; (No) A-b"
        model = [t.id for t in self.tokenizer.model.tokenize("thing")]
        return ids(probe) == ids("thing , \xe0\xe9\xdf ! it's x .y _z #end ; (no ) a -b") and ids("thing") == model and ids("thing.") == model + ids(".")

    def reset(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.size, self.ids, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.uint32), 0
        self.add([[END]])
        self[b""] = 0  # stands for the id that ends a document

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.fresh.append(word)
        return code

    def add(self, ids: list[list[int]]) -> None:
        self.size = np.append(self.size, [len(x) for x in ids])
        self.ids = np.append(self.ids, np.array([i for x in ids for i in x], np.uint32))
        self.start = np.cumsum(self.size) - self.size

    def new_ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words not seen before."""
        if not self.simple:
            return [e.ids for e in self.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in words], add_special_tokens=False)]
        model, out, other = self.tokenizer.model, [], []
        for x in words:
            plain = x.isalpha() and x.islower()  # of bytes: letters a to z only
            out.append([t.id for t in model.tokenize(x.decode())] if plain else None)
            if not plain:
                other.append(x.decode("utf-8", "replace"))
        rest = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        return [next(rest).ids if x is None else x for x in out]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; offsets)"""
        if self.bytes > self.ROOM:
            self.reset()
        if self.simple:
            data, off = simplify(data, off)
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        names: list[bytes] = []
        count = np.empty(len(texts), np.int64)
        for i, x in enumerate(texts):
            own = x.split()
            names += own
            names.append(b"")
            count[i] = len(own) + 1
        codes = np.fromiter(map(self.__getitem__, names), np.int64, len(names))
        if self.fresh:
            self.add(self.new_ids(self.fresh))
            self.bytes += sum(map(len, self.fresh)) + 150 * len(self.fresh)
            self.fresh = []
        size = self.size[codes]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[codes] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.append(0, end[np.cumsum(count) - 1]) if len(texts) else np.zeros(1, np.int64)


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _encoded(vocabulary: WordIds, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """encode(); a long text goes piece by piece, cut at white space."""
    if len(off) != 2 or len(data) <= 2 * SLICE_BYTES:
        return vocabulary.encode(data, off)
    parts, lo = [], 0
    while lo < len(data):
        hi = word_end(data, min(lo + SLICE_BYTES, len(data)))
        ids, _ = vocabulary.encode(data[lo:hi], np.array([0, hi - lo]))
        parts.append(ids if hi == len(data) else ids[:-1])
        lo = hi
    ids = np.concatenate(parts)
    return ids, np.array([0, len(ids)])


def _binary(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


_TOKENS = "doc_id long, queue_key string, pid int, local_start long, run_start long, doc_tokens long, ids binary"


def _tokens(path: str):
    def run(batches):
        vocabulary, pid, given = word_ids(path), TaskContext.get().partitionId(), {}
        for rows, data, off in text_slices(batches, "text"):
            ids, at = _encoded(vocabulary, data, off)
            size = np.diff(at)
            start = np.empty(len(size), np.int64)
            for i, (source, n) in enumerate(zip(rows.column("queue_key").to_pylist(), size.tolist(), strict=True)):
                start[i] = given.get(source, 0)
                given[source] = start[i] + n
            runs = -(-size // RUN)
            owner = np.repeat(np.arange(len(size)), runs)
            first = (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
            whole = len(owner) == len(size)
            for lo, hi in [(0, len(owner))] if whole else [(i, i + 1) for i in range(len(owner))]:
                own, begin = owner[lo:hi], first[lo:hi]
                cut = np.append(at[own] + begin, at[own[-1]] + min(begin[-1] + RUN, size[own[-1]]))
                flat = np.ascontiguousarray(ids[cut[0] : cut[-1]], "<u4").view(np.uint8)
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pick), rows.column("queue_key").take(pick), pa.array(np.full(len(own), pid, np.int32)), pa.array(start[own]), pa.array(begin), pa.array(size[own]), _binary(flat, 4 * (cut - cut[0]))],
                    names=["doc_id", "queue_key", "pid", "local_start", "run_start", "doc_tokens", "ids"],
                )

    return run


# ---- the round-robin ----

_ONE = 1 << BITS


def carry(w: np.ndarray) -> np.ndarray:
    """t(w) of the van der Corput sequence, in units of 2^-BITS: the bits of w in reverse."""
    out = np.zeros(len(w), np.int64)
    for i in range(int(w.max(initial=0)).bit_length()):
        out |= ((w >> i) & 1) << (BITS - 1 - i)
    return out


def roundings(edge: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of floor(edge + t(v)) over the windows v < w, edges in units of 2^-BITS.

    The windows below w fall into one run of 2^i windows for each binary digit i of w; in a run the carries are evenly
    spaced, so those that lift the edge's fraction over one are counted by a division.
    """
    part = edge & (_ONE - 1)
    total = (edge >> BITS) * w
    head = np.zeros(len(w), np.int64)
    for i in range(int(w.max(initial=0)).bit_length() - 1, -1, -1):
        on = (w >> i) & 1
        below = np.clip((_ONE - part - head + (1 << (BITS - i)) - 1) >> (BITS - i), 0, 1 << i)
        total += on * ((1 << i) - below)
        head += on << (BITS - 1 - i)
    return total


@dataclass
class Phase:
    """`windows` windows from `first` on, shared by the queues `active` (sorted); edges in units of 2^-BITS; base: tokens
    that each active queue gave before; end: those it gave after."""

    first: int
    windows: int
    active: np.ndarray
    edges: np.ndarray
    base: np.ndarray
    end: np.ndarray

    def given(self, k: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Tokens that the k-th active queues give before window w of the phase."""
        return roundings(self.edges[k + 1], w) - roundings(self.edges[k], w)

    def window_of(self, k: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The window in which the k-th active queues give their token of that number in the phase."""
        share = (self.edges[k + 1] - self.edges[k]) / _ONE
        lo = np.clip(np.floor((token - SPARE) / share), 0, self.windows - 1).astype(np.int64)
        hi = np.minimum(np.ceil((token + SPARE) / share) + 1, self.windows).astype(np.int64)
        while (open_ := np.flatnonzero(hi - lo > 1)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            low = self.given(k[open_], mid) <= token[open_]
            lo[open_[low]] = mid[low]
            hi[open_[~low]] = mid[~low]
        return lo


@dataclass
class Plan:
    window: int
    phases: list[Phase]
    gone: np.ndarray  # tokens of each queue that the phases take; the others are left over
    left_at: np.ndarray  # place of each queue's left-over tokens among all of them
    first_left: int
    n_left: int

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, tokens from its start, length, sequence, offset) of all pieces of documents at `start` in their
        queues, in the order of documents and tokens."""
        at, stop = start.astype(np.int64), (start + size).astype(np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for p in self.phases:
            k = np.minimum(np.searchsorted(p.active, queue), len(p.active) - 1)
            end = np.minimum(p.end[k], stop)
            doc = np.flatnonzero((p.active[k] == queue) & (at < end))
            if not len(doc):
                continue
            k, lo, hi = k[doc], at[doc] - p.base[k[doc]], end[doc] - p.base[k[doc]]
            near = p.window_of(np.concatenate((k, k)), np.concatenate((lo, hi - 1)))
            w0, w1 = near[: len(doc)], near[len(doc) :]
            n = w1 - w0 + 1
            own = np.repeat(np.arange(len(doc)), n)
            w = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + w0[own]
            turn = carry(w)
            left, right = (p.edges[k[own]] + turn) >> BITS, (p.edges[k[own] + 1] + turn) >> BITS
            before = np.cumsum(right - left) - (right - left)
            heads = np.cumsum(n) - n
            before += (p.given(k, w0) - before[heads])[own]  # tokens given before each window
            a, b = np.maximum(before, lo[own]), np.minimum(before + right - left, hi[own])
            some = np.flatnonzero(b > a)
            own, w, left, before, a, b = (x[some] for x in (own, w, left, before, a, b))
            out.append((doc[own], a - lo[own] + at[doc][own] - start[doc][own], b - a, p.first + w, left + a - before))
            at[doc] = end[doc]
        rest = np.flatnonzero(at < stop)
        if len(rest):
            place = self.left_at[queue[rest]] + at[rest] - self.gone[queue[rest]]
            bound = self.tail_bounds()
            last = np.searchsorted(bound, place + stop[rest] - at[rest] - 1, side="right")
            s0 = np.searchsorted(bound, place, side="right")
            n = last - s0 + 1
            own = np.repeat(np.arange(len(rest)), n)
            s = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + s0[own]
            a = np.maximum(np.append(0, bound)[s], place[own])
            b = np.minimum(bound[s], (place + stop[rest] - at[rest])[own])
            out.append((rest[own], a - place[own] + (at - start)[rest][own], b - a, self.first_left + s, a - np.append(0, bound)[s]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z, z, z
        found = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.lexsort((found[1], found[0]))
        return tuple(x[order] for x in found)

    def tail_bounds(self) -> np.ndarray:
        """Where the sequences of left-over tokens end: whole windows, then one for each binary digit of the rest."""
        whole, rest = divmod(self.n_left, self.window)
        digits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        return np.cumsum(np.array([self.window] * whole + digits, np.int64))


def _edges(share: np.ndarray, window: int) -> np.ndarray:
    top = window << BITS
    out = np.minimum(np.append(0, np.rint(np.cumsum(share) * _ONE)).astype(np.int64), top)
    out[-1] = top
    return out


def plan(totals, weights=None, window: int = WINDOW) -> Plan:
    """totals: tokens of each queue; weights: target proportions, by default the queues' own.

    Queues without weight come after all others, in proportion to their tokens.
    """
    totals = np.asarray(totals, np.int64)
    want = totals.astype(np.float64) if weights is None else np.asarray(weights, np.float64)
    gone = np.zeros(len(totals), np.int64)
    phases: list[Phase] = []
    first = 0

    def add(active: np.ndarray, share: np.ndarray, n: int) -> None:
        nonlocal first
        p = Phase(first, n, active, _edges(share, window), gone[active], gone[active])
        p.end = p.base + p.given(np.arange(len(active)), np.full(len(active), n))
        phases.append(p)
        gone[active] = p.end
        first += n

    for tier, rate in ((want > 0, want), (want <= 0, totals.astype(np.float64))):
        active, began = np.flatnonzero(tier), first
        while True:
            left = totals[active] - gone[active] - SPARE
            active, left = active[left > 0], left[left > 0]
            if left.sum() < window:
                break
            share = rate[active] / rate[active].sum() * window
            lasts = left / share
            least = lasts.min()
            if least < 1:  # less than a window's share: left over
                active = active[lasts >= 1]
                continue
            ending = lasts <= (first - began + least) * (1 + TOGETHER) - (first - began)
            if ending.all():
                add(active, left / left.sum() * window, int(left.sum() // window))
                break
            add(active, share, int(least))
            fade = int(lasts[ending].max() - least)
            if fade:
                left = np.maximum(totals[active] - gone[active] - SPARE, 0)
                share = np.where(ending, np.minimum(left / fade, share), share)
                share[~ending] *= (window - share[ending].sum()) / share[~ending].sum()
                n = min(fade, int((left[~ending] / share[~ending]).min()))
                if n:
                    add(active, share, n)
                if n < fade:
                    continue
            active = active[~ending]
    over = totals - gone
    return Plan(window, phases, gone, np.cumsum(over) - over, first, int(over.sum()))


def _pieces(totals: np.ndarray, want: np.ndarray | None, window: int):
    """Every task works the plan out from the queues' totals and weights, 16 bytes for each."""

    def run(batches):
        made = plan(totals, want, window)
        for batch in batches:
            data, off = utf8(batch.column("ids"))
            begin = batch.column("run_start").to_numpy()
            doc, at, length, sequence, offset = made.pieces(batch.column("queue").to_numpy(), batch.column("start").to_numpy(), np.diff(off) // 4)
            for lo in range(0, len(doc), 1 << 15):
                p = slice(lo, lo + (1 << 15))
                own, end = pa.array(doc[p]), np.cumsum(4 * length[p])
                base = int(off[doc[lo]] + 4 * at[lo])
                ids = _binary(data[base : base + end[-1]], np.append(0, end))
                cells = [batch.column("doc_id").take(own), pa.array((begin[doc] + at)[p]), pa.array(length[p]), ids, batch.column("doc_tokens").take(own), pa.array(sequence[p]), pa.array(offset[p]), batch.column("queue_key").take(own)]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"])

    return run


def _bases(tokens: DataFrame, base: DataFrame, most: int) -> DataFrame:
    """tokens with queue and base of their source and partition; token ids stay where they are.

    Bases go to every task, in as many ranges of partitions (pruned by the files' statistics) as keep each broadcast to
    `most` rows; a block of 256 partitions with more sources than that meets its tokens by a shuffle.
    """
    spans: list[list[int]] = []
    for r in base.groupBy(F.shiftright("pid", 8).alias("block")).count().orderBy("block").collect():  # one row for 256 partitions
        if spans and spans[-1][2] + r["count"] <= most:
            spans[-1][1:] = r["block"], spans[-1][2] + r["count"]
        else:
            spans.append([r["block"], r["block"], r["count"]])
    out = None
    for lo, hi, n in spans or [[0, 0, 0]]:
        inside = (F.col("pid") >= lo << 8) & (F.col("pid") < (hi + 1) << 8)
        own = base.where(inside) if len(spans) > 1 else base
        part = (tokens.where(inside) if len(spans) > 1 else tokens).join(F.broadcast(own) if n <= most else own, ["queue_key", "pid"])
        out = part if out is None else out.unionByName(part)
    return out


def _dealt(tokens: DataFrame, parts: DataFrame, sums: DataFrame, weights: dict[str, float] | None, window: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """For more than QUEUES sources: runs of documents in hashed queues, and the queues' tokens and weights.

    Sources with a weight are hashed into QUEUES queues; all others are in one more, of weight zero. In a queue, runs of at
    most `window` tokens come in the order of their middle's place in their source divided by the source's weight, which
    interleaves the sources in proportion to their weights. Places are sums over slices of that order, then within a slice.
    """
    if weights is None:
        known = sums.withColumn("weight", F.col("n").cast("double"))
    else:
        spark = tokens.sparkSession
        given = spark.createDataFrame([(k, float(x)) for k, x in weights.items() if x > 0], "queue_key string, weight double")
        known = sums.join(given, "queue_key", "left")
    hashed = F.pmod(F.xxhash64("queue_key"), F.lit(QUEUES)).cast("int")
    known = known.withColumn("queue", F.when(F.col("weight").isNull(), QUEUES).otherwise(hashed)).withColumn("rate", F.coalesce("weight", F.col("n").cast("double")))
    known = materialize(known, "pack-sources")
    totals, want = [0] * (QUEUES + 1), [0.0] * (QUEUES + 1)
    for r in known.groupBy("queue").agg(F.sum("n").alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).collect():  # at most QUEUES + 1 rows
        totals[r["queue"]], want[r["queue"]] = r["n"], r["weight"]
    last = known.groupBy("queue").agg(F.max(F.col("n") / F.col("rate")).alias("last"))
    known = known.join(F.broadcast(last), "queue")  # at most QUEUES + 1 rows

    order = Window.partitionBy("queue_key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("queue_key", "pid", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")).join(known.select("queue_key", "queue", "rate", "last"), "queue_key")
    own = tokens.join(base, ["queue_key", "pid"]).withColumn("first", F.col("base") + F.col("local_start"))
    runs = own.withColumn("in_run", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("ids") / 4).cast("long") - 1, F.lit(window).cast("long"))))
    runs = runs.withColumn("ids", F.expr(f"substring(ids, CAST(4 * in_run + 1 AS INT), {4 * window})")).withColumn("size", (F.length("ids") / 4).cast("long"))
    runs = runs.withColumn("run_start", F.col("run_start") + F.col("in_run"))
    runs = runs.withColumn("place", F.col("first") + F.col("run_start")).withColumn("turn", (F.col("place") + F.col("size") / 2) / F.col("rate"))
    runs = runs.withColumn("slice", F.least(F.floor(F.col("turn") / F.col("last") * SLICES), F.lit(SLICES - 1)).cast("int"))
    runs = materialize(runs.select("doc_id", "queue_key", "queue", "slice", "turn", "place", "run_start", "size", "doc_tokens", "ids"), "pack-runs", "zstd")
    before = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = runs.groupBy("queue", "slice").agg(F.sum("size").alias("n")).select("queue", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("queue", "slice").orderBy("turn", "queue_key", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(slices, ["queue", "slice"])
    return placed.select("doc_id", "queue_key", "queue", (F.col("before") + F.col("inside")).alias("start"), "run_start", "doc_tokens", "ids"), np.array(totals), np.array(want)


def pack(docs: DataFrame, tokenizer_path: str, weights: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """Pack every document's tokens into sequences of `window` tokens, each mixed in the target proportions of sources.

    docs: doc_id long, text string, source string; other columns are not read. tokenizer_path: a file of the
    `tokenizers` library whose pre-tokenizer drops white space (words are then encoded once and looked up). weights:
    target proportion by source; by default each source's share of all tokens, so that every window mirrors the corpus.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids. ids holds the
    piece's token ids, four bytes each, least byte first: a sequence is its pieces' ids in the order of offset.

    - A document's ids are its tokens, then the id 1; a null or empty text is that id alone.
    - A null source counts as the source "". A source that weights does not name has weight zero: its tokens come last.
    - Above QUEUES sources, sources share queues, in which runs of at most `window` tokens of each alternate by weight: the
      proportions of sources in one queue then hold over stretches of windows; those of queues hold in every window.
    - Rows that repeat a doc_id, and null doc_ids, are packed like any other. No rows give no pieces.
    - A document of any length is cut freely; no id is lost and none is padded. Long texts are encoded in slices cut at
      white space and stored in rows of RUN tokens: memory grows with a document's ids and its longest word.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue_key"))
    tokens = materialize(rows.mapInArrow(tidy(_tokens(tokenizer_path)), _TOKENS), "tokens", "zstd")
    ends = tokens.groupBy("queue_key", "pid").agg(F.sum(F.length("ids") / 4).cast("long").alias("n"))
    parts = materialize(ends, "pack-parts")  # one short row for each source of each partition
    sums = parts.groupBy("queue_key").agg(F.sum("n").alias("n"))
    named = sums.orderBy("queue_key").limit(QUEUES + 1).collect()
    if len(named) <= QUEUES:
        totals = np.array([r["n"] for r in named], np.int64)
        want = None if weights is None else np.array([weights.get(r["queue_key"], 0.0) for r in named])
        queues = docs.sparkSession.createDataFrame([(r["queue_key"], i) for i, r in enumerate(named)] or [("", 0)], "queue_key string, queue int")
        order = Window.partitionBy("queue_key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        base = parts.join(F.broadcast(queues), "queue_key")  # at most QUEUES rows
        base = materialize(base.select("queue_key", "pid", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "pack-bases")
        placed = _bases(tokens, base, BASE_ROWS)
        placed = placed.select("doc_id", "queue_key", "queue", (F.col("base") + F.col("local_start") + F.col("run_start")).alias("start"), "run_start", "doc_tokens", "ids")
    else:
        placed, totals, want = _dealt(tokens, parts, sums, weights, window)
    pieces = placed.mapInArrow(tidy(_pieces(totals, want, window)), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "ids")
