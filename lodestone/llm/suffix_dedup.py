"""Substring dedup with two-stage suffix sorting, in parallel.

A byte goes if a string of `window` bytes that covers it also starts in a document with a smaller doc_id. The suffixes of
a corpus fit no single task, so windows (suffixes cut at `window` bytes) are dealt out by content: each window is led by the
least hash among the GRAM-byte strings in it, so equal windows have equal leaders, and neighbouring windows mostly share
theirs. A maximal row of windows with one leader is a segment.

1. Documents are packed into batches (compressed; the unit of all later steps) and written once.
2. Leaders that occur in one document only cannot belong to a repeated window. Each batch sends its distinct leaders, with
   the least and greatest doc_id, to buckets by hash; a bucket answers with one bit for each, and another if the leader
   is crowded: led by more than CROWD different segments, as a common phrase in ever new surroundings is.
3. Each batch sends the distinct segments of the repeated leaders, with their least doc_id, to buckets; those of crowded
   leaders go one window at a time, each by its own hash. A bucket sorts the suffixes of its segments in two stages:
   suffixes smaller than their successor are sorted directly, all others are induced by one scan over the buckets of first
   bytes. Then the common prefix of every two neighbours is measured: stretches with prefixes of `window` bytes or more are
   equal windows, which the least doc_id among them owns. The bucket answers with the owner of each window.
4. Each batch marks the windows owned by a smaller doc_id and measures what is left.

A passage in any number of documents is one segment for each batch, and a phrase in any number of surroundings is dealt
out by these, so no bucket grows with the copies of one string. A row is a (batch, bucket) pair. Above BASE bytes of input
batches and buckets grow with its square root, so that rows grow in proportion to it and keep some KB each; both stop
growing at GROWTH times their size, which is what a worker of 2 GB holds, at some 60 TB for batches and 1.5 TB for buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import text_slices, tidy
from lodestone.llm.xxh import xxh64
from lodestone.plans.runtime import materialize, prepare, sweep

WINDOW, GRAM = 50, 24
#: Bytes of text in a batch, worked on at once, and for each bucket of leaders and of segments.
BATCH, TILE, LEADERS, SEGMENTS = 2 << 20, 1 << 20, 48 << 20, 12 << 20
#: Input up to which these sizes hold; how many times as large batches, and buckets, may become beyond.
BASE, GROWTH = 64 << 30, (32, 5)
#: Different segments of one leader, as far as batches differ in them, above which its windows are dealt out one by one.
CROWD = 20_000
#: Compression of texts, which are written once and dealt out twice.
TEXT_LEVEL = 3
NONE = np.iinfo(np.int64).max  # a null doc_id is larger than any other

_SCHEMA = "batch_id long, kind int, part long, n_bytes long, ids binary, sizes binary, blob binary"
_NAMES = ["batch_id", "kind", "part", "n_bytes", "ids", "sizes", "blob"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
TEXT, REPEATED, PLACES, ASKED, OWNERS = range(5)


def _row(batch_id, kind, part, blob, n_bytes=0, ids=None, sizes=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((batch_id, kind, part, n_bytes, ids, sizes, blob), _TYPES, strict=True)], names=_NAMES)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed byte plane by byte plane."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.compress(raw, 1)


def _expand(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(-1))
        at += n * w
    return out


# ---- segments ----


def _numbers(data: np.ndarray, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ndarray((len(data) - size + 1,), kind, data, strides=(1,))


def segments(data: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, leader's hash) of every segment of the texts in data."""
    n = len(data)
    first, count, lead = [], [], []
    whole = np.zeros(n + 1, np.int8)  # positions at which a window starts
    fits = np.diff(off) >= window
    whole[off[:-1][fits]] += 1
    whole[off[1:][fits] - window + 1] -= 1
    starts = np.cumsum(whole[:n], dtype=np.int8).view(bool)
    span = window - GRAM + 1
    padded = np.concatenate((data, np.zeros(window + GRAM, np.uint8)))
    with np.errstate(over="ignore"):
        for lo in range(0, n, TILE):
            hi = min(lo + TILE, n)
            u = _numbers(padded[lo : hi + window + GRAM], "<u8")
            m = hi - lo + window
            h = u[:m] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h += u[8 : m + 8]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h += u[16 : m + 16]
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
            width, least = 1, key
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            at = np.flatnonzero(starts[lo:hi])
            if not len(at):
                continue
            leader = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.append(True, (leader[1:] != leader[:-1]) | (at[1:] != at[:-1] + 1)))
            first.append(at[new] + lo)
            count.append(np.diff(np.append(new, len(at))))
            lead.append(h[leader[new]] * np.uint64(0x9E3779B97F4A7C15))
    if not first:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(lead)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


# ---- two-stage suffix sorting ----


def _steps(window: int) -> list[int]:
    """Offsets of 8-byte words that cover a window; the last may overlap the one before."""
    return sorted({*range(0, window - 7, 8), window - 8})


def sorted_suffixes(text: np.ndarray, cut: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Window starts of the strings text[cut[i]:cut[i + 1]] (each of `window` bytes or more), in order of their windows.

    Type B suffixes (smaller than their successor) are sorted directly by `window` bytes. Type A suffixes are induced: in
    a scan over buckets of first bytes, the predecessors of the suffixes placed so far come in their order.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(window + 8, np.uint8)))
    ends = np.zeros(n, bool)
    ends[cut[1:] - 1] = True
    differ = np.flatnonzero((padded[:n] != padded[1 : n + 1]) | ends)
    falls = ends[differ] | (text[differ] > padded[differ + 1])
    type_a = np.repeat(falls, np.diff(np.append(-1, differ)))
    # windows, and after the last window of a string what its induction needs: up to the first suffix of type B
    last = cut[1:] - window
    rises = np.append(np.flatnonzero(~type_a), n)
    stop = np.minimum(rises[np.searchsorted(rises, last)], cut[1:] - 1)
    edge = np.zeros(n + 1, np.int8)
    edge[cut[:-1]] += 1
    edge[stop + 1] -= 1
    needed = np.cumsum(edge[:n], dtype=np.int8).view(bool)
    begins = np.zeros(n, bool)
    begins[cut[:-1]] = True

    direct = np.flatnonzero(needed & ~type_a)
    big = _numbers(padded, ">u8")
    direct = direct[np.lexsort([big[direct + at] for at in reversed(_steps(window))])]
    at_byte = np.searchsorted(text[direct], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_out(placed: np.ndarray, above: int) -> None:
        before = placed[~begins[placed]] - 1
        before = before[needed[before] & type_a[before] & (text[before] > above)]
        if not len(before):
            return
        before = before[np.argsort(text[before], kind="stable")]
        byte = text[before]
        where = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        for a, b in zip(where, [*where[1:], len(byte)], strict=True):
            waiting[byte[a]].append(before[a:b])

    tails = cut[1:] - 1  # suffixes of one byte follow the end of their string, which is less than any byte
    tails = tails[needed[tails] & type_a[tails]]
    order = np.argsort(text[tails], kind="stable")
    for i in np.split(tails[order], np.flatnonzero(np.diff(text[tails[order]])) + 1) if len(tails) else []:
        waiting[text[i[0]]].append(i)
    out = []
    for c in range(256):
        lists = waiting[c]
        front = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        ready = [front]
        while len(front):  # runs of one byte: longer runs of type A are greater
            before = front[~begins[front]] - 1
            front = before[(text[before] == c) & needed[before]]
            ready.append(front)
        placed = np.concatenate((*ready, direct[at_byte[c] : at_byte[c + 1]]))
        if len(placed):
            hand_out(placed, c)
            out.append(placed)
    suffixes = np.concatenate(out) if out else np.zeros(0, np.int64)
    owner = np.searchsorted(cut, suffixes, side="right") - 1
    return suffixes[suffixes <= cut[owner + 1] - window]


def common_prefixes(text: np.ndarray, order: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bytes that each suffix in order has in common with the one before, up to `window`; 0 for the first."""
    big = _numbers(np.concatenate((text, np.zeros(window + 8, np.uint8))), ">u8")
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for at in _steps(window):
        differ = big[order[open_] + at] ^ big[order[open_ - 1] + at]
        same = differ == 0
        # leading equal bytes of the first words that differ
        own, x = open_[~same], differ[~same]
        equal = np.zeros(len(own), np.int64)
        for k in range(1, 8):
            equal += x < np.uint64(1) << np.uint64(64 - 8 * k)
        out[own] = at + equal
        open_ = open_[same]
    out[open_] = window
    return np.minimum(out, window)


def window_owners(text: np.ndarray, cut: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of the strings, in text order, the least owner of a string that holds it."""
    order = sorted_suffixes(text, cut, window)
    own = owner[np.searchsorted(cut, order, side="right") - 1]
    if len(order):
        run = np.flatnonzero(common_prefixes(text, order, window) < window)
        own = np.repeat(np.minimum.reduceat(own, run), np.diff(np.append(run, len(order))))
    out = np.empty(len(text), np.int64)
    out[order] = own
    return out[np.sort(order)]


# ---- the steps ----


def growth(total: int, most: int) -> float:
    """How many times their size batches or buckets have for an input of `total` bytes."""
    return min(max(1.0, (total / BASE) ** 0.5), most)


def expected_bytes(docs: DataFrame) -> int:
    """The optimizer's estimate of the input's size, or 0 if it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


#: Buckets up to which each has a partition of its own.
OWN_PARTITIONS = 4096


def even_labels(spark, n: int) -> np.ndarray | None:
    """Names for n buckets that Spark's hash partitioning deals to n partitions, one to each; above OWN_PARTITIONS None:
    then partitions have many buckets, whose numbers spread well enough."""
    if n > OWN_PARTITIONS:
        return None
    size = 32 * n + 1024
    while True:
        found = spark.range(size).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).orderBy("p").collect()  # n rows
        if len(found) == n:
            return np.array([r["id"] for r in found], np.int64)
        size *= 4


def _numbers_of(labels: np.ndarray | None):
    """From the name of a bucket to its number."""
    return (lambda x: x) if labels is None else {x: i for i, x in enumerate(labels.tolist())}.__getitem__


def _pack(limit: int):
    return lambda batches: _packed(batches, limit)


def _packed(batches: Iterator[pa.RecordBatch], limit: int):
    pid, seq = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    texts: list[bytes] = []
    held = 0

    def row():
        nonlocal seq, held
        out = _row((pid << 32) + seq, TEXT, 0, zstandard.compress(b"".join(texts), TEXT_LEVEL), held, np.concatenate(ids).tobytes(), np.concatenate(sizes).tobytes())
        seq, held = seq + 1, 0
        ids.clear(), sizes.clear(), texts.clear()
        return out

    for rows, data, off in text_slices(batches, "text", limit):
        if held and held + len(data) > limit:
            yield row()
        ids.append(rows.column("doc_id").fill_null(int(NONE)).to_numpy())
        sizes.append(np.diff(off))
        texts.append(data.tobytes())
        held += len(data)
    if ids:
        yield row()


def _text(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, doc_ids) of a batch."""
    data = np.frombuffer(zstandard.decompress(row["blob"]), np.uint8) if row["n_bytes"] else np.zeros(0, np.uint8)
    return data, np.append(0, np.cumsum(np.frombuffer(row["sizes"], np.int64))), np.frombuffer(row["ids"], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Consecutive rows with one key, which are sorted by it."""
    own: list[dict] = []
    for row in _rows(batches):
        if own and own[0][key] != row[key]:
            yield own
            own = []
        own.append(row)
    if own:
        yield own


def _leaders(data, off, ids, window):
    """Distinct leaders of a batch in order of hash, with the least and greatest doc_id; and each segment's place."""
    first, count, lead = segments(data, off, window)
    doc = ids[np.searchsorted(off, first, side="right") - 1]
    order = np.argsort(lead, kind="stable")
    h, d = lead[order], doc[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)]) - 1
    low = np.minimum.reduceat(d, start) if len(h) else d
    high = np.maximum.reduceat(d, start) if len(h) else d
    return first, count, place, doc, h[start], low, high


def _variety(data, first, count, place, n, window):
    """For each leader, its different segments in the batch (at most 255) and a byte that batches with the same ones share.
    Segments are told apart by a hash of their length, their ends and middle: this only decides how they are dealt out."""
    u = _numbers(np.concatenate((data, np.zeros(8, np.uint8))), "<u8")
    size = count + window - 1
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64)
        for at in (first, first + size // 2, first + size - 8):
            h = (h ^ u[at]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    key = np.sort((place.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    own = (key >> np.uint64(36)).astype(np.int64)
    kinds = np.minimum(np.bincount(own[new], minlength=n), 255).astype(np.uint8)
    least = key[np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])]
    return kinds, (least >> np.uint64(28)).astype(np.uint8)


def _ask_leaders(buckets: int, bits: int, window: int, labels: np.ndarray | None):
    def run(batches):
        for row in _rows(batches):
            data, off, ids = _text(row)
            first, count, place, _, h, low, high = _leaders(data, off, ids, window)
            kinds, sign = _variety(data, first, count, place, len(h), window)
            at = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(at)):
                p = slice(at[b], at[b + 1])
                yield _row(row["batch_id"], TEXT, int(b if labels is None else labels[b]), _squeeze(h[p] >> np.uint64(64 - bits), low[p], high[p] - low[p], kinds[p], sign[p]))

    return run


def _answer_leaders(crowd: int):
    def run(batches):
        for own in _groups(batches, "part"):
            parts = [_expand(r["blob"], "<u8", "<i8", "<i8", "u1", "u1") for r in own]
            h, low, high, kinds, sign = (np.concatenate([p[k] for p in parts]) for k in range(5))
            high += low
            order = np.argsort(h, kind="stable")
            k = h[order]
            start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(start, len(h)))
            many = np.minimum.reduceat(low[order], start) != np.maximum.reduceat(high[order], start)
            # different segments, but for those of the batches that agree most
            total = np.add.reduceat(kinds[order], start, dtype=np.int64)
            full = np.zeros(len(start), bool)
            for i in np.flatnonzero(total > crowd):
                run_ = order[start[i] : start[i] + size[i]]
                by_sign = np.bincount(sign[run_], weights=kinds[run_], minlength=256)
                alike = int(by_sign.argmax())
                full[i] = total[i] - by_sign[alike] + kinds[run_][sign[run_] == alike].max() > crowd
            flag = np.empty((2, len(h)), bool)
            for f, x in zip(flag, (many, full), strict=True):
                f[order] = np.repeat(x, size)
            at = 0
            for r, p in zip(own, parts, strict=True):
                bits = np.concatenate((flag[0, at : at + len(p[0])], flag[1, at : at + len(p[0])]))
                yield _row(r["batch_id"], REPEATED, r["part"], zstandard.compress(np.packbits(bits).tobytes(), 1))
                at += len(p[0])

    return run


def _ask_segments(leader_buckets: int, buckets: int, window: int, leader_labels: np.ndarray | None, labels: np.ndarray | None):
    def run(batches):
        number = _numbers_of(leader_labels)
        for own in _groups(batches, "batch_id"):
            data, off, ids = _text(own[0])
            first, count, place, doc, h, *_ = _leaders(data, off, ids, window)
            many, full = np.zeros(len(h), bool), np.zeros(len(h), bool)
            at = np.searchsorted(_bucket(h, leader_buckets), np.arange(leader_buckets + 1))
            for r in own[1:]:
                a, b = at[number(r["part"])], at[number(r["part"]) + 1]
                bits = np.unpackbits(np.frombuffer(zstandard.decompress(r["blob"]), np.uint8), count=2 * (b - a)).view(bool)
                many[a:b], full[a:b] = bits[: b - a], bits[b - a :]
            pick = np.flatnonzero(many[place])
            if not len(pick):
                continue
            key, first, count, doc, crowded = h[place[pick]], first[pick], count[pick], doc[pick], (many & full)[place[pick]]
            if crowded.any():  # one segment for each window, under a hash of its own
                alone = np.flatnonzero(crowded)
                each = np.repeat(alone, count[alone])
                at = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
                hashed = xxh64(np.concatenate((data, np.zeros(8, np.uint8))), at, np.full(len(at), window))
                key, first, doc = (np.concatenate((x[~crowded], y)) for x, y in ((key, hashed), (first, at), (doc, doc[each])))
                count = np.concatenate((count[~crowded], np.ones(len(each), np.int64)))
            order = np.argsort(key, kind="stable")  # hence by bucket
            key, first, count, doc = key[order], first[order], count[order], doc[order]
            raw = data.tobytes()
            seen: dict[bytes, int] = {}
            seg = np.empty(len(key), np.int64)
            for i, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
                seg[i] = seen.setdefault(raw[a : a + n + window - 1], len(seen))
            least = np.full(len(seen), NONE)
            np.minimum.at(least, seg, doc)
            lead = np.empty(len(seen), np.uint64)
            lead[seg] = key
            texts = list(seen)
            yield _row(own[0]["batch_id"], PLACES, 0, _squeeze(first, seg))
            cut = np.searchsorted(_bucket(lead, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                p = slice(cut[b], cut[b + 1])
                sizes = np.array([len(x) for x in texts[p]], np.uint16)
                yield _row(own[0]["batch_id"], ASKED, int(b if labels is None else labels[b]), zstandard.compress(b"".join(texts[p]), TEXT_LEVEL), 0, _squeeze(least[p]), _squeeze(sizes))

    return run


def _answer_segments(window: int):
    def run(batches):
        for own in _groups(batches, "part"):
            seen: dict[bytes, int] = {}
            which, low = [], []
            for r in own:
                raw, size = zstandard.decompress(r["blob"]), _expand(r["sizes"], "<u2")[0].astype(np.int64)
                end = np.cumsum(size).tolist()
                which.append(np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *end[:-1]], end, strict=True)]))
                low.append(_expand(r["ids"], "<i8")[0])
            least = np.full(len(seen), NONE)
            np.minimum.at(least, np.concatenate(which), np.concatenate(low))
            text = np.frombuffer(b"".join(seen), np.uint8)
            size = np.array([len(x) for x in seen])
            seen.clear()
            owners = window_owners(text, np.append(0, np.cumsum(size)), least, window)
            windows = size - window + 1
            start = np.cumsum(windows) - windows
            for r, w in zip(own, which, strict=True):
                n = windows[w]
                index = np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield _row(r["batch_id"], OWNERS, r["part"], _squeeze(owners[index]), 0, None, _squeeze(n.astype(np.uint16)))

    return run


def _measure(window: int, labels: np.ndarray | None):
    def run(batches):
        number = _numbers_of(labels)
        for own in _groups(batches, "batch_id"):
            own[2:] = sorted(own[2:], key=lambda r: number(r["part"]))  # segments are numbered by bucket
            data, off, ids = _text(own[0])
            # windows start once at a place, so at most `window` cover a byte
            edge = np.zeros(len(data) + 1, np.int8 if window < 128 else np.int16 if window < 1 << 15 else np.int32)
            if len(own) > 1:
                first, seg = _expand(own[1]["blob"], "<i8", "<i8")
                owner = np.concatenate([_expand(r["blob"], "<i8")[0] for r in own[2:]])
                n = np.concatenate([_expand(r["sizes"], "<u2")[0] for r in own[2:]]).astype(np.int64)
                start = np.cumsum(n) - n
                doc = ids[np.searchsorted(off, first, side="right") - 1]
                for lo in range(0, len(first), 1 << 16):
                    p = slice(lo, lo + (1 << 16))
                    size = n[seg[p]]
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    hit = owner[np.repeat(start[seg[p]], size) + step] < np.repeat(doc[p], size)
                    at = (np.repeat(first[p], size) + step)[hit]
                    edge[at] += 1
                    edge[at + window] -= 1
            gone = np.cumsum(edge[:-1], dtype=edge.dtype) > 0
            cut = np.zeros(len(data) + 2, bool)  # whether each byte goes, between two that stay
            cut[1:-1] = gone
            some = off[:-1] < off[1:]
            heads = off[:-1][some]
            first = np.zeros(len(data) + 1, bool)
            first[heads] = True
            begin = np.flatnonzero(gone & (~cut[:-2] | first[:-1]))
            end = np.flatnonzero(gone & (~cut[2:] | first[1:])) + 1
            left = np.diff(off)
            if len(heads):
                left[some] -= np.add.reduceat(gone, heads, dtype=np.int64)
            kept_off = np.append(0, np.cumsum(left)).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(kept_off), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            home = off[np.searchsorted(off, begin, side="right") - 1]
            pairs = pa.StructArray.from_arrays([pa.array(begin - home), pa.array(end - home)], ["start", "stop"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, off).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NONE), pa.array(np.diff(off)), kept, spans], names=["doc_id", "n_bytes", "kept", "spans"])

    return run


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What substring dedup leaves of every row: doc_id, n_bytes, kept (the bytes that stay) and spans (start and stop, in
    bytes, of each stretch that went).

    docs: doc_id long, text string (as UTF-8; null is empty); other columns are not read. Each byte goes that is covered by
    a string of `window` bytes (32 or more) which also starts in a document with a smaller doc_id. Matches do not cross
    documents; matches overlap freely and are judged on the input.

    - Rows that share a doc_id are not smaller than one another: neither loses bytes for the other's sake.
    - A null doc_id is larger than all others. A text under `window` bytes loses nothing. No rows give no rows.
    - A text longer than BATCH is a batch of its own: memory grows to some ten times the longest text.
    """
    if window < 32:
        raise ValueError("the window must have 32 bytes or more")
    spark = prepare(docs.sparkSession)
    sweep(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(rows.mapInArrow(tidy(_pack(int(BATCH * growth(expected_bytes(rows), GROWTH[0])))), _SCHEMA), "suffix-batches", "uncompressed")
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    larger = growth(total, GROWTH[1])
    leader_buckets, buckets = (max(12, int(-(-total // (size * larger)))) for size in (LEADERS, SEGMENTS))
    bits = min(64, total.bit_length() + 12)  # one leader of some 57,000 shares its bits with another by chance
    leader_labels, labels = (even_labels(spark, n) for n in (leader_buckets, buckets))

    def dealt(df: DataFrame, key: str, named: np.ndarray | None = None) -> DataFrame:
        """Rows by key; each bucket that has a name in a partition of its own."""
        by = df.repartition(key) if named is None else df.repartition(len(named), key)
        return by.sortWithinPartitions(key, "kind", "part", "batch_id")

    leaders = dealt(packed.mapInArrow(tidy(_ask_leaders(leader_buckets, bits, window, leader_labels)), _SCHEMA), "part", leader_labels)
    repeated = leaders.mapInArrow(tidy(_answer_leaders(CROWD)), _SCHEMA)
    asked = materialize(dealt(packed.unionByName(repeated), "batch_id").mapInArrow(tidy(_ask_segments(leader_buckets, buckets, window, leader_labels, labels)), _SCHEMA), "suffix-segments", "uncompressed")
    sweep(spark)  # the leaders and texts dealt out so far are as large as the input
    owners = dealt(asked.where(F.col("kind") == ASKED), "part", labels).mapInArrow(tidy(_answer_segments(window)), _SCHEMA)
    back = packed.unionByName(asked.where(F.col("kind") == PLACES)).unionByName(owners)
    return dealt(back, "batch_id").mapInArrow(tidy(_measure(window, labels)), "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digests of cut_repeats(): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    return cut_repeats(docs, window).select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
