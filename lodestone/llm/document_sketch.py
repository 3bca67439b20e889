"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds every different shingle hash below a fixed part, 1 / SCALE, of the hash range, so it grows with the
text, and two sketches of very unequal texts still hold the same sample of what the texts share: containment is counted
in it directly. Texts with fewer than FLOOR such hashes keep their FLOOR least ones, so that short texts can be told
apart; a sketch is then complete up to its last hash only, and comparisons stay below that. The sketch of a union is made
from the sketches alone (`merge_sketches`).

Neighbours in the order of doc_id are compared without a join: rows are dealt out by ranges of doc_id, each range is read
in order, and its last row meets the first one of the next range, which is sent to both.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import SLICE_BYTES, slices, text_slices, tidy
from lodestone.llm.simhash import long_pieces, shingle_hashes
from lodestone.llm.suffix_dedup import even_labels
from lodestone.plans.runtime import prepare

SHINGLE, SCALE, FLOOR = 5, 8, 16
#: Hashes have 63 bits, so that they are positive longs.
RANGE = 1 << 63

# ---- sketches of texts, in NumPy ----


def _least(h: np.ndarray, scale: int, floor: int) -> np.ndarray:
    """The sketch of a set of hashes, sorted."""
    low = np.unique(h[h < np.uint64(RANGE // scale)])
    return low if len(low) >= floor else np.unique(h)[:floor]


def sketches(data: np.ndarray, off: np.ndarray, size: int = SHINGLE, scale: int = SCALE, floor: int = FLOOR) -> list[np.ndarray]:
    """The sketch of every text; long texts are read in pieces."""
    out = []
    for lo, hi in slices(off):
        text = data[off[lo] : off[hi]]
        if hi - lo == 1 and len(text) > 2 * SLICE_BYTES:
            held = np.zeros(0, np.uint64)
            for part in long_pieces(text, size):
                own = shingle_hashes(part, np.array([0, len(part)]), size)[0] >> np.uint64(1)
                held = np.union1d(held, _least(own, scale, floor))
            out.append(_least(held, scale, floor))
        else:
            h, at = shingle_hashes(text, off[lo : hi + 1] - off[lo], size)
            h >>= np.uint64(1)
            out += [_least(h[a:b], scale, floor) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _limit(x: np.ndarray, scale: int, floor: int) -> int:
    """A sketch holds all hashes of its text below this."""
    if len(x) < floor:
        return RANGE
    return RANGE // scale if x[floor - 1] < RANGE // scale else int(x[-1]) + 1


def contained(x: np.ndarray, y: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> float:
    """The part of x's shingles that y has, as far as both sketches are complete. Two texts without words contain each
    other; where no hash of x is left to compare the part is 0."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    x = x[: np.searchsorted(x, np.uint64(min(_limit(x, scale, floor), _limit(y, scale, floor), RANGE - 1)), side="left")]
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return float((y[at] == x).mean()) if len(x) else 0.0


def as_hex(x: np.ndarray) -> str:
    """16 digits for each hash."""
    return x.astype(">u8").tobytes().hex()


# ---- sketches as columns ----


def _sketch(size: int, scale: int, floor: int):
    def run(batches):
        for rows, data, off in text_slices(batches, "text"):
            own = sketches(data, off, size, scale, floor)
            ends = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32)
            values = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "sketch"])

    return run


def sketch_documents(docs: DataFrame, size: int = SHINGLE, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """doc_id and sketch (array of long, ascending) of every row of docs (doc_id long, text string; others are not read).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text with fewer words than a shingle is one shingle; one
    without words, or null, has an empty sketch.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_sketch(size, scale, floor)), "doc_id long, sketch array<long>")


def containment(x: Column, y: Column, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """contained() of two columns of sketches."""

    def limit(s: Column) -> Column:
        full = F.when(F.element_at(s, floor) < RANGE // scale, F.lit(RANGE // scale)).otherwise(F.element_at(s, -1) + 1)
        return F.when(F.size(s) < floor, F.lit(RANGE - 1)).otherwise(full)

    most = F.least(limit(x), limit(y))
    own = F.filter(x, lambda h: h < most)
    part = F.when(F.size(own) > 0, F.size(F.array_intersect(own, y)) / F.size(own)).otherwise(0.0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.size(x) == F.size(y)).cast("double")).otherwise(part)


def merge_sketches(rows: DataFrame, *keys: str, sketch: str = "sketch", scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """keys and hash: the sketch of the union of each group's texts, a row for each hash.

    Rows stay rows, so a group may be of any size; equal hashes meet before the shuffle. Only groups with fewer than
    `floor` hashes below the fixed part are ranked, and those have few others.
    """
    each = rows.select(*keys, F.explode(sketch).alias("hash")).distinct()
    below = F.col("hash") < RANGE // scale
    group = F.struct(*keys) if keys else F.lit(0)
    dense = each.where(below).groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= floor).select("_group")
    kept = each.where(below).join(dense, F.col("_group").eqNullSafe(group), "left_semi")
    few = each.join(dense, F.col("_group").eqNullSafe(group), "left_anti")
    least = few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set("hash")), 1, floor).alias("_least"))
    return kept.select(*keys, "hash").unionByName(least.select(*keys, F.explode("_least").alias("hash")))


# ---- documents beside their edited selves and their neighbours ----

FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, code points) of every text but the last, its last half replaced by the beginning of the next one:
    of n code points the last floor(n / 2) give way to as many, or all, of the next text's first ones."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    base = np.searchsorted(lead, off)
    n = np.diff(base)
    lead = np.append(lead, len(data))
    half = n[:-1] // 2
    cut = lead[base[:-2] + n[:-1] - half]
    stop = lead[base[1:-1] + np.minimum(half, n[1:])]
    parts = [data[a:b] for own in zip(off[:-2], cut, off[1:-1], stop, strict=True) for a, b in (own[:2], own[2:])]
    sizes = (cut - off[:-2]) + (stop - off[1:-1])
    return np.concatenate(parts) if parts else data[:0], np.append(0, np.cumsum(sizes)), n[:-1]


def _beside(size: int, scale: int, floor: int):
    """Results for rows sorted by (bucket, extra, order); a bucket's rows with extra = 1 begin the next one."""

    def finish(ids, data, off, own):
        """Results of all texts but the last; own: their sketches."""
        text, at, n = edited(data, off)
        changed = sketches(text, at, size, scale, floor)
        view = memoryview(np.ascontiguousarray(text))
        sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        near = [contained(x, y, scale, floor) for x, y in zip(own[:-1], changed, strict=True)]
        after = [contained(x, y, scale, floor) for x, y in zip(own[:-1], own[1:], strict=True)]
        cells = [ids[:-1], n, sha, [as_hex(x) for x in own[:-1]], [as_hex(x) for x in changed], near, after]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, FIELDS.values(), strict=True)], names=list(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]):
        held = None  # (bucket, doc_id, bytes, sketch) of the last text, which waits for its next one
        for rows, data, off in text_slices(batches, "text"):
            bucket, extra = (rows.column(c).to_numpy() for c in ("bucket", "extra"))
            ids = rows.column("doc_id").to_pylist()
            begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(begins, np.append(begins[1:], len(bucket)), strict=True):
                own = int(np.searchsorted(extra[a:b], 1)) + a  # rows of the bucket itself, then at most one that follows
                b = min(b, own + 1)
                if held is None and own == a:
                    continue  # the bucket is done
                text, at, names = data[off[a] : off[b]], off[a : b + 1] - off[a], ids[a:b]
                made = sketches(text, at, size, scale, floor)
                if held is not None:
                    text, at = np.concatenate((held[1], text)), np.append(0, at + len(held[1]))
                    names, made = [held[0], *names], [held[2], *made]
                if len(names) > 1:
                    yield finish(names, text, at, made)
                held = None if b > own else (names[-1], text[at[-2] :].copy(), made[-1])

    return run


def _cuts(rows: DataFrame, n: int) -> list[int]:
    """Up to n - 1 places in the order of ids that cut the rows into even ranges; a hot id is named several times."""
    if n < 2:
        return []
    at = F.percentile_approx("place", [i / n for i in range(1, n)], 20 * max(n, 500))
    return rows.agg(at).first()[0] or []  # fewer than n numbers


def _bucket_of(cuts: list[int]):
    """The range of a row, in order. An id that is several cuts is a range of its own, cut by h into as many parts."""
    first = [c for c, before in zip(cuts, [None, *cuts], strict=False) if c != before]
    times = [bisect.bisect_right(cuts, c) - bisect.bisect_left(cuts, c) for c in first]
    parts = np.array([t if t > 1 else 0 for t in times], np.int64)
    start = np.append(0, np.cumsum(parts + 1))  # the range that ends with each cut, before the parts of its own
    first = np.array(first, np.int64)

    @F.pandas_udf("int")
    def bucket(place: pd.Series, h: pd.Series) -> pd.Series:
        k = np.searchsorted(first, place.to_numpy(), side="left")
        out = start[k]
        if len(first):
            hit = np.minimum(k, len(first) - 1)
            same = (first[hit] == place.to_numpy()) & (k < len(first)) & (parts[hit] > 0)
            share = (h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
            part = np.minimum((share * parts[hit]).astype(np.int64), parts[hit] - 1)
            out = np.where(same, out + 1 + part, out)
        return pd.Series(out.astype(np.int32))

    return bucket, int(start[-1]) + 1


def neighbour_fingerprints(docs: DataFrame, size: int = SHINGLE, scale: int = SCALE, floor: int = FLOOR, ranges: int | None = None) -> DataFrame:
    """For every row of docs its sketch, that of its edited text, and how much of it they and the next document hold.

    docs: doc_id long, text string (null: empty); other columns are not read. doc_id, n_chars (code points),
    edited_sha256, fingerprint and edited_fingerprint (16 hex digits a hash, ascending), near_edited and near_next
    (contained(): 1 if all of the text's shingles are in the other). In the edited text the last floor(n_chars / 2) code
    points give way to as many, or all, of the first of the next document by doc_id; after the last comes the first.

    - Null ids come first. Rows that share an id are in the order of a hash of their texts; equal rows follow one another.
    - A single row is its own next one. An empty text has an empty fingerprint, which contains no other text's.
    - No rows give no rows. A text is read in pieces, and is in memory about six times beside its next one.
    - `ranges` (by default spark.sql.shuffle.partitions) tasks each read a range of ids.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    bucket, n = _bucket_of(_cuts(rows, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = F.struct("place", F.col("doc_id").isNotNull().alias("named"), "h")
    dealt = rows.withColumn("bucket", bucket("place", "h"))
    begin = {r["bucket"]: tuple(r["least"]) for r in dealt.groupBy("bucket").agg(F.min(order).alias("least")).collect()}  # a row for each range
    used = sorted(begin)
    before = dict(zip(used, used[-1:] + used[:-1], strict=True))
    firsts = spark.createDataFrame([(b, *begin[b], before[b]) for b in used], "bucket int, place long, named boolean, h long, goes int")
    labels = even_labels(spark, n)
    name = lambda c: c.cast("long") if labels is None else F.element_at(F.array(*(F.lit(int(x)) for x in labels)), c + 1)
    also = dealt.withColumn("named", F.col("doc_id").isNotNull()).join(F.broadcast(firsts), ["bucket", "place", "named", "h"], "left")  # one row for each range
    own = F.struct(F.col("bucket"), F.lit(0).alias("extra"))
    both = F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("goes").alias("bucket"), F.lit(1).alias("extra"))))
    sent = also.select("doc_id", "text", "place", "named", "h", F.explode(both).alias("to")).select("*", "to.*").withColumn("bucket", name(F.col("bucket")))
    sent = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "place", "named", "h").select("bucket", "extra", "doc_id", "text")
    return sent.mapInArrow(tidy(_beside(size, scale, floor)), RESULT)
