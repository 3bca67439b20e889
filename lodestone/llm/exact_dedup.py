"""Exact dedup by composable polynomial fingerprints.

A text's bytes b0 b1 ... are the digits of a number in base B, taken modulo two primes. The value of a
concatenation follows from the parts: H(xy) = H(x) * B^|y| + H(y). So blocks are hashed independently (one matrix
product hashes the blocks of many documents at once, pieces of a huge one too) and combined by length-shifted
arithmetic. Texts with equal fingerprint and length are compared chunk by chunk: for each (fingerprint, length, chunk
number) the least and the greatest chunk are aggregated, which partial aggregation combines before the shuffle, so that
a group of copies of any size costs one chunk for each map task. Groups whose chunks differ are split by whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import collapse, text_slices
from lodestone.plans.runtime import materialize, prepare

#: The two largest primes below 2^31, and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
BLOCK = 512
CHUNK = 4096
#: Groups of copies up to which their keys (16 bytes each) are sent to every task.
BROADCAST_GROUPS = 200_000
#: Pieces of a longer text are hashed one after another.
PIECE = 4 << 20


class Polynomial:
    """Fingerprints modulo `moduli`; each is (value per modulus, length)."""

    def __init__(self, moduli: tuple[int, int] = MODULI, bases: tuple[int, int] = BASES):
        self.moduli, self.bases = moduli, bases
        self.weights = np.array([[pow(b, BLOCK - 1 - j, m) for m, b in zip(moduli, bases, strict=True)] for j in range(BLOCK)], np.float64)
        self.shifts = [np.ones(1, np.uint64) for _ in moduli]

    def shift(self, k: int, n: int) -> np.ndarray:
        """B^(BLOCK * t) for t below n."""
        m = self.moduli[k]
        while len(self.shifts[k]) < n:
            t = len(self.shifts[k])
            self.shifts[k] = np.concatenate((self.shifts[k], self.shifts[k] * np.uint64(pow(self.bases[k], BLOCK * t, m)) % np.uint64(m)))
        return self.shifts[k]

    def combine(self, left: tuple[list[int], int], right: tuple[list[int], int]) -> tuple[list[int], int]:
        """The fingerprint of a concatenation."""
        return [(x * pow(b, right[1], m) + y) % m for x, y, m, b in zip(left[0], right[0], self.moduli, self.bases, strict=True)], left[1] + right[1]

    def many(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Values of many texts, one row each."""
        size = np.diff(off)
        blocks = -(-size // BLOCK)
        end = np.cumsum(blocks)
        out = np.zeros((len(size), len(self.moduli)), np.uint64)
        if not len(size) or not end[-1]:
            return out
        flat = np.zeros(end[-1] * BLOCK, np.uint8)
        # right-aligned in its blocks: leading zeros do not change the number
        flat[np.arange(len(data)) + np.repeat(end * BLOCK - off[1:], size)] = data
        sums = flat.reshape(-1, BLOCK).astype(np.float64) @ self.weights  # exact: below 2^48
        full = blocks > 0
        owner_end = np.repeat(end, blocks)
        t = owner_end - 1 - np.arange(end[-1])
        starts = (end - blocks)[full]
        for k, m in enumerate(self.moduli):
            value = sums[:, k].astype(np.uint64) % np.uint64(m) * self.shift(k, int(blocks.max()))[t] % np.uint64(m)
            out[full, k] = np.add.reduceat(value, starts) % np.uint64(m)
        return out

    def one(self, data: np.ndarray) -> tuple[list[int], int]:
        """A long text, piece by piece."""
        whole: tuple[list[int], int] = ([0] * len(self.moduli), 0)
        for at in range(0, len(data), PIECE):
            part = data[at : at + PIECE]
            whole = self.combine(whole, ([int(x) for x in self.many(part, np.array([0, len(part)]))[0]], len(part)))
        return whole

    def keys(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) == 2 and len(data) > PIECE:
            values = np.array([self.one(data)[0]], np.uint64)
        else:
            values = self.many(data, off)
        return (values[:, 0] << np.uint64(31) | values[:, 1]).astype(np.int64)


FACTS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("mark", pa.int64())])
CHUNKS = pa.schema([("fp", pa.int64()), ("n_bytes", pa.int64()), ("seq", pa.int64()), ("chunk", pa.binary())])
WHOLE = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("norm", pa.binary()), ("mark", pa.int64())])


def _normalised(batches: Iterator[pa.RecordBatch], poly: Polynomial):
    for rows, data, off in text_slices(batches, "text"):
        data, off = collapse(data, off)
        yield rows, data, off, poly.keys(data, off)


def _facts(poly_args):
    def run(batches):
        poly = Polynomial(*poly_args)
        for rows, data, off, fp in _normalised(batches, poly):
            raw = memoryview(np.ascontiguousarray(data))
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("uid"), pa.array(fp), pa.array(np.diff(off)), pa.array(sha, pa.string()), rows.column("mark")], schema=FACTS)

    return run


def _chunks(poly_args):
    def run(batches):
        poly = Polynomial(*poly_args)
        for _, data, off, fp in _normalised(batches, poly):
            size = np.diff(off)
            count = -(-size // CHUNK)
            owner = np.repeat(np.arange(len(size)), count)
            if not len(owner):
                continue
            seq = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            lo = off[owner] + seq * CHUNK
            cut = np.append(lo, off[-1]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([pa.array(fp[owner]), pa.array(size[owner]), pa.array(seq), blob], schema=CHUNKS)

    return run


def _whole(poly_args):
    def run(batches):
        poly = Polynomial(*poly_args)
        for rows, data, off, fp in _normalised(batches, poly):
            blob = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("uid"), pa.array(fp), pa.array(np.diff(off)), blob, rows.column("mark")], schema=WHOLE)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "string": "string", "binary": "binary", "double": "double", "int32": "int", "bool": "boolean"}
    return ", ".join(f"`{f.name}` {names[str(f.type)]}" for f in schema)


def exact_dedup(docs: DataFrame, moduli: tuple[int, int] = MODULI, bases: tuple[int, int] = BASES) -> DataFrame:
    """Group equal texts; of each group the row with the smallest doc_id stays.

    docs: doc_id long, text string; further columns, whatever their names, are not read. Returns, for each row, doc_id,
    keep_id, group_size, kept, text_sha256, n_bytes, fp, mark and keep_mark, in no order. mark is the xxhash64 of the row's
    own text, keep_mark that of the row that stays.

    - Texts are equal when identical after replacing each `[\\x20\\x09-\\x0D]+` by one space; null counts as empty.
    - Rows that repeat a doc_id with the same text: one of them stays, kept is true once in a group.
    - A null doc_id comes after all others: it stays only if the whole group has none (keep_id is then null).
    - No rows give no rows. Texts of any length are hashed and compared in pieces.
    """
    prepare(docs.sparkSession)
    args = (tuple(moduli), tuple(bases))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    facts = materialize(rows.mapInArrow(_facts(args), _ddl(FACTS)), "exact-facts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "mark")).alias("first")
    # written, so that both joins below have plain exchanges on either side, whose hot partitions are split
    groups = materialize(facts.groupBy("fp", "n_bytes").agg(first, F.count(F.lit(1)).alias("group_size")), "exact-groups")

    many = groups.where("group_size > 1").select("fp", "n_bytes")
    if many.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        many = F.broadcast(many)  # else texts and groups meet by a shuffle, whose hot partitions are split
    suspects = rows.mapInArrow(_chunks(args), _ddl(CHUNKS)).join(many, ["fp", "n_bytes"], "left_semi")
    # another key than the join's, so that chunks are combined before they are dealt out again
    lane = F.xxhash64("fp", "n_bytes", "seq").alias("lane")
    compared = suspects.groupBy(lane, "fp", "n_bytes", "seq").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    unequal = materialize(compared.where("lo <> hi").select("fp", "n_bytes").distinct(), "exact-unequal")

    pick = [F.col("doc_id"), F.col("first.doc_id").alias("keep_id"), "group_size", F.expr("first.uid = uid").alias("kept"), "text_sha256", "n_bytes", "fp", "mark", F.col("first.mark").alias("keep_mark")]
    if unequal.isEmpty():
        return facts.join(groups, ["fp", "n_bytes"]).select(*pick)
    good = facts.join(groups.join(unequal, ["fp", "n_bytes"], "left_anti"), ["fp", "n_bytes"]).select(*pick)
    texts = materialize(rows.mapInArrow(_whole(args), _ddl(WHOLE)).join(unequal, ["fp", "n_bytes"], "left_semi"), "exact-texts")
    split = texts.groupBy("fp", "n_bytes", "norm").agg(first, F.count(F.lit(1)).alias("group_size"))
    apart = texts.join(split, ["fp", "n_bytes", "norm"]).withColumn("text_sha256", F.sha2("norm", 256)).select(*pick)
    return good.unionByName(apart)
