"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: XXH64 of every word shingle, one vote for each bit. Equal fingerprints are one node. Two fingerprints
within the radius r agree on at least k - r of k blocks of bits, so each choice of k - r blocks gives a table of buckets,
and every linked pair meets in a bucket; k grows with the number of nodes so that buckets stay small. Within buckets the
bits are stored as vertical planes, 64 fingerprints to a machine word. Distances of 64 lanes to a query are kept in
bitwise carry-save counters; words whose lanes all exceed the radius are abandoned. A bucket gives a spanning forest of
its links (fewer edges than nodes), never its pairs. Crowded buckets are cut into blocks that meet two at a time in
tasks of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import LOWER, SLICE_BYTES, text_slices, tidy, word_end, words
from lodestone.llm.graph import components
from lodestone.llm.xxh import xxh64
from lodestone.plans.runtime import materialize, prepare

BITS = 64
#: Fingerprints of a bucket compared in one task; a larger bucket is cut into blocks of about half as many.
CROWD = 8192
#: Mean nodes in a bucket above which more blocks of bits are used.
BUCKET = 1024


def _shingles(data: np.ndarray, off: np.ndarray, size: int):
    """(words joined by single spaces; start, length and text of every shingle; shingles of each text)"""
    data = LOWER[data]
    start, end, text = words(data, off)
    n = len(off) - 1
    count = np.bincount(text, minlength=n)
    shingles = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(16, np.uint8), none, none, none, shingles
    long = end - start
    to = np.cumsum(long + 1) - (long + 1)
    joined = np.full(int(to[-1] + long[-1]) + 16, 0x20, np.uint8)
    ink = np.repeat(start - to, long) + (np.arange(long.sum()) + np.repeat(np.arange(len(long)), long))
    joined[ink - np.repeat(start - to, long)] = data[ink]
    first_word = np.cumsum(count) - count
    owner = np.repeat(np.arange(n), shingles)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    a = first_word[owner] + k
    b = np.minimum(a + size, first_word[owner] + count[owner]) - 1
    return joined, to[a], to[b] + long[b] - to[a], owner, shingles


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, offsets by text)"""
    joined, at, long, _, shingles = _shingles(data, off, size)
    return xxh64(joined, at, long, seed), np.append(0, np.cumsum(shingles))


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of a wide hash; the first are the hash itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = (h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def add_votes(votes: np.ndarray, h: np.ndarray, owner: np.ndarray) -> None:
    """Count, for each text, how many of its hashes set each bit; owner is the text of each hash, in order."""
    if not len(h):
        return
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for k in range(votes.shape[1] // BITS):
        bits = np.unpackbits(_spread(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[owner[at], BITS * k : BITS * (k + 1)] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)


def majority(votes: np.ndarray, voters: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes: rows of 64-bit words."""
    return np.packbits(2 * votes > voters[:, None], axis=1, bitorder="little").view("<u8").reshape(len(votes), -1)


def _votes(data: np.ndarray, off: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the number of shingles and how many of their hashes set each bit."""
    joined, start, long, owner, shingles = _shingles(data, off, size)
    votes = np.zeros((len(off) - 1, BITS), np.int64)
    for lo in range(0, len(owner), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        add_votes(votes, xxh64(joined, start[part], long[part], seed), owner[part])
    return shingles, votes


def long_pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text cut behind words so that the pieces' shingles, one after another, are those of the text.

    Each piece but the last has `size` words or more and the next one begins with its last size - 1 words; a last piece
    without a word of its own is left out.
    """
    lo, n, fresh = 0, len(data), True
    while lo < n:
        hi = word_end(data, min(lo + SLICE_BYTES, n))
        start = words(data[lo:hi], np.array([0, hi - lo]))[0]
        while len(start) < size and hi < n:
            hi = word_end(data, min(hi + max(hi - lo, SLICE_BYTES), n))
            start = words(data[lo:hi], np.array([0, hi - lo]))[0]
        if fresh or len(start) >= size:
            yield data[lo:hi]
        if hi >= n:
            return
        lo, fresh = lo + int(start[-(size - 1)]) if size > 1 else hi, False


def fingerprints(data: np.ndarray, off: np.ndarray, size: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned fingerprints of texts; a text without words has zero."""
    if len(off) == 2 and len(data) > 2 * SLICE_BYTES:
        shingles, votes = np.zeros(1, np.int64), np.zeros((1, BITS), np.int64)
        for part in long_pieces(data, size):
            more, also = _votes(part, np.array([0, len(part)]), size, seed)
            shingles, votes = shingles + more, votes + also
    else:
        shingles, votes = _votes(data, off, size, seed)
    return majority(votes, shingles)[:, 0]


def _find(batches, size: int, seed: int):
    for rows, data, off in text_slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(data, off, size, seed).view(np.int64))], names=["doc_id", "fp"])


# ---- comparison ----

_BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
_ALL = _BELOW[64]


def planes(fp: np.ndarray) -> np.ndarray:
    """Vertical planes of fingerprints (rows of words): word w of plane b holds bit b of rows 64 w to 64 w + 63."""
    full = np.zeros((-(-len(fp) // 64) * 64, fp.shape[1]), np.uint64)
    full[: len(fp)] = fp
    bits = np.unpackbits(full.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _near(store: np.ndarray, fp: np.ndarray, query: np.ndarray, word: np.ndarray, live: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) within the radius among the live lanes of (query, word).

    Counters of w bits count to 2^w - 1 >= radius; a lane that overflows is dead, and a word without live lanes is
    abandoned.
    """
    width = max(1, radius.bit_length())
    counter = [np.zeros(len(query), np.uint64) for _ in range(width)]
    value = fp[query]
    for b in range(0, len(store), 2):
        own = value[:, b // BITS]
        x = store[b, word] ^ (np.uint64(0) - ((own >> np.uint64(b % BITS)) & np.uint64(1)))
        y = store[b + 1, word] ^ (np.uint64(0) - ((own >> np.uint64(b % BITS + 1)) & np.uint64(1)))
        # carry-save: counter 0 and two planes give a sum and a carry
        odd = x ^ y
        carry = (x & y) | (odd & counter[0])
        counter[0] = counter[0] ^ odd
        for k in range(1, width):
            carry, counter[k] = counter[k] & carry, counter[k] ^ carry
        live = live & ~carry
        if b % 8 == 6:
            keep = np.flatnonzero(live)
            if len(keep) < 0.8 * len(live):
                query, word, live, value = query[keep], word[keep], live[keep], value[keep]
                counter = [c[keep] for c in counter]
                if not len(query):
                    break
    if not len(query):
        return query, query
    at, lane = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    i, j = query[at], 64 * word[at] + lane
    close = distance(fp[i], fp[j]) <= radius
    return i[close], j[close]


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by group) of one group whose fingerprints are within the radius, some at a time."""
    n = len(fp)
    if n < 2:
        return
    store = planes(fp)
    last = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    stop = last[np.searchsorted(last, np.arange(n), side="right")]
    row = np.arange(n)
    reach = (stop - 1) // 64 - row // 64  # words after a row's own that its group enters
    for o in range(int(reach.max()) + 1):
        q = np.flatnonzero((reach >= o) & (stop > row + 1))
        w = q // 64 + o
        lo = np.clip(q + 1 - 64 * w, 0, 64)
        hi = np.clip(stop[q] - 64 * w, 0, 64)
        mask = _BELOW[hi] & ~_BELOW[lo]
        some = np.flatnonzero(mask)
        for part in range(0, len(some), 1 << 14):
            at = some[part : part + (1 << 14)]
            i, j = _near(store, fp, q[at], w[at], mask[at], radius)
            if len(i):
                yield i, j


def forest(fp: np.ndarray, group: np.ndarray, radius: int = 3) -> np.ndarray:
    """For rows sorted by group, the first row of each row's component within its group."""
    label = np.arange(len(fp))
    for i, j in close_pairs(fp, group, radius):
        while len(i):
            a, b = label[i], label[j]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, nearer := label[label]):
                label = nearer
    return label


def links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect the rows of each group as all such pairs do: fewer than there are rows."""
    label, found = np.arange(len(fp)), []
    for i, j in close_pairs(fp, group, radius):
        while len(i):
            a, b = label[i], label[j]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                break
            i, j = i[apart], j[apart]
            hi, lo = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            _, first = np.unique(hi, return_index=True)  # one pair for each component that joins a smaller one
            found.append((i[first], j[first]))
            label[hi[first]] = lo[first]
            while not np.array_equal(label, nearer := label[label]):
                label = nearer
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (label[:0], label[:0])


def per_bucket(work, words: tuple[str, ...]):
    """Run work(fingerprints, groups, table) on whole buckets (k1, k2), by which the rows are sorted."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
            change = np.append(False, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
            fp = np.column_stack([table.column(c).to_numpy() for c in words]).view(np.uint64)
            yield from work(fp, np.cumsum(change), table)

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < 1 << 15:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
            cut = int(np.flatnonzero((k1 == k1[-1]) & (k2 == k2[-1]))[0])  # the last group may go on
            if cut:
                yield from flush(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), len(table) - cut
        if rows:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _edges(radius: int):
    def work(fp, group, table):
        node, root = table.column("node").to_numpy(), forest(fp, group, radius)
        more = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(node[more]), pa.array(node[root[more]])], names=["a", "b"])

    return per_bucket(work, ("fp",))


def _tables(nodes: int, radius: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bit ranges of each table's key, and the key's width."""
    for k in range(radius + 1, 2 * radius + 5):
        cuts = [round(BITS * i / k) for i in range(k + 1)]
        blocks = list(zip(cuts[:-1], cuts[1:], strict=True))
        out = [([*c], sum(b - a for a, b in c)) for c in itertools.combinations(blocks, k - radius)]
        if nodes <= BUCKET * 2 ** min(w for _, w in out):
            break
    return out


def _key(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    key, at = F.lit(0).cast("long"), 0
    for a, b in ranges:
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1), at))
        at += b - a
    return key


def in_blocks(dealt: DataFrame, crowd: int, *words: str) -> DataFrame:
    """Rows of buckets (k1, n rows each) dealt out to tasks by (k1, k2): buckets above `crowd` are cut into blocks of about
    half as many rows by a hash of the fingerprint, and every two blocks meet. Sorted by node inside, so that the edges of
    a bucket lead to its least node and the components need few steps."""
    blocks = F.when(F.col("n") > crowd, F.ceil(F.col("n") / (crowd // 2)).cast("int"))
    cut = dealt.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(*words), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.shiftleft(F.least(x, F.col("own")).cast("long"), 31) + F.greatest(x, F.col("own")))
    cut = cut.withColumn("k2", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)))
    return cut.drop("blocks", "own", "n").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "node")


def link(nodes: DataFrame, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between nodes (fp, node) that connect the same nodes as all pairs of fingerprints within radius."""
    tables = _tables(nodes.count(), radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), _key(F.col("fp"), ranges).alias("key")) for t, (ranges, _) in enumerate(tables)))
    dealt = nodes.select("fp", "node", F.explode(keys).alias("x")).select("fp", "node", (F.shiftleft(F.col("x.t").cast("long"), 40) + F.col("x.key")).alias("k1"))
    crowded = dealt.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    near = in_blocks(dealt.join(crowded, "k1", "left"), crowd, "fp")
    return near.mapInArrow(_edges(radius), "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, crowd: int = CROWD) -> DataFrame:
    """Near-duplicate groups: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that can be reached).

    docs: doc_id long, text string; other columns are not read. Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in
    lower case. A text with fewer words than a shingle is one shingle; one without words, or null, has fingerprint zero
    and is linked like any other. Rows that repeat a doc_id each give a row. A row without doc_id links others like any
    other; a null doc_id is never the smallest, so only a component without any doc_id has a null component_id.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = materialize(rows.mapInArrow(tidy(lambda batches: _find(batches, shingle, seed)), "doc_id long, fp long"), "simhash-facts")
    nodes = materialize(facts.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(link(nodes.select("fp", F.col("fp").alias("node")), radius, crowd))
    whole = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "root").select("fp", "component_id")
    return facts.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
