"""SimHash near-dedup of a corpus at a similarity of word shingles: the wide form of simhash.py.

Texts of Jaccard similarity 0.8 differ in about 10 of 64 fingerprint bits, which no choice of equal blocks finds. So
buckets come from bands of min-hashes over the shingle hashes that vote for the fingerprint: two texts of similarity s
share one of BANDS bands with the chance 1 - (1 - s^ROWS)^BANDS, 0.9996 at s = 0.8 and more above. In a bucket the wide
fingerprints (WIDTH words) are compared bit-sliced; pairs within a radius, 4 standard deviations above the mean distance
at similarity 0.8, are candidates, of which a bucket passes on a spanning forest.

What candidates connect is a family, in which whole shingle sets decide. A family's sets meet in one task, which counts
the common shingles of all its pairs by products of incidence matrices and passes on a spanning forest of the similar
ones. A larger family is cut into parts that share some members (pivots), so that what is alike ends up connected; then
only members outside its largest group are compared with all others, part by part. Pairs are never rows. Texts with the
same sequence of shingles are one node.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import SLICE_BYTES, text_slices, tidy
from lodestone.llm.graph import components
from lodestone.llm.simhash import BITS, CROWD, add_votes, in_blocks, links, long_pieces, majority, per_bucket, shingle_hashes
from lodestone.plans.runtime import materialize, prepare, release

#: Words of a shingle, and the similarity from which texts are near duplicates.
SHINGLE, LEVEL = 5, 0.8
BANDS, ROWS = 20, 5
#: Words of a fingerprint, and the names of their columns.
WIDTH = 8
WORDS = tuple(f"w{k}" for k in range(WIDTH))
#: Texts with a candidate up to which their keys are sent to every task.
BROADCAST_ROWS = 200_000
#: Members of a family, and bytes of their sets, that meet in one task; members that all parts of a larger one share.
MEMBERS, SET_BYTES, PIVOTS = 4096, 32 << 20, 64
#: Families' members (two numbers each) sent to every task that reads sets; more meet them by a shuffle.
BROADCAST_MEMBERS = 1_000_000

_ODD = np.random.default_rng(42).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def reach(level: float, bits: int = BITS * WIDTH) -> int:
    """Bits in which texts of a similarity of `level` or more differ at most, but for chances beyond 4 standard deviations.

    Fingerprints of vectors at an angle differ in each bit with the chance angle / pi; equal weights for all shingles, of
    which a share of 2 s / (1 + s) is common, give its cosine.
    """
    p = math.acos(min(1.0, 2 * level / (1 + level))) / math.pi
    return min(bits, math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p))))


def _parts(data: np.ndarray, off: np.ndarray, size: int):
    """(hashes, offsets by text), one after another for a long text."""
    if len(off) == 2 and len(data) > 2 * SLICE_BYTES:
        for part in long_pieces(data, size):
            yield shingle_hashes(part, np.array([0, len(part)]), size)
    else:
        yield shingle_hashes(data, off, size)


def signatures(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, band keys, whether there is a shingle) of texts; node is a digest of the shingles in order."""
    n = len(off) - 1
    least = np.full((n, BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    digest = [hashlib.blake2b(digest_size=8) for _ in range(n)]
    some = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for h, at in _parts(data, off, size):
            raw = memoryview(h.tobytes())
            for d, a, b in zip(digest, at[:-1].tolist(), at[1:].tolist(), strict=True):
                d.update(raw[8 * a : 8 * b])
            own = np.flatnonzero(np.diff(at))
            some[own] = True
            if len(own):
                for k, odd in enumerate(_ODD):
                    least[own, k] = np.minimum(least[own, k], np.minimum.reduceat(h * odd, at[own]))
        keys = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
        for r in range(ROWS):
            keys = (keys ^ (keys >> np.uint64(29)) ^ least[:, r::ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
    node = np.frombuffer(b"".join(d.digest() for d in digest), "<i8")
    return node, keys.view(np.int64), some


def _facts(size: int):
    def run(batches):
        for rows, data, off in text_slices(batches, "text"):
            node, keys, some = signatures(data, off, size)
            ends = np.append(0, np.cumsum(np.where(some, BANDS, 0))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("mark"), pa.array(node), bands], names=["doc_id", "mark", "node", "bands"])

    return run


def _distinct(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The set of shingle hashes of every text, sorted."""
    parts = [*_parts(data, off, size)]
    if len(off) == 2:
        return [np.unique(np.concatenate([h for h, _ in parts]))]
    h, at = parts[0]
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of WIDTH words, each different shingle with one vote, so that they tell the similarity of sets."""
    votes, size = np.zeros((len(sets), BITS * WIDTH), np.int64), np.array([len(x) for x in sets])
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    for lo in range(0, len(h), 1 << 16):
        add_votes(votes, h[lo : lo + (1 << 16)], owner[lo : lo + (1 << 16)])
    return majority(votes, size)


def _described(size: int):
    """The fingerprint, the number of bytes of the set, and the set of every text."""

    def run(batches):
        for rows, data, off in text_slices(batches, "text"):
            own = _distinct(data, off, size)
            fp = wide_prints(own).view(np.int64)
            blobs = pa.array([x.tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("node"), *(pa.array(fp[:, k]) for k in range(WIDTH)), pa.array([8 * len(x) for x in own], pa.int64()), blobs], names=["node", *WORDS, "size", "shingles"])

    return run


def _forest(radius: int):
    def work(fp, group, table):
        node = table.column("node").to_numpy()
        i, j = links(fp, group, radius)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], names=["a", "b"])

    return per_bucket(work, WORDS)


def common_shingles(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """For every two sets of x and y, how many shingles they share.

    Shingles in many sets are columns of incidence matrices; the others give their few pairs one by one.
    """
    def flat(sets):
        h = np.concatenate(sets)
        return h, np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (hx, ox), (hy, oy) = flat(x), flat(y)
    both = np.intersect1d(hx, hy)
    out = np.zeros((len(x), len(y)), np.float32)  # exact: counts stay below 2^24
    if not len(both):
        return out

    def numbered(h, owner):
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        some = np.flatnonzero(both[at] == h)
        order = some[np.argsort(at[some], kind="stable")]
        return at[order], owner[order]

    (cx, ox), (cy, oy) = numbered(hx, ox), numbered(hy, oy)
    nx, ny = np.bincount(cx, minlength=len(both)), np.bincount(cy, minlength=len(both))
    heavy = nx * ny * 64 > len(x) * len(y)
    wide = np.flatnonzero(heavy)
    column = np.full(len(both), -1)
    column[wide] = np.arange(len(wide))
    sx, sy = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    for lo in range(0, len(wide), 1024):
        own = wide[lo : lo + 1024]
        parts = []
        for c, o, start, n, rows in ((cx, ox, sx, nx, len(x)), (cy, oy, sy, ny, len(y))):
            at = np.repeat(start[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
            m = np.zeros((rows, len(own)), np.float32)
            m[o[at], column[c[at]] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    thin = np.flatnonzero(~heavy)
    pairs = nx[thin] * ny[thin]
    cuts = np.searchsorted(np.cumsum(pairs), np.arange(1 << 21, int(pairs.sum()) + 1, 1 << 21))
    for own in np.split(thin, cuts):
        n = nx[own] * ny[own]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inner = np.repeat(ny[own], n)
        i, j = ox[np.repeat(sx[own], n) + k // np.maximum(inner, 1)], oy[np.repeat(sy[own], n) + k % np.maximum(inner, 1)]
        np.add.at(out, (i, j), 1)
    return out


def similar(x: list[np.ndarray], y: list[np.ndarray], level: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of x and y with a Jaccard similarity of `level` or more."""
    both = common_shingles(x, y)
    nx, ny = (np.array([len(s) for s in z], np.float64) for z in (x, y))
    i, j = [], []
    for lo in range(0, len(x), 256):
        part = both[lo : lo + 256].astype(np.float64)
        a, b = np.nonzero(part >= level * (nx[lo : lo + 256, None] + ny[None, :] - part))
        i.append(a + lo)
        j.append(b)
    return np.concatenate(i), np.concatenate(j)


def _joined(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Of the links (i, j) between nodes, some that connect the same ones."""
    label, found = np.arange(len(node)), []
    while len(i):
        a, b = label[i], label[j]
        apart = np.flatnonzero(a != b)
        i, j = i[apart], j[apart]
        hi, lo = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        _, first = np.unique(hi, return_index=True)
        found.append((i[first], j[first]))
        label[hi[first]] = lo[first]
        while not np.array_equal(label, nearer := label[label]):
            label = nearer
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (i, j)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], names=["a", "b"])


def _meetings(work):
    """Run work(node, side, root, sets) on the rows of each (k1, k2), by which the rows are sorted."""

    def run(batches):
        held: list[tuple] = []
        now = None
        for batch in batches:
            cells = (batch.column(c).to_pylist() for c in ("k1", "k2", "node", "side", "root"))
            for k1, k2, node, side, root, blob in zip(*cells, batch.column("shingles"), strict=True):
                if held and (k1, k2) != now:
                    yield from work(*_columns(held))
                    held = []
                now = k1, k2
                held.append((node, side, root, np.frombuffer(blob.as_buffer(), np.uint64).copy()))
        if held:
            yield from work(*_columns(held))

    return run


def _columns(held: list[tuple]):
    node, side, root, sets = zip(*held, strict=True)
    return np.array(node, np.int64), np.array(side), np.array(root, np.int64), list(sets)


def _within(level: float):
    def work(node, side, root, sets):
        i, j = similar(sets, sets, level)
        yield _joined(node, i[i < j], j[i < j])

    return _meetings(work)


def _across(level: float):
    def work(node, side, root, sets):
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(x) and len(y):
            i, j = similar([sets[k] for k in x], [sets[k] for k in y], level)
            apart = root[x[i]] != root[y[j]]
            yield _joined(node, x[i[apart]], y[j[apart]])

    return _meetings(work)


def _decide(pairs: DataFrame, sets: DataFrame, level: float) -> DataFrame:
    """Links (a, b) between similar nodes that connect all that are similar within the families of the candidate pairs."""
    tree = components(pairs)
    members = tree.select("node", F.col("root").alias("k1")).unionByName(tree.select(F.col("root").alias("node"), F.col("root").alias("k1")).distinct())
    members = members.join(sets.select("node", "size"), "node")
    sums = members.groupBy("k1").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    parts = lambda n, size: F.greatest(F.ceil(n / MEMBERS), F.ceil(size / SET_BYTES), F.lit(1)).cast("int")
    sums = sums.withColumn("parts", parts(F.col("n"), F.col("bytes"))).drop("bytes")
    members = materialize(members.join(sums, "k1"), "near-members")
    few = members.count() <= BROADCAST_MEMBERS

    def met(rows: DataFrame, work, label: str) -> DataFrame:
        """work on the sets of rows (k1, k2, node, side, root)."""
        both = (F.broadcast(rows) if few else rows).join(sets.select("node", "shingles"), "node")
        near = both.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "node")
        return materialize(near.mapInArrow(tidy(work), "a long, b long"), label)

    hashed = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.array(hashed(1, F.col("parts")))
    pivot = (F.col("parts") > 1) & (hashed(2, F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS))) == 0)
    rows = members.withColumn("k2", F.explode(F.when(pivot, every(F.col("parts"))).otherwise(own))).withColumn("k2", F.col("k2").cast("long"))
    links = met(rows.select("k1", "k2", "node", F.lit(0).alias("side"), F.col("node").alias("root")), _within(level), "near-links")

    large = members.where("parts > 1")
    if large.isEmpty():
        return links
    rooted = materialize(large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
    most = rooted.groupBy("k1", "root").count().groupBy("k1").agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("most"))
    rooted = rooted.join(most, "k1").withColumn("out", F.col("root") != F.col("most"))
    left = rooted.where("out").groupBy("k1").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"))
    rooted = rooted.join(left.select("k1", parts(F.col("m"), F.col("bytes")).alias("outs")), "k1")  # families that are one drop out
    key = lambda i, j: F.shiftleft(i.cast("long"), 31) + j
    asked = rooted.where("out").withColumn("k2", F.explode(F.transform(every(F.col("parts")), lambda j: key(hashed(3, F.col("outs")), j)))).withColumn("side", F.lit(0))
    store = rooted.withColumn("k2", F.explode(F.transform(every(F.col("outs")), lambda i: key(i, hashed(1, F.col("parts")))))).withColumn("side", F.lit(1))
    rows = asked.unionByName(store).select("k1", "k2", "node", "side", "root")
    return links.unionByName(met(rows, _across(level), "near-more-links"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, level: float = LEVEL, crowd: int = CROWD) -> DataFrame:
    """Of each group of near duplicates one row stays: doc_id, mark (xxhash64 of the text) and kept, for every row.

    docs: doc_id long, text string; other columns are not read. Two rows are near duplicates if the sets of their
    shingles of `size` words have a Jaccard similarity of `level` or more; groups are what such pairs connect. Words are
    `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text with fewer words is one shingle; texts without words, or null,
    are equal to one another. The row with the smallest doc_id stays, of rows with one doc_id that with the least mark;
    null doc_ids come last. Rows that repeat doc_id and text share their fate. No rows give no rows. Texts of any length
    are hashed in pieces; a candidate's set of shingle hashes is held whole.
    """
    prepare(docs.sparkSession)
    text, radius = F.col("text").cast("string"), reach(level)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    facts = materialize(rows.mapInArrow(tidy(_facts(size)), "doc_id long, mark long, node long, bands array<long>"), "near-facts")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    nodes = materialize(facts.groupBy("node").agg(F.min(place).alias("first")), "near-nodes")

    dealt = facts.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("k1"))
    groups = dealt.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(dealt.join(groups, "k1"), "near-met")
    # one text of each node that shares a bucket
    ask = met.select("node").distinct().join(nodes, "node").select("node", F.col("first.doc_id").alias("_doc"), F.col("first.mark").alias("_mark"))
    ask = materialize(ask, "near-asked")
    few = F.broadcast(ask) if ask.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ask
    texts = rows.join(few, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["mark"] == F.col("_mark"))).select("node", "text")
    kinds = ", ".join(["node long", *(f"{w} long" for w in WORDS), "size long", "shingles binary"])
    # rows that repeat doc_id and text give a node twice
    again = facts.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    sets = texts.mapInArrow(tidy(_described(size)), kinds)
    sets = materialize(sets if again else sets.dropDuplicates(["node"]), "near-sets")
    buckets = materialize(met.join(sets.select("node", *WORDS), "node"), "near-buckets")
    pairs = materialize(in_blocks(buckets, crowd, *WORDS).mapInArrow(_forest(radius), "a long, b long").distinct(), "near-pairs")
    release(met, buckets)
    roots = components(_decide(pairs, sets, level))
    release(sets)
    whole = materialize(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "near-roots")
    best = whole.groupBy("root").agg(F.min("first").alias("best"))
    return facts.join(whole.join(best, "root").select("node", "best"), "node").select("doc_id", "mark", (place == F.col("best")).alias("kept"))
