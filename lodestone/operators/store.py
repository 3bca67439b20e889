"""The chunk store: immutable segments, and a manifest for each revision that says which of their rows live.

An upsert writes its chunks, with their vectors, as one new segment, and the ids they replace in older segments as graves;
a delete writes graves only. So a change costs what it changes. Files have random names and are never written over. The
manifest is written last: readers see a revision whole or not at all. Of two writers at once the one that comes second
reads the first one's manifest, looks its keys up again and commits on top of it, with the vectors it has; nothing of
either is lost. When segments or graves become many, a change writes one segment of all that lives.

Beside each segment stand its keys, in buckets by their first digits: a change reads the buckets that its own keys fall
into, and no others. A segment's postings, and the vocabulary of all, are kept until live rows change. Files of all but the last
two revisions are deleted once they are older than any change takes.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.log import get_logger
from lodestone.operators import bm25
from lodestone.operators.dedup import first_wins, list_sources
from lodestone.operators.embed import Embedder, Progress, embed, reporting
from lodestone.operators.retrieval import Collection
from lodestone.plans.runtime import materialize, scratch, shuffles_end

SCHEMA = "chunk_id string, text string, source string, chunk_index int, content_hash string, vector array<float>, id long"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
KEYS = "chunk_id string, id long, source string, bucket string"
#: Segments, and share of dead rows, above which a change merges all that lives.
MOST_SEGMENTS, MOST_DEAD = 16, 0.25
#: Graves sent to every task of a read, over all segments; more meet the rows by a shuffle.
BROADCAST_GRAVES = 1_000_000
#: Keys of a segment to a bucket, about; buckets are 1, 16, 256 or 4,096.
BUCKET_KEYS, MOST_DIGITS = 100_000, 3
#: Rows of a page of a segment, the least that is read for an id.
PAGE_ROWS = 200
#: New keys sent to the keys of older segments, which then stay where they are.
BROADCAST_KEYS = 1_000_000
#: How often a change is tried again on top of another one's.
ATTEMPTS = 50

log = get_logger("lodestone.store")

#: Commits of this process to one store, one at a time: not every file system refuses a rename onto a file.
_COMMITS: dict[str, threading.Lock] = {}


class Conflict(RuntimeError):
    """Another writer has committed the revision."""


def _name() -> str:
    return uuid.uuid4().hex


class ChunkStore:
    """tokenizer: a Column function that the postings are made by; a store is searched with the one it was written with.
    keep_seconds: how long files that no manifest names are spared, as a writer may be about to name them; longer than any
    change or search takes."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, collection: str = "enterprise_kb", tokenizer: Callable[[Column], Column] = bm25.tokens, keep_seconds: float = 86_400):
        self.tokenizer, self.keep_seconds = tokenizer, keep_seconds
        self.spark, self.embedder, self.path = spark, embedder, f"{root.rstrip('/')}/{collection}"
        self._held: tuple[int, Collection] | None = None

    # ---- files ----

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, *names: str) -> None:
        fs, path = self._at(*names)
        fs.delete(path, True)

    def _revisions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    @property
    def revision(self) -> int:
        """0 for a store that was never changed; each change adds one."""
        return max(self._revisions(), default=0)

    def _manifest(self, revision: int | None = None) -> dict:
        at = self.revision if revision is None else revision
        if not at:
            return {"revision": 0, "next_segment": 1, "next_id": 0, "segments": []}
        fs, path = self._at("manifests", f"{at}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, new: dict) -> None:
        """Write the manifest of a revision that no one has written, or raise Conflict."""
        fs, path = self._at("manifests", f"{new['revision']}.json")
        part = path.suffix(f".{_name()}.part")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        with _COMMITS.setdefault(self.path, threading.Lock()):
            done = not fs.exists(path) and self.revision < new["revision"] and fs.rename(part, path)
        if not done:
            fs.delete(part, False)
            raise Conflict(f"revision {new['revision']} was written by someone else")
        log.info("%s: revision %d, %d chunks in %d segments", self.path, new["revision"], self._alive(new), len(new["segments"]))
        self._clean()

    def _change(self, change: Callable[[dict], dict]) -> dict:
        """Commit change(newest manifest); after a conflict once more, on top of what was committed meanwhile."""
        for attempt in range(ATTEMPTS):
            now = self._manifest()
            new = change(json.loads(json.dumps(now))) | {"revision": now["revision"] + 1}
            self._merge(new)
            try:
                self._commit(new)
                return new
            except Conflict:
                log.info("%s: revision %d was taken, trying again", self.path, new["revision"])
                time.sleep(random.random() * min(0.1 * 2**attempt, 5))
        raise Conflict(f"{self.path}: {ATTEMPTS} changes in a row were overtaken")

    def _clean(self) -> None:
        """Delete what the last two manifests do not name, if it is old enough that no one is about to name it."""
        known = self._revisions()
        for r in known[:-2]:
            self._delete("manifests", f"{r}.json")
        segments = [s for r in known[-2:] for s in self._manifest(r)["segments"]]
        names = {s["name"] for s in segments}
        used = {"segments": names, "keys": names, "graves": {g for s in segments for g in s["graves"]}, "index": {self._index_name(s) for s in segments}, "vocabulary": {self._vocabulary_name(self._manifest(r)) for r in known[-2:]}}
        fs, newest = self._at("manifests", f"{known[-1]}.json")
        before = fs.getFileStatus(newest).getModificationTime() - 1000 * self.keep_seconds
        for folder, named in used.items():
            _, at = self._at(folder)
            for x in fs.listStatus(at) if fs.exists(at) else ():
                if x.getPath().getName() not in named and x.getModificationTime() <= before:
                    fs.delete(x.getPath(), True)

    # ---- reading ----

    @staticmethod
    def _alive(manifest: dict) -> int:
        return sum(s["rows"] - s["dead"] for s in manifest["segments"])

    @staticmethod
    def _index_name(segment: dict) -> str:
        return f"{segment['name']}-{segment['dead']}"

    @staticmethod
    def _vocabulary_name(manifest: dict) -> str:
        """Of the live rows, so that a revision that changes none keeps it."""
        return str(uuid.uuid5(uuid.NAMESPACE_OID, " ".join(sorted(map(ChunkStore._index_name, manifest["segments"])))).hex)

    def _graves(self, segment: dict) -> DataFrame:
        dead = self.spark.read.schema("segment string, chunk_id string").parquet(*(f"{self.path}/graves/{g}" for g in segment["graves"]))
        return dead.where(F.col("segment") == segment["name"]).select("chunk_id")

    def _alive_of(self, segment: dict, rows: DataFrame, total_dead: int) -> DataFrame:
        if not segment["graves"]:
            return rows
        dead = self._graves(segment)
        return rows.join(F.broadcast(dead) if total_dead <= BROADCAST_GRAVES else dead, "chunk_id", "left_anti").select(*rows.columns)

    def _live(self, segment: dict, total_dead: int | None = None) -> DataFrame:
        """total_dead: graves of all segments that the plan reads."""
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/segments/{segment['name']}")
        return self._alive_of(segment, rows, segment["dead"] if total_dead is None else total_dead)

    def _all(self, manifest: dict) -> DataFrame:
        dead = sum(s["dead"] for s in manifest["segments"])
        return self._union([self._live(s, dead) for s in manifest["segments"]], SCHEMA)

    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def read(self, revision: int | None = None) -> DataFrame:
        """The live chunks, by default of the newest revision; the one before it can be read, too."""
        return self._all(self._manifest(revision))

    def count(self) -> int:
        return self._alive(self._manifest())

    def sources(self) -> DataFrame:
        return list_sources(self.read())

    def _make(self, folder: str, name: str, write: Callable[[str], None]) -> str:
        """The path of a table that anyone may make at any time: written under a name of its own, then renamed."""
        fs, at = self._at(folder, name)
        if not fs.exists(at):
            own = f".{name}.{_name()}"
            write(f"{self.path}/{folder}/{own}")
            with _COMMITS.setdefault(self.path, threading.Lock()):
                if fs.exists(at) or not fs.rename(self._at(folder, own)[1], at):
                    self._delete(folder, own)
        return f"{self.path}/{folder}/{name}"

    def _postings(self, segment: dict) -> str:
        def write(at: str) -> None:
            bm25.invert(self._live(segment).select("id", "text"), "id", self.tokenizer, segment["no"]).write.parquet(f"{at}/postings")
            bm25.counts_of(self.spark.read.schema(bm25.POSTINGS).parquet(f"{at}/postings")).write.parquet(f"{at}/counts")
            log.info("%s: postings of segment %d written", self.path, segment["no"])

        return self._make("index", self._index_name(segment), write)

    def collection(self) -> Collection:
        """What searches read. The postings of segments whose live rows changed since they were last made are written, and
        one vocabulary of all, sorted by token; a search at a revision that was searched before reads no texts but its
        results', and of the vocabulary the pages of its tokens."""
        manifest = self._manifest()
        if self._held and self._held[0] == manifest["revision"]:
            return self._held[1]
        made = [self._postings(s) for s in manifest["segments"]]
        kind = "tok string, df long, total long"
        postings = self._union([self.spark.read.schema(bm25.POSTINGS).parquet(f"{at}/postings") for at in made], bm25.POSTINGS)

        def write(at: str) -> None:
            counts = self._union([self.spark.read.schema(kind).parquet(f"{x}/counts") for x in made], kind)
            with scratch():
                sums = materialize(counts.groupBy("tok").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "token-counts")
                index = bm25.Index.of(postings, sums, self._alive(manifest))
                index.vocabulary.repartitionByRange("tok").sortWithinPartitions("tok").write.parquet(f"{at}/tokens")
                self.spark.createDataFrame([(index.n, index.length)], "n long, length long").coalesce(1).write.parquet(f"{at}/size")

        at = self._make("vocabulary", self._vocabulary_name(manifest), write)
        n, length = self.spark.read.schema("n long, length long").parquet(f"{at}/size").first()
        index = bm25.Index(postings, self.spark.read.schema("tok string, df long, idf double").parquet(f"{at}/tokens"), n, length)
        rows = self._all(manifest)
        self._held = manifest["revision"], Collection(rows.select("id", "text", "source"), rows.select("id", "vector"), index, self.tokenizer)
        return self._held[1]

    # ---- changes ----

    def _write(self, no: int, rows: DataFrame | None, loose: DataFrame | None = None) -> dict:
        """Write a segment and its keys. rows come in the order of ids, file by file, and stay where they are; loose ones are
        put in order, by a shuffle."""
        name = _name()
        at = f"{self.path}/segments/{name}"
        parts = [] if rows is None else [rows.select(COLUMNS).sortWithinPartitions("id")]
        if loose is not None:
            parts.append(loose.select(COLUMNS).repartitionByRange("id").sortWithinPartitions("id"))
        with shuffles_end(self.spark):
            reduce(DataFrame.unionByName, parts).write.option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").parquet(at)
        held = self.spark.read.schema(SCHEMA).parquet(at)
        n = held.count()
        digits = next((d for d in range(MOST_DIGITS) if n <= BUCKET_KEYS * 16**d), MOST_DIGITS)
        keys = held.select("chunk_id", "id", "source", self._bucket(digits).alias("bucket"))
        keys.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/keys/{name}")
        return {"name": name, "no": no, "rows": n, "dead": 0, "graves": [], "digits": digits}

    @staticmethod
    def _bucket(digits: int) -> Column:
        """b and the first digits of a hash of the key, whatever keys look like."""
        return F.concat(F.lit("b"), F.left(F.md5("chunk_id"), F.lit(digits)))

    def _keys(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(KEYS).parquet(f"{self.path}/keys/{segment['name']}")

    def _asked(self, segment: dict, new: DataFrame, n: int) -> DataFrame:
        """The keys of a segment in the buckets that the n keys of new fall into."""
        digits = segment["digits"]
        if not digits or n >= 16**digits:  # most buckets are met
            return self._keys(segment)
        buckets = [r[0] for r in new.select(self._bucket(digits)).distinct().collect()]  # fewer than 4,096
        return self._keys(segment).where(F.col("bucket").isin(buckets))

    def _known(self, manifest: dict, new: DataFrame, n: int) -> DataFrame:
        """segment, chunk_id and id of the live rows that the n keys of new would replace."""
        found = []
        dead = sum(s["dead"] for s in manifest["segments"])
        own = F.broadcast(new.select("chunk_id")) if n <= BROADCAST_KEYS else new.select("chunk_id")
        for s in manifest["segments"]:
            met = self._asked(s, new, n).join(own, "chunk_id", "left_semi").select("chunk_id", "id")
            found.append(self._alive_of(s, met, dead).withColumn("segment", F.lit(s["name"])))
        return self._union(found, "chunk_id string, id long, segment string")

    def _bury(self, manifest: dict, dead: DataFrame) -> None:
        """Write the graves (segment, chunk_id) and note them in the manifest's segments."""
        dead = materialize(dead.select("segment", "chunk_id"), "dead")
        sums = {r["segment"]: r["count"] for r in dead.groupBy("segment").count().collect()}  # one row for each segment
        if not sums:
            return
        name = _name()
        dead.write.parquet(f"{self.path}/graves/{name}")
        for s in manifest["segments"]:
            if s["name"] in sums:
                s["dead"] += sums[s["name"]]
                s["graves"].append(name)
        manifest["segments"] = [s for s in manifest["segments"] if s["dead"] < s["rows"]]

    def _merge(self, manifest: dict) -> None:
        """One segment of all that lives, if there are many segments or dead rows."""
        rows, dead = (sum(s[k] for s in manifest["segments"]) for k in ("rows", "dead"))
        if len(manifest["segments"]) <= MOST_SEGMENTS and dead <= MOST_DEAD * rows:
            return
        no = manifest["next_segment"]
        manifest |= {"next_segment": no + 1, "segments": [self._write(no, None, self._all(manifest))]}

    def add(self, chunks: DataFrame, progress: Progress | None = None) -> int:
        """Upsert by content_hash: text, source, index and vector of a known chunk are replaced, its place is kept. Returns
        the number added or replaced; without chunks nothing changes. progress(done, total): chunks embedded so far.

        Other writers may change the store meanwhile: the keys are then looked up again in what they left."""
        order = [c for c in ("file_no", "chunk_index") if c in chunks.columns]
        with scratch():
            new = first_wins(chunks, ["content_hash"], order or ["source"])
            new = new.select(F.col("content_hash").alias("chunk_id"), "text", "source", F.col("chunk_index").cast("int").alias("chunk_index"), "content_hash", *order[:-1])
            if progress:  # which is told of how many
                new = materialize(new, "new-chunks")
            with reporting(self.spark, progress, new.count() if progress else 0) as counter:
                placed = new.orderBy(*order[:-1], "source", "chunk_index").withColumn("_new", F.monotonically_increasing_id())
                placed = materialize(placed.withColumn("vector", embed(self.embedder, F.col("text"), counter=counter).cast("array<float>")), "embedded-chunks", "zstd")
            n = placed.count()
            if not n:
                return 0
            last = placed.agg(F.max("_new")).first()[0]

            def change(manifest: dict) -> dict:
                known = materialize(self._known(manifest, placed, n), "known-chunks")
                met = known.count()
                old = known.select("chunk_id", F.col("id").alias("_old"))
                self._bury(manifest, known)
                fresh, again = placed.withColumn("id", F.col("_new") + manifest["next_id"]), None
                if met > BROADCAST_KEYS:
                    fresh, again = None, placed.join(old, "chunk_id", "left").withColumn("id", F.coalesce("_old", F.col("_new") + manifest["next_id"]))
                elif met:  # only what takes an older chunk's place moves
                    again = placed.join(F.broadcast(old), "chunk_id").withColumn("id", F.col("_old"))
                    fresh = fresh.join(F.broadcast(old), "chunk_id", "left_anti") if met < n else None
                manifest["segments"].append(self._write(manifest["next_segment"], fresh, again))
                return manifest | {"next_segment": manifest["next_segment"] + 1, "next_id": manifest["next_id"] + last + 1}

            self._change(change)
        return n

    def delete_source(self, source: str) -> tuple[int, int]:
        """(chunks deleted, chunks left); the revision grows even if nothing matched."""
        before = [0]

        def change(manifest: dict) -> dict:
            before[0] = self._alive(manifest)
            dead = sum(s["dead"] for s in manifest["segments"])
            gone = [self._alive_of(s, self._keys(s).where(F.col("source").eqNullSafe(F.lit(source))).select("chunk_id"), dead).withColumn("segment", F.lit(s["name"])) for s in manifest["segments"]]
            self._bury(manifest, self._union(gone, "chunk_id string, segment string"))
            return manifest

        with scratch():
            left = self._alive(self._change(change))
        return before[0] - left, left

    def clear(self) -> None:
        self._change(lambda manifest: manifest | {"segments": []})
