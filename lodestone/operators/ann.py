"""Approximate nearest vectors: an inverted file over clusters, with the recall it was measured to have.

Centres are fitted by k-means to a bounded sample; every vector is stored under its nearest centre, in files of its own,
so a search reads only the clusters near its queries. How many clusters a query looks into is found when the index is
built: the fewest with which queries drawn from the table reach the recall wanted against exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.best import SCHEMA, SPARE, Best
from lodestone.operators.dense import dense_topk, matrix_of, most_queries, passes, query_rows, top_k, unit
from lodestone.plans.runtime import new_path, prepare

#: Bounds of the samples: vectors that the centres are fitted to, and queries that recall is measured with.
FIT_ROWS, CHECK_ROWS = 50_000, 200
MOST_CENTRES = 4096


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Unit centres of unit vectors; a centre without members stays where it is."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[size > 0] = unit(sums[size > 0])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n centres nearest to each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    for lo in range(0, len(x), 4096):
        score = x[lo : lo + 4096] @ centres.T
        pick = np.argpartition(-score, n - 1, axis=1)[:, :n]
        out[lo : lo + 4096] = np.take_along_axis(pick, np.argsort(-np.take_along_axis(score, pick, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _assign(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            if len(batch):
                near = nearest(unit(matrix_of(batch.column("vector"))), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(near.astype(np.int32))], names=["id", "vector", "cluster"])

    return run


def _probe(names: np.ndarray, matrix: np.ndarray, looks: np.ndarray, k: int):
    """looks: the clusters that each query looks into."""

    def run(batches):
        best = Best(len(names), k + SPARE)
        flat, owner = looks.reshape(-1), np.repeat(np.arange(len(looks)), looks.shape[1])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for batch in batches:
            cluster, ids = batch.column("cluster").to_numpy(), batch.column("id").to_numpy()
            if not len(batch):
                continue
            store = unit(matrix_of(batch.column("vector")))
            for c in np.unique(cluster):
                a, b = np.searchsorted(flat, (c, c + 1))
                mine = np.flatnonzero(cluster == c)
                if a < b:
                    score = matrix[owner[a:b]] @ store[mine].T
                    q, at = np.nonzero(score >= best.edge[owner[a:b]][:, None] - 1e-6)
                    best.add(owner[a:b][q], ids[mine[at]], score[q, at])
        yield best.batch(names)

    return run


@dataclass
class AnnIndex:
    """rows: id, vector, cluster, stored by cluster; probes: clusters that a query looks into; recall: as measured."""

    rows: DataFrame
    centres: np.ndarray
    probes: int
    recall: float

    @classmethod
    def build(cls, store: DataFrame, id_col: str = "id", vector_col: str = "vector", k: int = 15, recall: float = 0.95, fit_rows: int = FIT_ROWS, check_rows: int = CHECK_ROWS, path: str | None = None) -> AnnIndex:
        """Index every row of store (id_col long, vector_col array of one length; rows without a vector are left out).

        fit_rows, check_rows: the rows of greatest hashed id are the ones that recall is measured with, those of least hashed
        id, as far as others are left, the ones that the centres are fitted to. A query is not its own neighbour there.
        """
        spark = prepare(store.sparkSession)
        rows = store.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("vector IS NOT NULL")
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
        path = path or new_path(spark, "ann")
        x = unit(matrix_of(sample.column("vector").combine_chunks())) if len(sample) else np.zeros((0, 1))
        centres = k_means(x, max(1, min(MOST_CENTRES, int(np.sqrt(len(x)) * 2), len(x)))) if len(x) else np.zeros((0, 1))
        rows.mapInArrow(_assign(centres), "id long, vector " + rows.schema["vector"].dataType.simpleString() + ", cluster int").hint("rebalance", "cluster").write.partitionBy("cluster").mode("overwrite").parquet(path)
        stored = spark.read.schema("id long, vector " + rows.schema["vector"].dataType.simpleString() + ", cluster int").parquet(path)
        made = cls(stored, centres, len(centres), 1.0)
        return made._calibrated(rows.orderBy(F.desc(F.xxhash64("id")), "id").limit(check_rows), k, recall) if len(x) else made

    def _calibrated(self, asked: DataFrame, k: int, wanted: float) -> AnnIndex:
        asked = asked.select(F.col("id").alias("query_id"), "vector")
        others = F.col("query_id") != F.col("id")
        exact = {(r["query_id"], r["id"]) for r in dense_topk(self.rows, asked, k + 1).where(others).collect()}  # k rows for each of the sample
        n = 1
        while n < len(self.centres):
            found = {(r["query_id"], r["id"]) for r in AnnIndex(self.rows, self.centres, n, 0.0).search(asked, k + 1).where(others).collect()}
            share = len(found & exact) / max(len(exact), 1)
            if share >= wanted:
                return AnnIndex(self.rows, self.centres, n, share)
            n *= 2
        return AnnIndex(self.rows, self.centres, len(self.centres), 1.0)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score (rounded to 6 places), rank 1 to k among the clusters looked into; exact scores."""

        def one(part: DataFrame) -> DataFrame:
            names, matrix = query_rows(part)
            looks = nearest(matrix, self.centres, self.probes) if len(names) and len(self.centres) else np.zeros((len(names), 0), np.int64)
            rows = self.rows
            if len(wanted := np.unique(looks)) < len(self.centres):
                rows = rows.where(F.col("cluster").isin([int(c) for c in wanted]))  # prunes the files read
            found = rows.mapInArrow(_probe(names, matrix, looks, k), SCHEMA)
            return top_k(found.withColumn("score", F.round("score", 6)), k, "id")

        return passes(queries, most_queries(self.centres.shape[1]), one)
