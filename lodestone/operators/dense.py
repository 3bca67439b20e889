"""Exact dense retrieval: every stored vector is compared with all query vectors, where it is stored."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.best import SCHEMA, SPARE, Best
from lodestone.plans.runtime import materialize

#: Queries multiplied with a batch of vectors at once.
QUERY_BLOCK = 1024
#: Queries sent to every task for one pass over the store, and bytes of their vectors; more take several passes.
PASS_QUERIES, PASS_BYTES = 50_000, 128 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def matrix_of(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _candidates(names: np.ndarray, matrix: np.ndarray, k: int):
    def run(batches):
        best = Best(len(names), k + SPARE)
        for batch in batches:
            if not len(batch):
                continue
            store, ids = unit(matrix_of(batch.column("vector"))).T, batch.column("id").to_numpy()
            for lo in range(0, len(names), QUERY_BLOCK):
                best.add_block(lo, ids, matrix[lo : lo + QUERY_BLOCK] @ store)
        yield best.batch(names)

    return run


def passes(queries: DataFrame, most: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search over queries (query_id, ...), at most about `most` at a time; the results of several passes are written."""
    n = queries.count()
    if n <= most:
        return search(queries)
    parts, out = -(-n // (most // 2)), None
    for i in range(parts):
        found = materialize(search(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)), "pass")
        out = found if out is None else out.unionByName(found)
    return out


def query_rows(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(query_ids, unit vectors) of queries (query_id long, vector array), of one pass."""
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).orderBy("query_id").toArrow()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return rows.column("query_id").to_numpy(), unit(matrix_of(rows.column("vector").combine_chunks()))


def most_queries(dims: int) -> int:
    """Queries of one pass, by the length of their vectors."""
    return max(2, min(PASS_QUERIES, PASS_BYTES // (8 * max(dims, 1))))


def dense_topk(store: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """query_id, id, score (rounded to 6 places), rank 1 to k. Ties go to the smaller id.

    store: id_col long, vector_col array; queries: query_id long, vector array. A task multiplies each batch of stored
    vectors with all queries of the pass, QUERY_BLOCK at a time, and keeps its best: the shuffle holds about k rows for
    each task and query, and the store is read once for each PASS_QUERIES queries, or PASS_BYTES of them.
    """
    rows = store.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("vector IS NOT NULL")

    def search(asked: DataFrame) -> DataFrame:
        names, matrix = query_rows(asked)
        return top_k(rows.mapInArrow(_candidates(names, matrix, k), SCHEMA).withColumn("score", F.round("score", 6)), k, "id")

    one = rows.select(F.size("vector")).first()
    return passes(queries, most_queries(one[0] if one else 1), search)


def top_k(scored: DataFrame, k: int, tie: str) -> DataFrame:
    """The k rows of each query_id with the highest score, ranked from 1; only each task's best k are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

