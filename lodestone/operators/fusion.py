"""Reciprocal rank fusion, reranking, and the threshold that never leaves a question without an answer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.bm25 import tokens

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def recall_size(top_k: int) -> int:
    """Candidates fetched from each list, and kept after fusion."""
    return max(3 * top_k, 10)


def rrf_fuse(dense: DataFrame, sparse: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """fuse() of two lists (query_id, text, source, rank from 1)."""
    places = [df.select("query_id", "text", "source", F.lit(i).alias("list"), "rank") for i, df in enumerate((dense, sparse))]
    return fuse(places[0].unionByName(places[1]), limit, k)


def fuse(places: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """query_id, text, source, rrf, rank from places (query_id, text, source, list, rank from 1).

    A text scores the sum of 1 / (k + rank) over its places. Its source is that of its first place, lists in order, which
    also breaks ties.
    """
    seen = F.struct("list", "rank")
    fused = places.groupBy("query_id", "text").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 10).alias("rrf"), F.min_by("source", seen).alias("source"), F.min(seen).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "seen.list", "seen.rank")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "text", "source", "rrf", "rank")


class Reranker(Protocol):
    """Relevance of texts to questions, from 0 to 1."""

    def score(self, questions: list[str], texts: list[str]) -> list[float]: ...


class CrossEncoderReranker:
    """A sentence-transformers cross-encoder, loaded once in each Python worker; local files first, then by download."""

    _loaded: dict[str, object] = {}

    def __init__(self, name: str):
        self.name = name

    def model(self):
        if self.name not in self._loaded:
            from sentence_transformers import CrossEncoder

            try:
                self._loaded[self.name] = CrossEncoder(self.name, local_files_only=True)
            except Exception:  # noqa: BLE001  not cached: try the network
                try:
                    self._loaded[self.name] = CrossEncoder(self.name)
                except Exception as e:
                    raise RuntimeError(f"cannot load the reranking model {self.name}; download it or check the network") from e
        return self._loaded[self.name]

    def score(self, questions: list[str], texts: list[str]) -> list[float]:
        return [float(x) for x in self.model().predict([list(p) for p in zip(questions, texts, strict=True)])]


def rerank(candidates: DataFrame, queries: DataFrame, reranker: Reranker | None = None) -> DataFrame:
    """candidates (query_id, text, source, rank) with score, of the question's text (queries: query_id, text).

    Without a reranker the score is lexical and native: the share of the question's distinct tokens that the text holds.
    """
    asked = queries.select("query_id", F.col("text").alias("question"))
    both = candidates.join(asked, "query_id")
    if reranker is None:
        wanted, held = F.array_distinct(tokens(F.col("question"))), F.array_distinct(tokens(F.col("text")))
        score = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, held)) / F.size(wanted)).otherwise(0.0)
    else:

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in parts:
                yield pd.Series(reranker.score(q.tolist(), t.tolist()), index=q.index, dtype=float)

        score = run("question", "text")
    return both.withColumn("score", F.round(score, 6)).drop("question")


def threshold_topk(scored: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """The best top_k at or above the threshold; of a question without any, the best top_k. Ties keep the former rank."""
    some = F.max(F.when(F.col("score") >= threshold, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    kept = scored.withColumn("_some", some).where((F.col("_some") == 0) | (F.col("score") >= threshold))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_k).drop("_some", "rank").withColumnRenamed("_rank", "rank")
