"""Hybrid retrieval for a batch of questions: dense and BM25 lists, fusion, reranking, threshold, top k."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.text import UNKNOWN_SOURCE
from lodestone.operators import bm25
from lodestone.operators.dense import dense_topk
from lodestone.operators.embed import Embedder, embed
from lodestone.operators.fusion import Reranker, fuse, recall_size, rerank, threshold_topk
from lodestone.plans.runtime import materialize

#: Ranked ids (a few numbers each) sent to every task, so that texts stay where they are; more meet the texts by a shuffle.
BROADCAST_RANKED = 1_000_000
#: Ranked ids that are looked up by ranges, and ranges of one lookup; these reach the pages of the scan.
LOOKED_UP, RANGES = 10_000, 200


@dataclass
class Collection:
    """What a search reads: rows (id in the order of insertion, text, source), vectors (id, vector) and the postings, with
    the tokenizer they were made by. Rows are read for the texts of results only."""

    rows: DataFrame
    vectors: DataFrame
    index: bm25.Index
    tokenizer: Callable[[Column], Column] = bm25.tokens

    @classmethod
    def of(cls, chunks: DataFrame, embedder: Embedder, tokenizer: Callable[[Column], Column] = bm25.tokens) -> Collection:
        """Index chunks (id, text, source and, if embedded, vector), in the shared folder."""
        vectors = chunks.select("id", "vector") if "vector" in chunks.columns else materialize(chunks.select("id", embed(embedder, F.col("text")).alias("vector")), "vectors")
        return cls(chunks.select("id", "text", "source"), vectors, bm25.Index.build(chunks, tokenizer=tokenizer), tokenizer)


def ranges_of(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges that hold all ids, with the widest gaps between them left out."""
    own = sorted(set(ids))
    gaps = sorted(range(1, len(own)), key=lambda i: own[i - 1] - own[i])[: most - 1]
    cuts = [0, *sorted(i for i in gaps if own[i] - own[i - 1] > 1), len(own)]
    return [(own[a], own[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _any(tests: list[Column]) -> Column:
    """Any of many tests, as a flat tree."""
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def with_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with the text and source of chunks (id, text, source).

    Up to LOOKED_UP different ids are read by ranges of ids: of chunks that are stored in the order of ids, as those of a
    store are, only the pages that hold them.
    """
    ranked = materialize(ranked, "ranked")
    n = ranked.count()
    few = F.broadcast(ranked) if n <= BROADCAST_RANKED else ranked
    if 0 < n <= LOOKED_UP:
        found = ranges_of([r["id"] for r in ranked.select("id").distinct().collect()])  # at most LOOKED_UP numbers
        chunks = chunks.where(_any([F.col("id").between(a, b) if a < b else F.col("id") == a for a, b in found]))
    return few.join(chunks.select("id", "text", F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source")), "id")


def places(held: Collection, queries: DataFrame, embedder: Embedder, fetch: int) -> DataFrame:
    """query_id, text, source, list (0 dense, 1 BM25), rank: both lists, whose texts are read in one pass."""
    asked = queries.select("query_id", embed(embedder, F.col("text"), is_query=True).alias("vector"))
    dense = dense_topk(held.vectors, asked, fetch).select("query_id", "id", F.lit(0).alias("list"), "rank")
    sparse = bm25.search(held.index, queries, fetch, held.tokenizer).select("query_id", "id", F.lit(1).alias("list"), "rank")
    return with_text(dense.unionByName(sparse), held.rows).drop("id")


def hybrid_retrieve(chunks: DataFrame | Collection, queries: DataFrame, embedder: Embedder, top_k: int | None = None, threshold: float | None = None, reranker: Reranker | None = None, settings: Settings | None = None) -> DataFrame:
    """query_id, rank, text, source, score. chunks: a Collection, or rows to make one of; queries: query_id, text. A top_k of
    0 or None and a threshold of None are the settings'."""
    settings = settings or Settings()
    top_k = top_k or settings.top_k
    threshold = settings.score_threshold if threshold is None else threshold
    fetch = recall_size(top_k)
    held = chunks if isinstance(chunks, Collection) else Collection.of(chunks, embedder)
    fused = fuse(places(held, queries, embedder, fetch), fetch)
    best = threshold_topk(rerank(fused, queries, reranker), top_k, threshold)
    return best.select("query_id", "rank", "text", "source", F.round("score", 4).alias("score"))


def format_context(ranked: DataFrame, mask=None) -> DataFrame:
    """query_id, context: the texts under numbered headings with their sources. mask: a Column function for the texts."""
    text = mask(F.col("text")) if mask else F.col("text")
    block = F.concat(F.lit("[片段"), F.col("rank").cast("string"), F.lit("｜来源:"), F.col("source"), F.lit("]\n"), text)
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"))
