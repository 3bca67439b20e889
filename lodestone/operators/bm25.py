"""BM25 over a batch of questions, from a postings index.

idf = ln(N - n + 0.5) - ln(n + 0.5); where that is negative it is EPSILON times the mean idf of the vocabulary. A token
that a question repeats counts as often.

The index is one row for each token of each block of documents: which documents of the block hold it, how often, and their
lengths. It is built where the texts are read, without a shuffle, and sorted by token, so that a search skips the pages of
tokens nobody asked for. A search brings the rows of a block together, adds up the scores of all questions over the
block's documents, and passes on each task's best k: pairs of questions and documents are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.best import SCHEMA, SPARE, Best
from lodestone.operators.dense import QUERY_BLOCK, passes, top_k
from lodestone.plans.runtime import materialize

#: The constants of BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words, single Han characters and single other marks; case is kept.
TOKENS = r"[A-Za-z0-9]+|[一-鿿]|[^\sA-Za-z0-9]"
#: Documents of a block, and their tokens: a task holds the postings of one block.
BLOCK, BLOCK_TOKENS = 8192, 2_000_000
#: Pairs of a token and a document that leave a task at once.
ROW_PAIRS = 1 << 18
#: Questions of one pass over the postings: their tokens and weights go to every task.
PASS_QUESTIONS = 5_000
#: Asked tokens up to which the scan is filtered by them.
PUSHED_TOKENS = 200

POSTINGS = "block long, tok string, n long, total long, ids binary, tfs binary, lens binary"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKENS), F.lit(0))


def cut_by(cut: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A tokenizer from a Python function, such as a dictionary segmenter's: blank tokens are dropped."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for w in cut(t or "") if w.strip()])

    return run


@dataclass
class Corpus:
    """vocabulary: tok, df, idf; n documents of `length` tokens together."""

    vocabulary: DataFrame
    n: int
    length: int


def weigh(counts: DataFrame, n: int) -> DataFrame:
    """counts (tok, df) with idf for n documents."""
    raw = counts.withColumn("raw", F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.coalesce(F.avg("raw"), F.lit(0.0))).first()[0]
    return raw.select("tok", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def corpus(docs: DataFrame, id_col: str = "id", tokenizer=tokens) -> Corpus:
    """Statistics of docs (id_col, text). Counts are combined before they are shuffled."""
    rows = docs.select(tokenizer(F.col("text")).alias("toks"))
    n, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
    counts = rows.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    return Corpus(weigh(counts, n), n, length)


# ---- the index ----


def _pairs(batch: pa.RecordBatch):
    """Of a batch of documents (id, toks): its words, and for each word and document that holds it their numbers and how
    often it does; ids and lengths of the documents."""
    toks = batch.column("toks")
    size = np.diff(toks.offsets.to_numpy())
    words = toks.flatten().dictionary_encode()
    pair = words.indices.to_numpy().astype(np.int64)
    pair *= len(size)
    pair += np.repeat(np.arange(len(size)), size)
    pair, tf = np.unique(pair, return_counts=True)
    code, doc = np.divmod(pair, max(len(size), 1))
    return words.dictionary, code.astype(np.int32), doc.astype(np.int32), tf.astype("<i4"), batch.column("id").to_numpy().astype("<i8"), size.astype("<i4")


def _rows(block: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The postings of a block from the pairs of its batches, some words at a time."""
    words = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
    own = np.split(words.indices.to_numpy(), np.cumsum([len(h[0]) for h in held])[:-1])
    first = np.cumsum([0, *(len(h[4]) for h in held)])
    code = np.concatenate([o[h[1]] for o, h in zip(own, held, strict=True)])
    doc = np.concatenate([h[2] + np.int32(n) for n, h in zip(first, held, strict=False)])
    tf, ids, size = (np.concatenate([h[i] for h in held]) for i in (3, 4, 5))
    held.clear()
    order = np.argsort(code, kind="stable")  # documents are in order in each word
    code, doc, tf = code[order], doc[order], tf[order]
    del order
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    cut = np.append(start, len(code))
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + ROW_PAIRS, "right")) - 1)
        at = cut[a : b + 1]
        some = slice(at[0], at[-1])

        def packed(flat: np.ndarray, at=at, n=b - a) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((at - at[0]) * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])

        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(b - a, block)), words.dictionary.take(pa.array(code[start[a:b]])), pa.array(np.diff(at)), pa.array(np.add.reduceat(tf[some], at[:-1] - at[0], dtype=np.int64)), packed(ids[doc[some]]), packed(np.ascontiguousarray(tf[some])), packed(size[doc[some]])],
            names=["block", "tok", "n", "total", "ids", "tfs", "lens"],
        )
        a = b


def _invert(segment: int):
    def run(batches):
        block, held, rows, toks = (segment << 48) | (TaskContext.get().partitionId() << 24), [], 0, 0
        for batch in batches:
            size = np.diff(batch.column("toks").offsets.to_numpy())
            lo = 0
            while lo < len(batch):
                room = int(np.searchsorted(np.cumsum(size[lo : lo + BLOCK - rows]), BLOCK_TOKENS - toks, "right"))
                if not room and rows:  # full
                    if sum(len(h[1]) for h in held):
                        yield from _rows(block, held)
                    block, held, rows, toks = block + 1, [], 0, 0
                    continue
                part = batch.slice(lo, max(room, 1))  # a document of more tokens is a block
                held.append(_pairs(part))
                lo, rows, toks = lo + len(part), rows + len(part), toks + int(size[lo : lo + len(part)].sum())
        if sum(len(h[1]) for h in held):
            yield from _rows(block, held)

    return run


def invert(docs: DataFrame, id_col: str = "id", tokenizer=tokens, segment: int = 0) -> DataFrame:
    """The postings of docs (id_col long, unique; text), each task's sorted by token. segment keeps blocks of several
    tables apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), tokenizer(F.col("text")).alias("toks"))
    return rows.mapInArrow(_invert(segment), POSTINGS).sortWithinPartitions("tok", "block")


def counts_of(postings: DataFrame) -> DataFrame:
    """tok, df, total: documents that hold a token, and how often all do."""
    return postings.groupBy("tok").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))


@dataclass
class Index:
    """Postings of a table, with the vocabulary (tok, df, idf), the number of documents and of tokens."""

    postings: DataFrame
    vocabulary: DataFrame
    n: int
    length: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "id", tokenizer=tokens) -> Index:
        postings = materialize(invert(docs, id_col, tokenizer), "postings")
        return cls.of(postings, materialize(counts_of(postings), "token-counts"), docs.count())

    @classmethod
    def of(cls, postings: DataFrame, counts: DataFrame, n: int) -> Index:
        """counts as counts_of() gives them; n: documents, those without tokens among them."""
        length = counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        return cls(postings, weigh(counts, n), n, length)


def _score(names: np.ndarray, asked: dict[str, tuple[np.ndarray, np.ndarray]], avgdl: float, k: int):
    """asked: the questions (by number) that hold a token, in order, and its weight in each."""

    def run(batches):
        best = Best(len(names), k + SPARE)

        def flush(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
            ids, place = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
            at = np.split(place, np.cumsum([len(r[1]) for r in rows])[:-1])
            for lo in range(0, len(names), QUERY_BLOCK):
                total = np.zeros((min(QUERY_BLOCK, len(names) - lo), len(ids)))
                for (tok, _, part), col in zip(rows, at, strict=True):
                    q, w = asked[tok]
                    a, b = np.searchsorted(q, (lo, lo + QUERY_BLOCK))
                    if a < b:
                        total[q[a:b, None] - lo, col] += w[a:b, None] * part
                best.add_block(lo, ids, total, 0.0)

        held: list[tuple[str, np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            block = batch.column("block").to_numpy()
            for i, tok in enumerate(batch.column("tok").to_pylist()):
                if held and block[i] != now:
                    flush(held)
                    held = []
                now = block[i]
                ids, tf, size = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("ids", "<i8"), ("tfs", "<i4"), ("lens", "<i4")))
                held.append((tok, ids.copy(), tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avgdl))))
        if held:
            flush(held)
        yield best.batch(names)

    return run


def search(index: Index, queries: DataFrame, k: int, tokenizer=tokens) -> DataFrame:
    """query_id, id, score above 0, rank. Ties go to the smaller id, which stands for the order of insertion."""
    avgdl = (index.length / index.n if index.n else 1.0) or 1.0

    def one(part: DataFrame) -> DataFrame:
        asked = part.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokenizer(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count(F.lit(1)).alias("qtf"))
        rows = index.vocabulary.join(asked, "tok").select("query_id", "tok", (F.col("idf") * F.col("qtf")).alias("weight")).orderBy("query_id").collect()  # the questions of one pass
        names = np.array(sorted({r["query_id"] for r in rows}), np.int64)
        number = {q: i for i, q in enumerate(names.tolist())}
        held: dict[str, list] = {}
        for r in rows:
            held.setdefault(r["tok"], []).append((number[r["query_id"]], r["weight"]))
        weights = {t: (np.array([q for q, _ in x], np.int64), np.array([w for _, w in x])) for t, x in held.items()}
        postings = index.postings
        if held and len(held) <= PUSHED_TOKENS:  # as comparisons, which reach the pages of the scan
            postings = postings.where(reduce(lambda a, b: a | b, (F.col("tok") == t for t in held)))
        else:
            known = postings.sparkSession.createDataFrame([(t,) for t in held], "tok string")
            postings = postings.join(F.broadcast(known), "tok", "left_semi")  # tokens of one pass
        near = postings.select("block", "tok", "ids", "tfs", "lens").repartition("block").sortWithinPartitions("block")
        found = near.mapInArrow(_score(names, weights, avgdl, k), SCHEMA)
        return top_k(found.withColumn("score", F.round("score", 6)).where("score > 0"), k, "id").select("query_id", "id", "score", "rank")

    return passes(queries, PASS_QUESTIONS, one)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "id", tokenizer=tokens) -> DataFrame:
    """search() over docs (id_col, text) without an index kept for them."""
    return search(Index.build(docs, id_col, tokenizer), queries, k, tokenizer)
