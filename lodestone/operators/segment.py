"""Words of Han text, which has no spaces: a dictionary learnt from the corpus by counts, and the best path through it.

A string of two to MOST_CHARS Han characters is a word if it is frequent and its parts meet more often than chance has
them meet. A run of Han characters is cut where the product of its words' shares is greatest: each position keeps the
best way to it, over all words of the dictionary that end there, which one automaton finds in one reading. The words of
the first cut are counted anew, so that a part of a longer word is not credited with it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import cached_property

import ahocorasick
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import HAN
from lodestone.operators.bm25 import TOKENS, cut_by
from lodestone.plans.runtime import materialize

#: Characters of the longest word; how often a word occurs at least; how many times more often than by chance its parts
#: meet at least; words of a dictionary, the most frequent first, which every worker holds.
MOST_CHARS, LEAST_COUNT, LEAST_TIE, MOST_WORDS = 4, 5, 20.0, 200_000

_RUN = re.compile(r"[一-鿿]+")


def gram_counts(docs: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """gram, n: how often each string of up to `most` Han characters occurs in docs (text), across runs of them."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{HAN}]+"), F.lit(0))).alias("run"))

    def inside(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, F.lit(n)))
        return F.when(F.length("run") >= n, each).otherwise(F.array().cast("array<string>"))

    longer = [inside(n) for n in range(2, most + 1)]
    grams = runs.select(F.explode(F.concat(F.split("run", ""), *longer)).alias("gram")).where("gram <> ''")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(counts: DataFrame, least: int = LEAST_COUNT, tie: float = LEAST_TIE) -> DataFrame:
    """word, n of gram_counts(): single characters, and longer grams that occur `least` times or more, of which every cut in
    two has parts that meet at least `tie` times as often as if each stood anywhere."""
    counts = materialize(counts, "gram-counts")
    total = counts.where(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where((F.length("gram") > 1) & (F.col("n") >= least))
    at = F.explode(F.sequence(F.lit(1), F.length("gram") - 1))
    cut = often.select("gram", "n", at.alias("i")).select("gram", "n", F.expr("left(gram, i)").alias("a"), F.expr("substring(gram, i + 1)").alias("b"))
    part = lambda c: counts.select(F.col("gram").alias(c), F.col("n").alias(f"n_{c}"))
    met = cut.join(part("a"), "a").join(part("b"), "b")
    near = met.groupBy("gram", "n").agg(F.min(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))).alias("tie"))
    single = counts.where(F.length("gram") == 1).select(F.col("gram").alias("word"), "n")
    return single.unionByName(near.where(F.col("tie") >= tie).select(F.col("gram").alias("word"), "n"))


class Segmenter:
    """counts: how often each word of the dictionary occurs."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts

    @cached_property
    def _trie(self):
        total = math.log(max(sum(self.counts.values()), 1))
        out = ahocorasick.Automaton()
        for word, n in self.counts.items():
            if word and n > 0:
                out.add_word(word, (len(word), math.log(n) - total))
        out.make_automaton()
        return out, -total - math.log(2)

    def __getstate__(self):
        return {"counts": self.counts}

    def path(self, run: str) -> list[str]:
        """The words of a run with the greatest sum of log shares; of equal ones the fewest. A character that is no word
        has half the share of a word that occurs once."""
        trie, unknown = self._trie
        ends: list[list[tuple[int, float]]] = [[] for _ in run]
        for end, word in trie.iter(run) if len(trie) else ():
            ends[end].append(word)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end, words in enumerate(ends, 1):
            if all(size > 1 for size, _ in words):
                words = [*words, (1, unknown)]
            best.append(max((best[end - size][0] + weight, best[end - size][1] - 1, size) for size, weight in words))
        out, at = [], len(run)
        while at:
            size = best[at][2]
            out.append(run[at - size : at])
            at -= size
        return out[::-1]

    def cut(self, text: str) -> list[str]:
        """Tokens of a text: runs of Han characters by path(), all else as bm25.tokens() cuts it."""
        out, at = [], 0
        for run in _RUN.finditer(text or ""):
            out += re.findall(TOKENS, text[at : run.start()], re.ASCII)
            out += self.path(run[0])
            at = run.end()
        return out + re.findall(TOKENS, (text or "")[at:], re.ASCII)

    def tokenizer(self, spark: SparkSession) -> Callable[[Column], Column]:
        """cut() as a tokenizer for bm25 and the store; the dictionary is sent to every worker once."""
        sent = spark.sparkContext.broadcast(self)
        return cut_by(lambda text: sent.value.cut(text))


def learn(docs: DataFrame, least: int = LEAST_COUNT, tie: float = LEAST_TIE, most_chars: int = MOST_CHARS, most_words: int = MOST_WORDS, rounds: int = 1) -> Segmenter:
    """A segmenter for docs (text). rounds: how often the corpus is cut and its words are counted anew.

    Texts without Han characters give an empty dictionary, by which characters stand alone. Null texts are empty.
    """

    def kept(counts: DataFrame) -> Segmenter:
        best = counts.orderBy(F.desc("n"), "word").limit(most_words)  # a bound that is a parameter: every worker holds them
        return Segmenter({r["word"]: r["n"] for r in best.collect()})

    made = kept(frequent_words(gram_counts(docs, most_chars), least, tie))
    for _ in range(rounds):
        words = docs.select(F.explode(made.tokenizer(docs.sparkSession)(F.col("text"))).alias("word")).where(F.col("word").rlike(f"^[{HAN}]+$"))
        made = kept(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    return made
