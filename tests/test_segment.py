import itertools
import math
import random

import pytest

from lodestone.config import Settings
from lodestone.engine import Engine
from lodestone.operators import bm25, segment
from lodestone.operators.segment import Segmenter, frequent_words, gram_counts, learn

WORDS = ["报销", "流程", "年假", "员工", "回收站", "文件", "会员", "存储空间", "的", "在", "有", "是"]


def sentences(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) + rng.choice(["。", " ok 12。", "\n"]) for _ in range(n)]


def value(counts, words):
    total = math.log(sum(counts.values()))
    return sum(math.log(counts[w]) - total if w in counts else -total - math.log(2) for w in words), -len(words)


def test_path_is_the_best_of_all_cuts():
    rng = random.Random(2)
    for _ in range(60):
        letters = "甲乙丙丁"[: rng.randrange(2, 5)]
        counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))): rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))}
        made = Segmenter(counts)
        for size in range(1, 9):
            run = "".join(rng.choice(letters) for _ in range(size))
            cuts = []
            for marks in itertools.product((0, 1), repeat=size - 1):
                at = [0, *(i for i, m in enumerate(marks, 1) if m), size]
                words = [run[a:b] for a, b in itertools.pairwise(at)]
                if all(len(w) == 1 or w in counts for w in words):
                    cuts.append(words)
            got = made.path(run)
            assert "".join(got) == run and got in cuts
            best = max(value(counts, c) for c in cuts)
            assert abs(value(counts, got)[0] - best[0]) < 1e-9


def test_counts_and_words_by_loops(spark):
    texts = [*sentences(80), None, "", "no han"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {}
    for t in texts:
        for run in segment._RUN.findall(t or ""):
            for n in range(1, 5):
                for i in range(len(run) - n + 1):
                    want[run[i : i + n]] = want.get(run[i : i + n], 0) + 1
    counts = gram_counts(docs)
    assert {r["gram"]: r["n"] for r in counts.collect()} == want
    total = sum(n for g, n in want.items() if len(g) == 1)
    tie = lambda g: min(want[g] * total / (want[g[:i]] * want[g[i:]]) for i in range(1, len(g)))
    words = {g: n for g, n in want.items() if len(g) == 1 or n >= 5 and tie(g) >= 8}
    assert {r["word"]: r["n"] for r in frequent_words(counts, 5, 8.0).collect()} == words


def test_learnt_words_cut_the_corpus(spark):
    docs = spark.createDataFrame([(t,) for t in sentences(600)], "text string")
    made = learn(docs, tie=8.0)
    assert made.cut("员工的年假在存储空间ok 12。") == ["员工", "的", "年假", "在", "存储空间", "ok", "12", "。"]
    rng = random.Random(5)
    right = total = 0
    for _ in range(200):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 10))]
        right += len(set(itertools.accumulate(map(len, words))) & set(itertools.accumulate(map(len, made.path("".join(words))))))
        total += len(words)
    assert right / total > 0.97
    empty = learn(docs.where("false"))
    assert empty.cut("年假 a1") == ["年", "假", "a1"] and empty.cut("") == [] and made.cut(None) == []


def test_search_by_words(spark, tmp_path):
    """A word matches whole: a text with its characters apart is not found."""
    docs = spark.createDataFrame([(t,) for t in sentences(600)], "text string")
    cut = learn(docs, tie=8.0).tokenizer(spark)
    engine = Engine(spark, str(tmp_path / "kb"), Settings(chunk_size=60, chunk_overlap=0), tokenizer=cut)
    engine.ingest_bytes([(f"{i}.txt", t.encode()) for i, t in enumerate(("员工的年假", "文件在回收站", "存储空间", "站在回", "会员有文件"))])
    asked = spark.createDataFrame([(0, "回收站"), (1, "年假"), (2, "存储空间")], "query_id long, text string")
    found = bm25.search(engine.store.collection().index, asked, 9, cut).join(engine.store.read(), "id").collect()
    assert sorted((r["query_id"], r["text"]) for r in found) == [(0, "文件在回收站"), (1, "员工的年假"), (2, "存储空间")]


@pytest.mark.parametrize("run", ["年" * 3000, "年假" * 3000])
def test_long_runs(run):
    assert "".join(Segmenter({"年假": 9, "年": 3, "假": 2}).path(run)) == run
