import random

import pytest

from lodestone.operators import evaluate
from lodestone.operators.evaluate import containing


def test_short_passages_are_looked_for(spark):
    docs = spark.createDataFrame([(1, "one two three four", "a"), (2, "two three", "b"), (3, None, "c")], "id long, text string, source string")
    passages = spark.createDataFrame([(10, "two"), (11, "two three"), (12, "one two three four"), (13, "four five"), (14, None)], "query_id long, text string")
    assert sorted((r["query_id"], r["id"]) for r in containing(docs, passages).collect()) == [(10, 1), (10, 2), (11, 1), (11, 2), (12, 1)]


@pytest.mark.parametrize("chars", [evaluate.AUTOMATON_CHARS, 300])
def test_every_passage_is_found(spark, monkeypatch, chars):
    """Overlapping, nested, repeated and empty passages, by one automaton and by several, against plain search."""
    monkeypatch.setattr(evaluate, "AUTOMATON_CHARS", chars)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab汉🙂 .") for _ in range(n))
    docs = [(i, text(rng.randrange(200)), rng.choice(["s", None])) for i in range(80)] + [(80, None, "s"), (81, "", "s")]
    asked = [(i, text(rng.randrange(1, 7))) for i in range(120)] + [(120, docs[3][1]), (121, docs[3][1]), (122, ""), (123, None)]
    found = containing(spark.createDataFrame(docs, "id long, text string, source string"), spark.createDataFrame(asked, "query_id long, text string"))
    want = sorted((q, i, s or "") for i, d, s in docs for q, t in asked if d is not None and t is not None and t in d)
    assert sorted((r[0], r[1], r[2] or "") for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
