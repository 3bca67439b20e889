"""Conversation repair against an exhaustive search, and against a programme that keeps audit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestone.llm import turn_repair
from lodestone.llm.turn_repair import damage, repair_conversations, repair_damaged
from tests.conftest import DATA

KIND = "conv_id long, turn long, role string, text string"
STOP = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faulty(rows):
    """(role, text, fault) of a conversation's rows (turn, role, text) in order"""
    seen, out = set(), []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "" if STOP.search(text) else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def apply(rows, runs, ops):
    """The repaired turns and the cost, or None where the edits are not allowed."""
    out, cost, at = [], 0, ""

    def insert(k):
        nonlocal at, cost
        for _ in range(k):
            at = "a" if at == "u" else "u"
            out.append(({"u": "user", "a": "assistant"}[at], ""))
            cost += 2

    for (role, text, fault), k, op in zip(rows, runs, ops, strict=False):
        insert(k)
        if op == "D":
            cost += 3
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += fault == "truncated"
        if op == "R":
            cost += 2
            at = "a" if at == "u" else "u"
            role = {"u": "user", "a": "assistant"}[at]
        else:
            at = role[:1]
        out.append((role, text))
    insert(runs[-1])
    return (out, cost) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and all(r for r, _ in out) else None


def exhaustive(rows):
    best = None
    for ops in itertools.product("DKR", repeat=len(rows)):
        for runs in itertools.product(range(3), repeat=len(rows) + 1):
            if got := apply(rows, runs, ops):
                audit = "".join("I" * k + op for k, op in zip(runs, ops, strict=False)) + "I" * runs[-1]
                if best is None or (got[1], audit) < best[:2]:
                    best = got[1], audit, got[0]
    return best


def by_strings(rows):
    best = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}
        for at, (cost, audit, out) in best.items():
            state, made = at, list(out)
            for k in range(3):
                if k:
                    state = "a" if state == "u" else "u"
                    made = [*made, ({"u": "user", "a": "assistant"}[state], "")]
                nxt = "a" if state == "u" else "u"
                found = [("D", state, 3, [])]
                if fault not in ("blank", "duplicate"):
                    short = int(fault == "truncated")
                    found.append(("R", nxt, 2 + short, [({"u": "user", "a": "assistant"}[nxt], text)]))
                    if role[:1] == nxt or (role[:1] == "s" and state == ""):
                        found.append(("K", role[:1], short, [(role, text)]))
                for op, to, more, turn in found:
                    x = cost + 2 * k + more, audit + "I" * k + op, made + turn
                    if to not in new or x[:2] < new[to][:2]:
                        new[to] = x
        best = new
    ends = {"": [], "a": [], "u": ["assistant"], "s": ["user", "assistant"]}
    return min((c + 2 * len(ends[s]), a + "I" * len(ends[s]), o + [(r, "") for r in ends[s]]) for s, (c, a, o) in best.items())


def expected(conversations):
    out = {}
    for conv, rows in conversations.items():
        rows = ordered([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
        marked = faulty(rows)
        cost, audit, made = by_strings(marked)
        turns = [t for t, *_ in rows if t is not None]
        count = lambda f: sum(x[2] == f for x in marked)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha), made
    return out


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u2"]
TEXTS = ["Yes.", "No!", "Why? ", "cut", "cut off", "", " \n", None, "汉字。", "done.\x0b", "a.b"]


def some(rng, n):
    return [(rng.choice([None, *range(2 * n + 1)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]


def test_programme_is_the_exhaustive_search():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(12):
            rows = faulty(ordered([(t, r or "", x or "") for t, r, x in some(rng, n)]))
            assert by_strings(rows) == exhaustive(rows)


def test_ranks_stand_for_audits():
    rng = random.Random(2)
    for _ in range(300):
        codes = [rng.choice([1, 2, 1, 2, 0, 3, 5, 9, 10, 8]) for _ in range(rng.randrange(12))]
        layer = turn_repair.start(0)
        for c in codes:
            layer, _ = turn_repair.advance(layer, c)
        cost, leave = turn_repair.finish(layer)
        audit = "".join(turn_repair.MACROS[m] for _, m in turn_repair.read_off(codes, 0, leave)) + turn_repair.ENDING[leave]
        rows = [("suax"[c & 3], "", "blank" if c & 4 else "truncated" if c & 8 else "") for c in codes]
        assert (cost, audit) == by_strings(rows)[:2]
        # pieces, joined
        k = rng.randrange(len(codes) + 1)
        whole, enter = turn_repair.start(0), []
        for part in (codes[:k], codes[k:]):
            piece = {s: turn_repair.start(s) for s in range(4)}
            for c in part:
                piece = {s: turn_repair.advance(x, c)[0] for s, x in piece.items()}
            whole, before = turn_repair.join(whole, piece)
            enter.append(before)
        assert turn_repair.finish(whole) == (cost, leave)
        middle = enter[1][leave]
        both = turn_repair.read_off(codes[:k], 0, middle) + turn_repair.read_off(codes[k:], middle, leave)
        assert "".join(turn_repair.MACROS[m] for _, m in both) + turn_repair.ENDING[leave] == audit


@pytest.fixture(scope="module")
def conversations():
    """Some hundred short ones, one without id, and one that holds over a third of all rows."""
    rng = random.Random(3)
    out = {i: some(rng, rng.randrange(1, 9)) for i in range(150)}
    out[None] = some(rng, 7)
    out[77] = [(i if i % 50 else None, rng.choice(ROLES), rng.choice([*TEXTS, f"text {rng.randrange(300)}."])) for i in range(700)] + [(9, "user", "same.")] * 60
    return out


@pytest.mark.parametrize("ranges", ["2", "16"])
def test_repair(spark, conversations, ranges):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, *r, 1, "x") for c, own in conversations.items() for r in own]
        random.Random(4).shuffle(rows)
        made = repair_conversations(spark.createDataFrame(rows, f"{KIND}, pos int, part string"))
        got = {r["conv_id"]: tuple(r)[1:] for r in made.report.collect()}
        turns = {}
        for r in made.turns.orderBy("conv_id", "position").collect():
            turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = expected(conversations)
    assert got == {c: w for c, (w, _) in want.items()}
    assert turns == {c: t for c, (_, t) in want.items() if t}


def test_damage(spark):
    rows = [(i, t, r, x) for i in range(60) for t, r, x in [(0, "user", "Hi."), (1, "assistant", "Ho! No?"), (None, None, None)]]
    got = sorted(map(tuple, damage(spark.createDataFrame(rows, KIND)).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        how = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if how == 4 else r or " ", "" if how == 1 else re.sub("[.!?]", "", x or " ") if how == 2 else x or " ")
        want += [row] * (0 if how == 0 else 2 if how == 3 else 1)
    assert got == sorted(want, key=repr)


def test_every_conversation_has_a_row(spark):
    turns = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    got = repair_damaged(turns.where("turn = 0")).collect()
    assert len(got) == turns.where("turn = 0").select("conv_id").distinct().count()
    gone = [r for r in got if zlib.crc32(f"{r['conv_id']}:0".encode()) % 20 == 0]
    assert gone and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert repair_damaged(none).count() == repair_conversations(none).turns.count() == 0
