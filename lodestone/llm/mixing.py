"""Mixing sources to target weights by hierarchical budgeting.

The budget of tokens flows down a tree of domain, language and source. At every node it is shared among the children by
weight; a child that cannot use its share (its leaves hold too few tokens for the epochs allowed) takes what it can, and
its shortage goes to its siblings by weight. Only what a whole node cannot use goes to the node's own siblings. Each leaf
then has a quota: whole epochs of its documents, and a prefix by tokens of one more epoch, in an order seeded for that
epoch. The prefix ends at a hash value, found slice by slice: sums over SLICES parts of the hash range, then over parts of
the part that holds the end, then in order within that one. So no leaf is ever sorted or gathered, and applying the plan is
a comparison for each row, without a shuffle. Rows with one hash (copies of one row) are told apart by a second one.

Up to MOST_LEAVES leaves the tree is worked out on the driver; larger trees stay tables: a node's water level is found by
sums over its children, and whole tokens by rounding running sums.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.runtime import materialize, prepare

LEVELS = ("domain", "lang", "source")
SLICES = 256
#: Leaves up to which the driver works the tree out and the plan is sent to every task.
MOST_LEAVES = 200_000
#: Rounds of a search for a water level, each 16 times finer.
ROUNDS = 13


def share(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Split budget by weight, no part above its room; shortages go to the others by weight. Whole tokens."""
    out = [0] * len(room)
    left = min(budget, sum(room))
    # children without weight serve only when no other has room
    for tier in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        open_ = [i for i in tier if room[i] > 0]
        while left and open_:
            heavy = {i: weights[i] if weights[i] > 0 else 1.0 for i in open_}
            total = sum(heavy.values())
            full = [i for i in open_ if left * heavy[i] / total >= room[i] - out[i]]
            if full:
                for i in full:
                    left -= room[i] - out[i]
                    out[i] = room[i]
                open_ = [i for i in open_ if i not in set(full)]
                continue
            want = {i: left * heavy[i] / total for i in open_}
            for i in open_:
                out[i] += int(want[i])
            rest = left - sum(int(want[i]) for i in open_)
            for i in sorted(open_, key=lambda i: (int(want[i]) - want[i], i))[:rest]:
                out[i] += 1
            return out
    return out


@dataclass
class Weights:
    """Target weights by level and label; a label that is not named weighs `other` among its siblings."""

    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    other: float = 1.0

    def of(self, level: int, label: str) -> float:
        return getattr(self, LEVELS[level]).get(label, self.other)


def budget_tree(tokens: dict[tuple[str, ...], int], budget: int, weights: Weights, epochs: int) -> dict[tuple[str, ...], int]:
    """The quota of each leaf (domain, lang, source)."""
    room: dict[tuple[str, ...], int] = defaultdict(int)
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = defaultdict(set)
    for leaf, n in tokens.items():
        for depth in range(len(leaf) + 1):
            room[leaf[:depth]] += n * epochs
            if depth:
                children[leaf[: depth - 1]].add(leaf[:depth])
    quota = {(): min(budget, room[()])}
    for depth in range(len(LEVELS)):
        for node in sorted(k for k in quota if len(k) == depth):
            below = sorted(children[node])
            parts = share(quota[node], [weights.of(depth, c[-1]) for c in below], [room[c] for c in below])
            quota |= dict(zip(below, parts, strict=True))
    return {leaf: quota.get(leaf, 0) for leaf in tokens}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _label(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _place(seed: int, epoch: Column, doc_id: Column, mark: Column) -> Column:
    """Place of a row in its leaf's epoch, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), doc_id, mark), 1)


def _copy(uid: Column) -> Column:
    """Place of a row among those with its doc_id and text, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(uid), 1)


def _facts(docs: DataFrame, domain: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), _label("lang").alias("lang"), _label("source").alias("source"),
        word_count(F.col("text").cast("string")).alias("tokens"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.monotonically_increasing_id().alias("uid"),
    )


def _weight(weights: Weights, level: int) -> Column:
    named = getattr(weights, LEVELS[level])
    if not named:
        return F.lit(float(weights.other))
    known = F.create_map(*(F.lit(x) for pair in named.items() for x in (pair[0], float(pair[1]))))
    return F.coalesce(known[F.col(LEVELS[level])], F.lit(float(weights.other)))


def _running(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value before each row of its group, in the order of `slice`, then `child`: sums of slices first,
    so that no task orders a whole group."""
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*by, "slice").agg(F.sum(value).alias("_sum")).select(*by, "slice", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(*by, "slice").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0.0))).join(slices, [*by, "slice"]).withColumn(name, F.col("_before") + F.col("_inside"))


def budget_table(leaves: DataFrame, budget: int, weights: Weights, epochs: int) -> DataFrame:
    """budget_tree() for any number of leaves (domain, lang, source, tokens): the same columns with quota.

    Parts differ from budget_tree()'s by less than two tokens, as they are rounded along running sums.
    """
    quota = None
    for depth in range(len(LEVELS)):
        parents, own = list(LEVELS[:depth]), LEVELS[depth]
        rows = leaves.groupBy(*parents, own).agg((F.sum("tokens") * epochs).cast("double").alias("room")).where("room > 0")
        rows = rows.withColumn("w", _weight(weights, depth)).withColumn("tier", F.col("w") <= 0).withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
        rows = rows.withColumn("root", F.lit(0)) if depth == 0 else rows
        by = parents or ["root"]
        rows = materialize(rows, "mix-children")
        first, second = F.sum(F.when(~F.col("tier"), F.col("room")).otherwise(0.0)), F.sum(F.when(F.col("tier"), F.col("room")).otherwise(0.0))
        sums = rows.groupBy(*by).agg(first.alias("r0"), second.alias("r1"), F.max(F.col("room") / F.col("w")).alias("top"))
        sums = sums.withColumn("quota", F.lit(float(budget))) if quota is None else sums.join(quota.withColumnRenamed("quota", "given"), by).withColumnRenamed("given", "quota")
        sums = sums.withColumn("b0", F.least("quota", "r0"))
        tiers = F.array(F.struct(F.lit(False).alias("tier"), F.col("b0").alias("b")), F.struct(F.lit(True).alias("tier"), F.least(F.col("quota") - F.col("b0"), F.col("r1")).alias("b")))
        level = sums.select(*by, F.lit(0.0).alias("lo"), F.col("top").alias("hi"), F.inline(tiers))
        level = materialize(level, "mix-level")
        for _ in range(ROUNDS):
            step = (F.col("hi") - F.col("lo")) / 16
            used = [F.sum(F.least(F.col("room"), (F.col("lo") + step * j) * F.col("w"))).alias(f"f{j}") for j in range(1, 16)]
            seen = rows.join(level, [*by, "tier"]).groupBy(*by, "tier", "lo", "hi", "b").agg(*used)
            k = sum((F.when(F.col(f"f{j}") < F.col("b"), 1).otherwise(0) for j in range(1, 16)), F.lit(0))
            level = materialize(seen.select(*by, "tier", "b", (F.col("lo") + step * k).alias("lo"), F.when(k == 15, F.col("hi")).otherwise(F.col("lo") + step * (k + 1)).alias("hi")), "mix-level")
        fill = rows.join(level, [*by, "tier"]).withColumn("q", F.least(F.col("room"), F.col("hi") * F.col("w"))).withColumn("child", F.col(own)).withColumn("slice", F.pmod(F.xxhash64(own), F.lit(4096)).cast("int"))
        fill = _running(fill, [*by, "tier"], "q", "before")
        # a hair above whole numbers, so that sums which are whole are not rounded down
        whole = lambda c: F.floor(F.least(c, F.col("b")) + 1e-3)
        quota = materialize(fill.select(*parents, own, (whole(F.col("before") + F.col("q")) - whole(F.col("before"))).cast("double").alias("quota")), "mix-quota")
    return leaves.join(quota, list(LEVELS), "left").withColumn("quota", F.coalesce("quota", F.lit(0.0)).cast("long"))


def _cut(rows: DataFrame, send) -> DataFrame:
    """Where the prefix of each leaf ends. rows: LEVELS, rest, key, tokens; returns LEVELS, edge, before (tokens of lesser
    keys), at_edge and copies (tokens and rows of the key itself) for every leaf in which a key is reached."""
    upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.lit(0).cast("long"))
    for shift in (63 - 8, 63 - 16):
        rows = rows.withColumn("slice", F.shiftright("key", shift).bitwiseAND(F.lit(SLICES - 1)))
        sums = rows.groupBy(*LEVELS, "slice", "rest", "offset").agg(F.sum("tokens").alias("n"))
        sums = sums.withColumn("before", F.col("offset") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        edge = materialize(sums.where("before < rest AND rest <= before + n").select(*LEVELS, "slice", "before"), "mix-slice")
        rows = rows.join(send(edge), [*LEVELS, "slice"])  # one slice for each leaf
        rows = materialize(rows.select(*LEVELS, "rest", "key", "tokens", F.col("before").alias("offset")), "mix-inside")
    keys = rows.groupBy(*LEVELS, "key", "rest", "offset").agg(F.sum("tokens").alias("at_edge"), F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("before", F.col("offset") + F.coalesce(F.sum("at_edge").over(order), F.lit(0)))
    return keys.where("before < rest AND rest <= before + at_edge").select(*LEVELS, F.col("key").alias("edge"), "before", "at_edge", "copies", "rest")


def mixing_plan(facts: DataFrame, budget: float, weights: Weights, epochs: int = 1, seed: int = 42) -> tuple[DataFrame, bool]:
    """One row for each leaf: domain, lang, source, available, quota, epoch (whole epochs taken), edge, copy_edge and cut;
    and whether there are few enough for every task.

    A row of the next epoch is taken if its place is below edge, or at edge and its place among copies at most copy_edge
    (null: no copies); the last row taken gives `cut` tokens. budget: tokens, or a share of all tokens if it is a float of
    1.0 or less.
    """
    spark = facts.sparkSession
    leaves = materialize(facts.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    want = int(total * budget) if isinstance(budget, float) and budget <= 1.0 else int(budget)
    held = leaves.limit(MOST_LEAVES + 1).collect()
    small = len(held) <= MOST_LEAVES
    if small:
        tokens = {tuple(r[c] for c in LEVELS): int(r["tokens"]) for r in held}
        rows = [(*leaf, tokens[leaf], n) for leaf, n in budget_tree(tokens, want, weights, epochs).items()]
        plan = spark.createDataFrame(rows, "domain string, lang string, source string, available long, quota long")
    else:
        plan = budget_table(leaves, min(want, total * epochs), weights, epochs).withColumnRenamed("tokens", "available")
    send = F.broadcast if small else (lambda x: x)  # at most MOST_LEAVES rows
    whole = F.when(F.col("available") > 0, F.floor(F.col("quota") / F.col("available"))).otherwise(0).cast("long")
    plan = plan.withColumn("epoch", whole).withColumn("rest", F.when(F.col("available") > 0, F.col("quota") - F.col("epoch") * F.col("available")).otherwise(0))
    plan = materialize(plan, "mix-budget")
    part = facts.join(send(plan.where("rest > 0")), list(LEVELS))
    part = part.withColumn("key", _place(seed, F.col("epoch"), F.col("doc_id"), F.col("mark")))
    edges = materialize(_cut(part.select(*LEVELS, "rest", "key", "tokens"), send), "mix-edges")
    ties = edges.where("copies > 1").select(*LEVELS, "edge", (F.col("rest") - F.col("before")).alias("left"))
    again = edges.limit(0).select(*LEVELS, F.col("edge").alias("copy_edge"), F.col("rest").alias("copy_cut"))
    if not ties.isEmpty():
        copies = part.drop("rest").join(send(ties), list(LEVELS)).where(F.col("key") == F.col("edge"))
        copies = _cut(copies.select(*LEVELS, F.col("left").alias("rest"), _copy(F.col("uid")).alias("key"), "tokens"), send)
        again = copies.select(*LEVELS, F.col("edge").alias("copy_edge"), (F.col("rest") - F.col("before")).alias("copy_cut"))
    ends = edges.select(*LEVELS, "edge", (F.col("rest") - F.col("before")).alias("own")).join(again, list(LEVELS), "left")
    ends = ends.select(*LEVELS, "edge", "copy_edge", F.coalesce("copy_cut", "own").alias("cut"))
    return materialize(plan.drop("rest").join(ends, list(LEVELS), "left"), "mix-plan"), small


def _taken(facts: DataFrame, plan: DataFrame, small: bool, seed: int) -> DataFrame:
    placed = facts.join(F.broadcast(plan) if small else plan, list(LEVELS))
    placed = placed.withColumn("key", _place(seed, F.col("epoch"), F.col("doc_id"), F.col("mark"))).withColumn("copy", _copy(F.col("uid")))
    at = F.col("key") == F.col("edge")
    whole = (F.col("key") < F.col("edge")) | (at & F.coalesce(F.col("copy") < F.col("copy_edge"), F.lit(False)))
    last = at & F.coalesce(F.col("copy") == F.col("copy_edge"), F.lit(True))
    part = F.when(whole, F.col("tokens")).when(last, F.least("tokens", "cut")).otherwise(0)
    return placed.withColumn("part_tokens", part).withColumn("selected", (F.col("epoch") > 0) | F.coalesce(whole | last, F.lit(False)))


def mix_sources(docs: DataFrame, domain: Column, budget: float, weights: Weights, epochs: int = 1, seed: int = 42) -> DataFrame:
    """What of every row the mixture takes: doc_id, domain, lang, source, tokens, epochs, part_tokens, taken_tokens,
    selected.

    docs: doc_id long, text, lang and source string; other columns are read only by `domain`, an expression over docs.
    epochs: whole epochs of the row's leaf; part_tokens: the row's tokens in the next epoch's prefix, of which the last row
    is cut. Tokens are words `[^\\x20\\x09-\\x0D]+` of the whole text.

    - A null domain, language or source is the label "". A null or empty text has no tokens and goes with its neighbours.
    - Rows with the same doc_id and text are neighbours in their leaf's order; which of them come first follows from their
      place in the table.
    - A budget above epochs * all tokens takes everything that often. No rows give no rows. Any number of leaves.
    """
    prepare(docs.sparkSession)
    facts = materialize(_facts(docs, domain), "mix-facts")
    plan, small = mixing_plan(facts, budget, weights, epochs, seed)
    taken = F.col("epoch") * F.col("tokens") + F.col("part_tokens")
    return _taken(facts, plan, small, seed).select("doc_id", *LEVELS, "tokens", F.col("epoch").alias("epochs"), "part_tokens", taken.alias("taken_tokens"), "selected")


def keep_mixed(docs: DataFrame, domain: Column, budget: float, weights: Weights, seed: int = 42) -> DataFrame:
    """The rows of docs that a mixture of one epoch takes, whole, with all their columns, which may have any names.

    A filter by each leaf's edge, without a shuffle up to MOST_LEAVES leaves.
    """
    prepare(docs.sparkSession)
    facts = materialize(_facts(docs, domain), "mix-facts")
    plan, small = mixing_plan(facts, budget, weights, 1, seed)
    names = {c: f"_{c}_{uuid.uuid4().hex}" for c in (*LEVELS, "epoch", "edge", "copy_edge", "uid")}  # no column of docs has them
    leaf = plan.select(*(F.col(c).alias(names[c]) for c in (*LEVELS, "epoch", "edge", "copy_edge")))
    rows = docs.withColumn(names["uid"], F.monotonically_increasing_id())
    same = [F.coalesce(domain.cast("string"), F.lit("")), _label("lang"), _label("source")]
    for c, label in zip(LEVELS, same, strict=True):
        rows = rows.withColumn(names[c], label)
    rows = rows.join(F.broadcast(leaf) if small else leaf, [names[c] for c in LEVELS])
    place = _place(seed, F.col(names["epoch"]), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    copy = F.coalesce(_copy(F.col(names["uid"])) <= F.col(names["copy_edge"]), F.lit(True))
    edge = F.col(names["edge"])
    return rows.where((F.col(names["epoch"]) > 0) | (place < edge) | ((place == edge) & copy)).select(*(F.col(f"`{c}`") for c in docs.columns))


def source_group(parts: int = 4) -> Column:
    """A domain for tables that name none: the number at the end of the source, modulo `parts`."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", F.lit("0")).otherwise((number.cast("long") % parts).cast("string")))
