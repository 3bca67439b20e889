"""First-wins dedup and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import UNKNOWN_SOURCE
from lodestone.plans.runtime import materialize


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys, the first in `order`.

    The least row of each key is an aggregate, combined before the shuffle, so a key that many rows share costs no task
    more than one row for each map task. `order` must tell rows of a key apart for the choice to be unique.
    """
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return least.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def dedup_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """total, kept and skipped rows."""
    counts = rows.groupBy(*keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kept"))
    return counts.select("total", "kept", (F.col("total") - F.col("kept")).alias("skipped"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """With `no`, a long, 1 to n in the order of `by` (unique). Ranges of rows are sorted and written; a row's number is its
    place in its range and the rows of the ranges before, of which there is one number each."""
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(ranged, "numbered")
    part, inside = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for p, n in sorted(map(tuple, placed.groupBy(part).count().collect())):  # one row for each range
        starts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select(*rows.columns, (F.col("_before") + inside + 1).alias("no"))


def list_sources(chunks: DataFrame) -> DataFrame:
    """source, chunks: a null source is the unknown one. In code-point order."""
    return chunks.groupBy(F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("chunks")).orderBy("source")


def source_totals(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
