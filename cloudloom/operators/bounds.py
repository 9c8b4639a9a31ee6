"""Minima and maxima of positions, and row ids and ranks over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar
from cloudloom.shared import written

AXES = ("x", "y", "z")
MARGIN = 0.01


def aabb(df: DataFrame, *by: str, margin: float = 0.0, count: str | None = None) -> DataFrame:
    """min_x to max_z, by group if asked, of the rows whose three values are numbers, neither NaN nor infinite; null without one. count: a column for the number of rows. Partial sums meet, so it is one small shuffle."""
    value = {a: F.when(finite(*AXES), F.col(a).cast("double")) for a in AXES}
    aggs = [f(value[a]).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES] + ([F.count(F.lit(1)).alias(count)] if count else [])
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    if margin:
        out = out.withColumns({f"min_{a}": F.col(f"min_{a}") - margin for a in AXES} | {f"max_{a}": F.col(f"max_{a}") + margin for a in AXES})
    return out


def oriented_bounds(df: DataFrame) -> DataFrame:
    """df with lo_x to hi_z, the box of each splat from its position, scales and rotation."""
    s, q = [F.col(f"scale_{k}").cast("double") for k in range(3)], [F.col(f"rot_{k}").cast("double") for k in range(4)]
    r = scalar.oriented_radius(q, s)
    return df.withColumns({f"lo_{a}": F.col(a).cast("double") - r[k] for k, a in enumerate(AXES)} | {f"hi_{a}": F.col(a).cast("double") + r[k] for k, a in enumerate(AXES)})


def finite(*names: str):
    """Whether all are numbers, neither NaN nor infinite."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.abs(F.col(n)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(n)
    return out


def ranked(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """df with the rank from 1 in its group, for groups of any size: rows are dealt by range and sorted in their partitions, where
    each knows its place; the counts of earlier partitions, a row for each partition and group, are added."""
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = written(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(group, part).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    both = rows.withColumn("__part", part).join(before, [group, "__part"])
    return both.withColumn(name, place - F.col("__first") + F.col("__before") + 1).drop("__part", "__id", "__first", "__before")
