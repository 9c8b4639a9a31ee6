"""Morton codes and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar
from cloudloom.operators.bounds import AXES, MARGIN, aabb, ranked


def encode(df: DataFrame, *by: str) -> DataFrame:
    """df with `code`, within the bounds of all rows or of each group, widened by MARGIN. Bounds of all rows are one row and so are broadcast."""
    bounds = aabb(df, *by, margin=MARGIN)
    rows = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    low, high = [F.col(f"min_{a}") for a in AXES], [F.col(f"max_{a}") for a in AXES]
    code = scalar.morton3d(*[F.col(a).cast("double") for a in AXES], low, high)
    return rows.withColumn("code", code).drop(*bounds.columns[len(by) :])


def ordered(df: DataFrame) -> DataFrame:
    """df with code and pos, its place from 0 in Morton order; equal codes by gid."""
    rows = encode(df).withColumn("__all", F.lit(0))
    return ranked(rows, "__all", ["code", "gid"], "pos").withColumn("pos", F.col("pos") - 1).drop("__all")


def ordered_within(df: DataFrame, *by: str) -> DataFrame:
    """As ordered, within groups of bounded size (leaves of a tree)."""
    order = Window.partitionBy(*by).orderBy("code", "gid")
    return encode(df, *by).withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
