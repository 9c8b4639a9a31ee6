"""Operations on whole clouds: union of levels of detail, pruning of harmonics, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import scalar
from cloudloom.schema import COEFFICIENTS, ROTATION, SCALES


def filter_harmonics(df: DataFrame, degree: int) -> DataFrame:
    """The first 0, 3 or 8 coefficients of each colour plane; 3 or more keeps all, and nothing is widened. A negative degree is no filter."""
    if degree < 0 or degree >= 3:
        return df
    t, c = F.lit(COEFFICIENTS[degree]), F.floor(F.size("f_rest") / 3).cast("int")
    planes = F.concat(*[F.slice("f_rest", k * c + 1, t) for k in range(3)])
    return df.withColumn("f_rest", F.when(c > t, planes).otherwise(F.col("f_rest")))


def widened(rest: Column, coefficients: int) -> Column:
    """Colour planes padded with zeros to so many coefficients each."""
    c = F.floor(F.size(rest) / 3).cast("int")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.lit(coefficients) - c)
    return F.concat(*[x for k in range(3) for x in (F.slice(rest, k * c + 1, c), zeros)])


def union(parts: list[tuple[DataFrame, int]], widths: list[int] | None = None) -> DataFrame:
    """UNION ALL of clouds and their levels of detail; gid is the file's number above bit 40 and the row's number in it. Planes of
    harmonics get the widest width. widths: the lengths of f_rest by part, where they are known; else they are looked for."""
    out = None
    for k, (df, lod) in enumerate(parts):
        if not 0 <= lod <= 255:
            raise ValueError(f"level of detail {lod} is not within 0..255")
        one = df.withColumn("gid", F.lit(k << 40) + F.col("gid")).withColumn("lod", F.lit(lod).cast("smallint"))
        out = one if out is None else out.unionByName(one)
    if "f_rest" in out.columns and len(parts) > 1:
        sizes = widths or [df.agg(F.coalesce(F.max(F.size("f_rest")), F.lit(0))).first()[0] for df, _ in parts]
        if len(set(sizes)) > 1:
            out = out.withColumn("f_rest", widened(F.col("f_rest"), max(sizes) // 3))
    return out


def subset(df: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows of df by gid with their place: picked has gid and pos."""
    return df.join(picked, "gid")


def with_covariance(df: DataFrame) -> DataFrame:
    """df with covariance, nine values by row; derived on demand, so it cannot be stale."""
    q, s = [F.col(c).cast("double") for c in ROTATION], [F.col(c).cast("double") for c in SCALES]
    return df.withColumn("covariance", F.array(*[c.cast("float") for c in scalar.covariance(q, s)]))
