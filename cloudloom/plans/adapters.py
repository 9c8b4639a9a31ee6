"""Driver tables as clouds, vectors and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.schema import COLOURS, ROTATION, SCALES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as positions: gid, lod, x, y, z."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("gid"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("smallint").alias("lod"),
        (F.col("o_totalprice") / 1000).cast("float").alias("x"), F.col("o_custkey").cast("float").alias("y"), day.cast("float").alias("z"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a full splat cloud without harmonics; the other attributes follow from the key and price."""
    key, price = F.col("gid"), F.col("x").cast("double")
    made = {c: (((price * (k + 3)) % 97) / F.lit(97.0) * -4 - k / 10).cast("float") for k, c in enumerate(SCALES)}
    made |= {c: (((key * (2 * k + 5)) % 101) / F.lit(50.0) - 1).cast("float") for k, c in enumerate(ROTATION)}
    made |= {"opacity": (price / 100 - 2).cast("float")}
    made |= {c: (((price * (k + 7)) % 89) / F.lit(44.0) - 1).cast("float") for k, c in enumerate(COLOURS)}
    return points(spark, sf_dir).withColumns(made)


def vectors(spark: SparkSession, sf_dir: str, length: int | None = None) -> DataFrame:
    """embeddings as id and vec."""
    v = F.col("embedding") if length is None else F.slice("embedding", 1, length)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("vec"))


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 1 to 4 of embeddings as a rotation, 5 to 7 as scales, 8 to 10 as a position."""
    e = lambda k: F.element_at("embedding", k).cast("float")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), *[e(k + 1).alias(c) for k, c in enumerate(ROTATION)], *[e(k + 5).alias(c) for k, c in enumerate(SCALES)], *[e(k + 8).alias(c) for k, c in enumerate("xyz")])
