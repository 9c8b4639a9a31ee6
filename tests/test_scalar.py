"""Golden vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from cloudloom.functions import scalar


def test_morton(spark):
    points = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (-5.0, 5.0, 0.25)]
    codes = [3640, 613566232, 306784936, 153394288, 134217727, 1073738176, 323560658]
    df = spark.createDataFrame(points, "x double, y double, z double")
    got = df.select(scalar.morton3d(F.col("x"), F.col("y"), F.col("z"), [F.lit(-0.01)] * 3, [F.lit(1.01)] * 3).alias("c")).collect()
    assert [r.c for r in got] == codes


def test_quaternions(spark):
    rows = [((1, 0, 0, 0), (127, 127, 127, 252)), ((0, 1, 0, 0), (127, 127, 127, 253)), ((0, 0, -1, 0), (127, 127, 127, 254)), ((1, 1, 1, 1), (217, 217, 217, 252)), ((-1, 1, 0, 0), (0, 127, 127, 252)), ((0, 0, 0, 0), (127, 127, 127, 252)), ((0.1, 0.2, 0.3, -0.9), (109, 90, 72, 255))]
    df = spark.createDataFrame([tuple(map(float, q)) for q, _ in rows], "a double, b double, c double, d double")
    got = df.select(scalar.smallest_three([F.col(n) for n in "abcd"]).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got] == [b for _, b in rows]


def test_opacity_and_log(spark):
    df = spark.createDataFrame([(v,) for v in (-100.0, -2.0, 0.0, 2.0, 100.0)], "v double")
    assert [r.b for r in df.select(scalar.opacity_byte(F.col("v")).alias("b")).collect()] == [0, 30, 127, 224, 255]
    df = spark.createDataFrame([(v,) for v in (-10.0, -1.0, 0.0, 0.5, 10.0)], "v double")
    assert [r.b for r in df.select(scalar.log_transform(F.col("v")).alias("b")).collect()] == pytest.approx([-2.3978953, -0.6931472, 0, 0.4054651, 2.3978953], abs=1e-6)


def test_sizes(spark):
    want = {1: (4, 4, 256), 16: (4, 4, 256), 17: (8, 4, 256), 100: (12, 12, 256), 1000: (32, 32, 256), 1024: (32, 32, 1024), 6000: (80, 76, 4096), 60000: (248, 244, 32768), 600000: (776, 776, 65536)}
    for n, (w, h, p) in want.items():
        assert scalar.texture_dims(n) == (w, h) and scalar.palette_size(n) == p
    df = spark.createDataFrame([(n,) for n in want], "n long")
    w, h = scalar.texture_size(F.col("n"))
    assert {r.n: (r.w, r.h) for r in df.select("n", w.alias("w"), h.alias("h")).collect()} == {n: v[:2] for n, v in want.items()}


def test_axis_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (1.0, 3.0, 2.0), (1.0, 2.0, 3.0), (2.0, 2.0, 2.0)], "x double, y double, z double")
    assert [r.a for r in df.select(scalar.split_axis(F.col("x"), F.col("y"), F.col("z")).alias("a")).collect()] == [0, 1, 2, 0]
