"""Attributes as texture pixels: rows (ti, px, py, r, g, b, a), one for each pixel, padding included.

Positions that are not finite take no part in bounds; their bytes are those of the nearest end, and of the low end for NaN and null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import scalar
from cloudloom.operators import kmeans as km
from cloudloom.operators import quantize as qz
from cloudloom.operators.bounds import aabb
from cloudloom.schema import COLOURS, POSITION, ROTATION, SCALES
from cloudloom.shared import written

PALETTE_WIDTH = 64
CODES = 256


def pixels(df: DataFrame, rgba: list[Column], n: int, padding: tuple[int, int, int, int], width: int | None = None) -> DataFrame:
    """df has pos, the pixel's number. Padding is made apart, so that no pixel is joined."""
    w, h = scalar.texture_dims(n, width)
    names = ["r", "g", "b", "a"]
    own = df.select(F.col("pos").cast("bigint").alias("ti"), *[c.cast("smallint").alias(k) for c, k in zip(rgba, names, strict=True)])
    rest = df.sparkSession.range(n, w * h, 1, 1).select(F.col("id").alias("ti"), *[F.lit(v).cast("smallint").alias(k) for v, k in zip(padding, names, strict=True)])
    return own.union(rest).select("ti", (F.col("ti") % w).cast("int").alias("px"), F.floor(F.col("ti") / w).cast("int").alias("py"), *names)


def means(df: DataFrame, n: int) -> tuple[dict[str, DataFrame], dict]:
    logs = df.select("pos", *[scalar.log_transform(F.col(a).cast("double")).cast("float").cast("double").alias(a) for a in POSITION])
    r = aabb(logs).first().asDict()
    r = {k: 0.0 if v is None else v for k, v in r.items()}
    v = [scalar.quantize16(F.col(a), F.lit(r[f"min_{a}"]), F.lit(r[f"max_{a}"])) for a in POSITION]
    out = {f"means_{k}": pixels(logs, [*map(f, v), F.lit(255)], n, (0, 0, 0, 255)) for k, f in (("l", scalar.low_byte), ("u", scalar.high_byte))}
    return out, {"mins": [r[f"min_{a}"] for a in POSITION], "maxs": [r[f"max_{a}"] for a in POSITION], "files": ["means_l", "means_u"]}


def quats(df: DataFrame, n: int) -> tuple[dict[str, DataFrame], dict]:
    rows = df.select("pos", scalar.smallest_three([F.col(c).cast("double") for c in ROTATION]).alias("t"))
    return {"quats": pixels(rows, [F.col(f"t.{c}") for c in ("b0", "b1", "b2", "alpha")], n, (0, 0, 0, 0))}, {"files": ["quats"]}


def scales(df: DataFrame, n: int) -> tuple[dict[str, DataFrame], dict]:
    book = qz.codebook(qz.unpivot(df.select(*SCALES), *SCALES), CODES)
    rows = qz.labelled(df, SCALES, book)
    return {"scales": pixels(rows, [*[F.col(f"label_{c}") for c in SCALES], F.lit(255)], n, (0, 0, 0, 255))}, {"codebook": book, "files": ["scales"]}


def colours(df: DataFrame, n: int) -> tuple[dict[str, DataFrame], dict]:
    book = qz.codebook(qz.unpivot(df.select(*COLOURS), *COLOURS), CODES)
    rows = qz.labelled(df, COLOURS, book)
    return {"sh0": pixels(rows, [*[F.col(f"label_{c}") for c in COLOURS], scalar.opacity_byte(F.col("opacity").cast("double"))], n, (0, 0, 0, 0))}, {"codebook": book, "files": ["sh0"]}


def centroid_pixels(spark, labels: list[list[int]], coefficients: int) -> DataFrame:
    """Centroid i lies at column (i mod 64) * coefficients + j, row i div 64; colours come from its three planes; empty cells are 0."""
    w, h = PALETTE_WIDTH * coefficients, -(-len(labels) // PALETTE_WIDTH)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "cid int, label array<int>")
    return centroid_layout(rows, coefficients, w, h)


def centroid_layout(rows: DataFrame, coefficients: int, w: int, h: int) -> DataFrame:
    """rows: cid, label (array of 3 * coefficients)."""
    at = rows.select("cid", "label", F.explode(F.sequence(F.lit(0), F.lit(coefficients - 1))).alias("j"))
    px, py = (F.col("cid") % PALETTE_WIDTH) * coefficients + F.col("j"), F.floor(F.col("cid") / PALETTE_WIDTH)
    own = at.select((py * w + px).cast("bigint").alias("ti"), *[F.element_at("label", F.col("j") + 1 + k * coefficients).cast("smallint").alias(c) for k, c in enumerate("rgb")], F.lit(255).cast("smallint").alias("a"))
    every = rows.sparkSession.range(w * h).select(F.col("id").alias("ti")).join(own, "ti", "left")
    return every.select("ti", (F.col("ti") % w).cast("int").alias("px"), F.floor(F.col("ti") / w).cast("int").alias("py"), *[F.coalesce(c, F.lit(0)).cast("smallint").alias(c) for c in "rgba"])


def sh_label_pixels(df: DataFrame, n: int) -> DataFrame:
    """df: pos and cid."""
    return pixels(df, [scalar.low_byte(F.col("cid")), scalar.high_byte(F.col("cid")), F.lit(0), F.lit(255)], n, (0, 0, 0, 0))


def harmonics(df: DataFrame, n: int, iterations: int, start: list[list[float]] | None = None) -> tuple[dict[str, DataFrame], dict] | None:
    """Two textures, or nothing where there are no harmonics. start: centroids to begin with, instead of a seeded choice of rows."""
    length = df.agg(F.max(F.size("f_rest"))).first()[0] if "f_rest" in df.columns else None
    if not length or length < 3:
        return None
    c, spark = length // 3, df.sparkSession
    points = df.select(F.col("gid").alias("id"), F.col("f_rest").alias("vec"))
    centroids, assigned = km.kmeans(points, min(scalar.palette_size(n), n), iterations, start)
    values = spark.createDataFrame([(float(v),) for row in centroids for v in row], "value double")
    book = qz.codebook(values, CODES)
    mids = [(a + b) / 2 for a, b in zip(book, book[1:], strict=False)]
    import bisect

    labels = [[bisect.bisect_right(mids, v) if book[0] < book[-1] else 0 for v in row] for row in centroids]
    rows = df.select("gid", "pos").join(assigned.select(F.col("id").alias("gid"), "cid"), "gid")
    return (
        {"shN_centroids": centroid_pixels(spark, labels, c), "shN_labels": sh_label_pixels(written(rows, "sh-labels"), n)},
        {"count": len(centroids), "bands": {3: 1, 8: 2, 15: 3}.get(c, 0), "codebook": book, "files": ["shN_centroids", "shN_labels"]},
    )
