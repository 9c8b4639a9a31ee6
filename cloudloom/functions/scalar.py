"""Scalar functions on splat attributes, as Column builders. Values are computed in DOUBLE and truncated, never rounded, to bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_transform(v: Column) -> Column:
    """sign(v) * ln(|v| + 1)."""
    return F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.log(F.abs(v) + 1)


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def opacity_byte(v: Column) -> Column:
    return F.floor(F.least(F.greatest(sigmoid(v) * 255, F.lit(0.0)), F.lit(255.0))).cast("smallint")


def quantize16(v: Column, low: Column, high: Column) -> Column:
    """0 to 65535 between low and high, which values beyond are moved to; an empty range counts as 1; NaN and null give 0."""
    at = F.floor(F.lit(65535.0) * (F.least(F.greatest(v, low), high) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)).cast("int")
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(at)


def low_byte(v: Column) -> Column:
    return v.bitwiseAND(255).cast("smallint")


def high_byte(v: Column) -> Column:
    return F.shiftright(v, 8).bitwiseAND(255).cast("smallint")


def spread_bits(v: Column) -> Column:
    """Bit i of the ten lowest goes to bit 3i."""
    v = v.cast("bigint")
    return sum((F.shiftleft(F.shiftright(v, i).bitwiseAND(1), 3 * i) for i in range(1, 10)), v.bitwiseAND(1))


def unit(v: Column, low: Column, high: Column) -> Column:
    """v in [low, high] as a number from 0 to 1; an empty range, NaN and null give 0."""
    return F.when((high > low) & ~F.isnan(v), F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def morton3d(x, y, z, low, high) -> Column:
    """Code of 30 bits: x highest, then y, then z in each group of three. low, high: three columns each."""
    cells = [F.floor(unit(v, a, b) * 1023) for v, a, b in zip((x, y, z), low, high, strict=True)]
    return 4 * spread_bits(cells[0]) + 2 * spread_bits(cells[1]) + spread_bits(cells[2])


def normalized(q: list[Column]) -> list[Column]:
    """A quaternion of length one; zero stays zero."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return [F.when(n > 0, c / n).otherwise(c) for c in q]


def argmax_abs(q: list[Column]) -> Column:
    """Index of the component of the largest absolute value, the first of equal ones."""
    a = F.array(*[F.abs(c) for c in q])
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def bound(values: dict[str, Column], body) -> Column:
    """body of a struct of values that are made once; an expression that names a value again and again would make it as often."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def smallest_three(q: list[Column]) -> Column:
    """A struct of four bytes, b0 to b2 and alpha: the components but the largest, whose sign is made positive, and 252 + its index."""
    byte = lambda c: F.least(F.greatest(F.floor(255 * (c * F.lit(math.sqrt(2)) * 0.5 + 0.5)), F.lit(0)), F.lit(255)).cast("smallint")

    def second(x: Column) -> Column:
        sign = F.when(F.element_at(x["q"], x["m"] + 1) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        rest = [sign * F.element_at(x["q"], F.when(x["m"] <= k, k + 2).otherwise(k + 1)) for k in range(3)]
        return F.struct(*[byte(c).alias(f"b{k}") for k, c in enumerate(rest)], (252 + x["m"]).cast("smallint").alias("alpha"))

    def first(x: Column) -> Column:
        return bound({"q": F.array(*[x[f"q{k}"] for k in range(4)]), "m": argmax_abs([x[f"q{k}"] for k in range(4)])}, second)

    return bound({"n": F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0])), **{f"c{k}": c for k, c in enumerate(q)}}, lambda x: bound({f"q{k}": F.when(x["n"] > 0, x[f"c{k}"] / x["n"]).otherwise(x[f"c{k}"]) for k in range(4)}, first))


def rotation(q: list[Column]) -> list[list[Column]]:
    """Rotation matrix of a quaternion w, x, y, z, which is normalised first."""
    w, x, y, z = normalized(q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def covariance(q: list[Column], s: list[Column]) -> list[Column]:
    """R diag(s^2) R^T, nine values by row; s as stored."""
    r = rotation(q)
    return [sum((r[i][k] * r[j][k] * s[k] * s[k] for k in (1, 2)), r[i][0] * r[j][0] * s[0] * s[0]) for i in range(3) for j in range(3)]


def oriented_radius(q: list[Column], s: list[Column]) -> list[Column]:
    """Half extents of the box around a splat: sums of |R| exp(s)."""
    r = rotation(q)
    return [sum((F.abs(r[i][k]) * F.exp(s[k]) for k in (1, 2)), F.abs(r[i][0]) * F.exp(s[0])) for i in range(3)]


def largest_dim(extents: list[Column]) -> Column:
    return F.greatest(*extents)


def split_axis(ex: Column, ey: Column, ez: Column) -> Column:
    """0 unless y or z is larger than both others."""
    return F.when((ey > ex) & (ey > ez), 1).when((ez > ex) & (ez > ey), 2).otherwise(0)


def texture_size(n: Column, width: int | None = None) -> tuple[Column, Column]:
    """Width and height, multiples of 4 that hold n pixels; exact in integers."""
    if width:
        w = F.lit(width).cast("bigint")
    else:
        root = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
        root = F.when(root * root > n, root - 1).when((root + 1) * (root + 1) <= n, root + 1).otherwise(root)
        up = F.when(root * root == n, root).otherwise(root + 1)
        w = F.greatest(F.lit(4).cast("bigint"), 4 * F.floor((up + 3) / 4).cast("bigint"))
    return w, F.greatest(F.lit(4).cast("bigint"), 4 * F.floor((n + 4 * w - 1) / (4 * w)).cast("bigint"))


def texture_dims(n: int, width: int | None = None) -> tuple[int, int]:
    root = math.isqrt(n)
    w = width or max(4, -(-(root + (root * root < n)) // 4) * 4)
    return w, max(4, -(-n // (4 * w)) * 4)


def palette_size(n: int) -> int:
    """Clusters for n rows, before the clamp to n."""
    return 256 if n < 1024 else min(64, 1 << ((n // 1024).bit_length() - 1)) * 1024


def sh_bands(coefficients: Column) -> Column:
    return F.when(coefficients == 3, 1).when(coefficients == 8, 2).when(coefficients == 15, 3).otherwise(0)


def nearest_code(v: Column, codebook: list[float]) -> Column:
    """Index of the nearest value of an ascending codebook: how many midpoints are at most v; NaN gives 0."""
    mids = [(a + b) / 2 for a, b in zip(codebook, codebook[1:], strict=False)]
    if not mids:
        return F.lit(0)
    table = F.array(*map(F.lit, mids))
    return F.when(F.isnan(v) | v.isNull(), 0).otherwise(F.size(F.filter(table, lambda m: v >= m)))
