"""Distances between array columns, as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, v: t + v)


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, F.abs)


def l2(a: Column, b: Column) -> Column:
    """Squared."""
    return _sum(a, b, lambda d: d * d)


def so2(a: Column, b: Column) -> Column:
    """Difference of the angles in the last place, wrapped to -pi..pi."""
    d = F.element_at(b, -1).cast("double") - F.element_at(a, -1).cast("double")
    return F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d)


METRICS = {"l1": l1, "l2": l2, "l2_simple": l2, "so2": so2, "so3": l2}
