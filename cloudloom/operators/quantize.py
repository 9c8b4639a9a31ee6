"""Optimal one-dimensional codebooks: Spark makes the histogram, the driver solves 1024 bins, Spark assigns labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.operators.bounds import finite

BINS, ALPHA, TINY = 1024, 0.5, 1e-20


def unpivot(df: DataFrame, *names: str) -> DataFrame:
    """One row for each row and name: k (place of the name) and value."""
    return df.select("*", F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("k", "value")).drop(*names)


def value_range(values: DataFrame) -> tuple[float, float] | None:
    row = values.where(finite("value")).agg(F.min("value"), F.max("value")).first()
    return None if row[0] is None else (float(row[0]), float(row[1]))


def histogram(values: DataFrame, bins: int = BINS, ends: tuple[float, float] | None = None) -> DataFrame:
    """bin, n, total of the finite values in bins of equal width between their least and largest, which are looked for unless they are given."""
    v = values.where(finite("value")).select(F.col("value").cast("double").alias("value"))
    r = v.sparkSession.range(1).select(*[F.lit(e).alias(c) for e, c in zip(ends, ("lo", "hi"), strict=True)]) if ends else v.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return v.crossJoin(F.broadcast(r)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def prefixes(hist: DataFrame, lo: float, hi: float, bins: int = BINS, alpha: float = ALPHA) -> DataFrame:
    """For all bins: weight n^alpha, centre (mean, or the middle of an empty bin), running sums w, wx, wx2. A table of `bins` rows."""
    every = hist.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(hist, "bin", "left")
    weight = F.coalesce(F.pow("n", F.lit(alpha)), F.lit(0.0))
    centre = F.coalesce(F.col("total") / F.col("n"), F.lit(lo) + (F.col("bin") + 0.5) * ((hi - lo) / bins))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = every.select("bin", F.coalesce("n", F.lit(0)).alias("n"), weight.alias("weight"), centre.alias("centre"))
    return rows.select("*", F.sum("weight").over(run).alias("w"), F.sum(F.col("weight") * F.col("centre")).over(run).alias("wx"), F.sum(F.col("weight") * F.col("centre") * F.col("centre")).over(run).alias("wx2"))


def solve(weight: np.ndarray, centre: np.ndarray, k: int) -> list[float]:
    """Means of the k ranges of bins with the least weighted squared error, ascending, the last one repeated up to k.

    With one range more, the best first bin of the last range does not fall as the range's end grows; so the ends are taken level
    by level, the middle ones first, each between the first bins of its neighbours."""
    w, wx, wx2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weight, weight * centre, weight * centre * centre))
    n, used = len(weight), min(k, int((weight > 0).sum()))

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of bins i to j."""
        dw, dx = w[j + 1] - w[i], wx[j + 1] - wx[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(dw > 0, np.maximum(0.0, wx2[j + 1] - wx2[i] - dx * dx / dw), 0.0)

    best, came = cost(np.zeros(n, int), np.arange(n)), []
    for _ in range(1, used):
        before = np.concatenate([[np.inf], best[:-1]])
        total, from_ = np.full(n, np.inf), np.zeros(n, int)
        first, last, low, high = np.array([0]), np.array([n - 1]), np.array([0]), np.array([n - 1])
        while len(first):
            middle = (first + last) // 2
            top = np.minimum(high, middle)
            sizes = top - low + 1
            starts = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) - np.repeat(starts - low, sizes)
            j = np.repeat(middle, sizes)
            value = before[i] + cost(i, j)
            least = np.minimum.reduceat(value, starts)
            place = np.flatnonzero(value == np.repeat(least, sizes))
            chosen = i[place[np.searchsorted(place, starts)]]
            total[middle], from_[middle] = least, chosen
            left, right = first < middle, middle < last
            first, last, low, high = (np.concatenate(p) for p in ((first[left], middle[right] + 1), (middle[left] - 1, last[right]), (low[left], chosen[right]), (chosen[left], high[right])))
        best = total
        came.append(from_)
    ends, j = [], n - 1
    for from_ in reversed(came):
        ends.append((int(from_[j]), j))
        j = int(from_[j]) - 1
    ends.append((0, j))
    mean = lambda i, j: (wx[j + 1] - wx[i]) / (w[j + 1] - w[i]) if w[j + 1] > w[i] else (centre[i] + centre[j]) / 2
    out = sorted(float(np.float32(mean(i, j))) for i, j in ends)
    return out + [out[-1]] * (k - len(out))


def codebook(values: DataFrame, k: int = 256, alpha: float = ALPHA) -> list[float]:
    """The codebook of column `value`. Two passes over the values; 1024 rows come to the driver."""
    r = value_range(values)
    if r is None:
        return [0.0] * k
    lo, hi = r
    if hi - lo < TINY:
        return [float(np.float32(lo))] * k
    weight, centre = np.zeros(BINS), lo + (np.arange(BINS) + 0.5) * ((hi - lo) / BINS)
    for row in histogram(values, BINS, r).collect():
        weight[row.bin], centre[row.bin] = row.n**alpha, row.total / row.n
    return solve(weight, centre, k)


def labelled(df: DataFrame, names: list[str], book: list[float]) -> DataFrame:
    """df with label_<name>, the nearest code of each: a binary search by Arrow batch, as scalar.nearest_code compares each value with all midpoints."""
    mids = np.array([(a + b) / 2 for a, b in zip(book, book[1:], strict=False)])
    flat, columns, at = len(set(book)) == 1, df.columns, [df.columns.index(n) for n in names]

    def run(batches):
        for batch in batches:
            labels = []
            for k in at:
                v = batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)
                labels.append(pa.array(np.where(np.isnan(v) | flat, 0, np.searchsorted(mids, v, side="right")).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *labels], [*columns, *[f"label_{n}" for n in names]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(f"label_{n}", T.IntegerType()) for n in names]]))
