"""Lloyd's k-means over vectors; labels are those of the last assignment, before the last update of the centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.neighbors import nearest_centroid

SEED = 42


def initial(points: DataFrame, k: int, seed: int = SEED) -> list[list[float]]:
    """k vectors of different rows in the order of a seeded hash of the id: each task keeps k rows, the driver gets k."""
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    return [list(r[0]) for r in points.orderBy(*order).limit(k).select(F.col("vec").cast("array<double>")).collect()]


def sums(assigned: DataFrame) -> DataFrame:
    """cid, place, mean and n. A task adds its vectors up by cluster first, so what is shuffled is a row for each task, cluster and place."""

    def run(batches):
        total, n = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = np.argsort(cid, kind="stable")
            some, starts, sizes = np.unique(cid[order], return_index=True, return_counts=True)
            for c, v, m in zip(some.tolist(), np.add.reduceat(x[order], starts), sizes.tolist(), strict=True):
                total[c], n[c] = total[c] + v if c in total else v, n.get(c, 0) + m
        if total:
            vectors = np.concatenate(list(total.values()))
            width = len(vectors) // len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(total), width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(total))), pa.array(vectors), pa.array(np.repeat(list(n.values()), width))], ["cid", "place", "total", "n"])

    parts = assigned.select("cid", F.col("vec").cast("array<double>")).mapInArrow(run, "cid int, place int, total double, n long")
    return parts.groupBy("cid", "place").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def updated(assigned: DataFrame, centroids: list[list[float]]) -> list[list[float]]:
    """Means of the clusters; an empty cluster keeps its centroid."""
    out = [list(c) for c in centroids]
    for r in sums(assigned).toLocalIterator():
        out[r.cid][r.place] = r["mean"]
    return out


def kmeans(points: DataFrame, k: int, iterations: int = 10, start: list[list[float]] | None = None) -> tuple[list[list[float]], DataFrame]:
    """Centroids and points (id, vec, cid). points: id, vec; read once for each iteration, so persist what is dear to make."""
    centroids = start or initial(points, k)
    before = centroids
    for _ in range(iterations):
        before, centroids = centroids, updated(nearest_centroid(points, centroids), centroids)
    if not iterations:
        return centroids, points.select("id", "vec", F.lit(0).alias("cid"))
    return centroids, nearest_centroid(points, before).select("id", "vec", "cid")
