"""Nearest neighbours, radius and box searches, all exact; equal distances go to the smaller id."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.metrics import METRICS

#: Queries that are sent to the executors at once, index rows compared with them at once, and centroids at once.
QUERIES, ROWS, CENTROIDS = 4096, 512, 4096


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        return np.stack([np.abs(x - row).sum(1) for row in q], 1)
    if metric == "so2":
        d = x[:, -1:] - q[None, :, -1]
        return np.where(d > np.pi, d - 2 * np.pi, np.where(d < -np.pi, d + 2 * np.pi, d))
    return np.stack([((x - row) ** 2).sum(1) for row in q], 1)


def nearer(x: np.ndarray, q: np.ndarray, metric: str, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, queries and distances of the pairs below each query's limit. Squared distances are first had from products of
    blocks; only what is within rounding of the limit or below is then computed as it is defined."""
    if metric != "l2":
        d = distances(x, q, metric)
        i, j = np.nonzero(d < limit)
        return i, j, d[i, j]
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    slack = 1e-9 * (1 + xx.max(initial=0) + qq)
    i, j = np.nonzero(xx[:, None] + qq - 2 * (x @ q.T) < limit + slack)
    d = np.concatenate([np.zeros(0), *[((x[i[at : at + 65536]] - q[j[at : at + 65536]]) ** 2).sum(1) for at in range(0, len(i), 65536)]])
    ok = d < limit[j]
    return i[ok], j[ok], d[ok]


class Best:
    """The k nearest of each query so far; of equal distances those of the smaller ids."""

    def __init__(self, queries: int, k: int, radius: float | None):
        self.d, self.i = np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)
        self.radius = np.inf if radius is None else radius

    def limit(self) -> np.ndarray:
        """What is above cannot be among the best; what is equal still may, by its id."""
        return np.minimum(np.nextafter(self.d[:, -1], np.inf), self.radius)

    def add(self, ids: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        if not len(j):
            return
        k, some = self.d.shape[1], np.unique(j)
        row = np.concatenate([np.repeat(some, k), j])
        every_d, every_i = np.concatenate([self.d[some].ravel(), d]), np.concatenate([self.i[some].ravel(), ids])
        order = np.lexsort((every_i, every_d, row))
        row, every_d, every_i = row[order], every_d[order], every_i[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.d[row[keep], place[keep]], self.i[row[keep], place[keep]] = every_d[keep], every_i[keep]


def _searched(index: DataFrame, queries: DataFrame, k: int | None, metric: str, radius: float | None) -> DataFrame:
    """qid, id, distance. Queries go out in blocks of bounded size; with k each task keeps its k best for each query."""
    spark, out = index.sparkSession, None
    vectors = queries.select(F.col("qid").cast("long"), F.col("vec").cast("array<double>")).toLocalIterator()
    while block := list(itertools.islice(vectors, QUERIES)):
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], float)))

        def run(batches, sent=sent):
            qid, q = sent.value
            schema, best = ["qid", "id", "distance"], Best(len(qid), k, radius) if k is not None else None
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                i, j, d = nearer(x, q, metric, best.limit() if best else np.full(len(qid), radius))
                if best:
                    best.add(ids[i], j, d)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(qid[j]), pa.array(ids[i]), pa.array(d)], schema)
            if best:
                keep = np.isfinite(best.d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best.d.shape[1])[keep.ravel()]), pa.array(best.i[keep]), pa.array(best.d[keep])], schema)

        part = index.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(run, "qid long, id long, distance double")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "qid long, id long, distance double")


def knn(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2", radius: float | None = None) -> DataFrame:
    """qid, id, distance, rank: the k nearest of index (id, vec) to each query (qid, vec), within a radius if given (strictly)."""
    best = Window.partitionBy("qid").orderBy("distance", "id")
    return _searched(index, queries, k, metric, radius).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def radius_search(index: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", sort: bool = False) -> DataFrame:
    """qid, id, distance of all with distance < radius (for l2, both are squared)."""
    out = _searched(index, queries, None, metric, radius)
    return out.orderBy("qid", "distance", "id") if sort else out


def radius_visit(index: DataFrame, queries: DataFrame, radius: float, visit, schema: str, metric: str = "l2") -> DataFrame:
    """radius_search whose Arrow batches go through `visit`, a function of an iterator of batches."""
    return radius_search(index, queries, radius, metric).mapInArrow(visit, schema)


def worst(found: DataFrame) -> DataFrame:
    """The farthest match of each query."""
    return found.groupBy("qid").agg(F.max_by("id", F.struct("distance", (-F.col("id")).alias("i"))).alias("id"), F.max("distance").alias("distance"))


def radius_search_points(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """qid, gid, distance (squared) of points (gid, x, y, z) nearer than radius: an equi-join on cells as wide as the radius."""
    cell = [F.floor(F.col(a).cast("double") / radius).alias(f"c{a}") for a in "xyz"]
    near = F.explode(F.array(*[F.struct(*[(F.floor(F.col(a).cast("double") / radius) + d).alias(f"c{a}") for a, d in zip("xyz", ds, strict=True)]) for ds in itertools.product((-1, 0, 1), repeat=3)]))
    q = queries.select("qid", *[F.col(a).cast("double").alias(f"q{a}") for a in "xyz"], near.alias("c")).select("qid", "qx", "qy", "qz", "c.*")
    d = sum((F.pow(F.col(a).cast("double") - F.col(f"q{a}"), 2) for a in "yz"), F.pow(F.col("x").cast("double") - F.col("qx"), 2))
    return points.select("gid", "x", "y", "z", *cell).join(q, ["cx", "cy", "cz"]).select("qid", "gid", d.alias("distance")).where(F.col("distance") < radius * radius)


def box_search(points: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """Points inside a box, both ends included; the filter reaches the scan."""
    out = F.lit(True)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        out = out & F.col(a).between(lo, hi)
    return points.where(out)


def nearest_of(x: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest centroid of each row, the first of equal ones. Centroids are compared CENTROIDS at a time."""
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for at in range(0, len(c), CENTROIDS):
        part = c[at : at + CENTROIDS]
        if metric == "l2":  # by products; what is within rounding of the best is compared directly
            approx = (x * x).sum(1)[:, None] - 2 * x @ part.T + (part * part).sum(1)
            near = np.argmin(approx, 1)
            slack = 1e-9 * (np.abs(approx).max(1) + 1)
            close = approx <= approx[np.arange(len(x)), near][:, None] + slack[:, None]
            for i in np.flatnonzero(close.sum(1) > 1):
                some = np.flatnonzero(close[i])
                near[i] = some[np.argmin(((part[some] - x[i]) ** 2).sum(1))]
            d = ((x - part[near]) ** 2).sum(1)
        else:
            every = distances(x, part, metric)
            near = np.argmin(every, 1)
            d = every[np.arange(len(x)), near]
        better = d < least
        best[better], least[better] = near[better] + at, d[better]
    return best, least


def nearest_centroid(points: DataFrame, centroids: list[list[float]], metric: str = "l2") -> DataFrame:
    """points (id, vec) with cid and distance of the nearest centroid. Centroids are bounded by the palette (65,536)."""
    sent = points.sparkSession.sparkContext.broadcast(np.array(centroids, float))

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            best, d = nearest_of(x, sent.value, metric)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(d)], ["id", "vec", "cid", "distance"])

    return points.select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "id long, vec array<double>, cid int, distance double")


def metric_column(name: str):
    return METRICS[name]


class DynamicIndex:
    """Points (id, vec) to which others are added and from which some are taken away; kept as tables, searched as knn does."""

    def __init__(self, points: DataFrame):
        self.points, self.gone = points.select("id", "vec"), None

    def add(self, points: DataFrame) -> None:
        self.points = self.points.unionByName(points.select("id", "vec"))

    def remove(self, ids: DataFrame) -> None:
        self.gone = ids.select("id") if self.gone is None else self.gone.union(ids.select("id"))

    def current(self) -> DataFrame:
        return self.points if self.gone is None else self.points.join(self.gone, "id", "left_anti")

    def search(self, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        return knn(self.current(), queries, k, metric)

    def save(self, path: str) -> None:
        self.current().write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "DynamicIndex":
        return cls(spark.read.parquet(path))
