"""Median-split tree over positions: nodes numbered as in a heap, leaves in depth-first order, packing of leaves into files."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import scalar
from cloudloom.operators.bounds import AXES, aabb, finite, oriented_bounds, ranked
from cloudloom.shared import written

LEAST, TO_ROWS, MAX_DEPTH = 256, 1024, 60
#: Nodes of up to so many rows are split to their leaves in one task; larger ones level by level over many.
LOCAL_ROWS = 250_000


def is_leaf(n: Column, largest: Column, chunk_count: int, extent: float) -> Column:
    return (n <= LEAST) | ((n <= chunk_count * TO_ROWS) & (largest <= extent))


def build(points: DataFrame, chunk_count: int = 512, extent: float = 16.0, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """points with node and depth of their leaf. A node's rows are sorted by its axis and gid; the first floor(n / 2) go left.
    Extents are of finite rows only. Nodes of over local_rows are split a level at a time, each level ranked over many tasks and
    written, so plans do not grow; then one shuffle by node brings each smaller node to a task that splits it to its leaves."""
    if chunk_count < 0:
        raise ValueError("chunk_count must not be negative")
    todo, small, done, depth = points.withColumn("node", F.lit(1).cast("bigint")), [], [], 0
    while True:
        b = aabb(todo, "node", count="n")
        ext = [F.coalesce(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(0.0)) for a in AXES]
        leaf = is_leaf(F.col("n"), scalar.largest_dim(ext), chunk_count, extent)
        nodes = written(b.select("node", (F.col("n") > local_rows).alias("large"), "n", leaf.alias("leaf"), scalar.split_axis(*ext).alias("axis")), "nodes")
        kinds = {(r.large, r.leaf) for r in nodes.select("large", "leaf").distinct().collect()}
        rows = todo.join(nodes.where("large"), "node", "left") if any(large for large, _ in kinds) else todo.withColumns({"large": F.lit(None).cast("boolean"), "leaf": F.lit(None).cast("boolean")})
        small.append((rows.where("large is null").select(todo.columns), depth))
        done.append((rows.where("large and leaf").select(todo.columns), depth))
        if (True, False) not in kinds:
            break
        rows = rows.where("large and not leaf").withColumn("v", F.when(F.col("axis") == 2, F.col("z")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("x")))
        rows = ranked(rows, "node", ["v", "gid"], "k")
        side = F.when(F.col("k") <= F.floor(F.col("n") / 2), 0).otherwise(1)
        todo = written(rows.select(*[c for c in todo.columns if c != "node"], (2 * F.col("node") + side).alias("node")), "level")
        depth += 1

    def united(parts: list[tuple[DataFrame, int]]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [rows.withColumn("depth", F.lit(k)) for rows, k in parts])

    out = united(small)
    schema = out.schema

    def split(t: pa.Table) -> pa.Table:
        node, at = leaves(t, chunk_count, extent)
        for name, values in (("node", node), ("depth", at)):
            k = t.schema.get_field_index(name)
            t = t.set_column(k, t.schema.field(k), pa.array(values, t.schema.field(k).type))
        return t

    return out.groupBy("node").applyInArrow(split, schema).unionByName(united(done))


def leaves(t: pa.Table, chunk_count: int, extent: float) -> tuple[np.ndarray, np.ndarray]:
    """node and depth of the leaf of each row of a node."""
    axes = [t.column(a).cast(pa.float64()).to_numpy(zero_copy_only=False) for a in AXES]
    gid, missing = t.column("gid").to_numpy(), [t.column(a).is_null().to_numpy(zero_copy_only=False) for a in AXES]
    whole = np.isfinite(axes).all(0)
    node, depth = np.zeros(len(gid), np.int64), np.zeros(len(gid), np.int32)
    todo = [(t.column("node")[0].as_py(), t.column("depth")[0].as_py(), np.arange(len(gid)))]
    while todo:
        number, level, rows = todo.pop()
        known = rows[whole[rows]]
        ext = [float(v[known].max() - v[known].min()) if len(known) else 0.0 for v in axes]
        n = len(rows)
        if n <= LEAST or n <= chunk_count * TO_ROWS and max(ext) <= extent or level >= MAX_DEPTH:
            node[rows], depth[rows] = number, level
            continue
        axis = 1 if ext[1] > ext[0] and ext[1] > ext[2] else 2 if ext[2] > ext[0] and ext[2] > ext[1] else 0
        rows = rows[np.lexsort((gid[rows], axes[axis][rows], ~missing[axis][rows]))]  # null first, NaN last
        todo += [(2 * number, level + 1, rows[: n // 2]), (2 * number + 1, level + 1, rows[n // 2 :])]
    return node, depth


def dfs_position(node: Column, depth: Column, levels: int = MAX_DEPTH) -> Column:
    """Sorts leaves as a walk that visits left before right meets them."""
    return F.expr(f"shiftleft(node, {levels} - depth)") if levels <= 60 else node


def leaf_lod_bins(tree: DataFrame) -> DataFrame:
    """node, depth, lod, n: rows of each level of detail in each leaf."""
    return tree.groupBy("node", "depth", "lod").agg(F.count(F.lit(1)).alias("n"))


def leaf_bounds(tree: DataFrame) -> DataFrame:
    """Bounds of each leaf from the boxes of its finite rows; 0 without one. Rows that are not finite still count."""
    rows = oriented_bounds(tree) if "scale_0" in tree.columns else tree.withColumns({f"lo_{a}": F.col(a).cast("double") for a in AXES} | {f"hi_{a}": F.col(a).cast("double") for a in AXES})
    ok = finite(*[f"{s}_{a}" for s in ("lo", "hi") for a in AXES])
    aggs = [F.coalesce(F.min(F.when(ok, F.col(f"lo_{a}"))), F.lit(0.0)).alias(f"min_{a}") for a in AXES] + [F.coalesce(F.max(F.when(ok, F.col(f"hi_{a}"))), F.lit(0.0)).alias(f"max_{a}") for a in AXES]
    return rows.groupBy("node", "depth").agg(*aggs, F.count(F.lit(1)).alias("n"))


def node_bounds(tree: DataFrame) -> DataFrame:
    """node, depth, n, is_leaf and bounds of all nodes, the inner ones from their leaves."""
    leaves = leaf_bounds(tree)
    up = leaves.select(F.explode(F.sequence(F.lit(0), "depth")).alias("up"), "*").withColumn("depth", F.col("depth") - F.col("up")).withColumn("node", F.expr("shiftright(node, up)"))
    return up.groupBy("node", "depth").agg(F.sum("n").alias("n"), (F.max("up") == 0).alias("is_leaf"), *[F.min(f"min_{a}").alias(f"min_{a}") for a in AXES], *[F.max(f"max_{a}").alias(f"max_{a}") for a in AXES])


def pack_chunks(bins: DataFrame, target: int) -> DataFrame:
    """node, depth, lod, n, file_index, offset: next-fit by level of detail in leaf order. A task reads its level's sorted counts and keeps a running size only."""
    dealt = bins.withColumn("pos", F.expr(f"shiftleft(node, {MAX_DEPTH} - depth)")).where("n > 0").repartition("lod").sortWithinPartitions("lod", "pos")

    def run(batches):
        lod, file, size = None, 0, 0
        for batch in batches:
            files, offsets = [], []
            for level, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if level != lod:
                    lod, file, size = level, 0, 0
                if size + n > target and size > 0:
                    file, size = file + 1, 0
                files.append(file)
                offsets.append(size)
                size += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(files, pa.int32()), pa.array(offsets, pa.int64())], ["node", "depth", "lod", "n", "file_index", "offset"])

    return dealt.select("node", F.col("depth").cast("int"), F.col("lod").cast("int"), F.col("n").cast("bigint"), "pos").mapInArrow(run, "node long, depth int, lod int, n long, file_index int, offset long")


def file_catalog(chunks: DataFrame) -> DataFrame:
    """filename and file_no, numbered as the leaf walk (lods ascending in a leaf) first meets them."""
    met = chunks.withColumn("pos", F.expr(f"shiftleft(node, {MAX_DEPTH} - depth)")).groupBy("lod", "file_index").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"))
    order = Window.orderBy("pos", "lod")
    return met.select(F.format_string("%d_%d/meta.json", "lod", "file_index").alias("filename"), (F.row_number().over(order) - 1).cast("bigint").alias("file_no"), "n")
