"""Whole encodes: one cloud to textures, and many levels of detail to chunk files with a tree."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import textures as tx
from cloudloom.operators import tree as tr
from cloudloom.operators.morton import ordered, ordered_within
from cloudloom.shared import written
from cloudloom.sources import sinks

GENERATOR = "cloudloom"


def textures(cloud: DataFrame, sort: bool = True, iterations: int = 10) -> tuple[dict[str, DataFrame], dict]:
    """Texture rows by name, and the metadata. cloud: the columns of a splat cloud, with pos in place of the sort if sort is off."""
    n = cloud.count()
    if not n:
        raise ValueError("the cloud is empty")
    rows = written(ordered(cloud) if sort else cloud, "ordered")
    out, meta = {}, {"version": 2, "asset": {"generator": GENERATOR}, "count": n}
    for name, part in (("means", tx.means), ("quats", tx.quats), ("scales", tx.scales), ("sh0", tx.colours)):
        made, meta[name] = part(rows, n)
        out |= made
    if (rest := tx.harmonics(rows, n, iterations)) is not None:
        out |= rest[0]
        meta["shN"] = rest[1]
    return out, meta


def encoded_rows(cloud: DataFrame, sort: bool = True, iterations: int = 10) -> DataFrame:
    """All texture rows of an encode: texture, ti, px, py, r, g, b, a."""
    made, _ = textures(cloud, sort, iterations)
    out = None
    for name, rows in sorted(made.items()):
        one = rows.select(F.lit(name).alias("texture"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def write_folder(cloud: DataFrame, folder: str, sort: bool = True, iterations: int = 10, kind: str = "webp") -> dict:
    made, meta = textures(cloud, sort, iterations)
    for name, rows in made.items():
        sinks.write_texture(folder, name, rows, kind)
    for part in meta.values():
        if isinstance(part, dict) and "files" in part:
            part["files"] = [f"{name}.{kind}" for name in part["files"]]
    sinks.write_text(folder, "meta.json", sinks.meta_json(meta))
    return meta


def encode(cloud: DataFrame, target: str, bundle: bool = False, iterations: int = 10, kind: str = "webp") -> dict:
    """A folder, which must be absent or empty, or one ZIP file, which must be absent; staging is removed also on failure."""
    if not bundle:
        sinks.guard_folder(target)
        return write_folder(cloud, target, True, iterations, kind)
    sinks.guard_bundle(target)
    with tempfile.TemporaryDirectory() as stage:
        meta = write_folder(cloud, stage, True, iterations, kind)
        sinks.write_zip(target, stage)
    return meta


def export_lods(cloud: DataFrame, target: str, chunk_count: int = 512, extent: float = 16.0, iterations: int = 10, kind: str = "webp") -> dict:
    """Chunk folders <lod>_<file>/ and the tree's manifest at target, a .json path that must be absent."""
    sinks.guard_bundle(target)
    folder = os.path.dirname(os.path.abspath(target))
    placed = written(tr.build(cloud, chunk_count, extent), "tree")
    bins = written(tr.leaf_lod_bins(placed), "bins")
    chunks = written(tr.pack_chunks(bins, chunk_count * tr.TO_ROWS), "chunks")
    local = ordered_within(placed, "node", "lod").withColumnRenamed("pos", "in_chunk")
    rows = local.join(chunks.select("node", "lod", "file_index", "offset"), ["node", "lod"])
    rows = rows.withColumn("pos", F.col("offset") + F.col("in_chunk")).drop("code", "in_chunk").repartition("lod", "file_index")
    rows = written(rows.select(*[c for c in rows.columns if c not in ("lod", "file_index")], "lod", "file_index"), "files", "lod", "file_index")  # a file's jobs read its own rows only
    catalog = {r.filename: r.file_no for r in tr.file_catalog(chunks).collect()}
    for name in catalog:
        lod, file = map(int, name.split("/")[0].split("_"))
        part = rows.where((F.col("lod") == lod) & (F.col("file_index") == file))
        write_folder(part, os.path.join(folder, f"{lod}_{file}"), False, iterations, kind)
    meta = {"lodLevels": 1 + cloud.agg(F.max("lod")).first()[0], "filenames": sorted(catalog, key=catalog.get), "tree": manifest_tree(tr.node_bounds(placed), chunks, catalog)}
    sinks.write_text(folder, os.path.basename(target), sinks.lod_meta_json(meta))
    return meta


def manifest_tree(nodes: DataFrame, chunks: DataFrame, catalog: dict[str, int]) -> dict:
    """The tree as nested dictionaries; a manifest is one document, a row for each node."""
    lods: dict[int, dict] = {}
    for r in chunks.toLocalIterator():
        lods.setdefault(r.node, {})[str(r.lod)] = {"file": catalog[f"{r.lod}_{r.file_index}/meta.json"], "offset": r.offset, "count": r.n}
    made: dict[int, dict] = {}
    for r in nodes.toLocalIterator():
        made[r.node] = {"bound": {"min": [r[f"min_{a}"] for a in "xyz"], "max": [r[f"max_{a}"] for a in "xyz"]}} | ({"lods": lods.get(r.node, {})} if r.is_leaf else {})
    for node in sorted(made, reverse=True):
        if node > 1:
            made[node // 2].setdefault("children", []).insert(0, made[node])
    return made[1]


