"""Binary little-endian PLY clouds as a Spark data source (format "splat_ply") and their writer."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cloudloom.schema import BASE, COEFFICIENTS, SCHEMA

#: Bytes of a partition, about, and rows of an Arrow batch.
PART, ROWS = 64 << 20, 16_384


class PlyError(ValueError):
    """A file that cannot be read as a splat cloud."""


@dataclass
class Header:
    names: list[str]
    rows: int
    offset: int


def local(path: str) -> str:
    """The path of a file that driver and executors see under one name; file: URIs are taken, other stores are not."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise PlyError(f"{path}: only folders that the driver and all executors have mounted can be read and written")
    return path


def read_header(path: str) -> Header:
    """Only the vertex element counts; it must come first, with float properties only."""
    path = local(path)
    try:
        f = open(path, "rb")
    except OSError as e:
        raise PlyError(f"cannot open {path}") from e
    with f:
        if f.readline().rstrip(b"\r\n") != b"ply":
            raise PlyError(f"{path} is not a PLY file")
        names, rows, element, first = [], 0, None, True
        while True:
            line = f.readline()
            if not line:
                raise PlyError(f"{path} has no end_header")
            words = line.decode("ascii", "replace").split()
            if not words or words[0] in ("comment", "obj_info"):
                continue
            if words[0] == "end_header":
                break
            if words[0] == "format" and words[1] != "binary_little_endian":
                raise PlyError(f"{path}: format {words[1]} is not supported")
            if words[0] == "element":
                element = words[1]
                if element == "vertex":
                    if not first:
                        raise PlyError(f"{path}: the vertex element must come first")
                    rows = int(words[2])
                first = False
            elif words[0] == "property" and element == "vertex":
                if words[1] not in ("float", "float32"):
                    raise PlyError(f"{path}: property {words[-1]} has type {words[1]}; only float is supported")
                names.append(words[2])
        if rows <= 0:
            raise PlyError(f"{path} has no vertices")
        return Header(names, rows, f.tell())


@dataclass
class Part(InputPartition):
    path: str
    start: int
    rows: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, permissive: bool, lod: int):
        path = local(path)
        self.path, self.permissive, self.lod = path, permissive, lod
        self.header = h = read_header(path)
        missing = [c for c in BASE if c not in h.names]
        if missing:
            raise PlyError(f"{path} has no {', '.join(missing)}")
        self.rest = sorted((n for n in h.names if n.startswith("f_rest_") and n[7:].isdigit()), key=lambda n: int(n[7:]))
        if len(self.rest) // 3 not in COEFFICIENTS.values() or len(self.rest) % 3:
            raise PlyError(f"{path} has {len(self.rest)} f_rest properties")
        self.stride = 4 * len(h.names)
        there = (os.path.getsize(path) - h.offset) // self.stride
        if there < h.rows and not permissive:
            raise PlyError(f"{path} ends after {there} of {h.rows} vertices")
        self.rows = min(there, h.rows)

    def partitions(self):
        step = max(1, PART // self.stride)
        return [Part(self.path, k, min(step, self.rows - k)) for k in range(0, self.rows, step)] or [Part(self.path, 0, 0)]

    def read(self, part):
        names, at = self.header.names, {n: k for k, n in enumerate(self.header.names)}
        with open(part.path, "rb") as f:
            f.seek(self.header.offset + part.start * self.stride)
            for start in range(part.start, part.start + part.rows, ROWS):
                n = min(ROWS, part.start + part.rows - start)
                x = np.frombuffer(f.read(n * self.stride), "<f4").reshape(n, len(names))
                columns = [pa.array(np.arange(start, start + n)), pa.array(np.full(n, self.lod, np.int16))]
                columns += [pa.array(np.ascontiguousarray(x[:, at[c]])) for c in BASE]
                rest = np.ascontiguousarray(x[:, [at[c] for c in self.rest]]).ravel() if self.rest else np.zeros(0, np.float32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(self.rest)), pa.array(rest, pa.float32())))
                yield pa.RecordBatch.from_arrays(columns, ["gid", "lod", *BASE, "f_rest"])


class PlySource(DataSource):
    """Options: path; mode `permissive` takes the whole records of a short file; lod. The file must be reachable from every executor."""

    @classmethod
    def name(cls):
        return "splat_ply"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PlyReader(self.options["path"], self.options.get("mode") == "permissive", int(self.options.get("lod", 0)))


def read_ply(spark: SparkSession, path: str, lod: int = 0, mode: str = "strict") -> DataFrame:
    read_header(path)  # errors come here and not in a task
    spark.dataSource.register(PlySource)
    return spark.read.format("splat_ply").option("mode", mode).option("lod", lod).load(path)


def read_many(spark: SparkSession, inputs: list[tuple[str, int]], mode: str = "strict") -> DataFrame:
    from cloudloom.operators.clouds import union

    widths = [sum(n.startswith("f_rest_") for n in read_header(p).names) for p, _ in inputs]
    return union([(read_ply(spark, p, lod, mode), lod) for p, lod in inputs], widths)


def header_of(names: list[str], rows: int) -> bytes:
    return ("ply\nformat binary_little_endian 1.0\n" + f"element vertex {rows}\n" + "".join(f"property float {c}\n" for c in names) + "end_header\n").encode()


def export_ply(df: DataFrame, path: str) -> int:
    """Writes a cloud whose column pos numbers its rows from 0, and gives their number. Each task puts its rows where they belong in the file, so a task that runs again changes nothing."""
    path, rest = local(path), 0
    n = df.count()
    if "f_rest" in df.columns:
        rest = df.selectExpr("coalesce(max(size(f_rest)), 0)").first()[0]
    head = header_of([*BASE, *[f"f_rest_{k}" for k in range(rest)]], n)
    width = len(BASE) + rest
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + 4 * width * n)

    def run(batches):
        rows = 0
        with open(path, "r+b") as f:
            for batch in batches:
                x = np.zeros((batch.num_rows, width), "<f4")
                for k in range(len(BASE)):
                    x[:, k] = batch.column(k + 1).to_numpy(zero_copy_only=False)
                if rest:
                    x[:, len(BASE) :] = batch.column(len(BASE) + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, rest)
                pos = batch.column(0).to_numpy()
                starts = np.flatnonzero(np.diff(pos, prepend=-2) != 1)
                for a, b in zip(starts, [*starts[1:], len(pos)], strict=True):
                    f.seek(len(head) + 4 * width * int(pos[a]))
                    f.write(x[a:b].tobytes())
                rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([rows])], ["rows"])

    columns = ["pos", *BASE, *(["f_rest"] if rest else [])]
    return df.select(*columns).mapInArrow(run, "rows long").agg({"rows": "sum"}).first()[0] or 0


def write_ply(path: str, columns: dict[str, np.ndarray], extra: list[str] = ()) -> None:
    """A file from float arrays in the order of `columns`; for fixtures and small clouds."""
    names = [*columns, *extra]
    n = len(next(iter(columns.values())))
    data = np.stack([columns.get(c, np.zeros(n)) for c in names], 1).astype("<f4")
    with open(path, "wb") as f:
        f.write(header_of(names, n))
        f.write(data.tobytes())
