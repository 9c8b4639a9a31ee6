"""Shared tables for cutting lineage, and small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cloudloom.shared import new_path

def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a shared table that no result reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs no more than the stage that it was in."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that `cut` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None:
            drop_path(t.sparkSession, t.shared_path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, size: int = 256):
    """Arrow batches as short ones, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    pa.default_memory_pool().release_unused()


#: Bounds of the Arrow batches that are sent to Python workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def trimmed() -> None:
    """Gives the system back what Arrow and malloc have free."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes; a task that ends gives its memory back, and what is held goes if no task follows. Spark takes the bounds from the session when the plan runs, so they stay set there; bounds that the user has set are left as they are."""
    for k, most in BATCH.items():
        if df.sparkSession.conf.get(k, None) is None:
            df.sparkSession.conf.set(k, str(most))

    def trimming(batches):
        yield from run(batches)
        trimmed()
        idle()

    return df.mapInArrow(trimming, schema)


#: Seconds after a task for which a Python worker keeps what it holds.
IDLE_S = 2
_held: dict[str, object] = {}
_lock = threading.Lock()
_timers: list[threading.Timer] = []


def held(name: str, make):
    """What a Python worker keeps from task to task, of one operator at a time: workers outlive a query, so what the one before kept is let go, and all of it when no task has asked for it for IDLE_S."""
    with _lock:
        while _timers:
            _timers.pop().cancel()
        if name not in _held:
            _held.clear()
            gc.collect()
            trimmed()
            _held[name] = make()
        return _held[name]


def let_go() -> None:
    with _lock:
        _held.clear()
    gc.collect()
    trimmed()


def idle() -> None:
    """Lets go of what is held in IDLE_S, unless a task asks for it."""
    with _lock:
        if _held and not _timers:
            _timers.append(threading.Timer(IDLE_S, let_go))
            _timers[-1].daemon = True
            _timers[-1].start()
