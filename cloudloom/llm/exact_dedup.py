"""Stateful streaming exact deduplication, in DataFrame operations only.

Texts are equal when they are identical after deletion of the characters of [\\x20\\x09-\\x0D]; null counts as empty. A stream
over the table keeps state by digest in RocksDB on the executors' disks, without watermark or expiry: the digest, the stable
identifier and content locator (file and row) of the row that stays, and a count. A digest of several rows is a hit: the full
bytes of its rows are compared, so two texts of one digest stay apart. The hits are marked in a bitmap of fixed size, and only
rows that it marks are shuffled with their bytes, copies of a text meeting in each task first; a mark that a digest without a hit
shares costs a row's shuffle and changes nothing. Of equal texts the row with the most code points stays, then the smallest
doc_id (null last), then the first locator.

Rows that repeat one doc_id are rows of their own: only the one at the keeper's locator is kept. A text of any length is read
whole. An empty table gives no rows. `dedup` keeps extra columns, whatever their names; the others read doc_id and text only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.common import cut, new_path, unused

#: Bits of the bitmap of hits; 32,768 for each row of the small table that is broadcast.
MARKS = 1 << 22
#: Characters that equality ignores.
IGNORED = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store takes 4 MB of disk at once
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else the stores hold their memory after the stream has ended
}


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(df: DataFrame, digest) -> DataFrame:
    """doc_id, norm, digest, n (code points) and the locator; what stays is the smallest order()."""
    norm = normalised(F.col("text"))
    place = df.metadataColumn("_metadata")
    at = df.select("doc_id", "text", place["file_path"].alias("file"), place["row_index"].alias("row"))
    out = at.select("doc_id", norm.alias("norm"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), "file", "row")
    return out.withColumn("digest", digest(F.col("norm")))


def order() -> Column:
    """Smallest: most code points, then smallest doc_id with null last, then first locator."""
    return F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def stream_state(spark: SparkSession, path: str, schema, digest=sha256, max_files: int | None = None) -> DataFrame:
    """The state after the whole table: digest, count, keeper. max_files bounds a micro-batch; the state does not depend on it."""
    out, checkpoint = new_path(spark, "dedup-state"), new_path(spark, "dedup-stream")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    before = {k: spark.conf.get(k, None) for k in STREAM}
    for k, v in STREAM.items():
        spark.conf.set(k, v)
    try:
        rows = keyed(reader.parquet(_pattern(spark, path)), digest)
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(order()).alias("keeper"))
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _exists(spark, out):
        return spark.createDataFrame([], state.schema)
    updates = spark.read.schema(state.schema).parquet(f"{out}/batch=*")
    if not max_files:
        return updates
    return updates.groupBy("digest").agg(F.max(F.struct("rows", "keeper")).alias("last")).select("digest", "last.*")


def _escaped(path: str) -> str:
    """The path as a pattern that matches it alone."""
    return re.sub(r"([\\[\]{}*?])", r"\\\1", path)


def _pattern(spark: SparkSession, path: str) -> str:
    """The same for a stream, which reads a folder or a pattern, but a single file only as the latter."""
    escaped = _escaped(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return escaped
    return f"{escaped[:-1]}[{escaped[-1]}]"


def marked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose digest has its mark among those of hits: all rows of hits, and few others."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(MARKS)) + 1
    bits = hits.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("mark_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("marks"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    both = rows.withColumn("mark_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "mark_bucket")
    return both.where(on).select(rows.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def assignments(spark: SparkSession, path: str, digest=sha256, max_files: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file and row for each row of the Parquet table at path."""
    docs = spark.read.parquet(_escaped(path))
    state = cut(stream_state(spark, path, docs.schema, digest, max_files), "dedup-groups")
    rows = keyed(docs, digest)
    #: The full bytes of hits: copies of a text meet in each task. A digest with several texts is a clash.
    texts = marked(rows, state.where("rows > 1")).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clash = cut(texts.where("texts > 1").select("digest"), "dedup-clashes")
    slim = rows.select("doc_id", "n", "file", "row", "digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    if clash.isEmpty():
        placed = slim.join(state, "digest")
    else:
        apart = rows.join(clash, "digest", "left_semi")
        of_text = apart.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"), F.min(order()).alias("keeper"))
        apart = apart.join(of_text, ["digest", "norm"]).select(*slim.columns[:-1], F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "rows", "keeper")
        placed = slim.join(clash, "digest", "left_anti").join(state, "digest").select(apart.columns).union(apart)
    same = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    return placed.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("rows").alias("group_size"), same.alias("kept"), "text_sha256", "file", "row")


def dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """The rows of docs that stay, all columns as they were."""
    spark = docs.sparkSession
    path = new_path(spark, "dedup-input")
    docs.write.parquet(path)
    kept = assignments(spark, path, digest).where("kept").select("file", "row")
    rows = spark.read.schema(docs.schema).parquet(path)
    file, row = unused(docs, "file"), unused(docs, "row")
    place = rows.metadataColumn("_metadata")
    placed = rows.withColumns({file: place["file_path"], row: place["row_index"]})
    return placed.join(kept.select(F.col("file").alias(file), F.col("row").alias(row)), [file, row], "left_semi").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
