"""Near duplicates by BagMinHash, banding and verification of multiset overlap.

A document is the multiset of its five-word shingles (lower-cased words between white space; fewer than five words are one
shingle). Weights are shingle counts. The weights are discretised to whole levels, and each shingle has a Poisson process over
the levels, split by halves: level 0, then [1, 2), [2, 4), [4, 8) and so on, each a process with the rate of its width whose
points are thrown to single levels by coin flips. A point of a level below the shingle's count sets a register to its time if
that is earlier. The share of equal registers estimates the weighted Jaccard similarity without bias. Registers are made to a
time horizon at which all are set.

Documents of the same words are one node. Nodes that share a band fall into one bucket. First each node is compared with the
pivot of each of its buckets: the node whose buckets are largest in all, which in a group of near copies tends to be the text
that the others were made from. The links found so far give components. A bucket whose nodes are all in one component is done.
In any other bucket the nodes outside its largest component (the minor ones) are compared with all nodes of other components,
in blocks: a task holds one block of minor nodes, with an index of their elements, and streams one block of the others past it.
A pair that meets in several buckets is compared in that of its first common band. So no link within a bucket that joins two
components is lost, and no pairs are emitted but links. The work in a bucket is its minor nodes times its nodes.
Each compared pair is verified by its exact multiset similarity.

A class is a component of links; its id is its smallest doc_id. Null and empty texts are in no class but their own. A row whose
doc_id is null has class_id null. Rows that repeat a doc_id and text are rows of one document. Of nodes with equal scores the one
of the larger key is a bucket's pivot; classes do not depend on it. A text of any length is read whole. An empty table gives no
rows. Only doc_id and text are read; `dedup` keeps extra columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import cut, dropped, mapped, slices, table
from cloudloom.llm.components import components
from cloudloom.llm.hashing import mix, word_hashes

WORDS, SIMILARITY = 5, 0.8
LEAST = SIMILARITY - 1e-12
#: At a similarity of 0.8 two documents miss all bands with probability (1 - 0.8^5)^25 = 0.00005.
BANDS, ROWS = 25, 5
#: A block of minor nodes and one of those compared with them hold about so many nodes, or so many elements if these are fewer nodes.
MINOR_NODES, MINOR_ELEMENTS, OTHER_NODES, OTHER_ELEMENTS = 256, 1 << 20, 4096, 1 << 24
#: Copies of a pivot's elements, by bucket at most, so that the many nodes of one pivot are dealt to several tasks.
SALTS = 32
GOLD = 0x9E3779B97F4A7C15


def _times(k: int, by: int) -> np.uint64:
    return np.uint64(k * by & 0xFFFFFFFFFFFFFFFF)


def shingles(words: list[str], size: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each shingle, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(h))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(total)


def bagminhash(bag: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """The time of the first point in each register; bag: distinct hashes, counts: their weights. Points are made some at a time for all shingles whose process has not passed the horizon."""
    horizon = registers / float(counts.sum()) * (np.log(registers) + 2.5)
    while True:
        first = np.full(registers, np.inf)
        low, block = 0, 0
        while (inside := counts > low).any():
            x, w = (bag, counts) if inside.all() else (bag[inside], counts[inside])
            rate, t, j = max(low, 1), np.zeros(len(x)), 0
            seed = mix(x + _times(block + 1, 0xA0761D6478BD642F))
            some = int(rate * horizon) + 2
            while len(seed):
                step = np.arange(j + 1, j + some + 1, dtype=np.uint64) * np.uint64(GOLD)
                r = mix(seed[:, None] + step)
                wait = np.log(((r >> np.uint64(11)) + np.uint64(1)) * 2.0**-53)
                times = t[:, None] - np.cumsum(wait, 1) / rate
                soon = times <= horizon
                when, place = times[soon], mix(r[soon] ^ np.uint64(0xE7037ED1A0B428DB))
                there = ((place >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
                if low > 1:
                    ok = low + (place & np.uint64(low - 1)).astype(np.int64) < np.repeat(w, soon.sum(1))
                    there, when = there[ok], when[ok]
                np.minimum.at(first, there, when)
                more = soon[:, -1]
                seed, t, w, j = seed[more], times[more, -1], w[more], j + some
            low, block = max(1, 2 * low), block + 1
        if np.isfinite(first).all():
            return first
        horizon *= 2


def band_values(first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = first.view(np.uint64).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLD)
    for k in range(rows):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + bits[:, k])
    return h.view(np.int64)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def key_of(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def elements(words: list[str]) -> np.ndarray:
    """The multiset as a sorted set of (shingle, how many there were before)."""
    bag, counts = np.unique(shingles(words), return_counts=True)
    out = [bag]
    for k in range(1, int(counts.max(initial=0))):
        out.append(mix(bag[counts > k] + _times(k, GOLD)))
    return np.unique(np.concatenate(out)) if len(out) > 1 else bag


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key and band values; both are null where there is no word or no doc_id."""

    def run(batches):
        for batch in slices(batches):
            keys, bands = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if doc is None or not words:
                    keys.append(None)
                    bands.append(None)
                    continue
                bag, counts = np.unique(shingles(words), return_counts=True)
                keys.append(key_of(words))
                bands.append(band_values(bagminhash(bag, counts, BANDS * ROWS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, key binary, bands array<long>")


def _bags(docs: DataFrame, ids: DataFrame, keys: DataFrame) -> DataFrame:
    """key and elements of the nodes in keys, from one document of each. Texts travel compressed. The first join is never broadcast: a task with both functions takes two Python workers, which then stay."""

    def packed(batches):
        codec = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    def run(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            words = [words_of(codec.decompress(t).decode()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, words), pa.binary()), pa.array([elements(w).view(np.int64) for w in words], pa.list_(pa.int64()))], ["key", "bag"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    asked = mapped(texts, packed, "doc_id long, text binary").join(ids.hint("merge"), "doc_id", "left_semi").select("text")
    made = mapped(asked, run, "key binary, bag array<long>").join(keys, "key", "left_semi")
    return made.dropDuplicates(["key"])


class Block:
    """Minor nodes of one bucket, with an index of their elements."""

    def __init__(self, keys: list[bytes], roots: list[bytes], bands: np.ndarray, bags: list[np.ndarray]):
        self.keys, self.roots, self.bands = np.array(keys, "S16"), np.array(roots, "S16"), bands
        self.sizes = np.array([len(x) for x in bags])
        every, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.vocabulary, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)

    def linked(self, bucket: int | None, key: bytes, root: bytes, minor: bool, bands: np.ndarray, bag: np.ndarray) -> np.ndarray:
        """Indices of the nodes linked to one of another component, if `bucket` is that of their first common band or None."""
        ok = self.roots != np.bytes_(root)
        if bucket is not None:
            alike = self.bands == bands
            ok &= (bands[alike.argmax(1)] == bucket) & alike.any(1)
        if minor:  # the other node meets this one in the same way
            ok &= self.keys < np.bytes_(key)
        ok &= np.minimum(self.sizes, len(bag)) >= LEAST * np.maximum(self.sizes, len(bag))
        if not ok.any():
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, bag), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == bag]
        count = self.count[at]
        place = np.arange(count.sum()) + np.repeat(self.start[at] - np.cumsum(count) + count, count)
        same = np.bincount(self.owner[place], minlength=len(self.sizes))
        return np.flatnonzero(ok & (same >= LEAST * (self.sizes + len(bag) - same)))


def _compared(rows: DataFrame) -> DataFrame:
    """The links between rows to hold and others of their block (bucket, i, j). Blocks of pivots have a j of -1; there each pair meets once."""

    def run(batches):
        now, block, held = None, None, []
        for batch in slices(batches):
            found_a, found_b = [], []
            bucket, i, j, hold, minor, key, root = (batch.column(k).to_pylist() for k in range(7))
            for k in range(batch.num_rows):
                if now != (bucket[k], i[k], j[k]):
                    now, block, held = (bucket[k], i[k], j[k]), None, []
                bands, bag = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (7, 8))
                if hold[k]:
                    held.append((key[k], root[k], bands.copy(), bag.copy()))
                    continue
                if block is None:
                    if not held:
                        continue
                    keys, roots, all_bands, bags = zip(*held, strict=True)
                    block, held = Block(list(keys), list(roots), np.stack(all_bands), list(bags)), []
                for x in block.linked(bucket[k] if j[k] >= 0 else None, key[k], root[k], minor[k], bands, bag):
                    found_a.append(keys[x])
                    found_b.append(key[k])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], ["a", "b"])

    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("held"))
    return mapped(rows.select("bucket", "i", "j", "held", "minor", "key", "root", "bands", "bag"), run, "a binary, b binary")


def _pivots(found: DataFrame) -> DataFrame:
    """bucket, i (which copy of the pivot's elements), key and pivot: each node and each pivot of its buckets once."""
    pivots = found.groupBy("bucket").agg(F.max(F.struct("score", "key")).alias("p")).select("bucket", F.col("p.key").alias("pivot"))
    pairs = found.join(pivots, "bucket").where("key <> pivot").groupBy("key", "pivot").agg(F.min("bucket").alias("bucket"))
    return pairs.select("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("i"), "key", "pivot")


def _pivot_blocks(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The rows of `_compared` for `_pivots`: blocks of one pivot."""
    held = pairs.select("bucket", "i", F.col("pivot").alias("key"), F.lit(True).alias("held")).distinct()
    rows = held.union(pairs.select("bucket", "i", "key", F.lit(False))).select("bucket", "i", F.lit(-1).alias("j"), "held", F.lit(False).alias("minor"), "key", F.col("key").alias("root"))
    return rows.join(bags.select("key", "bands", "bag"), "key")


def _rooted(found: DataFrame, roots: DataFrame) -> DataFrame:
    """found with the root of each node's component."""
    return found.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", "size", F.coalesce("root", "key").alias("root"))


def _blocks(rooted: DataFrame, bags: DataFrame) -> DataFrame:
    """The rows of `_compared`: the blocks of buckets whose nodes are in several components."""
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("e"))
    whole = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.max(F.struct("n", "root", "e")).alias("top")).where("parts > 1")
    blocks = lambda n, e, nodes, elements: F.ceil(F.greatest(n / nodes, e / elements)).cast("int")
    whole = whole.select("bucket", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("e") - F.col("top.e"), MINOR_NODES, MINOR_ELEMENTS).alias("minors"), blocks(F.col("n"), F.col("e"), OTHER_NODES, OTHER_ELEMENTS).alias("others"))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    minor = F.col("root") != F.col("top")
    stream = F.transform(upto("minors"), lambda i: F.struct(i.alias("i"), dealt("others").alias("j"), F.lit(False).alias("held")))
    hold = F.when(minor, F.transform(upto("others"), lambda j: F.struct(dealt("minors").alias("i"), j.alias("j"), F.lit(True).alias("held"))))
    placed = rooted.join(whole, "bucket").select("bucket", "key", "root", minor.alias("minor"), F.inline(F.concat(stream, F.coalesce(hold, F.array().cast("array<struct<i int, j int, held boolean>>")))))
    return placed.join(bags.select("key", "bands", "bag"), "key")


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """node and root, as `components` gives them, of all links within buckets."""
    nodes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    entries = nodes.select("key", F.explode(F.array_distinct("bands")).alias("bucket"))
    several = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(entries.join(several, "bucket"), "shared")
    scores = shared.groupBy("key").agg(F.sum("n").alias("score"))
    wanted = cut(scores.join(nodes, "key"), "wanted")
    bags = cut(_bags(docs, wanted.select("doc_id").distinct(), wanted.select("key")).join(wanted.select("key", "score", "bands"), "key"), "bags")
    found = cut(shared.join(bags.select("key", "score", F.size("bag").alias("size")), "key"), "found")
    dropped(shared, wanted)
    pivots = cut(_pivots(found), "pivots")
    first = cut(_compared(_pivot_blocks(pivots, bags)), "first_links")
    roots = components(first)
    rooted = cut(_rooted(found, roots), "rooted")
    dropped(pivots, first, found)
    rest = cut(_compared(_blocks(rooted, bags)), "other_links")
    dropped(rooted, bags)
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    dropped(roots, rest)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id for each row."""
    signed = cut(signatures(docs), "signatures")
    roots = links(docs, signed)
    ids = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    root = F.coalesce("root", "key")
    placed = cut(ids.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", root.alias("root"), "first_id"), "placed")
    dropped(roots)
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("class_id")), "root").select("key", "class_id")
    return signed.select("doc_id", "key").join(named, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their class's, all columns as they were. Rows without doc_id stay; of rows that repeat a doc_id all stay or go."""
    gone = classes(docs.select("doc_id", "text")).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn("representative", F.col("doc_id") == F.col("class_id"))


#: All pairs of documents with an element in common, compared in full; classes are the components of the links.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id, g) AS k FROM s),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
edges AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT edges.b, reached.root FROM reached JOIN edges ON edges.a = reached.doc_id),
c AS (SELECT doc_id, min(root) AS class_id FROM reached GROUP BY doc_id)
SELECT doc_id, class_id, doc_id = class_id AS representative FROM c
"""
