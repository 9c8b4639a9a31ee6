"""Cross-entropy difference of two matched n-gram models that share one vocabulary.

Words (lower-cased, between white space) and pairs of words are counted under their full 64-bit hashes, so what is gathered grows
with the input. The target model counts the target documents, the background model all documents. The models are matched in
size: a background count n becomes the whole number next below n p + u, with p the target's share of all tokens and u a number
from 0 to 1 that the hash decides, so that the background has as many tokens as the target and leaves out as many rare words and
pairs, though it has met all documents. A document is scored without itself: its own counts are taken off first, from the target
too if it is target.

The vocabulary, shared by both models, is the words that other documents have; any other word is the unknown word, of one
probability in both. A known word's probability is MIX[0] of the pair's share of its first word's count (where that word has
none, its weight goes to the next part), MIX[1] of the word's share of the model, and MIX[2] of the word's share of all
documents. A document's score is the mean over its tokens of the loss under the target model less that under the background
model: the lower, the more like the target.

Documents are dealt to blocks of about BLOCK characters by doc_id. A block counts its different hashes and sends them, sorted and
packed, to buckets of the hashes' range; a bucket adds up what all blocks sent and answers each block with the sums of its own
hashes, from which the block scores its documents. No task sees more than a block or a bucket, and nothing is broadcast.

Texts that are null or empty have no token and score 0. A document without label is not target. If a doc_id has several labels,
one of quality 1 makes it target. Rows that repeat a doc_id are documents each. With no target document, and with no other
document, a model is the shared words alone. A very long text is a block of its own. An empty table gives no rows. Only doc_id,
text and quality are read, whatever other columns there are; tied scores stay tied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import table
from cloudloom.llm.hashing import mix, word_hashes

#: Characters of a block, and blocks for each bucket.
BLOCK, PER_BUCKET = 4_000_000, 4
#: Weights of pair, word and the word in all documents.
MIX = (0.4, 0.55, 0.05)
START = np.uint64(0x51A27)
#: The hash under which all tokens are counted; texts with tokens are counted under START, the word before their first.
ALL = np.uint64(0x9E3779B97F4A7C15)
KEYS = "bucket long, block long, keys binary, background binary, target binary"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of the pairs of all tokens of the texts, one after the other, and the number of tokens of each text."""
    words = [word_hashes((t or "").lower().split()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.concatenate([*words, np.zeros(0, np.uint64)])
    before = np.concatenate([[START], h[:-1]]) if len(h) else h
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return h, mix(before * np.uint64(0xD6E8FEB86659FD93) + h), sizes


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 by planes of bytes, as many as the largest needs, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], "<i8").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    n, width = map(int, np.frombuffer(b[:16], "<i8"))
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(b[16:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def blocks_of(docs: DataFrame) -> int:
    return max(1, -(-(docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // BLOCK))


def dealt(docs: DataFrame, blocks: int, good: DataFrame | None = None) -> DataFrame:
    """block, doc_id, text, label: the documents, and a row with label for each doc_id of good in the block of its documents."""

    def at(other: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), other)), F.lit(blocks)).alias("block")

    rows = docs.select(at(F.col("text")), "doc_id", "text", F.lit(False).alias("label"))
    if good is None:
        return rows
    return rows.union(good.where("doc_id is not null").select(at(F.lit("")), "doc_id", F.lit(None).cast("string"), F.lit(True)))


def parted(t: pa.Table) -> tuple[pa.Table, set]:
    """The documents of a block and the doc_ids that are target."""
    label = t.column("label").combine_chunks()
    return t.filter(pa.array(~np.asarray(label))), set(t.filter(label).column("doc_id").to_pylist())


def counts(rows: DataFrame, buckets: int, count: bool = True, ask: bool = True) -> DataFrame:
    """The different hashes of each block of `dealt` by bucket, with their counts (or 0), and the block if it asks for the sums."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        t, good = parted(t)
        h, pairs, sizes = hashes(t.column("text").to_pylist())
        is_target = np.array([i in good for i in t.column("doc_id").to_pylist()], bool)
        of_target, begun = np.repeat(is_target, sizes), lambda some: np.full(int((some & (sizes > 0)).sum()), START)
        keys, n = np.unique(np.concatenate([h, pairs, begun(np.ones(len(sizes), bool))]), return_counts=True)
        some, n_some = np.unique(np.concatenate([h[of_target], pairs[of_target], begun(is_target)]), return_counts=True)
        target = np.zeros(len(keys), np.int64)
        target[np.searchsorted(keys, some)] = n_some
        at = np.searchsorted(keys, ALL)
        keys, n, target = np.insert(keys, at, ALL), np.insert(n, at, len(h)), np.insert(target, at, of_target.sum())
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ends = [*(np.flatnonzero(np.diff(bucket)) + 1), len(keys)]
        out = []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            some = keys[a:b]
            zero = np.zeros(b - a, np.int64)
            out.append((bucket[a], block if ask else None, packed(np.diff(some, prepend=np.uint64(0))), packed(n[a:b] if count else zero), packed(target[a:b] if count else zero)))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "block", "keys", "background", "target"])

    return rows.groupBy("block").applyInArrow(run, KEYS)


def sums(sent: DataFrame) -> DataFrame:
    """Rows of `counts` that ask, with the counts of all rows of their hashes added up."""

    def run(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(b), dtype=np.uint64) for b in t.column("keys").to_pylist()]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        columns = {}
        for name in ("background", "target"):
            total = np.bincount(at, np.concatenate([unpacked(b) for b in t.column(name).to_pylist()])).astype(np.int64)
            columns[name] = pa.array([packed(x) if b is not None else None for x, b in zip(np.split(total[at], ends), t.column("block").to_pylist(), strict=True)], pa.binary())
        out = pa.table([t.column("bucket"), t.column("block"), *columns.values()], ["bucket", "block", *columns])
        return out.filter(out.column("block").is_valid())

    return sent.groupBy("bucket").applyInArrow(run, "bucket long, block long, background binary, target binary")


def own_counts(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in the token's document; keys: whole numbers from 0."""
    _, at, n = np.unique(doc * (int(keys.max(initial=0)) + 1) + keys, return_inverse=True, return_counts=True)
    return n[at]


def spread(keys: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each hash."""
    return (mix(keys) >> np.uint64(11)) * 2.0**-53


def losses(rows: DataFrame, answers: DataFrame, counted: bool = True) -> DataFrame:
    """Scores of the documents of `dealt`, from the answers to their blocks. counted: whether the models have counted these documents."""

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        t, good = parted(t)
        h, pairs, sizes = hashes(t.column("text").to_pylist())
        filled = np.flatnonzero(sizes)
        keys, at = np.unique(np.concatenate([h, pairs, np.full(len(filled), START)]), return_inverse=True)
        word, pair = at[: len(h)], at[len(h) : 2 * len(h)]
        told, place = told.sort_by("bucket"), np.searchsorted(keys, ALL)
        sums = [np.concatenate([np.zeros(0, np.uint64), *map(unpacked, told.column(name).to_pylist())]).astype(np.int64) for name in ("background", "target")]
        total, sums = [int(n[place]) if len(n) else 0 for n in sums], [np.delete(n, place) if len(n) else np.zeros(len(keys), np.int64) for n in sums]
        doc, last = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
        first = (last - sizes)[filled]
        before = np.concatenate([[0], word[:-1]]) if len(word) else word
        before[first] = at[2 * len(h) :]
        in_target = np.array([i in good for i in t.column("doc_id").to_pylist()], bool)[doc]
        own_word, own_pair = (own_counts(k, doc) if counted else np.zeros(len(h), np.int64) for k in (word, pair))
        own_before = np.concatenate([[0], own_word[:-1]]) if len(word) else own_word
        own_before[first] = int(counted)
        own = own_word, own_pair, own_before
        every_word, every_pair, every_before = (sums[0][k] - o for k, o in zip((word, pair, before), own, strict=True))
        sizes_here = sizes[doc] * int(counted)
        all_tokens = total[0] - sizes_here
        share, known, shared = total[1] / max(1, total[0]), every_word > 0, every_word / np.maximum(1, all_tokens)
        thinned = lambda n, k: np.floor(n * share + spread(keys)[k])
        models = (
            [sums[1][k] - o * in_target for k, o in zip((word, pair, before), own, strict=True)] + [total[1] - sizes_here * in_target],
            [thinned(n, k) for n, k in zip((every_word, every_pair, every_before), (word, pair, before), strict=True)] + [all_tokens * share],
        )
        out = []
        for n_word, n_pair, n_before, tokens in models:
            of_pair = np.where(n_before > 0, MIX[0], 0.0)
            p = of_pair * np.minimum(1, n_pair / np.maximum(1, n_before)) + (MIX[0] + MIX[1] - of_pair) * n_word / np.maximum(1, tokens) + MIX[2] * shared
            p = np.where(tokens < 1, shared, p)
            loss = -np.log(np.where(known, p, MIX[2] / (all_tokens + 1)))
            ends = np.concatenate([[0.0], np.cumsum(loss)])
            out.append((ends[last] - ends[last - sizes]) / np.maximum(1, sizes))
        return pa.table([t.column("doc_id"), pa.array(sizes), *map(pa.array, out), pa.array(out[0] - out[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)


class Models:
    """The documents counted: rows of `dealt`, and how many blocks they fill."""

    def __init__(self, rows: DataFrame, blocks: int):
        self.rows, self.blocks = rows, blocks

    @property
    def total(self) -> np.ndarray:
        """Number of tokens of the background and of the target."""

        def run(t: pa.Table) -> pa.Table:
            t, good = parted(t)
            n = [(len((x or "").split()), i in good) for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)]
            return pa.table({"background": [sum(k for k, _ in n)], "target": [sum(k for k, is_target in n if is_target)]})

        row = self.rows.groupBy("block").applyInArrow(run, "background long, target long").agg(F.sum("background"), F.sum("target")).first()
        return np.array([v or 0 for v in row], np.int64)


def buckets_of(blocks: int) -> int:
    return -(-blocks // PER_BUCKET)


def marked(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt to blocks with the labels of the target, and the number of blocks."""
    blocks = blocks_of(docs)
    return dealt(docs, blocks, labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()), blocks


def train(docs: tuple[DataFrame, int]) -> Models:
    return Models(*docs)


def scored(docs: DataFrame, models: Models) -> DataFrame:
    """Scores of documents that the models have not counted."""
    rows, buckets = dealt(docs, blocks_of(docs)), buckets_of(models.blocks)
    return losses(rows, sums(counts(models.rows, buckets, ask=False).union(counts(rows, buckets, count=False))), counted=False)


def query(spark, sf_dir: str) -> DataFrame:
    """Scores of the documents that are counted: what their blocks send is counted and asked for at once."""
    rows, blocks = marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return losses(rows, sums(counts(rows, buckets_of(blocks))))
