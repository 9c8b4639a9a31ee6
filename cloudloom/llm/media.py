"""Copies of images by local descriptors: multiscale corners, orientation-normalised binary tests, Hamming-table joins, consensus.

Corners are all local maxima of the Harris response over RESPONSE at two scales, so their number grows with the image's area.
Around each, the direction of the patch's centre of mass turns a fixed set of 256 pairs of places, and each pair gives a bit:
which place is brighter.

A table's word is some of the 256 bits, as many as the index needs for words to be rare: work grows with the rows, not with
queries times index. A query corner looks up its own word and those that differ in up to FLIPS of its UNSURE least certain bits
(the tests whose two places are least apart in brightness). Words are dealt to cells by their first bits; a cell with many query
corners is cut into blocks, its index corners into as many parts, and in a task a block is held while index corners stream past
it. Corners that meet and differ in at most NEAR bits vote for a shift, a turn and a change of scale; a pair of images with
CANDIDATE votes that agree (votes travel gathered by query image and share of the index) is then compared exactly: all its pairs of corners within NEAR bits vote, and with INLIERS that agree
the one is a copy of the other, also if it was cropped or its brightness and contrast edited.

Images of equal content are one class and are described once; results hold pairs of classes' representatives and membership.
Null or empty pixels, or a size that does not fit the pixels, have no corners: such a row is a class that matches nothing. Rows
are grouped by content, so repeated rows are members of one class; null ids are members too. An image of any size is described
whole. An empty table gives no rows. Extra columns are not read. Of ties in inliers both pairs stand.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import cut, dropped, mapped, slices, table
from cloudloom.llm.hashing import mix

SCALES, RESPONSE, NEAR, CANDIDATE, INLIERS, PATCH = 2, 1, 48, 2, 3, 15
TURNS = 30
UNSURE, FLIPS = 10, 3
#: Places fall into bins of so many pixels of shift; each vote goes to the four nearest bins.
SHIFT = 8
#: Corners of a cell and of a block of queries, pairs of descriptors that are compared at once, and pixels that are described at once.
CELL, BLOCK, STEP, PIXELS = 1 << 15, 1 << 15, 200_000, 1 << 20
#: Images of the index in a share; and corners of an image of 96 x 96, on average, which decides the size of words and shares only.
SHARE, CORNERS = 4096, 60
#: Images of a block of pairs, on either side.
TOGETHER = 256
#: Bits of a word that name its cell, at most: the sizes of so many cells for each table are what the driver holds and sends.
CELL_BITS = 16


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r + 1 pixels around each pixel of a stack of images; edges repeat."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis, dtype=np.float32)
        n = x.shape[axis]
        x = np.take(c, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, range(n), axis)
    return x


def largest(x: np.ndarray, r: int) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(x, pad, constant_values=-np.inf)
        x = functools.reduce(np.maximum, [np.take(p, range(k, k + x.shape[axis]), axis) for k in range(2 * r + 1)])
    return x


@functools.cache
def tests(seed: int = 5) -> np.ndarray:
    """Offsets (turn, test, end, yx) of the 256 pairs, turned by each of TURNS angles."""
    pairs = np.clip(np.random.default_rng(seed).normal(0, PATCH / 2.5, (256, 2, 2)), -PATCH * 0.7, PATCH * 0.7)
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    y, x = pairs[None, ..., 0], pairs[None, ..., 1]
    return np.rint(np.stack([sin * x + cos * y, cos * x - sin * y], -1)).astype(int)


@functools.cache
def places(table_: int, size: int) -> np.ndarray:
    """The tests whose bits are a table's word."""
    return np.random.default_rng(100 + table_).permutation(256)[:size]


def describe(images: np.ndarray, tables: int = 0, size: int = 0) -> list[tuple[np.ndarray, ...]]:
    """For a stack of grey images of one size: image, x, y, turn, scale (0, 1), bits (uint8, 32) of all corners; and for each of the tables the least certain bits of its word."""
    out = []
    for scale in range(SCALES):
        x = images.astype(np.float32)
        if scale:
            h, w = x.shape[1] // 2 * 2, x.shape[2] // 2 * 2
            x = (x[:, 0:h:2, 0:w:2] + x[:, 1:h:2, 0:w:2] + x[:, 0:h:2, 1:w:2] + x[:, 1:h:2, 1:w:2]) / 4
        n, h, w = x.shape
        edge = PATCH - 3
        if h <= 2 * edge + 2 or w <= 2 * edge + 2:
            continue
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        inner = response[:, edge : h - edge, edge : w - edge]
        image, row, column = np.nonzero((inner >= largest(inner, 3)) & (inner > RESPONSE))
        py, px = row + edge, column + edge
        smooth = np.pad(box(x, 1) / 9, ((0, 0), (PATCH, PATCH), (PATCH, PATCH)), mode="edge")
        span = np.arange(-7, 8)
        turns, every, doubt = [np.zeros(0, int)], [np.zeros((0, 32), np.uint8)], [np.zeros((0, tables, UNSURE), np.uint8)]
        for at in range(0, len(image), 4096):
            i, y, x = (v[at : at + 4096, None, None] for v in (image, py + PATCH, px + PATCH))
            patch = smooth[i, y + span[:, None], x + span]
            m10, m01 = (patch * span).sum((1, 2)), (patch * span[:, None]).sum((1, 2))
            turns.append(np.rint(np.arctan2(m01, m10) * TURNS / (2 * np.pi)).astype(int) % TURNS)
            o = tests()[turns[-1]]
            values = smooth[i, y + o[..., 0], x + o[..., 1]]
            every.append(np.packbits(values[..., 0] < values[..., 1], axis=1))
            if tables:
                apart = np.abs(values[..., 0] - values[..., 1])
                doubt.append(np.stack([np.argsort(apart[:, places(t, size)], 1, kind="stable")[:, :UNSURE] for t in range(tables)], 1).astype(np.uint8))
        f = 1 << scale
        out.append((image, px * f, py * f, np.concatenate(turns), np.full(len(image), scale), np.concatenate(every), np.concatenate(doubt)))
    return out


#: A corner: its place, turn, scale and bits.
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("turn", "u1"), ("scale", "u1"), ("bits", "u1", 32)])


def asking(tables: int) -> np.dtype:
    """A corner of a query, with the least certain bits of its words."""
    return np.dtype([*CORNER.descr, ("doubt", "u1", (tables, UNSURE))])


def descriptors(images: DataFrame, tables: int = 0, size: int = 0) -> DataFrame:
    """id and corners (packed CORNERs, or those of `asking` if there are tables) of each image that has any; images: id, width, height, pixels (grey bytes by row)."""
    kind = asking(tables) if tables else CORNER

    def run(batches):
        for batch in slices(batches, 64):
            ids, sizes = batch.column(0), {}
            for k, (w, h, p) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if p and w and h and len(p) == w * h:
                    sizes.setdefault((h, w), []).append((k, p))
            for (h, w), some in sizes.items():
                together = max(1, PIXELS // (w * h))
                for k in range(0, len(some), together):
                    part = some[k : k + together]
                    found = describe(np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for _, p in part]), tables, size)
                    if not found:
                        continue
                    image, x, y, turn, scale, bits, doubt = map(np.concatenate, zip(*found, strict=True))
                    corners = np.zeros(len(image), kind)
                    corners["x"], corners["y"], corners["turn"], corners["scale"], corners["bits"] = x, y, turn, scale, bits
                    if tables:
                        corners["doubt"] = doubt
                    order = np.argsort(image, kind="stable")
                    at, starts = np.unique(image[order], return_index=True)
                    parts = np.split(corners[order], starts[1:]) if len(at) else []
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([part[i][0] for i in at], pa.int64())), pa.array([c.tobytes() for c in parts], pa.binary())], ["id", "corners"])

    kept = dict(images.dtypes)["id"]
    return mapped(images.select("id", "width", "height", "pixels"), run, f"id {kept}, corners binary")


def near_pairs(queries: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and of index whose bits (uint64, 4 each) differ in at most NEAR: all are compared."""
    found, rows = [], max(1, STEP // max(1, len(index)))
    for at in range(0, len(queries), rows):
        apart = sum(np.bitwise_count(queries[at : at + rows, None, k] ^ index[None, :, k]).astype(np.int16) for k in range(4))
        i, j = np.nonzero(apart <= NEAR)
        found.append((i + at, j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def word_size(corners: int) -> int:
    """Bits of a word for an index of so many corners, so that a word has a few of them."""
    return min(max(int(corners).bit_length() - 1, 12), 48)


def tables_for(size: int) -> int:
    """One table for words of up to 24 bits; longer words differ more often, so there are more tables."""
    return 1 + max(0, size - 24) // 3


def words(bits: np.ndarray, table_: int, size: int) -> np.ndarray:
    on = np.unpackbits(bits, axis=1)[:, places(table_, size)]
    return on.astype(np.uint64) @ (np.uint64(1) << np.arange(size, dtype=np.uint64))


@functools.cache
def flips() -> np.ndarray:
    """Which of the UNSURE bits each probe flips."""
    return np.array([[k in c for c in itertools.chain.from_iterable(itertools.combinations(range(UNSURE), n) for n in range(FLIPS + 1))] for k in range(UNSURE)], np.uint64)


def probes(word: np.ndarray, doubt: np.ndarray) -> np.ndarray:
    """The words that each query corner looks up."""
    return word[:, None] ^ ((np.uint64(1) << doubt.astype(np.uint64)) @ flips())


def squeezed(x: np.ndarray) -> bytes:
    """Records by planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def loosened(b: bytes, n: int, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def numbered(kind: np.dtype) -> np.dtype:
    return np.dtype([("image", "<i8"), ("word", "<u8"), *kind.descr])


DEALT = "table int, cell long, block int, part int, held boolean, n int, corners binary"


def unpacked(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    """The corners of all images of a batch (id, corners), numbered."""
    blobs = batch.column(1).to_pylist()
    sizes = [len(b) // kind.itemsize for b in blobs]
    out = np.zeros(sum(sizes), numbered(kind))
    flat = np.frombuffer(b"".join(blobs), kind)
    for name in kind.names:
        out[name] = flat[name]
    out["image"] = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
    return out


def in_rows(keys: list[np.ndarray], corners: np.ndarray, table_: int, is_held: bool) -> pa.RecordBatch:
    """A row for each different (cell, block, part) with its corners."""
    order = np.lexsort(keys[::-1])
    keys, corners = [k[order] for k in keys], corners[order]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(corners) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = [*starts[1:], len(corners)]
    cell, block, part = (k[starts] for k in keys)
    blobs = [squeezed(corners[a:b]) for a, b in zip(starts, ends, strict=False)]
    n = np.diff([*starts, len(corners)]) if len(starts) else starts
    columns = [pa.array(np.full(len(starts), table_), pa.int32()), pa.array(cell, pa.int64()), pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(starts), is_held)), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["table", "cell", "block", "part", "held", "n", "corners"])


def dealt_queries(asked: DataFrame, tables: int, size: int, cell_bits: int) -> DataFrame:
    """Rows of DEALT: each query corner once for each cell that it looks into; one block of a cell for each batch of images, as yet."""
    kind, shift = asking(tables), np.uint64(size - cell_bits)

    def run(batches):
        for batch in slices(batches):
            corners = unpacked(batch, kind)
            for t in range(tables):
                corners["word"] = words(corners["bits"], t, size)
                cells = probes(corners["word"], corners["doubt"][:, t]) >> shift
                cells.sort(1)
                first = np.concatenate([np.ones((len(cells), 1), bool), cells[:, 1:] != cells[:, :-1]], 1)
                who, at = np.nonzero(first)
                zero = np.zeros(len(who), np.int64)
                yield in_rows([cells[who, at].astype(np.int64), zero, zero], corners[who], t, True)

    return mapped(asked, run, DEALT)


def dealt_index(index: DataFrame, size: int, cell_bits: int, blocks: dict[tuple[int, int], int]) -> DataFrame:
    """Rows of DEALT: the corners of cells that a query looks into, in one of as many parts as the cell has blocks of queries, for each of these blocks."""
    shift, sent, tables = np.uint64(size - cell_bits), index.sparkSession.sparkContext.broadcast(blocks), tables_for(size)

    def run(batches):
        n_blocks = np.zeros((tables, 1 << cell_bits), np.int32)
        for (t, cell), n in sent.value.items():
            n_blocks[t, cell] = n
        for batch in slices(batches):
            corners = unpacked(batch, CORNER)
            for t in range(tables):
                corners["word"] = words(corners["bits"], t, size)
                cell = (corners["word"] >> shift).astype(np.int64)
                n = n_blocks[t, cell]
                who = np.repeat(np.arange(len(corners)), n)
                block = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                part = (corners["image"][who] * 0x9E3779B1 >> 16) % np.maximum(n[who], 1)
                yield in_rows([cell[who], block, part], corners[who], t, False)

    return mapped(index, run, DEALT)


def blocked(asked: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The rows of `dealt_queries` in blocks of about BLOCK corners, for each part of their cell; and the number of blocks of each cell, of which there are at most 2^CELL_BITS for each table."""
    sizes = {(r["table"], r.cell): max(1, -(-r.n // BLOCK)) for r in asked.groupBy("table", "cell").agg(F.sum("n").alias("n")).collect()}
    many = [(t, c, n) for (t, c), n in sizes.items() if n > 1]
    if not many:
        return asked, sizes
    n = F.coalesce("blocks", F.lit(1))
    rows = asked.join(F.broadcast(asked.sparkSession.createDataFrame(many, "table int, cell long, blocks int")), ["table", "cell"], "left")
    block = F.pmod(F.xxhash64("corners"), n).cast("int")
    rows = rows.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(asked.columns), sizes


#: A vote: the found image, and the poses (place, turn and scale) of the two corners.
VOTE = np.dtype([("found", "<i8"), ("q", "<i8"), ("d", "<i8")])
VOTES = "query long, share int, n int, votes binary"


def shares_of(images: int) -> int:
    """Shares that the found images are dealt to, so that the votes of a query for a share's images are no more than a task can hold."""
    return -(-max(1, images) // SHARE)


def in_votes(query: np.ndarray, votes: np.ndarray, shares: int) -> pa.RecordBatch:
    """A row for each query image and share of found images with its votes."""
    share = (mix(votes["found"].view(np.uint64)) % np.uint64(shares)).astype(np.int64)
    order = np.lexsort((share, query))
    query, share, votes = query[order], share[order], votes[order]
    starts = np.flatnonzero(np.concatenate([[True], (query[1:] != query[:-1]) | (share[1:] != share[:-1])])) if len(query) else np.zeros(0, int)
    blobs = [squeezed(votes[a:b]) for a, b in zip(starts, [*starts[1:], len(votes)], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(query[starts]), pa.array(share[starts], pa.int32()), pa.array(np.diff([*starts, len(votes)])[: len(starts)], pa.int32()), pa.array(blobs, pa.binary())], ["query", "share", "n", "votes"])


def met(rows: DataFrame, tables: int, shares: int) -> DataFrame:
    """Rows of VOTES: corners that meet in a cell and differ in at most NEAR bits, gathered by query image and share in each task."""
    asks, index = numbered(asking(tables)), numbered(CORNER)

    def pose(c: np.ndarray) -> np.ndarray:
        return (c["x"].astype(np.int64) << 40) | (c["y"].astype(np.int64) << 16) | (c["turn"].astype(np.int64) << 8) | c["scale"]

    def compared(block: tuple, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, q_bits, looked_up, owner = block
        d_bits = np.ascontiguousarray(d["bits"]).view("<u8")
        first, last = (np.searchsorted(looked_up, d["word"], side=s) for s in ("left", "right"))
        n = last - first
        ends, out = np.cumsum(n), []
        steps = [0, *(np.flatnonzero(np.diff(ends // STEP)) + 1), len(d)]
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            total = int(n[a:b].sum())
            whom = np.repeat(np.arange(a, b), n[a:b])
            who = owner[np.arange(total) + np.repeat(first[a:b] - (ends[a:b] - n[a:b] - (ends[a - 1] if a else 0)), n[a:b])]
            good = np.bitwise_count(q_bits[who] ^ d_bits[whom]).sum(1, dtype=np.int32) <= NEAR
            out.append((who[good], whom[good]))
        who, whom = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        votes = np.zeros(len(who), VOTE)
        votes["found"], votes["q"], votes["d"] = d["image"][whom], pose(q)[who], pose(d)[whom]
        return q["image"][who], votes

    def run(batches):
        now, waiting, block, passing, cast = None, [], None, [], []

        def flush():
            nonlocal cast
            query, votes = (np.concatenate([c[k] for c in cast]) for k in (0, 1))
            cast = []
            return in_votes(query, votes, shares)

        for batch in slices(batches, 1024):
            for key, is_held, n, blob in zip(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True), *(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
                if key != now:
                    if block and passing:
                        cast.append(compared(block, np.concatenate(passing)))
                    now, waiting, block, passing = key, [], None, []
                if is_held:
                    waiting.append(loosened(blob, n, asks))
                    continue
                if block is None:
                    if not waiting:
                        continue
                    q, waiting = np.concatenate(waiting), []
                    looked_up = probes(q["word"], q["doubt"][:, key[0]])
                    owner = np.repeat(np.arange(len(q)), looked_up.shape[1])
                    looked_up = looked_up.reshape(-1)
                    order = np.argsort(looked_up, kind="stable")
                    block = q, np.ascontiguousarray(q["bits"]).view("<u8"), looked_up[order], owner[order]
                passing.append(loosened(blob, n, index))
                if sum(map(len, passing)) >= 1 << 14:
                    cast.append(compared(block, np.concatenate(passing)))
                    passing = []
                    if sum(len(v) for _, v in cast) >= STEP:
                        yield flush()
        if block and passing:
            cast.append(compared(block, np.concatenate(passing)))
        if cast:
            yield flush()

    rows = rows.repartition("table", "cell", "block", "part").sortWithinPartitions("table", "cell", "block", "part", F.desc("held"))
    return mapped(rows, run, VOTES)


def agreeing(q: np.ndarray, q_image: np.ndarray, d: np.ndarray, d_image: np.ndarray, least: int = INLIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Images of q and d with `least` places or more that agree on scale, turn and shift, and how many; q and d: corners that match.

    Bins are of SHIFT in four grids half a bin apart: each bin is two by two cells."""
    scale = q["scale"].astype(np.int64) - d["scale"]
    turn = (q["turn"].astype(np.int64) - d["turn"]) % TURNS
    angle, grown = turn * (2 * np.pi / TURNS), 2.0**scale
    x, y = d["x"] * grown, d["y"] * grown
    cx = np.floor(2 * (q["x"] - (np.cos(angle) * x - np.sin(angle) * y)) / SHIFT).astype(np.int64)
    cy = np.floor(2 * (q["y"] - (np.sin(angle) * x + np.cos(angle) * y)) / SHIFT).astype(np.int64)
    columns = [q_image, d_image, scale, (turn + 1) // 3]
    votes = np.concatenate([np.stack([*columns, np.full(len(q), 2 * a + b), (cx + a) // 2, (cy + b) // 2, q["x"], q["y"]], 1) for a in (0, 1) for b in (0, 1)])
    order = np.lexsort(votes.T[::-1])
    votes = votes[order]
    votes = votes[np.concatenate([[True], (votes[1:] != votes[:-1]).any(1)])] if len(votes) else votes
    bins = votes[:, :7]
    begins = np.flatnonzero(np.concatenate([[True], (bins[1:] != bins[:-1]).any(1)])) if len(bins) else np.zeros(0, np.int64)
    n, images = np.diff([*begins, len(bins)]), bins[begins, :2]
    images, n = images[n >= least], n[n >= least]
    begins = np.flatnonzero(np.concatenate([[True], (images[1:] != images[:-1]).any(1)])) if len(images) else np.zeros(0, np.int64)
    return images[begins, 0], images[begins, 1], np.maximum.reduceat(n, begins) if len(n) else n


def candidates(votes: DataFrame) -> DataFrame:
    """query and found of images with CANDIDATE votes that agree; votes: rows of VOTES. A task holds the votes of a query for one share at a time."""

    def corners(pose: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pose), CORNER)
        out["x"], out["y"], out["turn"], out["scale"] = pose >> 40, pose >> 16 & 0xFFFFFF, pose >> 8 & 255, pose & 255
        return out

    def found(rows: list[tuple]) -> pa.RecordBatch:
        votes = np.concatenate([loosened(blob, n, VOTE) for _, _, n, blob in rows])
        query, q_at = np.unique(np.repeat([r[0] for r in rows], [r[2] for r in rows]), return_inverse=True)
        image, d_at = np.unique(votes["found"], return_inverse=True)
        a, b, _ = agreeing(corners(votes["q"]), q_at, corners(votes["d"]), d_at, CANDIDATE)
        return pa.RecordBatch.from_arrays([pa.array(query[a], pa.int64()), pa.array(image[b], pa.int64())], ["query", "found"])

    def run(batches):
        rows: list[tuple] = []
        for batch in slices(batches):
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if rows and row[:2] != rows[-1][:2] and sum(r[2] for r in rows) >= STEP:
                    yield found(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield found(rows)

    return mapped(votes.repartition("query", "share").sortWithinPartitions("query", "share"), run, "query long, found long")


def confirmed(pairs: DataFrame, asked: DataFrame, index: DataFrame, tables: int, queries: int, images: int) -> DataFrame:
    """query, found and inliers of the pairs whose corners, all compared, hold INLIERS matches that agree.

    Pairs are dealt to blocks of about TOGETHER query and TOGETHER found images; an image's corners go once to each block that has a pair of it."""

    def run(batches):
        now, sides = None, ({}, {})
        for batch in slices(batches):
            out = []
            for a, b, kind, query, found, corners in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (a, b) != now:
                    now, sides = (a, b), ({}, {})
                if kind < 2:
                    sides[kind][found if kind else query] = np.frombuffer(corners, CORNER if kind else asking(tables))
                    continue
                q, d = sides[0][query], sides[1][found]
                i, j = near_pairs(*(np.ascontiguousarray(c["bits"]).view("<u8") for c in (q, d)))
                zero = np.zeros(len(i), np.int64)
                n = agreeing(q[i], zero, d[j], zero)[2]
                if len(n):
                    out.append((query, found, int(n[0])))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["query", "found", "inliers"])

    def block(c: str, n: int):
        return F.pmod(F.xxhash64(c), F.lit(-(-max(1, n) // TOGETHER))).cast("int").alias(f"{c}_block")

    dealt = pairs.select("query", "found", block("query", queries), block("found", images))
    none, blocks = F.lit(None), ["query_block", "found_block"]
    left = dealt.select("query", *blocks).distinct().join(asked.select(F.col("id").alias("query"), "corners"), "query")
    right = dealt.select("found", *blocks).distinct().join(index.select(F.col("id").alias("found"), "corners"), "found")
    rows = left.select(*blocks, F.lit(0).alias("kind"), "query", none.cast("long").alias("found"), "corners")
    rows = rows.union(right.select(*blocks, F.lit(1), none.cast("long"), "found", "corners")).union(dealt.select(*blocks, F.lit(2), "query", "found", none.cast("binary")))
    return mapped(rows.repartition(*blocks).sortWithinPartitions(*blocks, "kind"), run, "query long, found long, inliers long")


def matches(queries: DataFrame, index: DataFrame, corners: int, again=None) -> DataFrame:
    """query, found, inliers: images of index that hold INLIERS consistent matches with a query image. Both hold images (id long, width, height, pixels); index has about so many corners.

    again gives the images of index whose id is in a table, if there is a cheaper way to them than to join the whole index."""
    size = word_size(corners)
    tables, cell_bits = tables_for(size), min(CELL_BITS, max(2, (int(corners) // CELL).bit_length()))
    asked = cut(descriptors(queries, tables, size), "asked")
    held_rows = cut(dealt_queries(asked, tables, size, cell_bits), "asked-cells")
    rows, blocks = blocked(held_rows)
    votes = met(rows.select(*[c.split()[0] for c in DEALT.split(", ")]).union(dealt_index(descriptors(index), size, cell_bits, blocks)), tables, shares_of(int(corners) // CORNERS))
    pairs = cut(candidates(votes), "candidates")
    dropped(held_rows)
    ids = pairs.select(F.col("found").alias("id")).distinct()
    return confirmed(pairs, asked, descriptors(again(ids) if again else index.join(ids, "id", "left_semi")), tables, asked.count(), int(corners) // CORNERS)


#: Rendering of vectors as images: a sum of plane waves, so that near vectors give near images.
SIDE = 96


@functools.cache
def waves(n: int, seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    angle, f, phase = r.uniform(0, np.pi, n), r.uniform(3, 14, n), r.uniform(0, 2 * np.pi, n)
    return np.cos(2 * np.pi * f[:, None, None] * (np.cos(angle)[:, None, None] * x + np.sin(angle)[:, None, None] * y) + phase[:, None, None]).reshape(n, -1).astype(np.float32)


def rendered(vectors: list[list[float] | None]) -> list[bytes | None]:
    out = []
    for v in vectors:
        v = None if not v or any(e is None for e in v) else np.array(v, np.float32)
        if v is None or not np.isfinite(v).all() or not v.any():
            out.append(None)
            continue
        z = v @ waves(len(v))
        out.append(np.clip(128 + 45 * z / max(float(z.std()), 1e-9), 0, 255).astype(np.uint8).tobytes())
    return out


def edited(pixels: bytes, key: int) -> tuple[int, int, bytes]:
    """A crop of three quarters of each side at a place that key decides, with brightness and contrast changed."""
    side, room = SIDE * 3 // 4, SIDE - SIDE * 3 // 4 + 1
    x, y = key % room, key // room % room
    a = np.frombuffer(pixels, np.uint8).reshape(SIDE, SIDE)[y : y + side, x : x + side].astype(np.float32)
    return side, side, np.clip(a * 0.85 + 14, 0, 255).astype(np.uint8).tobytes()


def images(vectors: DataFrame, edit: bool) -> DataFrame:
    """id, width, height, pixels of vectors (id, key, embedding), as they are or edited as key says."""

    def run(batches):
        for batch in slices(batches, 64):
            keys = batch.column(1).to_pylist()
            made = [(p and (edited(p, int(i[:12], 16)) if edit else (SIDE, SIDE, p))) or (None, None, None) for i, p in zip(keys, rendered(batch.column(2).to_pylist()), strict=True)]
            w, h, p = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(p, pa.binary())], ["id", "width", "height", "pixels"])

    return mapped(vectors.select("id", "key", "embedding"), run, "id long, width int, height int, pixels binary")


def search(vectors: DataFrame, is_query) -> DataFrame:
    """row_kind `member`: vec_id and rep_id (its class) for each row; `match`: a query class and a class in which the edited query was found, with inliers. vectors: vec_id, embedding."""
    content = F.coalesce(F.md5(F.to_json(F.struct("embedding")).cast("binary")), F.lit("0"))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", content.alias("key"))
    classes = rows.groupBy("key").agg(F.min("vec_id").alias("rep_id"), F.max(F.coalesce(is_query(F.col("vec_id")), F.lit(False))).alias("asked"), F.min("embedding").alias("embedding"))
    found = cut(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "contents")
    hits = matches(images(found.where("asked"), True), images(found, False), CORNERS * found.count(), lambda ids: images(found.join(ids, "id", "left_semi"), False))
    reps = found.select("id", "rep_id")
    pairs = hits.join(reps.select(F.col("id").alias("query"), F.col("rep_id").alias("vec_id")), "query").join(reps.select(F.col("id").alias("found"), "rep_id"), "found")
    members = rows.join(found.select("key", "rep_id"), "key").select(F.lit("member").alias("row_kind"), "vec_id", "rep_id", F.lit(None).cast("long").alias("inliers"))
    return members.union(pairs.select(F.lit("match"), "vec_id", "rep_id", "inliers"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)
