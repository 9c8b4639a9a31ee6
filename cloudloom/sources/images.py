"""Lossless images: WebP (VP8L with literal codes only) and PNG, both with their readers for tests."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

#: Fixed order in which VP8L stores the lengths of the code of code lengths.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LONGEST = 15


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman lengths of at most LONGEST bits; rare symbols count for more until the code is short enough."""
    out = np.zeros(len(counts), int)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
        return out
    floor = 1
    while True:
        queue = [(max(int(counts[s]), floor), int(s), (int(s),)) for s in used]
        heapq.heapify(queue)
        out[:] = 0
        while len(queue) > 1:
            a, b = heapq.heappop(queue), heapq.heappop(queue)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(queue, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if out.max() <= LONGEST:
            return out
        floor *= 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes with their bits reversed, as they are written from the lowest bit on."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        codes[s], last = int(f"{code:0{n}b}"[::-1], 2), n
        code += 1
    return codes


class Bits:
    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(np.array([value >> k & 1 for k in range(n)], np.uint8))

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        k = np.arange(int(sizes.max(initial=0)))
        bits = (values[:, None] >> k) & 1
        self.parts.append(bits[k < sizes[:, None]].astype(np.uint8))

    def data(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _put_code(out: Bits, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for the counted symbols; returns codes and lengths (0 bits for a lone symbol)."""
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        symbol = int(used[0]) if len(used) else 0
        if symbol < 256:
            out.put(1, 1)
            out.put(0, 1)
            out.put(1, 1)
            out.put(symbol, 8)
            return np.zeros(len(counts), np.int64), np.zeros(len(counts), int)
    lengths = code_lengths(counts)
    meta = np.bincount(lengths, minlength=19)
    if (meta > 0).sum() == 1:
        meta[0 if meta[0] == 0 else 1] = 1
    inner = code_lengths(meta)
    while inner.max() > 7:
        meta = np.where(meta > 0, meta // 2 + 1, 0)
        inner = code_lengths(meta)
    codes = canonical(inner)
    n = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if inner[s]))
    out.put(0, 1)
    out.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        out.put(int(inner[s]), 3)
    out.put(0, 1)
    out.put_many(codes[lengths], inner[lengths])
    return canonical(lengths), lengths


def webp(rgba: np.ndarray) -> bytes:
    """rgba: height, width, 4 bytes. No transform, no colour cache, one group of codes."""
    h, w, _ = rgba.shape
    if not 0 < w <= 16384 or not 0 < h <= 16384:
        raise ValueError(f"a WebP image cannot have {w} x {h} pixels")
    out, flat = Bits(), rgba.reshape(-1, 4).astype(np.int64)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group of codes
    channels = [flat[:, k] for k in (1, 0, 2, 3)]
    tables = [_put_code(out, np.bincount(c, minlength=size)) for c, size in zip(channels, (280, 256, 256, 256), strict=True)]
    _put_code(out, np.zeros(40, int))
    values = np.stack([t[0][c] for c, t in zip(channels, tables, strict=True)], 1).ravel()
    sizes = np.stack([t[1][c] for c, t in zip(channels, tables, strict=True)], 1).ravel()
    for at in range(0, len(values), 1 << 18):
        out.put_many(values[at : at + (1 << 18)], sizes[at : at + (1 << 18)])
    body = b"\x2f" + out.data()
    pad = b"\0" * (len(body) % 2)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def read_webp(data: bytes) -> np.ndarray:
    """Pixels of an image as `webp` writes it."""
    size = struct.unpack("<I", data[16:20])[0]
    bits = np.unpackbits(np.frombuffer(data[21 : 20 + size], np.uint8), bitorder="little").tolist()
    at = 0

    def get(n):
        nonlocal at
        v = sum(b << k for k, b in enumerate(bits[at : at + n]))
        at += n
        return v

    def tree(lengths):
        return {(n, int(c)): s for s, (n, c) in enumerate(zip(lengths, canonical(np.array(lengths)), strict=True)) if n}

    def symbol(t):
        code = n = 0
        while (n, code) not in t:
            code |= get(1) << n
            n += 1
        return t[n, code]

    def code(size):
        if get(1):
            two, wide = get(1), get(1)
            some = [get(8 if wide else 1), *([get(8)] if two else [])]
            return {(0, 0): some[0]} if not two else {(1, 0): some[0], (1, 1): some[1]}
        inner = [0] * 19
        for k in range(get(4) + 4):
            inner[LENGTH_ORDER[k]] = get(3)
        if get(1):
            raise ValueError("not written by this module")
        t = tree(inner)
        return tree([symbol(t) for _ in range(size)])

    w, h = get(14) + 1, get(14) + 1
    if get(1) != 1 or get(3) or get(3):
        raise ValueError("not written by this module")
    trees = [code(s) for s in (280, 256, 256, 256, 40)]
    out = np.zeros((h * w, 4), np.uint8)
    for k in range(h * w):
        g, r, b, a = (symbol(t) for t in trees[:4])
        out[k] = r, g, b, a
    return out.reshape(h, w, 4)


def png(rgba: np.ndarray) -> bytes:
    h, w, _ = rgba.shape
    if not h or not w:
        raise ValueError("an image needs pixels")
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    w, h = struct.unpack(">II", data[16:24])
    n = struct.unpack(">I", data[33:37])[0]
    return np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)
