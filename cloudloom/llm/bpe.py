"""Byte-level BPE: a heap of merge ranks over a doubly linked list of symbols, and decoding by joining vocabulary strings.

Texts are cut into chunks at white space, where no token of the splitting pattern can cross, and chunks into words; the ids of
a word are found once and kept in a dictionary of bounded size. A null text counts as empty: no ids, an empty decoded text.
A text of any length is encoded whole. Of equal ranks the leftmost pair is merged first. Rows are independent; repeated rows give
repeated results, and an empty table none. Only the columns named are read, whatever other columns there are.
Special tokens that stand in a text become their ids, as the library does unless it is told otherwise.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cloudloom.llm.common import held, mapped, slices, table

#: Unicode's White_Space characters, and the splitting pattern of the vocabulary.
SPACE = "\t-\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Words, and chunks, that a Python worker keeps in each of two dictionaries.
KEPT = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Encoder and decoder for a vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(alphabet[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.decimal = [f"{i}," for i in range(size)]
        self.words = regex.compile(WORDS)
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.of_word: dict[str, list[int]] = {}
        self.older_words: dict[str, list[int]] = {}
        self.of_chunk: dict[str, tuple[str, bytes, int]] = {}
        self.older_chunks: dict[str, tuple[str, bytes, int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one word. A queue entry is a rank and, in the low bits, the place of the left symbol; it is stale once either symbol is gone or the pair there has another rank."""
        of_byte, rank, made = self.of_byte, self.rank, self.made
        ids = [of_byte[b] for b in data]
        n, i = len(ids), 0
        bits = n.bit_length()
        mask, queue = (1 << bits) - 1, []
        for pair in zip(ids, ids[1:], strict=False):
            if pair in rank:
                queue.append(rank[pair] << bits | i)
            i += 1
        if not queue:
            return ids
        queue.sort()
        ids.append(-1)  # the end, which no pair has
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        while queue:
            entry = heappop(queue)
            i = entry & mask
            j = after[i]
            pair = ids[i], ids[j]
            if pair not in rank or rank[pair] != entry >> bits:
                continue
            ids[i] = new = made[entry >> bits]
            ids[j] = -2
            after[i] = j = after[j]
            before[j] = i
            pair = new, ids[j]
            if pair in rank:
                heappush(queue, rank[pair] << bits | i)
            j = before[i]
            if j >= 0:
                pair = ids[j], new
                if pair in rank:
                    heappush(queue, rank[pair] << bits | j)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> list[int]:
        ids = self.of_word.get(word)
        if ids is None:
            ids = self.older_words.get(word) or self.merge(word.encode())
            if len(self.of_word) >= KEPT:
                self.of_word, self.older_words = {}, self.of_word
            self.of_word[word] = ids
        return ids

    def ids(self, chunk: str) -> list[int]:
        """Most chunks are a word, or one with a mark after it; the pattern needs not be asked then."""
        if (letters := chunk[chunk[0] == " " :]).isalpha():
            return self.word(chunk)
        if letters[:-1].isalpha() and letters[-1] in ",.;:!?":
            return self.word(chunk[:-1]) + self.word(letters[-1])
        return [i for word in self.words.findall(chunk) for i in self.word(word)]

    def chunk(self, chunk: str) -> tuple[str, bytes, int]:
        """Of a chunk: its ids in decimal with a comma after each, the vocabulary strings of its ids joined, how many they are. A full dictionary becomes the older one, from which what is still used comes back."""
        made = self.older_chunks.get(chunk)
        if made is None:
            ids = self.ids(chunk)
            made = "".join([self.decimal[i] for i in ids]), b"".join([self.strings[i] for i in ids]), len(ids)
        if len(self.of_chunk) >= KEPT:
            self.of_chunk, self.older_chunks = {}, self.of_chunk
        self.of_chunk[chunk] = made
        return made

    def chunks(self, text: str) -> list[tuple[str, bytes, int]]:
        known, chunk = self.of_chunk.get, self.chunk
        return [known(c) or chunk(c) for c in CHUNKS.findall(text)]

    def parts_of(self, text: str) -> list[tuple[str, bytes, int]]:
        if self.parts is None or "<" not in text:
            return self.chunks(text)
        return [x for p in self.parts.split(text) for x in ([(self.decimal[self.special[p]], p.encode(), 1)] if p in self.special else self.chunks(p))]

    def both(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal joined by commas, decoded text."""
        parts = self.parts_of(text)
        return sum([x[2] for x in parts]), "".join([x[0] for x in parts])[:-1], b"".join([x[1] for x in parts]).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.parts_of(text) for i in x[0].split(",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> ByteBPE:
    """One for each Python worker; later tasks find its dictionaries filled."""
    return held(f"byte bpe {path}", lambda: ByteBPE(path))


def encoded(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, then ids (array of int) and decoded. One row for each row of df; no shuffle."""
    picked = df.select(*keep, text)

    def run(batches):
        bpe = encoder(path)
        for batch in slices(batches):
            ids = [bpe.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], [*keep, "ids", "decoded"])

    kept = [f"{c} {t}" for c, t in picked.dtypes[: len(keep)]]
    return mapped(picked, run, ", ".join([*kept, "ids array<int>", "decoded string"]))


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; the ids stay in the Python worker."""

    def run(batches):
        bpe = encoder(path)
        for batch in slices(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                n, ids, decoded = bpe.both(t or "")
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(df.select("doc_id", text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
