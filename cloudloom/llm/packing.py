"""Cost-balanced packing of token ids into sequences of bounded length.

A document costs LINEAR for each token and QUADRATIC for each pair of tokens (attention). Documents are packed in groups of
GROUP tokens as they are read, so nothing is shuffled and a task holds one group. In a group, whole sequences are cut from long
documents; what is left goes, in descending order of cost, to the sequence of the lowest cost of all that have token capacity for
it, and is cut only where no sequence has. Tokens beyond the last full sequence wait for the next group; those of a task's last
group fill sequences whose lengths are powers of two, which need no padding. sequence_id holds the task's partition above bit 32.

A null text counts as empty: its end token alone. Of equal costs the document read first goes first, to the sequence of the
smallest number. Rows that repeat a doc_id are documents each. A text of any length is cut over sequences whole. An empty table
gives no rows. Other columns than doc_id and the text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cloudloom.llm.common import held, mapped, slices, table

LENGTH, GROUP, KEPT_CHUNKS = 2048, 4_000_000, 250_000
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Up to here lower case is the same for Python and the tokenizer, which lower-cases, so words of either case are asked for once.
LATIN = "\u024f"
#: Marks that may follow a word in a chunk; together they are one token of the splitting pattern.
MARKS = ".,;:!?*#$%&|-+)]}\""


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Sequences:
    """Sequences by the room left in them: a heap for each room, and a tree over the rooms with the cheapest sequence of each half."""

    def __init__(self, count: int, length: int):
        self.length, self.size, self.none = length, 1 << length.bit_length(), (float("inf"), -1, 0)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        self.tree = [self.none] * (2 * self.size)
        if count:
            self.heaps[length] = [(0.0, b) for b in range(count)]
            self._up(length)

    def _up(self, room: int) -> None:
        at, heap, tree = room + self.size, self.heaps[room], self.tree
        tree[at] = (*heap[0], room) if heap else self.none
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def put(self, spent: float, number: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (spent, number))
            self._up(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """The cheapest sequence, the first of equal ones, with so much room; it is taken out."""
        low, high, best = room + self.size, self.length + 1 + self.size, self.none
        while low < high:
            if low & 1:
                best, low = min(best, self.tree[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, self.tree[high])
            low, high = low >> 1, high >> 1
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._up(best[2])
        return best


def pack(lengths: list[int], length: int = LENGTH, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), and the pieces that wait for the next group (none if it is the last)."""
    full, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % length
        full += [[(doc, at, length)] for at in range(0, whole, length)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    rest.sort(key=lambda p: (-cost(p[2]), p[0], p[1]))
    bins, left = divmod(sum(p[2] for p in rest), length)
    wait: list[tuple[int, int, int]] = []
    while left:  # the cheapest pieces wait
        doc, at, n = rest.pop()
        cut = min(n, left)
        wait.append((doc, at + n - cut, cut))
        left -= cut
        if n > cut:
            rest.append((doc, at, n - cut))
    rest.sort(key=lambda p: (-cost(p[2]), p[0], p[1]))
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    open_ = Sequences(bins, length)
    for doc, at, n in rest:
        while n:  # cut only where no sequence has room for the whole
            spent, b, room = open_.take(n) or open_.take(1)
            part = min(n, room)
            held[b].append((doc, at, part))
            open_.put(spent + cost(part), b, room - part)
            at, n = at + part, n - part
    if last and wait:
        todo, size = wait[::-1], 1 << (sum(p[2] for p in wait).bit_length() - 1)
        while todo:
            total = sum(p[2] for p in todo)
            size, seq = 1 << (total.bit_length() - 1), []
            while size:
                doc, at, n = todo.pop()
                cut = min(n, size)
                seq.append((doc, at, cut))
                size -= cut
                if n > cut:
                    todo.append((doc, at + cut, n - cut))
            held.append(seq)
        wait = []
    return full + held, wait


class WordIds:
    """Ids of texts by the tokenizers library; the ids of a chunk between white space are asked for once and kept.

    Words of letters only are asked for together, as one text: each ends in an id whose vocabulary string has the word-end mark.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.known = np.uint32(end).tobytes(), {}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def by_library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Fills the dictionary with chunks. A full one becomes the older one, from which what is still used comes back."""
        lacking = chunks.difference(self.known)
        if len(self.known) + len(lacking) > KEPT_CHUNKS and self.known:
            self.known, self.older, lacking = {}, self.known, chunks
        known, older, words, marked = self.known, self.older, {}, []
        for c in lacking:
            if c in older:
                known[c] = older[c]
                continue
            stem = c.rstrip(MARKS)
            word = stem.lower()
            if not word.isalpha():
                known[c] = self.by_library(c)
                continue
            if not stem.isascii() and max(stem) > LATIN:
                word = stem
            if word != c:
                marked.append((c, word, c[len(stem) :]))
            if word not in known:
                words[word] = None
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words):
                data, at = ids.tobytes(), 0
                for w, cut in zip(words, (4 * cuts).tolist(), strict=True):
                    known[w] = data[at:cut]
                    at = cut
            else:
                for w in words:
                    known[w] = self.by_library(w)
        for c, word, marks in marked:
            if marks:
                tail = known.get(marks)
                if tail is None:
                    tail = known[marks] = self.by_library(marks)
                known[c] = known[word] + tail
            else:
                known[c] = known[word]

    def odd(self, text: str) -> bool:
        """Whether white space is not what str.split takes for it, or a special token may be there."""
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")

    def many(self, texts: list[str]) -> list[bytes]:
        split = [None if self.odd(t) else t.split() for t in texts]
        self.learn(set().union(*[c for c in split if c]))
        get = self.known.__getitem__
        return [(self.by_library(t) if c is None else b"".join(map(get, c))) + self.end for t, c in zip(texts, split, strict=True)]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


def word_ids(path: str, end: int) -> WordIds:
    """One for each Python worker; later tasks find its dictionary filled."""
    return held(f"word ids {path} {end}", lambda: WordIds(path, end))


def packed(df: DataFrame, path: str, end: int = 1, length: int = LENGTH, text: str = "text", group: int = GROUP) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Rows of one doc_id count as documents each."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches):
        words, made = word_ids(path, end), TaskContext.get().partitionId() << 32
        docs: list[tuple] = []  # doc_id, start of what is here, tokens of the document, ids

        def flush(last: bool):
            nonlocal docs, made
            sequences, wait = pack([len(d[3]) // 4 for d in docs], length, last)
            columns: list[list] = [[] for _ in fields]
            for seq in sequences:
                offset = 0
                for k, at, n in seq:
                    doc, start, tokens, ids = docs[k]
                    row = (doc, start + at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), tokens, made, offset)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    offset += n
                made += 1
            docs = [(docs[k][0], docs[k][1] + at, docs[k][2], docs[k][3][4 * at : 4 * (at + n)]) for k, at, n in wait]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])

        waiting = 0
        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), words.many([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                docs.append((doc, 0, len(ids) // 4, ids))
                waiting += len(ids) // 4
                if waiting >= group:
                    yield flush(False)
                    waiting = sum(len(d[3]) for d in docs) // 4
        if docs:
            yield flush(True)

    return mapped(df.select("doc_id", text), run, ", ".join(f"{f} long" for f, _ in fields))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
