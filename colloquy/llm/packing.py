"""Packing of tokenized documents into fixed windows by Karmarkar-Karp multiway differencing.

Each task tokenizes the documents of its own splits; whole windows are cut off long documents at
once. What is left over of each document is cut into pieces of at most ``PIECE`` ids and gathers in a bounded group. A full group is
divided into k windows by differencing: partial partitions (lists of window contents) wait in a heap ordered by
their imbalance, and the two most imbalanced are merged with opposing orders, the fullest windows
of one with the emptiest of the other, until one partition is left. The windows come out nearly
equal. The window count k is the smallest whose capacity holds the group and rises by
one while a window exceeds capacity; the windows are emitted as they come out, each some ids short of capacity
(about one window of padding in a group of ``GROUP_WINDOWS``).

No shuffle and no state outside the task: tokens stay where they are made, and a lost task is
made anew with equal results, for sequence numbers are built from the partition's number.

Defined cases: a null text counts as empty and is the single end token; very long texts are packed whole; of equal imbalances the older partition
comes first; the special token's string in a text is its id, as in the tokenizer file; rows without an id and
repeated rows are packed like any other; the order of documents within windows follows the input; an
empty table gives no piece; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from colloquy.llm import common as C

CAPACITY = 2048
END = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
GROUP_WINDOWS = 128         #: left-over tokens of a group, in windows
PIECE = 256                 #: ids of a left-over piece at most
CACHED_PIECES = 200_000     #: bound on the words whose ids a worker keeps


class Encoder:
    """Ids of the byte-level BPE vocabulary, equal to those of the ``tokenizers`` file of the same name.

    A space before a non-space always begins a token, so a text is split there and each piece
    is looked up among the pieces met before (in natural text nearly all); the rest are encoded.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, all below 2**16."""
        parts = text.split(SPECIAL)
        out = [self.ordinary(parts[0])]
        for p in parts[1:]:
            out += [np.array([SPECIAL_ID], "<u2").tobytes(), self.ordinary(p)]
        return np.frombuffer(b"".join(out), "<u2")

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens, two bytes each."""
        known, ids = self.known, []
        for piece in pieces(text):
            got = known.get(piece)
            if got is None:
                got = np.array(self.model.encode_ordinary(piece), "<u2").tobytes()
                if len(known) >= CACHED_PIECES:
                    known.clear()
                if len(piece) <= 32:
                    known[piece] = got
            ids.append(got)
        return b"".join(ids)


def pieces(text: str) -> list[str]:
    """The text cut before every space that a non-space follows."""
    parts = text.split(" ")
    out = [parts[0]] if parts[0] else []
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        elif out:
            out[-1] += " " + p
        else:
            out.append(" " + p)
    return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Numbers of the items in each of k windows, by Karmarkar-Karp differencing.

    A partial partition keeps its non-empty windows only, sorted from the fullest. Its imbalance is the
    fullest less the emptiest window (0 while windows are empty).
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        merged = a
        if len(b) <= free:
            merged = a + b
        else:  # the fullest of b meet the emptiest of a; empty windows count as emptiest
            rest = b[free:] if free else b
            keep = b[:free]
            n = len(rest)
            merged = a[:len(a) - n] + keep + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - n:], reversed(rest), strict=True)]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, number, merged))
        number += 1
    windows = [w[1] for w in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the items in each window: near-equal windows by differencing, as few as hold every one within
    capacity (no item may be larger)."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [sorted(w) for w in windows if w]
        k += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """State of one task: left-over pieces and the rows that are ready."""

    def __init__(self, partition: int, capacity: int, with_ids: bool):
        self.capacity, self.with_ids = capacity, with_ids
        self.next_sequence = partition << 33
        self.left: list[tuple[int | None, int, np.ndarray, int]] = []
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self.emit([(doc_id, at, ids[at:at + self.capacity], len(ids))])
        step = min(PIECE, self.capacity)
        for at in range(whole, len(ids), step):
            self.left.append((doc_id, at, ids[at:at + step], len(ids)))
        self.waiting += len(ids) - whole
        if self.waiting >= GROUP_WINDOWS * self.capacity:
            self.flush()

    def flush(self) -> None:
        """Packs the group. Pieces that follow one another in a document and in a window become one."""
        items, self.left, self.waiting = self.left, [], 0
        for window in windows_of([len(x[2]) for x in items], self.capacity) if items else []:
            contents: list[tuple] = []
            last = -2
            for i in window:
                doc_id, start, ids, total = items[i]
                if i == last + 1 and start and items[last][1] + len(items[last][2]) == start and items[last][0] == doc_id:
                    _, begun, before, _ = contents[-1]
                    contents[-1] = (doc_id, begun, np.concatenate([before, ids]), total)
                else:
                    contents.append(items[i])
                last = i
            self.emit(contents)

    def emit(self, contents: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in contents:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, offset, *([ids] if self.with_ids else [])))
            offset += len(ids)
        self.next_sequence += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
        if self.with_ids:
            columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=_NAMES + ["ids"] * self.with_ids)


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence (with its ids on demand)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(), Packer(TaskContext.get().partitionId(), capacity, with_ids)
        for b in batches:
            for s in C.slices(b):
                for doc_id, text in zip(s.column("doc_id").to_pylist(), s.column("text"), strict=True):
                    packer.add(doc_id, np.append(encoder.encode(text.as_py() or ""), END).astype("<u4"))
                if len(packer.rows) >= 4096:
                    yield packer.batch()
        packer.flush()
        yield packer.batch()

    schema = SCHEMA + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
