"""Alignment of two tokenizers, with corpus-wide counts of linked id pairs.

Both tokenizations cut the same bytes (a blank and the text). Byte offsets where tokens of both end cut them
into groups; the last tokens of a group, whose byte ranges end together, are a link. An id pair's count is its number of links in the whole corpus.

Of two linked tokens the shorter one's bytes end the longer one's. So the pairs that can occur are those of the
vocabularies where one token's bytes are a suffix of the other's: some hundred thousand (``pair_bound``), however
large the corpus. Everything below that is gathered or sent to the workers holds one entry a distinct pair
and is bounded by that number.

First pass: tasks align their documents and count pairs; the partial counts are written once. The distinct
pairs get a minimal perfect hash: levels of bit arrays, each taking the keys that meet no other one in it, and
a key's number is its bit's rank over all levels. Every task's partial counts become dense vectors indexed by
that hash, cut in blocks, and the blocks are added up in a tree of ``FAN_IN`` by Spark. Second pass: tasks align
the documents again and look up each link's count by its hash, where the stored key must be the
link's own.

No token of either vocabulary has a blank after another character, so both tokenizations are cut before every blank that follows a
non-blank. Pieces between such cuts are aligned apart, which changes nothing; within a slice of ``SLICE_BYTES`` each distinct piece once.

Defined cases: null and empty texts, and texts whose joined bytes differ from those of blank and text (with U+2581, which reads
as a blank), have no tokens: zeros and an empty digest; very long texts are aligned piece by piece, whole; of several A ids tied for a B id's highest
count each one is best; rows without an id and repeated rows count and are returned like any other; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import common as C

VOCABULARY_A = "byte_bpe_50k.tiktoken"  #: the ranks of byte_bpe_50k.json: equal ids, special tokens' strings as plain text
VOCABULARY_B = "piece_bpe_32k.model"
B_BITS = 15                 #: bits of a B id in a pair's number
SPELLED_B = 1 << 16         #: ids of either vocabulary are below
SLICE_BYTES = 1 << 22       #: texts whose distinct pieces are aligned at once
BLOCK = 1 << 13             #: counters of a block
FAN_IN = 16
_MARK = "▁"


class Aligner:
    """Both tokenizers and the pieces met before."""

    def __init__(self):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(VOCABULARY_A), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding(VOCABULARY_A, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY_B))
        self.bytes_a = [b""] * len(ranks)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in known]) for known in (self.bytes_a, self.bytes_b))
        self.spelled = [f"{i}{sep}" for sep in ",|,;" for i in range(SPELLED_B)]

    def _bytes_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode()

    def align(self, pieces: list[str]) -> Aligned:
        """Aligns pieces that begin with their blank."""
        ids_a = [self.a.encode_ordinary(p) for p in pieces]
        ids_b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        whole = [p.encode() for p in pieces]
        good = np.ones(len(pieces), bool)
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join(map(known.__getitem__, chain.from_iterable(ids))) != b"".join(whole):
                good &= [b"".join(map(known.__getitem__, i)) == w for i, w in zip(ids, whole, strict=True)]
        if not good.all():
            ids_a, ids_b = ([i if g else [] for i, g in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(pieces)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        last_a = np.flatnonzero(np.isin(end_a, end_b, assume_unique=True))
        last_b = np.flatnonzero(np.isin(end_b, end_a, assume_unique=True))
        groups = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)]))
        # every group's A tokens stand before its B tokens; the last one of each side has another separator
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        group_a = np.searchsorted(last_a, at_a)
        shift = np.concatenate([[0], last_b + 1])
        code = np.zeros(len(a) + len(b), np.int64)
        code[at_a + shift[group_a]] = a
        code[last_a + shift[group_a[last_a]]] += SPELLED_B
        group_b = np.searchsorted(last_b, at_b)
        place_b = at_b + last_a[group_b] + 1
        code[place_b] = b + 2 * SPELLED_B
        code[place_b[last_b]] += SPELLED_B
        return Aligned(good, n_a, n_b, groups, a[last_a] << B_BITS | b[last_b], code, np.concatenate([[0], np.cumsum(n_a + n_b)]))


@dataclass
class Aligned:
    """Pieces aligned: whether their bytes agree, their tokens, the bounds of their links, the linked pairs, and their tokens in
    the order of the groups (as numbers of ``Aligner.spelled``) with bounds."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    links: np.ndarray
    pairs: np.ndarray
    code: np.ndarray
    codes: np.ndarray

    def groups(self, spelled: list[str]) -> list[str]:
        """Groups of each piece, each with a semicolon after it."""
        words, bounds = list(map(spelled.__getitem__, self.code.tolist())), self.codes.tolist()
        return ["".join(words[x:y]) for x, y in zip(bounds, bounds[1:])]


def pieces(text: str) -> list[str]:
    """Blank and text, cut before every blank that follows a non-blank and isn't the last character."""
    parts = text.split(" ")
    out = [" " + parts[0]]
    last = len(parts) - 1
    for i, p in enumerate(parts[1:], 1):
        before = parts[i - 1]
        if before and not before[-1].isspace() and (p or i < last):
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


def pair_bound(aligner: Aligner) -> int:
    """Number of pairs (A id, B id) of which one's bytes end with the other's: more can't be linked."""

    def suffixes(long: list[bytes], short: Counter, proper: int) -> int:
        return sum(short[x[i:]] for x in long for i in range(proper, len(x)))

    return suffixes(aligner.bytes_a, Counter(aligner.bytes_b), 0) + suffixes(aligner.bytes_b, Counter(aligner.bytes_a), 1)


# --- minimal perfect hash --------------------------------------------------------------------
@dataclass
class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys. Level by level a key takes the bit that its hash names, if no
    other key of the level wants it; the rest goes on to the next level."""

    bits: list[np.ndarray]
    ranks: list[np.ndarray]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (C.mix(keys.astype(np.uint64) + C.U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % C.U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, ranks, number, level = [], [], 0, 0
        while len(keys):
            size = max(64, 2 * len(keys))
            at = cls.place(keys, level, size)
            single = np.bincount(at, minlength=size) == 1
            bits.append(single)
            ranks.append((number + np.cumsum(single) - single).astype(np.int32))
            number += int(single.sum())
            keys = keys[~single[at]]
            level += 1
        return cls(bits, ranks)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; any number, or -1, for other values."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = self.place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


@dataclass
class PairCounts:
    """Hash, the key of every number (to verify), its count, and whether that is its B id's highest."""

    hash: PerfectHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    @classmethod
    def of(cls, hash: PerfectHash, keys: np.ndarray, counts: np.ndarray) -> PairCounts:
        b = keys & ((1 << B_BITS) - 1)
        highest = np.zeros(1 << B_BITS, np.int64)
        np.maximum.at(highest, b, counts)
        return cls(hash, keys, counts, counts == highest[b])

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair and whether it is best; 0 for a pair that isn't known."""
        if not len(self.keys):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = self.hash(pairs)
        known = (at >= 0) & (self.keys[at] == pairs)
        return np.where(known, self.counts[at], 0), known & self.best[at]


# --- passes over the documents ---------------------------------------------------------------
#: Texts in which a blank doesn't end a piece everywhere: after white space, at the beginning or at the end.
_UNEVEN = r"^ | $|[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def distinct_pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of a slice, the numbers of each text's pieces end to end, and the texts' bounds."""
    uneven = pc.fill_null(pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, _UNEVEN)), False)
    parts = pc.split_pattern(texts, " ")
    if pc.any(uneven).as_py():
        cut = [None if not t else [p[1:] for p in pieces(t)] if u else p
               for t, u, p in zip(texts.to_pylist(), uneven.to_pylist(), parts.to_pylist(), strict=True)]
        parts = pa.array(cut, pa.list_(pa.string()))
    flat = parts.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
    return [" " + p for p in flat.dictionary.to_pylist()], flat.indices.to_numpy(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def per_text(values: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum over each text of its pieces' values."""
    return np.diff(np.concatenate([[0], np.cumsum(values[number])])[bounds])


def count_pairs(docs: DataFrame) -> DataFrame:
    """Partial counts of linked pairs: one row a task and pair (``pair``, ``n``, ``task``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pair, n = Aligner(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for s in C.slices(b, limit=SLICE_BYTES):
                distinct, number, bounds = distinct_pieces(s.column("text"))
                got = aligner.align(distinct)
                whole = per_text(~got.good, number, bounds) == 0  # else the bytes differ and the text has no tokens
                times = np.bincount(number[np.repeat(whole, np.diff(bounds))], minlength=len(distinct))
                pair, at = np.unique(np.concatenate([pair, got.pairs]), return_inverse=True)
                # bincount adds in double precision, exact below 2**53
                n = np.bincount(at, np.concatenate([n, np.repeat(times, np.diff(got.links))]), len(pair)).astype(np.int64)
        pair, n = pair[n > 0], n[n > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair, pa.int32()), pa.array(n), pa.array(np.full(len(pair), TaskContext.get().partitionId(), np.int32))], names=["pair", "n", "task"])

    return docs.select("text").mapInArrow(run, "pair int, n long, task int")


def tree_sum(vectors: DataFrame, tasks: int) -> DataFrame:
    """Adds up blocks of dense vectors (``block``, ``task``, ``counts``): at most ``FAN_IN`` of a block meet in a step."""

    def add(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]
        first = table.slice(0, 1)
        return first.set_column(2, "counts", pa.array([np.sum(rows, axis=0).tobytes()], pa.binary()))

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        vectors = (vectors.withColumn("task", (F.col("task") / FAN_IN).cast("int"))
                   .groupBy("block", "task").applyInArrow(add, "block int, task int, counts binary"))
    return vectors


def count_all(docs: DataFrame) -> PairCounts:
    """First pass: the distinct pairs, their hash, and the summed dense vectors."""
    partial = C.stored(count_pairs(docs), "token-pairs")
    most = pair_bound(Aligner())
    keys = np.sort(partial.select("pair").distinct().limit(most + 1).toArrow().column("pair").to_numpy())
    if len(keys) > most:
        raise ValueError(f"more than {most} linked pairs: the vocabularies are not those of the bound")
    hash, n = PerfectHash.build(keys), len(keys)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: dict[int, np.ndarray] = {}
        for b in batches:
            task, at = b.column("task").to_numpy(), hash(b.column("pair").to_numpy())
            for t in np.unique(task):
                v = vectors.setdefault(int(t), np.zeros(-(-n // BLOCK) * BLOCK, np.int64))
                v[at[task == t]] += b.column("n").to_numpy()[task == t]
        total = sum(vectors.values()) if vectors else np.zeros(0, np.int64)
        blocks = [i for i in range(len(total) // BLOCK) if total[i * BLOCK:(i + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()),
             pa.array([total[i * BLOCK:(i + 1) * BLOCK].tobytes() for i in blocks], pa.binary())], names=["block", "task", "counts"])

    vectors = C.stored(partial.mapInArrow(dense, "block int, task int, counts binary"), "token-pair-vectors")
    tasks = (vectors.agg(F.max("task").alias("t")).first()["t"] or 0) + 1
    counts, key_of = np.zeros(-(-n // BLOCK) * BLOCK, np.int64), np.zeros(n, np.int64)
    for row in tree_sum(vectors, tasks).select("block", "counts").toArrow().to_pylist():
        counts[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    key_of[hash(keys)] = keys
    return PairCounts.of(hash, key_of, counts[:n])


SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def look_up(docs: DataFrame, counted: PairCounts) -> DataFrame:
    """Second pass: each document aligned again, its links' counts looked up. No shuffle."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(counted)  # one entry a pair: bounded by the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = Aligner(), shared.value
        for b in batches:
            for s in C.slices(b, limit=SLICE_BYTES):
                distinct, number, bounds = distinct_pieces(s.column("text"))
                got = aligner.align(distinct)
                n, best = counts.look_up(got.pairs)
                sums, bests = (np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[got.links]) for x in (n, best))
                whole = (per_text(~got.good, number, bounds) == 0) & (np.diff(bounds) > 0)
                links = np.diff(got.links)
                columns = [np.where(whole, per_text(x, number, bounds), 0) for x in (got.n_a, got.n_b, links, links, bests, sums)]
                spelled, at, ends = got.groups(aligner.spelled), number.tolist(), bounds.tolist()
                digests = [hashlib.sha256("".join([spelled[p] for p in at[x:y]])[:-1].encode()).hexdigest() if w else ""
                           for x, y, w in zip(ends, ends[1:], whole.tolist())]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *map(pa.array, columns), pa.array(digests, pa.string())], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def align_tokens(docs: DataFrame) -> DataFrame:
    """Groups, links and corpus-wide link counts of every document."""
    return look_up(docs, count_all(docs))
