"""Periodic runs of words, found by internal pattern matching.

The words of a bounded slice of documents form one sequence of numbers, with a number of its own after
each document, so nothing repeats over a document's border. Prefix doubling gives the suffix array
and, for every power of two m, the rank of the m words from each position on: equal ranks are equal blocks, and
the suffixes that begin with a block are an interval of the suffix array that begins at the block's rank.

A dyadic block is the m words from a multiple of m on. For each one, the nearest occurrence after it and
the nearest before it are range successor and predecessor queries over its interval, answered by a
wavelet matrix of the suffix array for all blocks of a level at once. Occurrences of a block in the windows
beside it, m words to each side, are arithmetic progressions, so the nearest one gives the difference: a
candidate period. A run of smallest period q and at least 4q words holds, for the m in [q, 2q) (2 for q = 1), a whole dyadic
block whose root is primitive and which recurs q words further on or q words before inside the run, and nowhere
nearer. So every run is among the candidates. Each candidate is
extended to both sides by binary descent over the ranks, kept if it is long enough, and of equal stretches the one of
the smallest period stays.

Everything happens where the rows are read: no shuffle, memory in proportion to a slice, or to the longest text
if that is longer (about 12 bytes a word and level).

Defined cases: a null or empty text has no words and no runs (the digests are those of the empty string);
very long texts are one slice each, whole; a row without an id is left as it is (its words don't repeat by the
id's number); repeated rows get a row each; ties go to the smallest start, then the smallest period; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm import common as C

LEAST_WORDS = 6             #: a run has so many words at least
LEAST_PERIODS = 4           #: and so many periods
SLICE_BYTES = 1 << 19


# --- suffix array and wavelet matrix ---------------------------------------------------------
def prefix_ranks(seq: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order by the first 2**k symbols, and for each k the ranks of all positions.

    A rank is the place of the block's first suffix in the order. ``most``: longest block wanted. Levels
    end early when all blocks differ; the last symbol of ``seq`` has to be unique.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable").astype(np.int32)
    heads = np.concatenate([[True], seq[order[1:]] != seq[order[:-1]]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels, m = [rank], 1
    while 2 * m <= most:
        size = np.diff(np.append(np.flatnonzero(heads), n))
        open_at = np.flatnonzero(np.repeat(size > 1, size))  # places of the order whose block isn't alone
        if not len(open_at):
            break
        pos = order[open_at]
        after = np.where(pos + m < n, rank[np.minimum(pos + m, n - 1)].astype(np.int64) + 1, 0)
        key = rank[pos].astype(np.int64) * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order = order.copy()
        order[open_at] = pos[by]
        key = key[by]
        heads = heads.copy()
        heads[open_at[1:]] |= key[1:] != key[:-1]
        rank = rank.copy()
        rank[order[open_at]] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))[open_at]
        levels.append(rank)
        m *= 2
    return order, levels


class WaveletMatrix:
    """Values of an array by bits, from the highest; counts and the r-th smallest in a range in one step a bit."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros_before, self.zeros = [], []
        v = values
        for b in range(self.bits - 1, -1, -1):
            zero = (v >> b) & 1 == 0
            before = np.zeros(len(v) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros_before.append(before)
            self.zeros.append(int(before[-1]))
            v = np.concatenate([v[zero], v[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Number of values under ``limit`` in each range of places."""
        found = np.zeros(len(lo), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            z = self.zeros_before[level]
            l0, h0 = z[lo], z[hi]
            one = (limit >> b) & 1 == 1
            found += np.where(one, h0 - l0, 0)
            lo = np.where(one, lo - l0 + self.zeros[level], l0)
            hi = np.where(one, hi - h0 + self.zeros[level], h0)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The r-th smallest value (from 0) in each range of places."""
        value = np.zeros(len(lo), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            z = self.zeros_before[level]
            l0, h0 = z[lo], z[hi]
            one = r >= h0 - l0
            r = np.where(one, r - (h0 - l0), r)
            value |= one.astype(np.int64) << b
            lo = np.where(one, lo - l0 + self.zeros[level], l0)
            hi = np.where(one, hi - h0 + self.zeros[level], h0)
        return value


def neighbours(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dyadic blocks and the difference to their nearest occurrence on either side, up to the block's length.

    Returns the earlier of the two occurrences, the difference and the block's length.
    """
    n = len(order)
    wavelet = WaveletMatrix(order)
    at, step, length = [], [], []
    for k in range(1, len(levels)):
        m, rank = 1 << k, levels[k]
        b = np.arange(0, n, m)
        lo = rank[b].astype(np.int64)
        hi = lo + np.bincount(rank, minlength=n)[lo]
        again = hi - lo > 1
        b, lo, hi = b[again], lo[again], hi[again]
        earlier = wavelet.below(lo, hi, b)
        for there in (earlier + 1 < hi - lo, earlier > 0):
            ahead = len(at) % 2 == 0
            x, l, h, e = b[there], lo[there], hi[there], earlier[there]
            other = wavelet.smallest(l, h, e + 1 if ahead else e - 1)
            d = np.abs(other - x)
            near = d <= m
            at.append(np.minimum(x, other)[near])
            step.append(d[near])
            length.append(np.full(int(near.sum()), m))
    if not at:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(at), np.concatenate(step), np.concatenate(length)


def equal_ahead(levels: list[np.ndarray], x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Number of places from x on where the symbol equals the one d further on."""
    n = len(levels[0])
    found = np.zeros(len(x), np.int64)
    top = len(levels) - 1
    active = np.arange(len(x))
    while len(active):  # the longest block as often as it fits, then each shorter one once
        p = x[active] + found[active]
        ok = (p + d[active] < n) & (levels[top][np.minimum(p, n - 1)] == levels[top][np.minimum(p + d[active], n - 1)])
        active = active[ok]
        found[active] += 1 << top
    for k in range(top - 1, -1, -1):
        p = x + found
        ok = (p + d < n) & (levels[k][np.minimum(p, n - 1)] == levels[k][np.minimum(p + d, n - 1)])
        found += ok.astype(np.int64) << k
    return found


def equal_behind(levels: list[np.ndarray], x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Number of places before x where the symbol equals the one d further on."""
    found = np.zeros(len(x), np.int64)
    top = len(levels) - 1

    def fits(rows: np.ndarray, k: int) -> np.ndarray:
        p = x[rows] - found[rows] - (1 << k)
        return (p >= 0) & (levels[k][np.maximum(p, 0)] == levels[k][np.maximum(p, 0) + d[rows]])

    active = np.arange(len(x))
    while len(active):
        active = active[fits(active, top)]
        found[active] += 1 << top
    every = np.arange(len(x))
    for k in range(top - 1, -1, -1):
        found += fits(every, k).astype(np.int64) << k
    return found


def find_runs(seq: np.ndarray, longest: int) -> np.ndarray:
    """All runs of a sequence whose last symbol is unique: rows of start, length and smallest period, by start and period.

    ``longest``: most words that a run can have (those of the longest document).
    """
    if longest < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    order, levels = prefix_ranks(seq, max(2, 2 * (longest // LEAST_PERIODS)))
    if len(levels) < 2:
        return np.zeros((0, 3), np.int64)
    at, d, m = neighbours(order, levels)
    at, d, m = np.unique(np.stack([at, d, m]), axis=1) if len(at) else (at, d, m)
    start = at - equal_behind(levels, at, d)
    length = at + m + equal_ahead(levels, at + m, d) + d - start
    kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d)
    start, length, d = start[kept], length[kept], d[kept]
    by = np.lexsort((d, length, start))
    rows = np.stack([start, length, d], 1)[by]
    if len(rows):
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


# --- documents -------------------------------------------------------------------------------
def repeated_words(doc_id: int | None, n: int) -> np.ndarray:
    """Number of the word that stands at each place: in one id of ten, all from one place on repeat a stretch."""
    i = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return i
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i >= a, a + (i - a) % p, i)


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def slice_rows(ids: list[int | None], texts: pa.Array) -> list[tuple]:
    """Result rows of a slice of documents."""
    raw, offsets = C.utf8(texts)
    starts, stops, first = C.word_spans(raw, offsets, C.NOT_SPACE)
    number = np.unique(C.word_hashes(raw, starts, stops), return_inverse=True)[1].astype(np.int64)
    counts = np.diff(first)
    picked = [first[i] + repeated_words(doc_id, int(counts[i])) for i, doc_id in enumerate(ids)]
    border = len(number) + np.arange(len(ids))  # unique symbols
    seq = np.concatenate([x for i, p in enumerate(picked) for x in (number[p], border[i:i + 1])])
    begin = np.concatenate([[0], np.cumsum(counts + 1)])
    runs = find_runs(seq, int(counts.max()))
    bounds = np.searchsorted(runs[:, 0], begin)
    rows, blob = [], raw.tobytes()
    for i, doc_id in enumerate(ids):
        own = runs[bounds[i]:bounds[i + 1]] - [begin[i], 0, 0]
        dropped = np.zeros(counts[i] + 1, np.int64)
        np.add.at(dropped, own[:, 0] + own[:, 2], 1)
        np.add.at(dropped, own[:, 0] + own[:, 1], -1)
        kept = picked[i][np.cumsum(dropped[:-1]) == 0]
        text = b" ".join([blob[a:e] for a, e in zip(starts[kept].tolist(), stops[kept].tolist(), strict=True)])
        told = own.tolist()
        best = min(told, key=lambda r: (-r[1], r[0], r[2]), default=None)
        rows.append((doc_id, len(told), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in told).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    return rows


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each document: its runs' number and digest, the longest run, and the digest of the text without repeats."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b, limit=SLICE_BYTES):
                rows = slice_rows(s.column("doc_id").to_pylist(), s.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64() if i < 6 else pa.string()) for i in range(8)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
