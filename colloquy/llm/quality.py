"""Quality rules: fixed text statistics plus a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: the raw corpus from **all** documents,
the trusted target from a bounded sample of rows that ``labels`` marks ``quality = 1``. A
document's score is the mean over its n-grams of ``log p_target - log p_raw`` (length
normalised, with ``PRIOR_GRAMS`` neutral n-grams added so that a tiny text can't reach an extreme
score by chance). Every document is kept or dropped by one fixed threshold; nothing is sampled.

The hash space is fixed (2**16), so the model that reaches the driver and the workers is half a
megabyte at any corpus size, while the counts gathered from the tasks grow with the corpus.

Defined cases: a null text has no words, all counts 0, score 0 and fails the base rules; equal
rows get equal results, a row each; an empty table gives an empty result; without trusted
labels both multinomials are equal, so only the base rules decide; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import common as C

GRAM = 5                    #: bytes in an n-gram
LOG2_BUCKETS = 16
SMOOTHING = 0.5             #: added to every bucket's raw count
PRIOR = 32_768              #: n-grams by which the target leans on the raw corpus: little evidence, little verdict
TARGET_DOCS = 50_000        #: bound on the trusted sample (lowest hashed ids)
PRIOR_GRAMS = 64
THRESHOLD = -0.1            #: nats an n-gram
# --- fixed values: base rules ------------------------------------------------------------
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
_SYMBOL = C.byte_class(lambda b: b in b"#*$%&|<>")
_LINE = C.byte_class(lambda b: b != 0x0A)
_GRAM_CODE = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def buckets(raw: np.ndarray) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each byte (the last ``GRAM - 1`` have none)."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = _GRAM_CODE[raw]
    h = code[:n].copy()
    for j in range(1, GRAM):
        h *= np.uint32(0x01000193)
        h += code[j:j + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - LOG2_BUCKETS)


def _gram_rows(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last n-gram position of each row; n-grams over a row's border belong to none."""
    return np.minimum(offsets[:-1], n), np.minimum(np.maximum(offsets[1:] - GRAM + 1, offsets[:-1]), n)


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[stops] - total[starts]


def trusted_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> np.ndarray:
    """Sorted ids of at most ``limit`` rows marked quality 1, the lowest by hash."""
    rows = (labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toArrow())
    return np.sort(rows.column(0).to_numpy().astype(np.int64))


def fit(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket. Tasks count whole texts; a shuffle adds their tables up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << LOG2_BUCKETS, np.int64), np.zeros(1 << LOG2_BUCKETS, np.int64)
        for b in batches:
            for s in C.slices(b):
                data, off = C.utf8(s.column("text"))
                if len(data) < GRAM:
                    continue
                h = buckets(data)
                first, last = _gram_rows(off, len(h))
                edge = np.zeros(len(h) + 1, np.int8)
                np.add.at(edge, first, 1)
                np.add.at(edge, last, -1)
                own = np.cumsum(edge[:-1], dtype=np.int8) > 0
                raw += np.bincount(h[own], minlength=len(raw))
                marked = np.isin(s.column("doc_id").fill_null(-1).to_numpy(), trusted)
                for i in np.flatnonzero(marked & (last > first)):
                    target += np.bincount(h[first[i]:last[i]], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(count, "bucket int, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    raw, target = np.full(1 << LOG2_BUCKETS, SMOOTHING), np.zeros(1 << LOG2_BUCKETS)
    at = rows.column("bucket").to_numpy()
    raw[at] += rows.column("raw").to_numpy()
    target[at] += rows.column("target").to_numpy()
    raw /= raw.sum()
    return np.log((target / raw + PRIOR) / (target.sum() + PRIOR)).astype(np.float32)


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics of each row of a slice."""
    rows = len(off) - 1
    starts, stops, at = C.word_spans(data, off, C.NOT_SPACE)
    n_words = np.diff(at)
    is_word = C.NOT_SPACE[data]
    out = {"n_words": n_words,
           "word_chars": _sums((is_word & ((data & 0xC0) != 0x80)).view(np.int8), off[:-1], off[1:]),
           "n_symbols": _sums(_SYMBOL[data].view(np.int8), off[:-1], off[1:])}
    # lines with a word that equal an earlier line of the same row
    l0, l1, l_at = C.word_spans(data, off, _LINE)
    filled = _sums(is_word.view(np.int8), l0, l1) > 0
    row = np.repeat(np.arange(rows), np.diff(l_at))
    key = C.mix(C.word_hashes(data, l0, l1) ^ C.mix(row.astype(np.uint64) + C.U(1)))[filled]
    _, first = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[first] = False
    out["n_dup_lines"] = np.bincount(row[filled][dup], minlength=rows)
    # words inside windows that the row has twice or more
    grams = C.gram_hashes(C.word_hashes(data, starts, stops), REPEAT_WINDOW)
    row = np.repeat(np.arange(rows), n_words)
    last = np.repeat(at[1:], n_words)[:len(grams)]
    where = np.flatnonzero(np.arange(len(grams)) + REPEAT_WINDOW <= last)
    key = C.mix(grams[where] ^ C.mix(row[where].astype(np.uint64) + C.U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int32)
    np.add.at(cover, where[twice], 1)
    np.add.at(cover, where[twice] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _sums((np.cumsum(cover[:-1]) > 0).view(np.int8), at[:-1], at[1:])
    return out


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, score double")


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base statistics, score and verdict. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b):
                data, off = C.utf8(s.column("text"))
                x = statistics(data, off)
                h = buckets(data)
                first, last = _gram_rows(off, len(h))
                score = _sums(ratios[h], first, last) / (last - first + PRIOR_GRAMS)
                failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), *(pa.array(x[k].astype(np.int64)) for k in names), pa.array(failed),
                     pa.array(~failed & (score >= threshold)), pa.array(score.astype(np.float64))],
                    names=["doc_id", *names, "base_failed", "kept", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, trusted_ids(labels)))
