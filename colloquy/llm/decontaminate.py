"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item. Documents and items are fingerprinted
alike: of the hashes of all ``GRAM``-word grams, the least of every ``WINDOW - GRAM + 1`` consecutive ones is
kept (of equal ones the last). Any ``WINDOW`` words that a document shares with an item have the same grams, so both
keep the same gram inside them: every shared window meets in the fingerprint join. A
meeting is then extended, word by word and on the words themselves, to both sides as far as a
window can reach; a run of a whole window or more is a hit.

Items of fewer words are one window of their own; for each such length the grams of exactly that
many words are compared, all of them.

Documents' fingerprints are tested against a bitmap of the items' first (fixed size, so it can be sent to
every task); what passes - true meetings and a few strangers - is joined with the items'
fingerprints by a shuffle. Each fingerprint is salted by the document, and the items' side repeated for
every salt, so a passage that a third of all documents share is spread over ``SALTS`` tasks.

Defined cases: null texts have no words and match nothing; items without words have no window; repeated
documents (same id and text) give one row, an id with several texts a row for each; equal items
count as items of their own, equal ids of items once; an item without an id counts as hits but is
not listed in ``n_items``; without items nothing is contaminated; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import common as C

WINDOW = 10
GRAM = 5
SALTS = 32
LOG2_BITS = 24


def tokens(col: pa.Array):
    """Lower-cased bytes, word spans, first words of the rows and word hashes of a text column."""
    raw, off = C.utf8(col)
    raw = C.LOWER[raw]
    starts, stops, at = C.word_spans(raw, off, C.ALNUM)
    return raw, starts, stops, at, C.word_hashes(raw, starts, stops)


def winnowed(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions that are the least (of equals the last) in some run of ``WINDOW - GRAM + 1`` grams.

    ``at`` holds the rows' first words; runs that reach over a row's border are left out.
    """
    span = WINDOW - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, where = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, span):
        g = grams[j:j + n]
        low = g <= least
        least[low] = g[low]
        where[low] = j
    last = np.repeat(at[1:], np.diff(at))[:n]
    inside = np.arange(n) + WINDOW <= last
    chosen = np.zeros(len(grams), bool)
    chosen[(np.arange(n) + where)[inside]] = True
    return np.flatnonzero(chosen)


def fingerprints(words: np.ndarray, at: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, positions, hashes) for whole windows and for each short item length."""
    grams = C.gram_hashes(words, GRAM, WINDOW)
    where = winnowed(grams, at)
    yield WINDOW, where, grams[where]
    for n in lengths:
        grams = C.gram_hashes(words, n, n)
        last = np.repeat(at[1:], np.diff(at))[:len(grams)]
        where = np.flatnonzero(np.arange(len(grams)) + n <= last)
        yield n, where, grams[where]


def _context(raw, starts, stops, first: int, last: int) -> str:
    return " ".join(bytes(raw[starts[i]:stops[i]]).decode("utf-8", "replace") for i in range(first, last))


ITEM = "item_id long, size int, hash long, before string, after string"


def item_fingerprints(items: DataFrame) -> DataFrame:
    """Fingerprints of the items, each with the words that a window around it can hold.

    ``before`` are the words left of the gram, ``after`` the gram and the words right of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b):
                raw, starts, stops, at, words = tokens(s.column("text"))
                ids = s.column("item_id").to_pylist()
                rows = []
                for i in range(len(ids)):
                    a, e = int(at[i]), int(at[i + 1])
                    if e == a:
                        continue
                    short = [e - a] if e - a < WINDOW else []
                    for size, where, hashes in fingerprints(words[a:e], np.array([0, e - a]), short):
                        if short and size == WINDOW:
                            continue
                        reach, gram = (WINDOW - GRAM, GRAM) if size == WINDOW else (0, size)
                        for p, h in zip(where.tolist(), hashes.view(np.int64).tolist(), strict=True):
                            rows.append((ids[i], size, h, _context(raw, starts, stops, max(a, a + p - reach), a + p),
                                         _context(raw, starts, stops, a + p, min(e, a + p + gram + reach))))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                                 names=["item_id", "size", "hash", "before", "after"])

    return items.select(items["item_id"].cast("long").alias("item_id"), "text").mapInArrow(run, ITEM)


_SPOT = "struct<size:int,hash:long,at:array<int>,before:string,after:string>"
_SPOT_ARROW = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("at", pa.list_(pa.int32())), ("before", pa.string()), ("after", pa.string())]))


def document_fingerprints(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """One row per document: its words and its fingerprints that are in the bitmap, with their surroundings.

    Equal surroundings of one document are one spot with all its positions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b):
                raw, starts, stops, at, words = tokens(s.column("text"))
                found: list[dict[tuple, list[int]]] = [defaultdict(list) for _ in range(s.num_rows)]
                for size, where, hashes in fingerprints(words, at, lengths):
                    known = C.in_bitmap(bits, hashes)
                    reach, gram = (WINDOW - GRAM, GRAM) if size == WINDOW else (0, size)
                    rows = np.searchsorted(at, where[known], side="right") - 1
                    for p, h, i in zip(where[known].tolist(), hashes[known].view(np.int64).tolist(), rows.tolist(), strict=True):
                        a, e = int(at[i]), int(at[i + 1])
                        key = (size, h, _context(raw, starts, stops, max(a, p - reach), p), _context(raw, starts, stops, p, min(e, p + gram + reach)))
                        found[i][key].append(p - a)
                spots = [[dict(size=k[0], hash=k[1], at=v, before=k[2], after=k[3]) for k, v in f.items()] for f in found]
                key = pa.array([hash_of(x) for x in s.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), key, pa.array(np.diff(at).astype(np.int64)), pa.array(spots, _SPOT_ARROW)],
                                                 names=["doc_id", "text_key", "n_words", "spots"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, text_key long, n_words long, spots array<{_SPOT}>")


def hash_of(text: str | None) -> int:
    """Spark's ``xxhash64`` of the text, a null text counting as empty."""
    import xxhash
    return (xxhash.xxh64_intdigest(text or "", seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)


_HIT = "doc_id long, text_key long, item_id long, hits array<struct<a:int,b:int>>"


def extended(pairs: DataFrame) -> DataFrame:
    """Meetings extended to both sides; those that reach a whole window give the hit words of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "text_key", "size", "at", "before", "after", "item_id", "item_before", "item_after")]
            for doc, key, size, at, before, after, item, i_before, i_after in zip(*cols, strict=True):
                x, y = before.split(" ") if before else [], i_before.split(" ") if i_before else []
                left = 0
                while left < min(len(x), len(y)) and x[-1 - left] == y[-1 - left]:
                    left += 1
                x, y = after.split(" "), i_after.split(" ")
                right = 0
                while right < min(len(x), len(y)) and x[right] == y[right]:
                    right += 1
                if right >= min(size, GRAM) and left + right >= size:
                    out.append((doc, key, item, [{"a": p - left, "b": p + right} for p in at]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "text_key", "item_id", "hits"])

    return pairs.mapInArrow(run, _HIT)


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their word counts, and (document, item, hit words) of every hit."""
    marks = C.stored(item_fingerprints(items), "item-marks")
    lengths = [r["size"] for r in marks.where(F.col("size") < WINDOW).select("size").distinct().orderBy("size").collect()]
    scanned = C.stored(document_fingerprints(docs, C.bitmap(marks, "hash", LOG2_BITS), lengths), "document-marks")
    spots = scanned.where(F.size("spots") > 0).select("doc_id", "text_key", F.explode("spots").alias("s")).select(
        "doc_id", "text_key", "s.*", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = marks.select("item_id", "size", "hash", F.col("before").alias("item_before"), F.col("after").alias("item_after"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return scanned.select("doc_id", "text_key", "n_words"), extended(spots.join(salted, ["size", "hash", "salt"]))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: its words, how many are hit, and the items that hit it."""
    counted, found = hits(docs, items)
    # words covered by the union of the hits of a document, from its distinct runs
    runs = (found.select("doc_id", "text_key", F.explode("hits").alias("h")).distinct()
            .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("h")).alias("runs")))
    covered = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                          lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(acc["to"], r["a"]))).alias("n"),
                                                  F.greatest(acc["to"], r["b"]).alias("to")))["n"]
    listed = (found.where("item_id is not null").select("doc_id", "text_key", "item_id").distinct()
              .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    both = runs.select("doc_id", "text_key", covered.cast("long").alias("n_hit")).alias("r").join(
        listed.alias("l"), (F.col("r.doc_id").eqNullSafe(F.col("l.doc_id"))) & (F.col("r.text_key") == F.col("l.text_key")), "left").select(
        F.col("r.doc_id").alias("d"), F.col("r.text_key").alias("k"), "n_hit", "items")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return (counted.distinct().join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                    F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns. A decision holds for its id (or no id) and text."""
    _, found = hits(docs, items)
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct().alias("gone")
    rows = docs.alias("rows")
    return rows.join(gone, F.col("rows.doc_id").cast("long").eqNullSafe(F.col("gone.gone_id"))
                     & (F.xxhash64(F.coalesce("rows.text", F.lit(""))) == F.col("gone.gone_key")), "left_anti").select(*docs.columns)
