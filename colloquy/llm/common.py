"""Shared helpers: bounded slices of Arrow batches, vectorised word hashing, shared tables.

Python workers get whole texts in Arrow batches. Every helper works on slices of a bounded
number of bytes (one row at least, whatever its length), so memory follows the longest
single text and never the batch.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U = np.uint64


# --- tables ------------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only on a local master (single-machine tests) its absence is no error: there the warehouse folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: computed once, lineage
    cut, safe against lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold_of(doc_id) -> "F.Column":
    """crc32 of the id's decimal text, modulo 5: fold 0 is held out from all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fold_number(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


# --- Arrow slices ------------------------------------------------------------------------
def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of ``column``, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    ends = _offsets(batch.column(column))[1:]
    at, base = 0, int(ends[0]) - _length(batch.column(column), 0)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        base, at = int(ends[to - 1]), to


def _length(col: pa.Array, i: int) -> int:
    o = _offsets(col)
    return int(o[i + 1] - o[i])


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind, count=len(col) + 1, offset=col.offset * np.dtype(kind).itemsize)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, end to end, and the offsets of the rows (null: empty)."""
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = _offsets(col).astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


# --- words -------------------------------------------------------------------------------
def byte_class(wanted) -> np.ndarray:
    return np.array([wanted(b) for b in range(256)], dtype=bool)


#: UTF-8 bytes of words: everything but the space and 0x09-0x0D.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: 0-9, a-z after lower-casing, and every byte of a character beyond ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 2**64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept in the worker and grown at need."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BASE_INV))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the word."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """Start and end byte of every word, and for each row the number of the first word of it.

    A word never reaches over a row's border.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: polynomial over random byte codes, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = words[:n] + U(seed * 0x632BE59BD9B4E019 % 2**64)
    for t in range(1, k):
        g = g * U(0xD6E8FEB86659FD93) + words[t:t + n]
    return mix(g + U(k))


# --- bitmaps of a fixed size -------------------------------------------------------------
def bitmap(df: DataFrame, column: str, log2_bits: int = 24) -> np.ndarray:
    """Membership bits of 64-bit hashes: bit ``hash mod 2**log2_bits`` is set.

    The size is fixed (2 MB at 24 bits) however many hashes there are: what reaches the driver
    and is sent to the workers is bounded. More hashes only make the filter let more through;
    the join that follows stays exact.
    """
    slot = F.col(column).bitwiseAND((1 << log2_bits) - 1)
    rows = (df.select(F.shiftright(slot, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 31 as int))").alias("b"))
            .groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow())
    bits = np.zeros(1 << (log2_bits - 5), np.uint32)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint32)
    return bits


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.uint64, copy=False) & U(len(bits) * 32 - 1)
    return (bits[(h >> U(5)).astype(np.int64)] >> (h & U(31)).astype(np.uint32)) & np.uint32(1) != 0


def ragged(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array whose row i holds values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
