"""WARC archives: a writer with payload digests and revisits, and a splittable reader.

Writing. Equal payloads of at least ``REVISIT_BYTES`` bytes are stored once: the record with the largest
page id is the response, the others are revisits that refer to it. Records are gzip members of
their own, so an archive is the concatenation of its members. Spark's text writer puts the raw
bytes of each row out, followed by its line separator; a member ends with a zero byte (the high byte of its length),
so the row holds all but that byte and the separator is it. Members of 16 MB or more, whose last
byte isn't zero, are followed by an empty member, which every gzip reader skips.

Reading. An archive is cut into byte ranges by Spark's text source with the three gzip magic bytes
as separator: a task scans its range for them and owns what starts inside. Each stretch is only
a candidate: the magic may occur within compressed data. A candidate is a record when it
inflates to a ``WARC/1`` header; a stretch that doesn't is joined to the one before it. What a
range's end cuts off that way is put together in a second step, over the few unfinished
stretches only.

Defined cases: a null html is an empty payload; a null url is written as ``about:blank``; pages without an id are
written under the id ``null`` and come back with a null id, they are never what a revisit refers to when another
page has the payload; equal rows are records of their own (two rows of the largest id are both
responses); an empty table gives an empty archive and result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common as C

REVISIT_BYTES = 1000
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
LARGE_MEMBER = 1 << 24


# --- records -----------------------------------------------------------------------------
def member(data: bytes) -> bytes:
    """One gzip member; it ends with a zero byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    return out + member(b"") if len(data) >= LARGE_MEMBER else out


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload when ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in (url or "about:blank"))
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1"):
        raise ValueError("no WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(field["Content-Length"])]
    if len(block) != int(field["Content-Length"]):
        raise ValueError("record cut short")
    number = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[10:-1])
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload differs from its digest")
        size = len(payload)
    else:
        size = int(field["WARC-Payload-Length"])
    return (number(field["WARC-Record-ID"]), size, digest, kind, number(field.get("WARC-Refers-To")), field["WARC-Target-URI"],
            payload if kind == "response" else None)


# --- writing -----------------------------------------------------------------------------
def decide(pages: DataFrame) -> DataFrame:
    """Pages with their payload's digest and, for revisits, the page they refer to.

    The largest id of each repeated payload is found on digests alone with partial aggregation and
    written down, so Spark knows its size when it plans the join. The pages are the only side with many rows
    a digest: adaptive execution can split a hot one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"))
    keyed = pages.select(pages["page_id"].cast("long").alias("page_id"), payload.alias("payload")).where(
        F.octet_length("payload") >= REVISIT_BYTES).select("page_id", F.sha1("payload").alias("same"))
    first = keyed.groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = C.stored(first.select("same", "first"), "warc-first")
    return (p.join(first, p["digest"] == first["same"], "left")
            .select("page_id", "url", "payload", "digest", F.expr("case when page_id = first then null else first end").alias("refers_to")))


def write(pages: DataFrame, path: str) -> None:
    """One archive file for each task, below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b, "payload", 4 << 20):
                rows = zip(*(s.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([member(record(*r))[:-1] for r in rows], pa.binary())], names=["member"])

    members = decide(pages).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


# --- reading -----------------------------------------------------------------------------
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_STEP = RECORD + ", file string, block long, number long, rest binary"
_NAMES = [f.split()[0] for f in _STEP.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def begins(stretch: bytes) -> bool:
    """Whether the stretch, with the magic before it, is a member that inflates to a WARC header or to nothing."""
    try:
        head = zlib.decompressobj(31)
        text = head.decompress(MAGIC + stretch[:4096], 6)
        return text == b"WARC/1" or head.eof and not text
    except zlib.error:
        return False


class Joiner:
    """Joins the stretches of one range, in order, into whole members."""

    def __init__(self):
        self.parts: list[tuple[int, bytes]] = []
        self.inflate = None
        self.out: list[bytes] = []

    def feed(self, number: int, stretch: bytes) -> tuple[bytes | None, list[tuple[int, bytes]]]:
        """A member's data, if this stretch ends one, and the stretches that belong to no member here."""
        if self.inflate is not None:
            try:  # the open member goes on: the magic between was part of its data
                return self._more(number, stretch), []
            except zlib.error:
                lost, self.parts, self.inflate = self.parts, [], None
                data, rest = self.feed(number, stretch)
                return data, lost + rest
        if not begins(stretch):
            return None, [(number, stretch)]
        self.inflate, self.out, self.parts = zlib.decompressobj(31), [], []
        return self._more(number, stretch), []

    def _more(self, number: int, stretch: bytes) -> bytes | None:
        self.out.append(self.inflate.decompress(MAGIC + stretch))
        self.parts.append((number, stretch))
        if not self.inflate.eof:
            return None
        data, self.parts, self.inflate = b"".join(self.out), [], None
        return data


def _rows(records: list[tuple], lost: list[tuple], with_payload: bool) -> pa.RecordBatch:
    rows = [(*r[:6], r[6] if with_payload else None, None, None, None, None) for r in records] + [(None,) * 7 + x for x in lost]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``path``, read by byte ranges."""
    stretches = (spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
                 .select(F.col("value").cast("binary").alias("rest"), F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("block")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, joiner, n = None, Joiner(), 0
        for b in batches:
            for s in C.slices(b, "rest", 4 << 20):
                records, lost = [], []
                for file, block, rest in zip(s.column("file").to_pylist(), s.column("block").to_pylist(), s.column("rest").to_pylist(), strict=True):
                    if (file, block) != at:
                        lost += [(*at, *x) for x in joiner.parts] if at else []
                        at, joiner, n = (file, block), Joiner(), 0
                    n += 1
                    if n == 1 and block == 0:
                        continue  # what stands before a file's first magic
                    data, given_up = joiner.feed(n, rest)
                    lost += [(*at, *x) for x in given_up]
                    if data:
                        records.append(parse(data))
                yield _rows(records, lost, with_payload)
        if at:
            yield _rows([], [(*at, *x) for x in joiner.parts], with_payload)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, joiner = None, Joiner()
        for b in batches:
            records = []
            for file, rest in zip(b.column("file").to_pylist(), b.column("rest").to_pylist(), strict=True):
                if file != at:
                    at, joiner = file, Joiner()
                data, lost = joiner.feed(0, rest)
                if lost:
                    raise ValueError(f"{file}: a gzip member is damaged")
                if data:
                    records.append(parse(data))
            yield _rows(records, [], with_payload)

    found = C.stored(stretches.mapInArrow(scan, _STEP), "warc-scan")
    unfinished = found.where("file is not null").select("file", "block", "number", "rest")
    mended = unfinished.repartition("file").sortWithinPartitions("file", "block", "number").mapInArrow(mend, _STEP)
    return found.where("file is null").unionByName(mended).select(*[f.split()[0] for f in RECORD.split(", ")])


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages into archives in the shared folder and reads the records back."""
    path = C.shared_dir(spark, "warc")
    write(pages, path)
    return read(spark, path, with_payload=False).drop("url", "payload")
