"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

Base spans follow three fixed patterns (assignment, access key, long hex). The method adds
strings that the patterns don't know: a candidate (an unbroken run of key-like characters)
that stands in sensitive context is compressed together with the code around it by a
compressor primed with a dictionary of identifiers; its marginal cost is

    bytes(context + candidate) - bytes(context)

Identifiers, words and repeated characters cost next to nothing; random key material can't be
compressed. Copies of the candidate are taken out of its context, so a secret that is written twice costs the
same both times. It is reported when it costs ``NOVEL_BITS`` bits a character or more; of runs shorter than ``LONG`` and
runs without a letter or without a digit, whose words cost more too, ``STRICT_BITS``. (Random lower-case letters
cost about as much as rare words, so of such runs those that cost less aren't told apart.)

Context is sensitive in the whole statement of a sensitive word, before and after it, in the
``SENSITIVE_REACH`` characters after it, in a whole PEM block with a sensitive name, and in what adjoins a run
in sensitive context with nothing but blanks, line ends, quotes and punctuation between (the next lines of a key, the
next parts of a token).

Defined cases: a null text counts as empty and has no spans; spans are in code points with
the end exclusive; repeated rows and repeated ids give a row each; extra input columns are
ignored by :func:`scan` and passed through by :func:`redact`.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: the base patterns -----------------------------------------------------
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

# --- parameters of the method ------------------------------------------------------------
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
SENSITIVE = re.compile(r"(?ai:pass|pwd|secret|token|key|auth|bearer|credential|private|signature|cookie|session|salt|cert)")
CONTEXT_BEFORE, CONTEXT_AFTER, SENSITIVE_REACH = 256, 64, 48
NOVEL_BITS, STRICT_BITS, LONG = 4.5, 6.75, 20
STATEMENT_END = re.compile(r"[;\n]|[.!?](?=\s)")
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(.*?)(?:-----END |\Z)", re.S)
BLOCK_LINE = re.compile(r"^[ \t]*([A-Za-z0-9+/=]+)[ \t]*\r?$", re.M)
JOINT = re.compile(r"[\s\"'`\\.,:|&]*")
#: Identifiers and phrases of code and configuration that are no secrets.
IDENTIFIERS = """
import from return function class public private protected static void const string number boolean
authentication authorization authenticate authorize Authorization Authentication Bearer Basic
password_hash passwordHash password_reset passwordReset PASSWORD_DEFAULT password_verify
access_token accessToken refresh_token refreshToken client_secret clientSecret CLIENT_SECRET
api_key apiKey API_KEY secret_key secretKey SECRET_KEY public_key publicKey PUBLIC_KEY
private_key privateKey PRIVATE_KEY session_id sessionId session_token sessionToken cookie_secret
signature_algorithm signatureAlgorithm certificate_path certificatePath credentials_provider
credentialsProvider getCredentials setCredentials tokenizer tokenization token_type token_expires
configuration environment production development application container repository kubernetes
http https localhost example username user_name userName email address database connection
content-type application/json charset utf-8 timeout retries max_connections default_value
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 your_token_here your-api-key-here
xxxxxxxxxxxxxxxxxxxxxxxx changeme placeholder insert_your_key_here REPLACE_ME lorem ipsum
""".encode()
#: Stands before the context of strictly measured runs, so that a rare word costs what its letters cost in longer texts.
PROSE = """It is a common question whether the following statement can be understood without knowledge of what happened before,
and although most people would probably answer that they have never thought about it, everyone will agree that language
is always learned from examples. Just because something has been written down, it does not have to be true; quickly
checking several independent sources, with patience and judgement, makes the difference between an opinion and a fact. """


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed size against a primed dictionary; one compressor per worker."""

    def __init__(self):
        self.pack = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(
            IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)

    def bits(self, before: str, candidate: str, after: str) -> float:
        around = (before + " " + after + " ").encode()
        grown = len(self.pack.compress(around + candidate.encode())) - len(self.pack.compress(around))
        return 8.0 * grown / len(candidate)


def blocks(text: str) -> list[tuple[int, int]]:
    """The insides of PEM blocks with a sensitive name."""
    return [m.span(2) for m in BLOCK.finditer(text) if SENSITIVE.search(m[1])] if "-----BEGIN " in text else []


def sensitive_parts(text: str, inside: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint parts of the text, in order, that are sensitive by a word in the statement or by their block."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    ends = [m.end() for m in STATEMENT_END.finditer(text)]
    parts = list(inside)
    for a, b in words:
        i, j = bisect.bisect_right(ends, a), bisect.bisect_left(ends, b)
        parts.append((ends[i - 1] if i else 0, max(ends[j] if j < len(ends) else len(text), b + SENSITIVE_REACH)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], meter: Novelty) -> list[tuple[int, int, int]]:
    """Candidates outside all base spans, in sensitive context, that cost as much as random text."""
    inside = blocks(text)
    parts = sensitive_parts(text, inside)
    if not parts:
        return []
    found, starts = [], [a for a, _ in parts]
    reached = -1  # end of the last run in sensitive context
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        word = m[0]
        i = bisect.bisect_right(starts, s) - 1
        if not (i >= 0 and s < parts[i][1] or i + 1 < len(parts) and starts[i + 1] < e
                or reached >= 0 and JOINT.match(text, reached).end() >= s):
            continue
        reached = e
        if any(a < e and s < b for a, _, b in base):
            continue
        mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
        if len(set(word)) < 4 or not any(c.isalnum() for c in word):
            continue
        # a copy may lie across the window's border, so it is taken out before the window is cut
        before = text[max(0, s - CONTEXT_BEFORE - len(word)):s].replace(word, " ")[-CONTEXT_BEFORE:]
        after = text[e:e + CONTEXT_AFTER + len(word)].replace(word, " ")[:CONTEXT_AFTER]
        strict = not mixed or len(word) < LONG
        if meter.bits(PROSE + before if strict else before, word, after) >= (STRICT_BITS if strict else NOVEL_BITS):
            found.append((s, 3, e))
    return found + block_lines(text, inside, base, found)


def block_lines(text: str, inside: list[tuple[int, int]], base, found) -> list[tuple[int, int, int]]:
    """The lines of a block that holds a novel run and aren't found themselves: its short last line, lines of one class."""
    out, known = [], sorted(s for s, _, _ in found)
    taken = sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e in found])
    for a, b in inside:
        i = bisect.bisect_left(known, a)
        if i < len(known) and known[i] < b:
            out += [(m.start(1), 3, m.end(1)) for m in BLOCK_LINE.finditer(text, a, b)
                    if not any(s < m.end(1) and m.start(1) < e for s, e in taken)]
    return out


def spans_of(text: str | None, meter: Novelty):
    """Base spans and all spans of one text, each sorted by start, then kind."""
    base = sorted(base_spans(text)) if text else []
    return base, sorted(base + novel_spans(text, base, meter)) if text else base


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its spans. No shuffle: each text is scanned where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Novelty()
        for b in batches:
            found = [spans_of(t.as_py(), meter) for t in b.column("text")]
            n = [[sum(s[1] == k for s in every) for _, every in found] for k in range(4)]
            base = [_joined(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in n[:3]),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                 pa.array([_joined(x) for _, x in found], pa.string()), pa.array(n[3], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)


def redacted(text: str, spans, mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at, upto = [], 0, -1
    for s, _, e in spans:
        if s >= upto:
            out += [text[at:s], mark]
        upto = at = max(upto, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced in ``text``; ``n_chars``, where there is one, follows.

    All rows and columns stay; a null text stays null.
    """
    schema = docs.schema
    names = schema.names
    counted = "n_chars" in names and isinstance(schema["n_chars"].dataType, (T.LongType, T.IntegerType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Novelty()
        for b in batches:
            texts = b.column(names.index("text")).to_pylist()
            found = [spans_of(t, meter)[1] for t in texts]
            new = [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(new, cols[names.index("text")].type)
            if counted:
                at = names.index("n_chars")
                cols[at] = pa.array([len(t) if s else v for t, s, v in zip(new, found, cols[at].to_pylist(), strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
