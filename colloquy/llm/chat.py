"""Chat formatting by token-level assembly.

A turn becomes four segments that are encoded separately: a reserved id that opens the turn, the
role, a reserved id that ends the head, the text, and a reserved id that closes the turn.
Reserved ids lie above the vocabulary and are spliced in, so no text can produce one. In the
rendered form the reserved ids stand for the control strings below; a control string that occurs
inside a text or role is escaped there with ``ESCAPE``, reversibly, so the rendered form can be
read back too. The loss mask comes from marks of +1 where an assistant text begins and -1 where it
ends, by a running sum over the tokens.

Each row of the result is a turn's part of its conversation's token sequence (``conv_id``, ``turn``,
``ids``, ``mask``); a conversation is its parts in order. Encoding runs where rows are read, before any
shuffle; one shuffle by conversation orders the parts, and reading back streams through them with
running digests, so a very long conversation takes no memory.

Defined cases: a null role or text is empty; a null conversation id is a conversation of its own;
rows are ordered by turn (nulls first), then role, text; repeated rows are turns of their own; an empty
table gives only what is added; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the template ----------------------------------------------------------
ESCAPE = "\\"
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>")
TURN, HEAD, CLOSE = 0, 2, 3             #: of CONTROL: opens a turn, ends its head, closes it
LOSS_ROLE = "assistant"
VOCABULARY = "byte_bpe_50k.tiktoken"


def escape(text: str) -> str:
    """An escape sign before every control string and every escape sign of the text."""
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    for c in CONTROL:
        text = text.replace(c, ESCAPE + c)
    return text


def unescape(text: str) -> str:
    out, at = [], text.find(ESCAPE)
    done = 0
    while at >= 0:
        out += [text[done:at], text[at + 1:at + 2]]
        done = at + 2
        at = text.find(ESCAPE, done)
    return "".join(out) + text[done:]


class Codec:
    """Encodes text segments and decodes token ranges; reserved ids follow the vocabulary's."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.reserved = max(ranks.values()) + 2

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        role_ids = self.model.encode_ordinary(escape(role))
        text_ids = self.model.encode_ordinary(escape(text))
        ids = np.array([self.reserved + TURN, *role_ids, self.reserved + HEAD, *text_ids, self.reserved + CLOSE], np.int32)
        marks = np.zeros(len(ids) + 1, np.int8)
        if role == LOSS_ROLE:
            marks[len(role_ids) + 2] += 1
            marks[len(role_ids) + 2 + len(text_ids)] -= 1
        return ids, np.cumsum(marks[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        """Rendered form of token ids, reserved ones as their control strings."""
        at = np.flatnonzero(ids >= self.reserved)
        out, done = [], 0
        for i in at:
            out += [self.model.decode_bytes(ids[done:i].tolist()).decode(), CONTROL[ids[i] - self.reserved]]
            done = i + 1
        return "".join(out) + self.model.decode_bytes(ids[done:].tolist()).decode()

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn, from its tokens alone."""
        head = int(np.flatnonzero(ids == self.reserved + HEAD)[0])
        if ids[0] != self.reserved + TURN or ids[-1] != self.reserved + CLOSE:
            raise ValueError("not a whole turn")
        return unescape(self.text(ids[1:head])), unescape(self.text(ids[head + 1:-1]))


def assemble(turns: DataFrame) -> DataFrame:
    """Tokens and loss mask of every turn (``conv_id, turn, role, text`` in), made where the rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                made = [codec.turn(r or "", t or "") for r, t in zip(s.column("role").to_pylist(), s.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [s.column("conv_id"), s.column("turn"), pa.array([x[0] for x in made], pa.list_(pa.int32())),
                     pa.array([x[1].tobytes() for x in made], pa.binary()), s.column("role"), s.column("text_key")],
                    names=["conv_id", "turn", "ids", "mask", "role", "text_key"])

    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), "role", "text",
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"))
    return rows.mapInArrow(run, "conv_id long, turn long, ids array<int>, mask binary, role string, text_key string")


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_tokens long, loss_tokens long")


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, all of it read from the tokens and masks of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        open_, at, done = False, None, []
        n = turns = loss = None

        def closed():
            return (at, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3], n[4])

        for b in batches:
            for conv, ids, mask in zip(b.column("conv_id").to_pylist(), b.column("ids"), b.column("mask"), strict=True):
                if not open_ or conv != at:
                    if open_:
                        done.append(closed())
                    open_, at, n, turns, loss = True, conv, [0] * 5, hashlib.sha256(), hashlib.sha256()
                tokens = ids.values.to_numpy()
                role, text = codec.read(tokens)
                turns.update(f"{role}\n{text}\n".encode())
                under = np.frombuffer(mask.as_py(), np.int8) == 1
                said = unescape(codec.text(tokens[under]))
                loss.update(said.encode())
                for i, x in enumerate((1, len(said), len(codec.text(tokens)), len(tokens), int(under.sum()))):
                    n[i] += x
            if len(done) >= 4096:
                yield _batch(done)
                done = []
        if open_:
            done.append(closed())
        if done:
            yield _batch(done)

    ordered = parts.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text_key")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def format_chats(turns: DataFrame) -> DataFrame:
    return read_back(assemble(turns))
