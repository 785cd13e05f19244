"""Cross-tokenizer alignment against whole-text tokenization with the named libraries and plain counting."""
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import crosstoken

ALPHABET = [" ", "  ", "\n", " \n", "\t", "a", "bc", "é", "日本", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "'s", "don't", "123", "!!", "　",
            "\x85", "\x1c", " ", "😀", "\r\n", "the", "▁", "\x00", "́", "​", "﻿"]


@pytest.fixture(scope="module")
def aligner():
    return crosstoken.Aligner()


@pytest.fixture(scope="module")
def whole(aligner):
    import public_tokenizers
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True

    def run(text):
        """Groups as pairs of id lists, by a walk over all byte ends; None without tokens."""
        if not text:
            return None
        ids, raw = (a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)), (" " + text).encode()
        parts = [[known[i] for i in x] for known, x in zip((aligner.bytes_a, aligner.bytes_b), ids)]
        if any(b"".join(p) != raw for p in parts):
            return None
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [x.index(e) + 1 for x in ends]
            groups.append(tuple(ids[k][at[k]:to[k]] for k in (0, 1)))
            at = to
        return groups

    return run


def test_pieces_change_nothing(aligner, whole, writer):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 12))) for _ in range(3000)] + [writer(rng, 200) for _ in range(30)]
    for t in texts:
        cut = crosstoken.pieces(t)
        got, expected = aligner.align(cut), whole(t)
        assert "".join(cut) == " " + t and got.good.all() == (expected is not None)
        distinct, number, bounds = crosstoken.distinct_pieces(pa.array([None, t, ""])[1:])
        assert [distinct[i] for i in number] == cut and bounds.tolist() == [0, len(cut), len(cut)]
        if expected is not None:
            assert "".join(got.groups(aligner.spelled)) == "".join(f"{','.join(map(str, a))}|{','.join(map(str, b))};" for a, b in expected)
            assert got.pairs.tolist() == [a[-1] << crosstoken.B_BITS | b[-1] for a, b in expected] and got.links[-1] == len(expected)


def test_perfect_hash_is_minimal_and_keys_are_verified():
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.random.default_rng(n).choice(1 << 31, n, replace=False)
        h = crosstoken.PerfectHash.build(keys)
        assert sorted(h(keys).tolist()) == list(range(n))
        key_of = np.zeros(n, np.int64)
        key_of[h(keys)] = keys
        counts = np.arange(n)
        found, best = crosstoken.PairCounts.of(h, key_of, counts).look_up(np.concatenate([keys, keys ^ 1, keys + (1 << 32)]))
        assert (found[:n] == h(keys)).all()
        unknown = ~np.isin(keys ^ 1, keys)
        assert not found[n:2 * n][unknown].any() and not found[2 * n:].any() and not best[2 * n:].any()


def test_tree_sum(spark):
    rng = np.random.default_rng(2)
    vectors = {(b, t): rng.integers(0, 100, 4) for b in range(3) for t in range(40)}
    df = spark.createDataFrame([(b, t, bytearray(v.tobytes())) for (b, t), v in vectors.items()], "block int, task int, counts binary")
    got = {r["block"]: np.frombuffer(r["counts"], np.int64).tolist() for r in crosstoken.tree_sum(df, 40).collect()}
    assert got == {b: sum(v for (x, _), v in vectors.items() if x == b).tolist() for b in range(3)}


def test_documents_equal_plain_counting(spark, make, writer, odd_texts, aligner, whole):
    rng = random.Random(8)
    texts = [t for t in odd_texts if not t or len(t) < 5000] + [writer(rng, 80) for _ in range(40)] + ["x▁y", "a  b ", " a", " ", "tail \n", "<|endoftext|> <s>"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(30)) for _ in range(40)]
    ids = [*range(len(texts) - 2), 0, None]
    groups = [whole(t) for t in texts]
    links = Counter((a[-1], b[-1]) for g in groups if g for a, b in g)
    top = {}
    for (_, b), n in links.items():
        top[b] = max(top.get(b, 0), n)
    expected = []
    for i, g in zip(ids, groups):
        g, pairs = g or [], [(a[-1], b[-1]) for a, b in g or []]
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        expected.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(links[p] == top[p[1]] for p in pairs),
                         sum(links[p] for p in pairs), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    got = crosstoken.align_tokens(make(texts, ids=ids, extra=True, partitions=20))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert len(links) <= crosstoken.pair_bound(aligner)
    assert crosstoken.align_tokens(make([])).count() == 0


def test_long_text(spark, make, odd_texts, whole):
    long = max((t for t in odd_texts if t), key=len)
    row = crosstoken.align_tokens(make([long, long])).collect()[0]
    groups = whole(long[:50_000].rsplit(" ", 1)[0])
    assert row["n_groups"] > len(groups) and row["n_links"] == row["n_groups"] and row["count_sum"] >= 2 * row["n_links"]
