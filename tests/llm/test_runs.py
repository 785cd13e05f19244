"""Periodic runs against brute force: all periods tried on every word sequence."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from colloquy.llm import runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def periodic(rng, size):
    w = []
    while len(w) < size:
        if rng.random() < 0.5:
            w += [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 6))]
        else:
            root = [rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
            w += (root * 8)[:rng.randint(3 * len(root), 7 * len(root))]
    return w


@pytest.mark.parametrize("size", [3, 6, 12, 60, 300])
def test_all_runs_of_random_and_periodic_sequences(size):
    rng = random.Random(size)
    for _ in range(300 if size < 300 else 40):
        w = periodic(rng, size)
        assert [tuple(r) for r in runs.find_runs(np.array([*w, 10**6]), len(w)).tolist()] == brute_runs(w)


def test_wavelet_matrix_counts_and_selects():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        v = rng.permutation(n).astype(np.int32)
        m = runs.WaveletMatrix(v)
        lo = rng.integers(0, n, 50)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 50))
        x = rng.integers(0, n, 50)
        assert m.below(lo, hi, x).tolist() == [int((v[a:b] < y).sum()) for a, b, y in zip(lo, hi, x)]
        r = (x % (hi - lo)).astype(np.int64)
        assert m.smallest(lo, hi, r).tolist() == [int(np.sort(v[a:b])[k]) for a, b, k in zip(lo, hi, r)]


def test_documents_equal_brute_force(spark, make, writer, odd_texts):
    rng = random.Random(9)
    texts = list(odd_texts) + [writer(rng, 60) for _ in range(60)]
    texts += [" ".join(f"w{x}" for x in periodic(rng, 120)) for _ in range(40)] + ["a\tb\n" * 300, "x " * 5, "x " * 6, ("r s t u " * 40) + "v w " * 9]
    texts += [texts[60]] * 3  # copies beside one another don't run over their borders
    ids = [*range(len(texts) - 2), None, None]
    got = sorted(map(tuple, runs.periodic_runs(make(texts, ids=ids, extra=True)).collect()), key=repr)
    assert got == sorted((brute_row(i, t) for i, t in zip(ids, texts)), key=repr)
    assert runs.periodic_runs(make([])).count() == 0
