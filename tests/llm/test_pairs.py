"""Decontamination and near duplicates against brute force."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from colloquy.llm import decontaminate as D
from colloquy.llm import neardup as N

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leak_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute_leaks(texts, items):
    out = []
    for t in texts:
        w, hit, who = leak_words(t), set(), set()
        for i, item in items:
            x = leak_words(item)
            n = min(10, len(x))
            windows = {tuple(x[p:p + n]) for p in range(len(x) - n + 1)} if x else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit.update(range(p, p + n))
                    who.add(str(i))
        out.append((len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


def test_leaks_equal_brute_force(spark, make, writer, odd_texts):
    rng = random.Random(1)
    items = [(i, writer(rng, rng.choice([1, 3, 9, 10, 11, 40, 60]) if i % 3 else 25)) for i in range(30)]
    items += [(30, None), (31, ""), (32, "Wörter ÜBER alles: 10 mal, ja! 10 mal nein; und so weiter, immer weiter."), (33, items[0][1])]
    texts = list(odd_texts)
    for k in range(60):
        x = items[k % 33][1] or ""
        words = x.split()
        a = rng.randint(0, max(0, len(words) - 5))
        part = " ".join(words[a:a + rng.randint(5, 30)])
        texts.append(f"{writer(rng, rng.randint(0, 30))} {part.upper() if k % 2 else part}, {writer(rng, rng.randint(0, 30))} {part if k % 5 == 0 else ''}")
    got = D.decontaminate(make(texts, extra=True), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "'b' as hash"))
    got = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    expected = brute_leaks(texts, items)
    assert got == dict(enumerate(expected))
    assert sum(x[4] for x in expected) > 20


def test_leaks_odd_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(make(["a b c"]), none).first()["contaminated"] is False
    assert D.decontaminate(make([]), none).count() == 0
    item = spark.createDataFrame([(None, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = make(["x one two three four five six seven eight nine ten y"] * 2 + ["one two"], ids=[None, None, 7])
    rows = {r["doc_id"]: r for r in D.decontaminate(docs, item).collect()}
    assert rows[None]["contaminated"] and rows[None]["n_items"] == 0 and rows[None]["n_hit"] == 10 and not rows[7]["contaminated"]
    assert D.clean(make(["x one two three four five six seven eight nine ten y", "b"], extra=True), item).count() == 1


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_groups_equal_brute_force(make, writer, odd_texts):
    rng = random.Random(2)
    texts = list(odd_texts)
    for _ in range(25):
        words = writer(rng, rng.choice([4, 5, 6, 30, 150])).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(1, 6)):  # a chain of edits: far ends are alike only by way of the middle
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"w{rng.random():.6f}"
            texts.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    got = {r["doc_id"]: tuple(r)[1:] for r in N.near_duplicates(make(texts, extra=True)).collect()}
    assert got == dict(enumerate(brute_groups(texts)))


def test_template_groups_equal_brute_force(make, writer, monkeypatch):
    """All texts share a template and are 0.72 to 0.73 alike, ten pairs 0.75 to 0.76. The rounds see small buckets only."""
    rng = random.Random(11)
    template = writer(rng, 300)
    rest = lambda n: " ".join(f"{rng.random():.9f}" for _ in range(n))
    texts = [f"{template} {rest(56)}" for _ in range(200)]
    for k in range(0, 20, 2):
        more = rest(7)
        texts[k], texts[199 - k] = f"{template} {more} {rest(49)}", f"{template} {more} {rest(49)}"
    expected = brute_groups(texts)
    assert sum(not x[2] for x in expected) == 10
    rounds = N.round_pairs
    monkeypatch.setattr(N, "round_pairs", lambda rows: rounds(rows.where(F.col("size") <= N.WHOLE)))
    monkeypatch.setattr(N, "BLOCK", 16)
    got = {r["doc_id"]: tuple(r)[1:] for r in N.near_duplicates(make(texts)).collect()}
    assert got == dict(enumerate(expected))


def test_groups_odd_tables(make):
    assert N.near_duplicates(make([])).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    # no id; an id with two texts joins what is alike to either; a repeated row
    docs = make([long, long, long + " x", other, other + " y", other + " y"], ids=[None, 3, 2, 3, 9, 9])
    rows = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect()}
    assert rows == {(None, 36): (None, True), (3, 36): (2, False), (2, 37): (2, True), (9, 37): (2, False)}


def test_decisions_hold_for_rows_without_or_with_repeated_ids(spark, make):
    leak = "one two three four five six seven eight nine ten"
    item = spark.createDataFrame([(1, leak)], "item_id long, text string")
    docs = make([f"x {leak} y", f"x {leak} z", "clean text of the same id", None, None, f"v {leak} w", "b"], ids=[None, 5, 5, None, 6, None, None], extra=True)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in D.clean(docs, item).collect()) == [
        ("5", "clean text of the same id"), ("6", ""), ("None", ""), ("None", "b")]

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "uvw")
    docs = make([a, a, a + " x", b, b, b, b + " y", c, c, None, None, ""], ids=[None, 3, 2, 3, 9, 9, None, None, None, None, None, 3], extra=True)
    kept = N.one_row_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted(
        [("2", a + " x"), ("3", b), ("None", c), ("None", ""), ("None", ""), ("3", "")])


def test_signature_agrees_as_often_as_sets_do():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    signer = N.Signer(rows=1, bands=320)
    for share in (0.5, 0.75, 0.9):
        other = base.copy()
        changed = round(len(base) * (1 - share) / (1 + share))
        other[:changed] = rng.integers(0, 2**63, changed, dtype=np.uint64)
        agree = (signer.bands_of(np.sort(base)) == signer.bands_of(np.sort(other))).mean()
        assert abs(agree - share) < 0.1


def test_components_of_chains_rings_and_stars(spark):
    order = [7, 31, 2, 19, 11, 5, 23, 13, 29, 3, 17]
    edges = list(zip(order, order[1:]))                                   # a chain
    edges += [(101, 102), (102, 103), (103, 104), (104, 101)]             # a ring
    edges += [(200, n) for n in range(201, 220)] + [(201, 200), (5, 5)]   # a star, an edge twice, a loop
    found = {(r.node, r.root) for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == ({(n, 2) for n in order if n != 2} | {(n, 101) for n in (102, 103, 104)} | {(n, 200) for n in range(201, 220)})
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0
