"""Blocked windows equal plain windows; runs and running indicators (FIXTURES D)."""
import random
import re
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import dialogue as D
from colloquy.operators import running as R
from colloquy.operators.sequence import dense_ordinal, prefix_sums, previous_values


def test_blocked_equals_plain(spark):
    rnd = random.Random(7)
    rows = [(g, i, rnd.randint(-5, 5)) for g in range(3) for i in range(0, 200, rnd.choice([1, 2]))]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = prefix_sums(df, ["g"], "o", ["v"], block=7)
    got = previous_values(got, ["g"], "o", ["v"], block=5)
    got = dense_ordinal(got, ["g"], ["o"], out="ord", block=3)
    w = Window.partitionBy("g").orderBy("o")
    ref = df.select("g", "o", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v_cum"),
                    F.lag("v").over(w).alias("prev_v"), (F.row_number().over(w) - 1).alias("ord"))
    a = sorted(tuple(r) for r in got.select("g", "o", "v_cum", "prev_v", "ord").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_speaker_runs(spark):
    t = spark.createDataFrame([(1, i, s, f"t{i}") for i, s in enumerate([1, 1, 2, 2, 2, 1])],
                              "conv_id long, turn long, speaker int, text string")
    runs = D.merge_runs(t).orderBy("run_id").collect()
    assert [r["speaker"] for r in runs] == [1, 2, 1]
    assert runs[1]["text"] == "t2 t3 t4"


def test_running_hapax_and_difference(spark):
    t = spark.createDataFrame([(1, 0, 2, "k m."), (1, 1, 2, "m n."), (1, 2, 2, "k.")],
                              "conv_id long, turn long, speaker int, text string")
    emo = spark.createDataFrame([("qqq", 0, 0, 0, 0, 0, 0, 0)],
                                "word string, joy int, fear int, sadness int, anger int, surprise int, disgust int, line_no long")
    units = spark.createDataFrame([("qqq",)], "unit string")
    c = R.session_counters(t, emo, units)
    cum = prefix_sums(c, ["conv_id"], "turn", ["hapax", "n_doc"]).orderBy("turn").collect()
    assert [r["hapax_cum"] for r in cum] == [2, 2, 1]
    # N counts punctuation too: "k m ." → 3, "m n ." → 6, "k ." → 8
    assert [r["n_doc_cum"] for r in cum] == [3, 6, 8]
    lv = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 1, 0.7), (1, 2, 2, 0.4)], "conv_id long, phrase long, turn long, TTR double")
    d = R.differences(lv, ["TTR"]).orderBy("phrase").collect()
    assert [round(r["delta_TTR"], 10) for r in d] == [0.5, 0.2, -0.3]


def test_fused_scan_equals_the_whole_text_of_each_prefix(spark):
    """Levels and differences, over small blocks, against counting on every prefix of the session."""
    rnd = random.Random(5)
    words = "k m n the not marchait gehen dog".split()
    said = {c: [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) + rnd.choice([".", "! ", "? more."]) for _ in range(23)] for c in (1, 2)}
    said[3] = ["dog."]
    rows = [(c, 2 * i, 2, t) for c, ts in said.items() for i, t in enumerate(ts)] + [(1, 1, 1, "ignored clinician words.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, speaker int, text string")
    emo = spark.createDataFrame([("k", 1, 0, 0, 0, 0, 0, 0), ("dog", 0, 1, 1, 0, 0, 0, 1), ("k", 0, 1, 0, 0, 0, 0, 2)],
                                "word string, joy int, fear int, sadness int, anger int, surprise int, disgust int, line_no long")
    units = spark.createDataFrame([("m",), ("not",)], "unit string")
    got = {(r["conv_id"], r["phrase"]): r for r in
           R.running_levels(R.session_counters(turns, emo, units), with_differences=True, block=3).collect()}
    phr = {(r["conv_id"], r["phrase"]): r["text"] for r in R.phrases(turns).collect()}
    assert sorted(got) == sorted(phr)
    before = {}
    for (c, p), text in sorted(phr.items()):
        seen = " ".join(phr[(c, q)] for q in range(p + 1))
        tokens = re.findall(r"\w+|[^\w\s]", seen)
        plain = [t for t in tokens if t.isalnum()]
        count = Counter(t for t in plain if t not in ("the", "not"))
        verbs = [t for t in plain if t in ("marchait", "more")]  # a finite form, and one that reads as an infinitive
        level = {"TTR": sum(n == 1 for n in count.values()) / len(tokens), "adv_rates": plain.count("not") / len(plain),
                 "verb_conj_rate": verbs.count("marchait") / len(verbs) if verbs else 0.0, "total_concept_density": sum(t in ("m", "not") for t in plain) / len(plain),
                 "joy_rate": plain.count("k") / len(plain), "fear_rate": plain.count("dog") / len(plain), "anger_rate": 0.0}
        for s, x in level.items():
            assert abs(got[(c, p)][s] - x) < 1e-9, (c, p, s)
            assert abs(got[(c, p)][f"delta_{s}"] - (x - before[s] if p else x)) < 1e-9, (c, p, s)
        before = level


def test_fused_scan_has_few_exchanges(spark):
    c = spark.createDataFrame([(1, 0, 0, *[1] * len(R.COUNTERS))], "conv_id long, turn long, pos int, " + ", ".join(f"{x} long" for x in R.COUNTERS))
    p = R.running_levels(c, with_differences=True)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") < 6


def test_casenote_layout(spark):
    sents = spark.createDataFrame([(1, 0, "Hello there."), (1, 1, "I sleep badly.")], "conv_id long, ordinal long, sentence string")
    notes = spark.createDataFrame([(1, 0, 1, "sleep issue", 1), (1, 1, 0, "greets", 0), (1, 2, 1, "x", 99)],
                                  "conv_id long, elem_id long, categoryId int, formalText string, sourceId long")
    note = D.casenote_text(notes, sents).first()["note"]
    assert note == "Client Details:\n\ngreets\n\nChief Complaint:\n\nsleep issue\n\n"
    assert D.unmatched_elements(notes, sents).count() == 1
    src = D.casenote_text(notes, sents, include_source=True).first()["note"]
    assert '"I sleep badly." => sleep issue' in src


def test_running_text_blocked(spark):
    phr = spark.createDataFrame([(1, i, i, f"p{i}.") for i in range(7)] + [(2, 0, 0, "q0.")],
                                "conv_id long, phrase long, turn long, text string")
    got = {(r["conv_id"], r["phrase"]): r["texte"] for r in R.running_text(phr, block=3).collect()}
    assert got[(1, 0)] == "p0." and got[(1, 6)] == " ".join(f"p{i}." for i in range(7))
    assert got[(1, 4)] == "p0. p1. p2. p3. p4." and got[(2, 0)] == "q0."


def test_quantile_blocks_split_clusters_and_quantiles_are_exact(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from colloquy.operators.features import exact_quantiles
    from colloquy.operators.sequence import quantile_blocks

    rng = np.random.default_rng(4)
    near = (0.5 + rng.random(900) * 1e-6).tolist()      # nine values in ten within 1e-6
    rows = [("a", v) for v in near + rng.random(100).tolist()] + [("b", float(v)) for v in rng.integers(0, 3, 50)] + [(None, 1.5), ("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    b = quantile_blocks(df.where("k = 'a' and v is not null"), ["k"], "v", "blk", blocks=64)
    sizes = [r["count"] for r in b.groupBy("blk").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 60 and max(sizes) <= 2 * 1000 / 64
    spans = sorted((r["lo"], r["hi"]) for r in b.groupBy("blk").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
    assert set(got) == {"a", "b", None}
    for k in got:
        values = [v for x, v in rows if x == k and v is not None]
        assert np.allclose([got[k][c] for c in ("min", "q1", "m", "q3", "max")], np.quantile(values, [0, 0.25, 0.5, 0.75, 1]), rtol=0, atol=1e-12)
