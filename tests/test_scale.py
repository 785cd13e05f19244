"""Steps that grow with the input alone: gloss without the text on its tokens, each pair of blocks once, one state write a batch."""
import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import dialogue as D
from colloquy.operators import sampling as Sm
from colloquy.streaming import session as St


def test_gloss_keeps_every_token_in_place(spark):
    turns = spark.createDataFrame([(1, 0, "Un mot, un MOT."), (1, 1, "Un mot, un MOT."), (2, 0, ""), (2, 1, None), (3, 0, "rien")],
                                  "conv_id long, turn long, text string")
    lexicon = spark.createDataFrame([("mot", "word"), ("un", "b"), ("un", "a"), ("x", "y"), ("rien", None)], "word string, target string")
    got = {(r[0], r[1]): r[2] for r in D.gloss(turns, "text", lexicon).select("conv_id", "turn", "traduit").collect()}
    assert got == {(1, 0): "a b word , a b word .", (1, 1): "a b word , a b word .", (2, 0): "", (2, 1): "", (3, 0): "rien"}


def test_gloss_shuffles_no_text_with_a_token(spark):
    turns = spark.createDataFrame([(1, 0, "a b")], "conv_id long, turn long, text string")
    lexicon = spark.createDataFrame([("a", "z")], "word string, target string")
    plan = D.gloss(turns, "text", lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Generate inline") == 1     # (id, word, places) only


def test_each_pair_of_blocks_is_compared_once(spark):
    rng = np.random.default_rng(7)
    vec = {i: rng.normal(size=5).round(1) for i in range(90)}          # rounded: many equal distances
    vec[88], vec[89] = vec[0], vec[0]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vec.items()], "id long, vec array<double>")
    nn = Sm.knn(df, "id", "vec", 4, block_rows=16)
    got = {(r["id"], r["rank"]): r["nid"] for r in nn.collect()}
    for i in vec:
        best = sorted((float(((vec[i] - vec[j]) ** 2).cumsum()[-1]), j) for j in vec if j != i)
        assert [got[(i, r)] for r in range(4)] == [j for _, j in best[:4]]
    assert "_bi" in nn._jdf.queryExecution().optimizedPlan().toString()
    assert nn._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1     # one row for each pair of its block


def test_a_phrase_is_one_row_and_its_known_words(spark):
    phr = spark.createDataFrame([(1, 0, 0, "2024-01-01 00:00:00", "Joy and joy and pain."), (1, 1, 2, "2024-01-01 00:01:00", "")],
                                "conv_id long, phrase long, turn long, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    emo = spark.createDataFrame([("joy", 1, 0, 0, 0, 0, 0, 1)], "word string, joy int, fear int, sadness int, anger int, surprise int, disgust int, line_no long")
    units = spark.createDataFrame([("pain",)], "unit string")
    rows = St.phrase_events(phr, emo, units).collect()
    assert sorted((r["phrase"], r["words"] is not None, r["n_doc"], r["joy"], r["n_units"]) for r in rows) == [
        (0, False, 0, 0, 1), (0, False, 0, 1, 0), (0, False, 0, 1, 0), (0, True, 6, 0, 0), (1, True, 0, 0, 0)]


def test_adasyn_searches_all_rows_once(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, int(i % 4 == 0), [float(x) for x in rng.normal(size=3)]) for i in range(60)], "id long, cls int, vec array<double>")
    searches = []
    for sampler in (Sm.smote, Sm.adasyn):
        out = sampler(df, "id", "vec", "cls", k=3)
        searches.append(out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas"))
        assert out.filter("synthetic").count() > 0
    assert searches[0] == searches[1]      # what is left in the plan is the search within the minority, as in SMOTE


def test_adasyn_of_a_null_minority_searches_nothing(spark):
    rows = [(i, None if i < 3 else i % 2, [float(i)] * (1 + i % 2)) for i in range(20)]       # vectors of two lengths
    out = Sm.adasyn(spark.createDataFrame(rows, "id long, cls int, vec array<double>"), "id", "vec", "cls")
    assert out.count() == 20 and out.filter("synthetic").count() == 0


def test_variant_report_scores_once_and_equals_separate_reports(spark):
    from colloquy.operators import metrics as M
    from colloquy.plans import model_queries as Q

    class Scorer:
        """Counts the rows that it scores."""
        def __init__(self, cut):
            self.cut, self.seen = cut, spark.sparkContext.accumulator(0)

        def transform(self, df):
            cut, seen = self.cut, self.seen

            def score(x):
                seen.add(1)
                return [1 - x, x]
            p = df.withColumn("probability_array", F.udf(score, "array<double>")("x"))
            return p.withColumn("prediction", (F.col("probability_array")[1] > cut).cast("double"))

    rng = np.random.default_rng(12)
    test = spark.createDataFrame([(float(i % 3 == 0), float(round(x, 2))) for i, x in enumerate(rng.random(50))], "label double, x double").repartition(3)
    models = {"a": Scorer(0.5), "b": Scorer(0.9), "c": Scorer(2.0)}      # c predicts one class only
    got = sorted(map(tuple, Q.variant_report(models, test).collect()), key=str)
    assert [m.seen.value for m in models.values()] == [50, 50, 50]
    want = []
    for v, m in models.items():
        scored = m.transform(test).withColumn("p1", F.col("probability_array")[1]).withColumn("variant", F.lit(v))
        rep = M.classification_report(M.confusion(scored, keys=["variant"]), keys=["variant"])
        want += map(tuple, rep.join(M.roc_auc(scored, score="p1", keys=["variant"]), "variant").collect())
    assert got == sorted(want, key=str) and len(got) == 15
