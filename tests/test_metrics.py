"""Evaluation metrics: the six published confusion matrices are test vectors (BASELINE)."""
import pytest

from colloquy.operators import features as Fe
from colloquy.operators import metrics as M

# fixed values: published matrices [[tn, fp], [fn, tp]] and printed scores
# (precision0, recall0, f1_0, precision1, recall1, f1_1, accuracy, macro P, macro R, macro F1, weighted P, weighted R, weighted F1)
CASES = [
    ([[33, 6], [15, 2]], (0.69, 0.85, 0.76, 0.25, 0.12, 0.16, 0.62, 0.47, 0.48, 0.46, 0.55, 0.62, 0.58)),
    ([[25, 14], [11, 6]], (0.69, 0.64, 0.67, 0.30, 0.35, 0.32, 0.55, 0.50, 0.50, 0.50, 0.57, 0.55, 0.56)),
    ([[31, 8], [14, 3]], (0.69, 0.79, 0.74, 0.27, 0.18, 0.21, 0.61, 0.48, 0.49, 0.48, 0.56, 0.61, 0.58)),
    ([[39, 0], [17, 0]], (0.70, 1.00, 0.82, 0.00, 0.00, 0.00, 0.70, 0.35, 0.50, 0.41, 0.49, 0.70, 0.57)),
    ([[0, 39], [0, 17]], (0.00, 0.00, 0.00, 0.30, 1.00, 0.47, 0.30, 0.15, 0.50, 0.23, 0.09, 0.30, 0.14)),
]


def rows_of(matrix):
    out = []
    for label, row in enumerate(matrix):
        for pred, n in enumerate(row):
            out += [(label, pred)] * n
    return out


@pytest.mark.parametrize("matrix,expected", CASES)
def test_printed_scores(spark, matrix, expected):
    df = spark.createDataFrame(rows_of(matrix), "label int, prediction int")
    conf = M.confusion(df)
    rep = {r["row"]: r for r in M.classification_report(conf, zero_division=0).collect()}
    got = (rep["0"]["precision"], rep["0"]["recall"], rep["0"]["f1"], rep["1"]["precision"], rep["1"]["recall"],
           rep["1"]["f1"], rep["accuracy"]["f1"], rep["macro avg"]["precision"], rep["macro avg"]["recall"],
           rep["macro avg"]["f1"], rep["weighted avg"]["precision"], rep["weighted avg"]["recall"], rep["weighted avg"]["f1"])
    assert tuple(float(f"{x:.2f}") for x in got) == expected
    cells = {(r["label"], r["prediction"]): r["n"] for r in conf.collect()}
    assert cells == {(i, j): matrix[i][j] for i in range(2) for j in range(2)}


def test_auc_ties_and_ranks(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "label int, score double")
    assert M.roc_auc(tied).first()["roc_auc"] == 0.5
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert M.roc_auc(df).first()["roc_auc"] == 0.75


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    w = {r["label"]: r["weight"] for r in Fe.balanced_weights(df, "label").collect()}
    assert abs(w[0] - 4 / 6) < 1e-12 and abs(w[1] - 4 / 2) < 1e-12


def test_macro_f1_evaluator_and_vote(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows_of([[33, 6], [15, 2]])], "label double, prediction double")
    assert round(M.MacroF1Evaluator().evaluate(df), 2) == 0.46
    p = spark.createDataFrame([(1, [0.8, 0.2], [0.4, 0.6])], "id int, a array<double>, b array<double>")
    v = M.soft_vote(p, ["a", "b"]).first()
    assert v["prediction"] == 0 and abs(v["probability"][1] - 0.4) < 1e-12


def test_auc_equals_spark_evaluator(spark):
    import random
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    rnd = random.Random(5)
    rows = [(int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(400)]     # many ties
    df = spark.createDataFrame(rows, "label int, score double")
    ours = M.roc_auc(df).first()["roc_auc"]
    raw = df.select(F.col("label").cast("double").alias("label"),
                    array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("rawPrediction"))
    theirs = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(raw)
    assert abs(ours - theirs) < 1e-9
