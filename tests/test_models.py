"""Model layer on small separable data (no SQL oracle for fits)."""
import numpy as np
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import metrics as M
from colloquy.operators import models as Mo


def blobs(spark, n=80, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = i % 2
        x = rng.normal(loc=2.5 * y, scale=0.6, size=3)
        rows.append((i, float(y), Vectors.dense(x.tolist())))
    schema = T.StructType([T.StructField("participant_id", T.LongType()), T.StructField("label", T.DoubleType()),
                           T.StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema)


def test_adaboost_separates(spark):
    df = blobs(spark)
    model = Mo.AdaBoostClassifier(n_estimators=5, learning_rate=0.5, max_depth=2).fit(df)
    out = model.transform(df)
    acc = M.accuracy(out).first()["accuracy"]
    assert acc >= 0.95 and len(model.trees) >= 1
    p = out.select(F.aggregate("probability_array", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in p)


def test_sigmoid_svc_probabilities(spark):
    df = blobs(spark)
    out = Mo.positive_probability(Mo.SigmoidSVC(max_landmarks=32).fit(df).transform(df))
    ps = [r["p1"] for r in out.select("p1").collect()]
    assert all(0.0 <= p <= 1.0 for p in ps)
    assert M.accuracy(out).first()["accuracy"] >= 0.85


def test_grid_search_and_persistence(spark, tmp_path):
    df = blobs(spark)
    cv = Mo.grid_search(Mo.logistic(1.0, n_rows=80), {"regParam": [0.01, 1.0]}, M.MacroF1Evaluator(), folds=2).fit(df)
    assert len(cv.avgMetrics) == 2
    model = Mo.fit_pipeline([Mo.decision_tree(max_depth=2)], df)
    path = Mo.save_model(model, "t_tree", spark)
    a = [r["prediction"] for r in model.transform(df).orderBy("participant_id").collect()]
    b = [r["prediction"] for r in Mo.load_model(path).transform(df).orderBy("participant_id").collect()]
    assert a == b


def test_importance_selection(spark):
    df = blobs(spark)
    rf = Mo.random_forest(num_trees=10, max_depth=3).fit(df)
    keep = Mo.important_features(rf, ["a", "b", "c"], threshold=0.0)
    assert {k for k, _ in keep} <= {"a", "b", "c"} and keep
    sl = Mo.select_features(["a", "b", "c"], [keep[0][0]]).transform(df)
    assert sl.first()["selected"].size == 1


def test_composite_models_are_saved_within_pipelines(spark):
    from pyspark.ml import PipelineModel

    df = blobs(spark)
    vote = Mo.SoftVote([Mo.random_forest(5, 2), Mo.gradient_boosting(3, 2)], weights=[2, 1])
    for name, est in {"ada": Mo.AdaBoostClassifier(4, 0.5, max_depth=1, balanced_trees=True), "svm": Mo.SigmoidSVC(max_landmarks=16), "vote": vote}.items():
        model = est.fit(df)
        back = Mo.load_model(Mo.save_model(PipelineModel([model]), f"t_{name}", spark))
        a, b = ([tuple(r) for r in Mo.positive_probability(m.transform(df)).select("participant_id", "prediction", "p1").orderBy("participant_id").collect()]
                for m in (model, back))
        assert a == b and type(back.stages[0]) is type(model) and back.stages[0].uid == model.uid
        if name == "vote":  # the mean of the members' probabilities, by weight
            p = [[r["p1"] for r in Mo.positive_probability(m.transform(df)).orderBy("participant_id").collect()] for m in model.models]
            assert np.allclose([x[2] for x in a], (2 * np.array(p[0]) + np.array(p[1])) / 3)


def test_logistic_search_equals_separate_fits(spark):
    from colloquy.operators import search as Se
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3))
    y = (x @ [1.5, -1, 0] + rng.normal(size=150) * 1.5 > 0.8).astype(float)
    rows = [(i, float(y[i]), Vectors.dense(x[i].tolist())) for i in range(150)]
    df = spark.createDataFrame(rows, blobs(spark, 2).schema).repartition(3)
    points = [Se.Point(c, balanced, intercept, n) for c in (0.05, 2.0) for balanced in (True, False) for intercept in (True, False) for n in (1, 50)]
    found = Se.logistic_search(df, points, "participant_id", folds=3)
    assert [f.point for f in found] == points
    folds = {r["i"]: r["fold"] for r in folds_of(df)}
    for f in found:
        p = f.point
        if p.max_iter == 1:
            continue

        def fit(keep):
            t = df.where(F.col("participant_id").isin(keep))
            n1 = sum(y[i] for i in keep)
            w = F.when(F.col("label") == 1, len(keep) / (2 * n1)).otherwise(len(keep) / (2 * (len(keep) - n1))) if p.balanced else F.lit(1.0)
            t = t.withColumn("w", w)
            total = t.agg(F.sum("w")).first()[0]
            m = LogisticRegression(regParam=1 / (p.c * total), standardization=False, fitIntercept=p.intercept, weightCol="w", tol=1e-12, maxIter=500).fit(t)
            return np.append(m.coefficients.toArray(), m.intercept)

        if p.c == 2.0 and p.balanced:
            assert np.allclose(f.coefficients, fit(list(range(150))), atol=1e-4)
            acc = []
            for k in range(3):
                w = fit([i for i in folds if folds[i] != k])
                test = [i for i in folds if folds[i] == k]
                acc.append(np.mean([(x[i] @ w[:3] + w[3] > 0) == y[i] for i in test]))
            assert abs(np.mean(acc) - f.accuracy) < 1e-9


def folds_of(df):
    from colloquy.operators import features as Fe

    return Fe.hash_rank(df, ["label"], "participant_id").select(F.col("participant_id").alias("i"), (F.col("_rank") % 3).alias("fold")).collect()


def test_large_forest_grows_in_stored_groups(spark):
    from pyspark.ml.classification import RandomForestClassificationModel
    df = blobs(spark)
    whole = Mo.Forest(7, 4).fit(df)
    assert isinstance(whole, RandomForestClassificationModel) and len(whole.trees) == 7  # a small forest is Spark's own
    model = Mo.Forest(7, 4, tree_rows=32 * 3).fit(df)  # 32 nodes bound a tree: three trees at once
    assert model.sizes == [3, 3, 1] and abs(sum(model.importances) - 1) < 1e-9
    groups = [RandomForestClassificationModel.load(p) for p in model.paths]
    assert [len(g.trees) for g in groups] == [3, 3, 1]
    out = {r["participant_id"]: r for r in model.transform(df).collect()}
    votes = [{r["participant_id"]: r["probability"].toArray() for r in g.transform(df).collect()} for g in groups]
    for i, r in out.items():
        p = (3 * votes[0][i] + 3 * votes[1][i] + votes[2][i]) / 7
        assert np.allclose(p, r["probability"].toArray()) and r["prediction"] == float(p[1] > p[0])
    again = Mo.load_model(Mo.save_model(Mo.PipelineModel([model]), "t_forest", spark))
    assert {r["participant_id"]: r["probability"] for r in again.transform(df).collect()} == {i: r["probability"] for i, r in out.items()}
    assert len(out) == 80 and "_votes" not in model.transform(df).columns
