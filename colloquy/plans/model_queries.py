"""Named queries of the model layer (rows-only checks; pytest covers the semantics).

Training data: the participant features (stored-JSON indicators of the labelled documents),
split 3 = train and 1 = test, missing values filled with train means, z-scored with the
population deviation. The feature frame is checkpointed once into the shared checkpoint
folder because every fit runs many jobs over it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import features as Fe
from colloquy.operators import metrics as M
from colloquy.operators import models as Mo
from colloquy.operators import sampling as Sm
from colloquy.operators import search as Se
from colloquy.operators.indicators import INDICATOR_COLUMNS
from colloquy.plans.feature_queries import _features
from colloquy.plans.registry import register, rounded
from colloquy.session import cut_lineage


NUMERIC = INDICATOR_COLUMNS


def frames(spark, sf, train_split: int = 3, test_split: int = 1):
    """(train, test) with ``features`` vector, ``label`` double and ``participant_id``."""
    f = cut_lineage(_features(spark, sf))
    train, test = f.filter(F.col("partof") == train_split), f.filter(F.col("partof") == test_split)
    means = Fe.column_stats(train, NUMERIC)
    train_f, test_f = Fe.fill_means(train, means), Fe.fill_means(test, means)
    scale = Fe.column_stats(train_f, NUMERIC)

    def prep(d: DataFrame) -> DataFrame:
        z = Fe.zscore(d, scale)
        return Fe.assemble(NUMERIC).transform(z).select(
            "participant_id", F.col("phq_binary").cast("double").alias("label"), "features")
    return prep(train_f), prep(test_f)


def indicator_stages(train: DataFrame) -> list:
    """Pipeline stages from raw indicators to ``features``: means and population deviations of the training rows are
    part of the first stage, so a saved pipeline scores any rows as it would the training rows."""
    means = Fe.column_stats(train, NUMERIC)
    scale = Fe.column_stats(Fe.fill_means(train, means), NUMERIC)

    def z(c: str) -> str:
        (fill, _), (mean, std) = means[c], scale[c]
        if fill is None or not std:
            return f"0D AS z_{c}"
        return f"(coalesce(CAST({c} AS DOUBLE), {fill!r}D) - ({mean!r}D)) / {std!r}D AS z_{c}"

    return [SQLTransformer(statement=f"SELECT *, {', '.join(z(c) for c in NUMERIC)} FROM __THIS__"), Fe.assemble([f"z_{c}" for c in NUMERIC])]


def session_models(spark, sf, prefix: str):
    """The five classifiers of a session (AdaBoost, boosting, logistic regression, SVM, vote), fitted on the training
    split at full size, saved as pipelines with their scaling and loaded back: ``({name: model}, raw test rows)``."""
    f = cut_lineage(_features(spark, sf))
    train = f.filter(F.col("partof") == 3)
    stages = indicator_stages(train)
    ready = cut_lineage(PipelineModel(stages).transform(train).select("participant_id", F.col("phq_binary").cast("double").alias("label"), "features"))
    n = ready.count()
    weighted = Fe.balanced_weights(ready, "label")
    makers = {
        "adaboost": (Mo.AdaBoostClassifier(balanced_trees=True), ready),
        "boosting": (Mo.gradient_boosting(), ready),
        "logistic": (Mo.logistic(1.0, n_rows=n), ready),
        "svm": (Mo.SigmoidSVC(), ready),
        "voting": (Mo.SoftVote([Mo.sampled_boosting(max_iter=5, max_depth=3, weight_col="weight"),
                                Mo.random_forest(max_depth=1, weight_col="weight")]), weighted)}

    def stored(name: str):
        est, rows = makers[name]
        return Mo.load_model(Mo.save_model(PipelineModel([*stages, est.fit(rows)]), f"{prefix}_{name}", spark))

    return dict(zip(makers, Mo.each([lambda name=name: stored(name) for name in makers]))), f.filter(F.col("partof") == 1)


def long_predictions(models: dict, rows: DataFrame, key: str) -> DataFrame:
    """One row for each model and scored row."""
    out = None
    for name, model in models.items():
        scored = model.transform(rows).select(F.lit(name).alias("model"), key, F.col("prediction").cast("double").alias("prediction"))
        out = scored if out is None else out.unionByName(scored)
    return out


def _scored(model, test: DataFrame, name: str | None = None) -> DataFrame:
    out = Mo.positive_probability(model.transform(test))
    cols = ["participant_id", "label", "prediction", F.round("p1", 6).alias("p1")]
    if name:
        cols.insert(0, F.lit(name).alias("model"))
    return out.select(*cols)


@register("m10")
def q_m10(spark, sf):
    """Random forest (100 trees) trained on split 3, scored on split 1."""
    train, test = frames(spark, sf)
    return _scored(Mo.random_forest().fit(train), test)


@register("p18")
def q_p18(spark, sf):
    """Indicators whose forest importance is at least 0.02."""
    train, _ = frames(spark, sf)
    keep = Mo.important_features(Mo.random_forest().fit(train), NUMERIC)
    return spark.createDataFrame(keep, "feature string, importance double")


@register("m11")
def q_m11(spark, sf):
    """Decision tree of depth 3 (split roles swapped: train 1, test 3)."""
    train, test = frames(spark, sf, train_split=1, test_split=3)
    return _scored(Mo.decision_tree().fit(train), test)


@register("m12")
def q_m12(spark, sf):
    """Gradient boosting 100 × depth 3, plain and with balanced sample weights."""
    train, test = frames(spark, sf)
    wtrain = Fe.balanced_weights(train, "label")
    plain_m, weighted_m = Mo.each([lambda: Mo.gradient_boosting().fit(train),
                                        lambda: Mo.gradient_boosting(weight_col="weight").fit(wtrain)])
    return _scored(plain_m, test, "plain").unionByName(_scored(weighted_m, test, "weighted"))


@register("m13")
def q_m13(spark, sf):
    """AdaBoost (SAMME, 50 rounds, rate 0.01) over full trees: raw data with balanced trees, SMOTE and ADASYN data."""
    train, test = frames(spark, sf)
    return _variants(train, test, lambda v: Mo.AdaBoostClassifier(balanced_trees=v == "raw"))


@register("m14")
def q_m14(spark, sf):
    """Sigmoid-kernel SVM (C = 7, γ = 0.3) with calibrated probabilities."""
    train, test = frames(spark, sf)
    return _scored(Mo.SigmoidSVC().fit(train), test)


@register("m15")
def q_m15(spark, sf):
    """Logistic regression with the C → regParam mapping."""
    train, test = frames(spark, sf)
    return _scored(Mo.logistic(1.0, n_rows=train.count()).fit(train), test)


@register("m16")
def q_m16(spark, sf):
    """Second boosting engine with row/column sampling and balanced weights."""
    train, test = frames(spark, sf)
    wtrain = Fe.balanced_weights(train, "label")
    est = Mo.sampled_boosting(max_iter=100, subsample=0.8, col_sample="0.8", weight_col="weight")
    return _scored(est.fit(wtrain), test)


# fixed values: the searched axes that change the optimum
PENALTIES = [0.001, 0.01, 0.1, 1, 2, 5, 10, 100]
ITERATIONS = [10, 100, 200, 500, 1000]


@register("m18")
def q_m18(spark, sf):
    """Logistic search: 160 points (C, class weights, intercept, iterations) x 5 stratified folds in shared scans."""
    train = cut_lineage(frames(spark, sf)[0])
    points = [Se.Point(float(c), balanced, intercept, n) for c in PENALTIES for balanced in (True, False)
              for intercept in (True, False) for n in ITERATIONS]
    found = Se.logistic_search(train, points, "participant_id")
    best = max(found, key=lambda f: f.accuracy)
    rows = [(f.point.c, f.point.balanced, f.point.intercept, f.point.max_iter, f.accuracy, f.f1_macro, f is best) for f in found]
    return rounded(spark.createDataFrame(rows, "c double, balanced boolean, fit_intercept boolean, max_iter int, accuracy double, f1_macro double, best boolean"))


def _resampled(train: DataFrame, how: str) -> DataFrame:
    if how == "raw":
        return train
    arr = train.select("participant_id", "label", vector_to_array("features").alias("vec"))
    fn = Sm.smote if how == "smote" else Sm.adasyn
    out = fn(arr, "participant_id", "vec", "label")
    return out.select(F.col("participant_id"), "label", array_to_vector("vec").alias("features"))


VARIANTS = ("raw", "smote", "adasyn")


def _variant_models(train: DataFrame, make) -> dict:
    """A model of each resampled training set; a set's model is fitted while the next sets are still being resampled."""
    return dict(zip(VARIANTS, Mo.each([lambda v=v: make(v).fit(cut_lineage(_resampled(train, v))) for v in VARIANTS])))


def _variants(train: DataFrame, test: DataFrame, make) -> DataFrame:
    """Scores of the test rows by a model of each resampled training set."""
    out = None
    for v, model in _variant_models(train, make).items():
        scored = _scored(model, test).withColumn("variant", F.lit(v))
        out = scored if out is None else out.unionByName(scored)
    return out


def variant_report(models: dict, test: DataFrame) -> DataFrame:
    """Report and AUC of each model. The report reads predictions in many places: each model scores the test rows once,
    and one report has the models as its key."""
    out = None
    for variant, model in models.items():
        scored = Mo.positive_probability(model.transform(test)).select(F.lit(variant).alias("variant"), "label", "prediction", "p1")
        out = scored if out is None else out.unionByName(scored)
    scored = cut_lineage(out)
    conf = cut_lineage(M.confusion(scored, keys=["variant"]))
    rep = M.classification_report(conf, keys=["variant"])
    return rep.join(M.roc_auc(scored, score="p1", keys=["variant"]), "variant")


@register("m24")
def q_m24(spark, sf):
    """Gradient boosting on raw, SMOTE and ADASYN training data, one report table."""
    train, test = frames(spark, sf)
    return rounded(variant_report(_variant_models(train, lambda v: Mo.gradient_boosting()), test))


@register("m25")
def q_m25(spark, sf):
    """Five persisted models (AdaBoost, boosting, logistic, SVM, vote) loaded back and applied to the test rows (long form)."""
    models, test = session_models(spark, sf, "m25")
    return long_predictions(models, test, "participant_id").join(
        test.select("participant_id", F.col("phq_binary").cast("double").alias("expected")), "participant_id")


@register("k7")
def q_k7(spark, sf):
    """Model persistence round trip: a saved and reloaded forest (100 trees) gives the same predictions."""
    train, test = frames(spark, sf)
    model = Mo.fit_pipeline([Mo.random_forest()], train)
    path = Mo.save_model(model, "k7_forest", spark)
    a = model.transform(test).select("participant_id", F.col("prediction").alias("before"))
    b = Mo.load_model(path).transform(test).select("participant_id", F.col("prediction").alias("after"))
    return a.join(b, "participant_id")
