"""Named queries of the evaluation metrics, on scores derived from the ``labels`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import md5_int, md5_int_sql
from colloquy.operators import metrics as M
from colloquy.plans.registry import register, rounded, rsql
from colloquy.sources import tables as S

MODELS = {"fine": 1000, "coarse": 10}       # score resolution of the two stand-in models


def predictions(spark, sf) -> DataFrame:
    """``(model, doc_id, label, score, prediction)``: scores from md5 of (id, model)."""
    lab = S.read(spark, sf, "labels", "doc_id", "toxic")
    out = None
    for name, res in MODELS.items():
        s = (md5_int(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(name))) % res) / F.lit(float(res))
        p = lab.select(F.lit(name).alias("model"), "doc_id", F.col("toxic").alias("label"), s.alias("score"))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


PRED_SQL = "preds AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, doc_id, toxic AS label, ({md5_int_sql(f'CAST(doc_id AS VARCHAR) || {chr(39)}:{n}{chr(39)}')} % {r}) / {float(r)} AS score FROM labels"
    for n, r in MODELS.items()) + "), pr AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM preds)"
CONF_SQL = (PRED_SQL + ", cls AS (SELECT DISTINCT model, label AS c FROM pr UNION SELECT DISTINCT model, prediction FROM pr), "
            "cnt AS (SELECT model, label, prediction, count(*) AS n FROM pr GROUP BY 1, 2, 3), "
            "conf AS (SELECT a.model, a.c AS label, b.c AS prediction, coalesce(cnt.n, 0) AS n FROM cls a JOIN cls b USING (model) "
            "LEFT JOIN cnt ON cnt.model = a.model AND cnt.label = a.c AND cnt.prediction = b.c)")
PC_SQL = (CONF_SQL + ", tp AS (SELECT model, label AS cls, n AS tp FROM conf WHERE label = prediction), "
          "sup AS (SELECT model, label AS cls, sum(n) AS support FROM conf GROUP BY 1, 2), "
          "prd AS (SELECT model, prediction AS cls, sum(n) AS predicted FROM conf GROUP BY 1, 2), "
          "pc0 AS (SELECT model, cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
          "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM tp JOIN sup USING (model, cls) JOIN prd USING (model, cls)), "
          "pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc0)")


@register("m19", "WITH " + CONF_SQL + " SELECT model, label, prediction, n FROM conf")
def q_m19(spark, sf):
    """Confusion counts per model, zero cells included."""
    return M.confusion(predictions(spark, sf), keys=["model"])


@register("m20", "WITH " + PC_SQL + ", acc AS (SELECT model, sum(CASE WHEN label = prediction THEN n ELSE 0 END) / sum(n) AS a, "
          "sum(n) AS n FROM conf GROUP BY 1) "
          f"SELECT model, CAST(cls AS VARCHAR) AS row, {rsql('precision')} AS precision, {rsql('recall')} AS recall, {rsql('f1')} AS f1, "
          "CAST(support AS BIGINT) AS support FROM pc UNION ALL "
          f"SELECT model, 'macro avg', {rsql('avg(precision)')}, {rsql('avg(recall)')}, {rsql('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM pc GROUP BY model UNION ALL "
          f"SELECT model, 'weighted avg', {rsql('sum(precision * support) / sum(support)')}, {rsql('sum(recall * support) / sum(support)')}, "
          f"{rsql('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM pc GROUP BY model UNION ALL "
          f"SELECT model, 'accuracy', NULL, NULL, {rsql('a')}, CAST(n AS BIGINT) FROM acc")
def q_m20(spark, sf):
    """Classification report per model (zero_division = 0)."""
    conf = M.confusion(predictions(spark, sf), keys=["model"])
    return rounded(M.classification_report(conf, keys=["model"]))


@register("m21", "WITH " + PRED_SQL + f" SELECT model, {rsql('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pr GROUP BY model")
def q_m21(spark, sf):
    """Accuracy per model."""
    return rounded(M.accuracy(predictions(spark, sf), keys=["model"]))


@register("m22", "WITH " + PRED_SQL + ", rk AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + "
          "(count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM pr), "
          "ag AS (SELECT model, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rs, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, "
          "sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS n FROM rk GROUP BY model) "
          f"SELECT model, {rsql('(rs - p * (p + 1) / 2.0) / (p * n)')} AS roc_auc FROM ag")
def q_m22(spark, sf):
    """ROC AUC per model by rank sum with averaged ties."""
    return rounded(M.roc_auc(predictions(spark, sf), keys=["model"]))


@register("m23", "WITH " + PC_SQL + f" SELECT model, {rsql('avg(f1)')} AS f1_macro FROM pc GROUP BY model")
def q_m23(spark, sf):
    """Macro F1 per model (the grid-search score)."""
    conf = M.confusion(predictions(spark, sf), keys=["model"])
    return rounded(M.macro_f1(conf, keys=["model"]))


@register("m17", "WITH " + PRED_SQL + ", w AS (SELECT doc_id, max(CASE WHEN model = 'fine' THEN score END) AS s1, "
          "max(CASE WHEN model = 'coarse' THEN score END) AS s2 FROM pr GROUP BY doc_id) "
          f"SELECT doc_id, {rsql('(s1 + s2) / 2')} AS p1, CASE WHEN (2 - s1 - s2) / 2 >= (s1 + s2) / 2 THEN 0 ELSE 1 END AS prediction FROM w")
def q_m17(spark, sf):
    """Soft voting of the two stand-in models (mean class probabilities, argmax)."""
    p = predictions(spark, sf)
    wide = p.groupBy("doc_id").pivot("model", list(MODELS)).agg(F.first("score"))
    probs = wide.select("doc_id", *[F.array(1 - F.col(m), F.col(m)).alias(f"p_{m}") for m in MODELS])
    v = M.soft_vote(probs, [f"p_{m}" for m in MODELS])
    return rounded(v.select("doc_id", F.col("probability")[1].alias("p1"), "prediction"))


@register("j12", "WITH " + PRED_SQL + " SELECT model, doc_id, prediction, label AS expected FROM pr")
def q_j12(spark, sf):
    """Prediction ⋈ expected label per model, long form."""
    return predictions(spark, sf).select("model", "doc_id", "prediction", F.col("label").alias("expected"))
