"""Evaluation metrics as DataFrame aggregates.

Every metric is grouped by an optional ``model`` key so that many models are scored in one
pass. Nothing is collected row by row: the confusion counts are an aggregate, the ROC AUC
aggregates by distinct score first and ranks with blocked running sums.
"""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.sequence import prefix_sums, quantile_blocks

AUC_BLOCKS = 1024


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              keys: list[str] | None = None) -> DataFrame:
    """M19 long form ``(keys…, label, prediction, n)`` with zero cells for every class pair."""
    keys = keys or []
    counts = df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    classes = (df.select(*keys, F.col(label).alias("c")).union(df.select(*keys, F.col(prediction).alias("c")))
                 .distinct())
    grid = (classes.withColumnRenamed("c", "label")
                   .join(classes.withColumnRenamed("c", "prediction"), keys) if keys else
            classes.withColumnRenamed("c", "label").join(classes.withColumnRenamed("c", "prediction")))
    return grid.join(counts, [*keys, "label", "prediction"], "left").fillna(0, ["n"])


def confusion_matrix(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M19 wide form: one row per true class, one column per predicted class."""
    keys = keys or []
    return conf.groupBy(*keys, "label").pivot("prediction").agg(F.first("n")).fillna(0)


def per_class(conf: DataFrame, keys: list[str] | None = None, zero_division: float = 0.0) -> DataFrame:
    """M20 per class: precision, recall, F1, support (``zero_division`` for 0/0)."""
    keys = keys or []
    tp = conf.filter(F.col("label") == F.col("prediction")).select(*keys, F.col("label").alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(*keys, F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(*keys, F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    d = tp.join(sup, [*keys, "cls"]).join(pred, [*keys, "cls"])
    zd = F.lit(float(zero_division))

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(zd)

    p = ratio(F.col("tp"), F.col("predicted"))
    r = ratio(F.col("tp"), F.col("support"))
    d = d.select(*keys, "cls", p.alias("precision"), r.alias("recall"), "support")
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(
        # both zero: F1 = 0, unless both came from 0/0 and zero_division = 1
        F.lit(0.0))
    return d.withColumn("f1", f1)


def classification_report(conf: DataFrame, keys: list[str] | None = None,
                          zero_division: float = 0.0) -> DataFrame:
    """M20 long form: rows per class, ``accuracy``, ``macro avg``, ``weighted avg``."""
    keys = keys or []
    pc = per_class(conf, keys, zero_division)
    classes = pc.select(*keys, F.col("cls").cast("string").alias("row"), "precision", "recall", "f1",
                        F.col("support").cast("long").alias("support"))
    tot = pc.groupBy(*keys).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("long").alias("n"))
    acc = accuracy_from_confusion(conf, keys)
    macro = tot.select(*keys, F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = tot.select(*keys, F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    accuracy = acc.join(tot.select(*keys, "n"), keys) if keys else acc.join(tot.select("n"))
    accuracy = accuracy.select(*keys, F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                               F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
                               F.col("n").alias("support"))
    return classes.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def accuracy_from_confusion(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return conf.groupBy(*keys).agg(
        (F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             keys: list[str] | None = None) -> DataFrame:
    """Share of rows with ``label == prediction``."""
    return df.groupBy(*(keys or [])).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Mann–Whitney AUC with averaged ties = Σ_s pos(s)·(neg(<s) + ½·neg(s)) / (P·N).

    Rows are first reduced to one row per distinct score; the "negatives below" running
    sum is blocked on score quantiles (:data:`AUC_BLOCKS` blocks a group), so no single task ranks
    all scores, also when they lie close together. A group with one class only gives null.
    """
    keys = keys or []
    key_cols = keys or ["_all"]
    d = df.select(*keys, F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("long").alias("pos"))
    if not keys:
        d = d.withColumn("_all", F.lit(0))
    per = d.groupBy(*key_cols, "s").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n"))
    cum = prefix_sums(quantile_blocks(per, key_cols, "s", "_block", AUC_BLOCKS), key_cols, "s", ["n"], suffix="_cum", block_col="_block")
    contrib = cum.withColumn("_c", F.col("p") * (F.col("n_cum") - F.col("n") + F.col("n") * 0.5))
    out = contrib.groupBy(*key_cols).agg(
        (F.sum("_c") / (F.sum("p") * F.sum("n"))).alias("roc_auc"), F.sum("p").alias("_P"), F.sum("n").alias("_N"))
    out = out.withColumn("roc_auc", F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("roc_auc")))
    return out.select(*keys, "roc_auc")


def macro_f1(conf: DataFrame, keys: list[str] | None = None, zero_division: float = 0.0) -> DataFrame:
    """Unweighted mean of the per-class F1."""
    return per_class(conf, keys, zero_division).groupBy(*(keys or [])).agg(F.avg("f1").alias("f1_macro"))


class MacroF1Evaluator(Evaluator):
    """M23 as a Spark ML evaluator (Spark's own ``f1`` metric is the weighted one)."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction", zero_division: float = 0.0):
        super().__init__()
        self.labelCol, self.predictionCol, self.zero_division = labelCol, predictionCol, zero_division

    def _evaluate(self, dataset: DataFrame) -> float:
        conf = confusion(dataset, self.labelCol, self.predictionCol)
        return float(macro_f1(conf, zero_division=self.zero_division).first()["f1_macro"])

    def isLargerBetter(self) -> bool:
        return True


def soft_vote(df: DataFrame, prob_cols: list[str], out_prob: str = "probability",
              out_pred: str = "prediction") -> DataFrame:
    """Mean of the models' class-probability arrays, prediction = argmax (first on ties)."""
    arrs = [F.col(c) for c in prob_cols]
    mean = F.zip_with(arrs[0], arrs[1], lambda a, b: a + b) if len(arrs) > 1 else arrs[0]
    for extra in arrs[2:]:
        mean = F.zip_with(mean, extra, lambda a, b: a + b)
    mean = F.transform(mean, lambda x: x / F.lit(float(len(arrs))))
    with_mean = df.withColumn(out_prob, mean)
    best = F.array_max(F.col(out_prob))
    return with_mean.withColumn(out_pred, (F.array_position(F.col(out_prob), best) - 1).cast("int"))
