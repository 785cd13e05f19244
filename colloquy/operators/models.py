"""Classifiers and model utilities on Spark ML.

Built-in estimators cover random forest, decision tree, gradient boosting, logistic
regression and the grid search (the shared-scan search is in ``search.py``). Three estimators are written on the
public ``Estimator`` / ``Model`` extension points; their models are saved and loaded like Spark's own, alone or as stages of a ``PipelineModel``:

* :class:`AdaBoostClassifier` — SAMME (Zhu et al. 2009) over weighted Spark decision
  trees; the sample weights are a column, the lineage is cut each round with a reliable
  checkpoint into the shared checkpoint folder;
* :class:`SigmoidSVC` — a sigmoid-kernel SVM approximated with landmark features
  tanh(γ·x·l + c) (Nyström-style; Williams & Seeger 2001), a ``LinearSVC`` on them and
  Platt calibration (a logistic regression on the margin) for probabilities;
* :class:`SoftVote` — the weighted mean of the class probabilities of its members.
"""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import trees as Tr
from colloquy.session import checkpoint_dir, cut_lineage, discard, write_stage

SEED = 42


# --- built-in estimators with the reference settings ------------------------------------------------

def random_forest(num_trees: int = 100, max_depth: int = 30, weight_col: str | None = None) -> "Forest":
    """100 trees, seeded; sklearn grows unbounded trees, Spark caps depth at 30."""
    return Forest(num_trees, max_depth, weight_col)


def decision_tree(max_depth: int = 3, weight_col: str | None = None) -> DecisionTreeClassifier:
    """M11."""
    dt = DecisionTreeClassifier(maxDepth=max_depth, seed=SEED)
    return dt.setWeightCol(weight_col) if weight_col else dt


def gradient_boosting(max_iter: int = 100, max_depth: int = 3, step: float = 0.1,
                      weight_col: str | None = None) -> GBTClassifier:
    """100 rounds of depth-3 trees, rate 0.1; plain or weighted."""
    g = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=SEED)
    return g.setWeightCol(weight_col) if weight_col else g


def sampled_boosting(max_iter: int = 100, max_depth: int = 6, step: float = 0.3, subsample: float = 1.0,
                     col_sample: str = "all", min_child: int = 1, gamma: float = 0.0,
                     weight_col: str | None = None) -> GBTClassifier:
    """Boosting with row/column sampling, minimum child size and split gain."""
    g = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample,
                      featureSubsetStrategy=col_sample, minInstancesPerNode=min_child, minInfoGain=gamma, seed=SEED)
    return g.setWeightCol(weight_col) if weight_col else g


def logistic(c: float = 1.0, n_rows: int | None = None, total_weight: float | None = None,
             max_iter: int = 100) -> LogisticRegression:
    """C weighs the summed loss, Spark averages it: regParam = 1 / (C · Σw)."""
    denom = total_weight if total_weight is not None else (n_rows or 1)
    return LogisticRegression(regParam=1.0 / (c * denom), elasticNetParam=0.0, standardization=False,
                              maxIter=max_iter)


# --- saving of models that hold models ---------------------------------------------------------------------

def each(fns: list, threads: int = 8) -> list:
    """Runs independent Spark work as concurrent jobs."""
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(fns)))) as pool:
        return [f.result() for f in [pool.submit(fn) for fn in fns]]


class _CompositeWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession,
                                         extraMetadata={"values": self.model.values(), "parts": len(self.model.parts())})
        self.model.save_parts(path)


class _CompositeReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls.restore(metadata["values"], self.cls.load_parts([f"{path}/parts/{i}" for i in range(metadata["parts"])], spark))
        model._resetUid(metadata["uid"])
        return model


class CompositeModel(Model, MLWritable, MLReadable):
    """A model made of plain values (``values``, in its metadata) and nested models (``parts``, saved beneath)."""

    def write(self) -> MLWriter:
        return _CompositeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CompositeReader(cls)

    def save_parts(self, path: str) -> None:
        each([lambda i=i, p=p: p.write().save(f"{path}/parts/{i}") for i, p in enumerate(self.parts())])

    @classmethod
    def load_parts(cls, paths: list[str], spark) -> list:
        return each([lambda p=p: DefaultParamsReader.loadParamsInstance(p, spark) for p in paths])


# --- forests in groups of trees ----------------------------------------------------------------------------

TREE_ROWS = 1 << 21     #: rows times trees (or nodes, of shallow trees) that are grown and held at once
SHALLOW_DEPTH = 10      #: trees up to it have so few nodes that Spark grows them in some passes
BOOST_ROWS = 1 << 13    #: rows up to which Spark grows the deep trees of a boosted model


class ForestModel(CompositeModel):
    """A forest kept as groups of trees below the shared folder (``paths``); the driver holds one group at a time.

    Rows pass the groups in turn and are written after each; a class's probability is the mean over all trees.
    """

    def __init__(self, paths, sizes, importances, n_classes, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self.paths, self.sizes, self.importances, self.n_classes = paths, sizes, importances, n_classes
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def values(self) -> dict:
        return {"sizes": self.sizes, "importances": self.importances, "n_classes": self.n_classes, "featuresCol": self.featuresCol, "predictionCol": self.predictionCol}

    def parts(self) -> list:
        return list(self.paths)

    def save_parts(self, path: str) -> None:
        for i, p in enumerate(self.paths):
            RandomForestClassificationModel.load(p).write().save(f"{path}/parts/{i}")

    @classmethod
    def load_parts(cls, paths: list[str], spark) -> list:
        return paths

    @classmethod
    def restore(cls, values: dict, parts: list) -> "ForestModel":
        return cls(parts, **values)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df = dataset.withColumn("_votes", F.array(*[F.lit(0.0)] * self.n_classes))
        for path, size in zip(self.paths, self.sizes):
            group = (RandomForestClassificationModel.load(path).setFeaturesCol(self.featuresCol).setPredictionCol("")
                     .setRawPredictionCol("").setProbabilityCol("_p"))
            voted = group.transform(df).withColumn("_votes", F.zip_with("_votes", vector_to_array("_p"), lambda a, b: a + b * F.lit(float(size))))
            df = write_stage(voted.drop("_p"), "forest-votes")
        total = float(sum(self.sizes))
        df = df.withColumn("probability", array_to_vector(F.transform("_votes", lambda v: v / F.lit(total))))
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return df.withColumn(self.predictionCol, best.cast("double")).drop("_votes")


class TreeTableModel(CompositeModel):
    """Trees of :mod:`colloquy.operators.trees`, kept as a table of their pieces below the shared folder (``path``)."""

    def __init__(self, path, cuts, sizes, n_classes, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self.path, self.cuts, self.sizes, self.n_classes = path, cuts, sizes, n_classes
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def values(self) -> dict:
        return {"cuts": self.cuts, "sizes": self.sizes, "n_classes": self.n_classes, "featuresCol": self.featuresCol, "predictionCol": self.predictionCol}

    def parts(self) -> list:
        return [self.path]

    @staticmethod
    def table(spark, path: str) -> DataFrame:
        return spark.read.schema(Tr.PIECE).option("recursiveFileLookup", True).parquet(path)

    def save_parts(self, path: str) -> None:
        spark = SparkSession.active()
        self.table(spark, self.path).write.parquet(f"{path}/parts/0")

    @classmethod
    def load_parts(cls, paths: list[str], spark) -> list:
        return paths

    @classmethod
    def restore(cls, values: dict, parts: list):
        return cls(*parts, **values)

    def voted(self, dataset: DataFrame, weights: list[float], whole: bool) -> DataFrame:
        return Tr.with_votes(dataset, self.featuresCol, [np.array(c) for c in self.cuts], self.table(dataset.sparkSession, self.path),
                             self.sizes, self.n_classes, weights, whole)


class GrownForestModel(TreeTableModel):
    """A forest whose class probabilities are the mean of its leaves' shares."""

    def __init__(self, path, cuts, sizes, n_classes, importances, featuresCol="features", predictionCol="prediction"):
        super().__init__(path, cuts, sizes, n_classes, featuresCol, predictionCol)
        self.importances = importances

    def values(self) -> dict:
        return super().values() | {"importances": self.importances}

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = float(len(self.sizes))
        df = self.voted(dataset, [1.0] * len(self.sizes), whole=False)
        df = df.withColumn("probability", array_to_vector(F.transform("_votes", lambda v: v / F.lit(n))))
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return df.withColumn(self.predictionCol, best.cast("double")).drop("_votes")


class Forest(Estimator):
    """A random forest of deep trees, whose nodes grow with the rows.

    A forest of at most ``tree_rows`` rows times trees is Spark's own. A larger one of deep trees is grown by
    :mod:`colloquy.operators.trees`, one of shallow trees by Spark in groups of
    trees of that size (one tree at least), each with a seed of its own and stored before the next.
    """

    def __init__(self, num_trees: int = 100, max_depth: int = 30, weight_col: str | None = None, tree_rows: int | None = None,
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.num_trees, self.max_depth, self.weight_col, self.tree_rows = num_trees, max_depth, weight_col, tree_rows
        self.featuresCol, self.labelCol = featuresCol, labelCol

    def group(self, num_trees: int, seed: int) -> RandomForestClassifier:
        rf = RandomForestClassifier(featuresCol=self.featuresCol, labelCol=self.labelCol, numTrees=num_trees, maxDepth=self.max_depth, seed=seed)
        return rf.setWeightCol(self.weight_col) if self.weight_col else rf

    def _fit(self, dataset: DataFrame):
        nodes = min(dataset.count(), 2 ** (self.max_depth + 1))
        at_once = max(1, (self.tree_rows or TREE_ROWS) // max(1, nodes))
        if at_once >= self.num_trees:
            return self.group(self.num_trees, SEED).fit(dataset)
        if self.max_depth > SHALLOW_DEPTH:
            return self._grown(dataset)
        folder = f"{checkpoint_dir(dataset.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"
        paths, sizes, importances, grown, k = [], [], 0.0, 0, 0
        for i, at in enumerate(range(0, self.num_trees, at_once)):
            sizes.append(min(at_once, self.num_trees - at))
            model = self.group(sizes[-1], SEED + i).fit(dataset)
            paths.append(f"{folder}/{i}")
            model.write().save(paths[-1])
            n = sum(t.depth > 0 for t in model.trees)      # a tree without a split has no importances
            importances, grown, k = importances + n * model.featureImportances.toArray(), grown + n, model.numClasses
            del model
        return ForestModel(paths, sizes, (importances / max(1, grown)).tolist(), k, self.featuresCol)


    def _grown(self, dataset: DataFrame) -> GrownForestModel:
        rows = tree_rows(dataset, self.featuresCol, self.labelCol, F.col(self.weight_col) if self.weight_col else F.lit(1.0))
        cuts = Tr.cuts_of(rows)
        stored = Tr.stored_chunks(rows, cuts)
        n, top = rows.agg(F.count("*"), F.max("y")).first()
        k, path = int(top) + 1, f"{checkpoint_dir(dataset.sparkSession).rstrip('/')}/trees-{uuid.uuid4().hex}"
        for pieces in Tr.grow_trees(stored, n, k, len(cuts), list(range(self.num_trees)), self.max_depth, Tr.sqrt_of(len(cuts)), SEED,
                                    lambda c, t: c.w * np.random.default_rng([SEED, t, c.number]).poisson(1.0, len(c.y))):
            pieces.write.mode("append").parquet(path)
        discard(stored)
        sizes, gains = [0] * self.num_trees, np.zeros((self.num_trees, len(cuts)))
        for r in TreeTableModel.table(dataset.sparkSession, path).select("tree", "nodes", "gains").toLocalIterator():
            sizes[r["tree"]] += r["nodes"]
            gains[r["tree"]] += np.frombuffer(r["gains"])
        gains = gains[gains.sum(1) > 0]         # a tree without a split has no importances
        importances = (gains / gains.sum(1, keepdims=True)).mean(0) if len(gains) else np.zeros(len(cuts))
        return GrownForestModel(path, [c.tolist() for c in cuts], sizes, k, importances.tolist(), self.featuresCol)


def tree_rows(df: DataFrame, features: str, label: str, weight) -> DataFrame:
    return df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w"))


# --- AdaBoost (SAMME) ------------------------------------------------------------------------------------

class AdaBoostModel(CompositeModel):
    def __init__(self, trees, alphas, n_classes, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self.trees, self.alphas, self.n_classes = trees, alphas, n_classes
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def values(self) -> dict:
        return {"alphas": self.alphas, "n_classes": self.n_classes, "featuresCol": self.featuresCol, "predictionCol": self.predictionCol}

    def parts(self) -> list:
        return list(self.trees)

    @classmethod
    def restore(cls, values: dict, parts: list) -> "AdaBoostModel":
        return cls(parts, **values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k = self.n_classes
        df = dataset.withColumn("_score", F.array(*[F.lit(0.0)] * k))
        for i, (tree, alpha) in enumerate(zip(self.trees, self.alphas)):
            col = f"_p{i}"
            tree = tree.copy().setPredictionCol(col).setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}")
            df = tree.transform(df).drop(f"_r{i}", f"_q{i}")
            df = df.withColumn("_score", F.transform("_score", lambda s, j: s + F.when(
                F.col(col).cast("int") == j, F.lit(alpha)).otherwise(F.lit(0.0)))).drop(col)
        return _boosted(df, self.alphas, k, self.predictionCol)


def _boosted(df: DataFrame, alphas: list[float], k: int, prediction: str) -> DataFrame:
    """Probabilities and class from ``_score``, the weights of the trees that vote for each class."""
    total = float(sum(alphas)) or 1.0
    proba = F.transform("_score", lambda s: F.exp(s / F.lit(total) / F.lit(float(max(k - 1, 1)))))
    df = df.withColumn("_e", proba)
    df = df.withColumn("probability_array", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
    best = F.array_position("_score", F.array_max("_score")) - 1
    return df.withColumn(prediction, best.cast("double")).drop("_score", "_e")


class GrownBoostModel(TreeTableModel):
    """AdaBoost over trees of :mod:`colloquy.operators.trees`: scores as :class:`AdaBoostModel` does."""

    def __init__(self, path, cuts, sizes, n_classes, alphas, featuresCol="features", predictionCol="prediction"):
        super().__init__(path, cuts, sizes, n_classes, featuresCol, predictionCol)
        self.alphas = alphas

    def values(self) -> dict:
        return super().values() | {"alphas": self.alphas}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df = self.voted(dataset, self.alphas, whole=True).withColumnRenamed("_votes", "_score")
        return _boosted(df, self.alphas, self.n_classes, self.predictionCol)


class AdaBoostClassifier(Estimator):
    """SAMME boosting of weighted decision trees (50 rounds, rate 0.01 by default).

    Trees grow to ``max_depth`` (30 is Spark's bound for unbounded ones). ``balanced_trees`` multiplies the weights that a
    tree learns from by n / (classes * n_c); the boosting error keeps the plain ones. Deep trees of more than ``boost_rows`` rows are grown by
    :mod:`colloquy.operators.trees`, others by Spark.
    """

    def __init__(self, n_estimators: int = 50, learning_rate: float = 0.01, max_depth: int = 30,
                 featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None,
                 checkpoint_every: int = 5, balanced_trees: bool = False, boost_rows: int | None = None):
        super().__init__()
        self.boost_rows = boost_rows
        self.n_estimators, self.learning_rate, self.max_depth = n_estimators, learning_rate, max_depth
        self.checkpoint_every, self.balanced_trees = max(1, checkpoint_every), balanced_trees
        self.featuresCol, self.labelCol, self.weightCol = featuresCol, labelCol, weightCol

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        lab = self.labelCol
        counts = {r[lab]: r["count"] for r in dataset.groupBy(lab).count().collect()}
        k = len(counts)
        factor = F.lit(1.0)
        if self.balanced_trees:
            for y, n in counts.items():
                factor = F.when(F.col(lab) == y, sum(counts.values()) / (k * n)).otherwise(factor)
        w0 = F.col(self.weightCol) if self.weightCol else F.lit(1.0)
        df = dataset.select(self.featuresCol, lab, w0.cast("double").alias("_w"))
        total = df.agg(F.sum("_w")).first()[0]
        if self.max_depth > SHALLOW_DEPTH and sum(counts.values()) > (self.boost_rows or BOOST_ROWS):
            return self._grown(df.withColumn("_w", F.col("_w") / F.lit(total)), counts)
        df = cut_lineage(df.withColumn("_w", F.col("_w") / F.lit(total)))
        trees, alphas, scored = [], [], []
        for t in range(self.n_estimators):
            tree = DecisionTreeClassifier(featuresCol=self.featuresCol, labelCol=lab, weightCol="_tw",
                                          maxDepth=self.max_depth, seed=SEED + t).fit(df.withColumn("_tw", F.col("_w") * factor))
            pred = tree.transform(df).select(self.featuresCol, lab, "_w",
                                             (F.col("prediction") != F.col(lab)).cast("double").alias("_miss"))
            scored.append(pred.persist(StorageLevel.MEMORY_AND_DISK))  # a round's tree scores the rows once, not in each job of the next ones
            err = pred.agg((F.sum(F.col("_w") * F.col("_miss")) / F.sum("_w")).alias("e")).first()["e"]
            if err <= 0:
                trees.append(tree)
                alphas.append(1.0)
                break
            if err >= 1.0 - 1.0 / k:
                if not trees:
                    trees.append(tree)
                    alphas.append(1.0)
                break
            alpha = self.learning_rate * (math.log((1.0 - err) / err) + math.log(k - 1))
            trees.append(tree)
            alphas.append(alpha)
            if t == self.n_estimators - 1:
                break
            for old in scored[:-1]:
                old.unpersist()
            scored = scored[-1:]
            nxt = pred.withColumn("_w", F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")))
            s = nxt.agg(F.sum("_w")).first()[0]
            df = nxt.select(self.featuresCol, lab, (F.col("_w") / F.lit(s)).alias("_w"))
            if (t + 1) % self.checkpoint_every == 0:      # reliable checkpoint bounds the lineage
                df = cut_lineage(df)
        for old in scored:
            old.unpersist()
        return AdaBoostModel(trees, alphas, int(k), self.featuresCol)

    def _grown(self, df: DataFrame, counts: dict) -> GrownBoostModel:
        spark, n, k = df.sparkSession, sum(counts.values()), len(counts)
        classes = max(k, int(max(counts)) + 1)
        factors = np.ones(classes)
        if self.balanced_trees:
            for y, n_y in counts.items():
                factors[int(y)] = n / (k * n_y)
        rows = tree_rows(df, self.featuresCol, self.labelCol, F.col("_w"))
        cuts = Tr.cuts_of(rows)
        stored = Tr.stored_chunks(rows, cuts)
        path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
        alphas, sizes, alpha, scale = [], [], 0.0, 1.0
        for t in range(self.n_estimators):
            # a row's weight: what it was in the last round, raised where that round's tree was wrong
            weight = lambda c, alpha=alpha, scale=scale: c.w * np.exp(alpha * c.miss) / scale
            for pieces in Tr.grow_trees(stored, n, classes, len(cuts), [t], self.max_depth, len(cuts), SEED, lambda c, _: weight(c) * factors[c.y]):  # noqa: B023
                pieces.write.mode("append").parquet(f"{path}/{t}")
            (tree,) = Tr.load(TreeTableModel.table(spark, f"{path}/{t}"), [t])
            scored = Tr.scored_chunks(stored, tree, weight)
            discard(stored)
            stored = scored
            mass, missed = stored.agg(F.sum("mass"), F.sum("missed")).first()
            err = missed / mass
            if err >= 1.0 - 1.0 / k and err > 0 and alphas:
                break
            sizes.append(len(tree.feature))
            if err <= 0 or err >= 1.0 - 1.0 / k:
                alphas.append(1.0)
                break
            alpha = self.learning_rate * (math.log((1.0 - err) / err) + math.log(k - 1))
            scale = mass - missed + missed * math.exp(alpha)
            alphas.append(alpha)
        discard(stored)
        return GrownBoostModel(path, [c.tolist() for c in cuts], sizes, classes, alphas, self.featuresCol)


# --- sigmoid-kernel SVM --------------------------------------------------------------------------------------

class SigmoidSVCModel(CompositeModel):
    def __init__(self, landmarks, gamma, coef0, svm, platt, featuresCol="features"):
        super().__init__()
        self.landmarks, self.gamma, self.coef0 = landmarks, gamma, coef0
        self.svm, self.platt, self.featuresCol = svm, platt, featuresCol

    def values(self) -> dict:
        return {"landmarks": self.landmarks.tolist(), "gamma": self.gamma, "coef0": self.coef0, "featuresCol": self.featuresCol}

    def parts(self) -> list:
        return [self.svm, self.platt]

    @classmethod
    def restore(cls, values: dict, parts: list) -> "SigmoidSVCModel":
        return cls(np.array(values["landmarks"]), values["gamma"], values["coef0"], *parts, values["featuresCol"])

    def kernel_features(self, df: DataFrame) -> DataFrame:
        lm, g, c0 = self.landmarks, self.gamma, self.coef0

        @F.pandas_udf("array<double>")
        def kmap(x: pd.Series) -> pd.Series:
            xs = np.stack(x.to_numpy()) if len(x) else np.zeros((0, lm.shape[1]))
            z = np.tanh(g * xs @ lm.T + c0)
            return pd.Series(list(z))

        return df.withColumn("_k", array_to_vector(kmap(vector_to_array(F.col(self.featuresCol)))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k = self.kernel_features(dataset)
        m = self.svm.transform(k).withColumn("_margin", vector_to_array("rawPrediction")[1]).drop(
            "rawPrediction", "prediction")
        m = VectorAssembler(inputCols=["_margin"], outputCol="_mv").transform(m)
        out = self.platt.transform(m)
        return out.drop("_k", "_mv", "rawPrediction")


class SigmoidSVC(Estimator):
    """Sigmoid-kernel SVM (C = 7, γ = 0.3 in the reference) with probabilities."""

    def __init__(self, c: float = 7.0, gamma: float = 0.3, coef0: float = 0.0, max_landmarks: int = 512,
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.c, self.gamma, self.coef0, self.max_landmarks = c, gamma, coef0, max_landmarks
        self.featuresCol, self.labelCol = featuresCol, labelCol

    def _fit(self, dataset: DataFrame) -> SigmoidSVCModel:
        from colloquy.functions.text import md5_int
        n = dataset.count()
        keyed = dataset.withColumn("_h", md5_int(F.to_json(F.struct(vector_to_array(self.featuresCol).alias("v")))))
        lm_rows = keyed.orderBy("_h").limit(self.max_landmarks).select(vector_to_array(self.featuresCol).alias("v")).collect()
        lm = np.array([r["v"] for r in lm_rows], dtype=float)
        proto = SigmoidSVCModel(lm, self.gamma, self.coef0, None, None, self.featuresCol)
        kf = proto.kernel_features(dataset.select(self.featuresCol, self.labelCol))
        svm = LinearSVC(featuresCol="_k", labelCol=self.labelCol, regParam=1.0 / (self.c * n), maxIter=200).fit(kf)
        m = svm.transform(kf).withColumn("_margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
        m = VectorAssembler(inputCols=["_margin"], outputCol="_mv").transform(m)
        platt = LogisticRegression(featuresCol="_mv", labelCol=self.labelCol, regParam=0.0).fit(m)
        return SigmoidSVCModel(lm, self.gamma, self.coef0, svm, platt, self.featuresCol)


# --- soft voting -------------------------------------------------------------------------------------------

class SoftVoteModel(CompositeModel):
    def __init__(self, models: list, weights: list[float]):
        super().__init__()
        self.models, self.weights = models, weights

    def values(self) -> dict:
        return {"weights": self.weights}

    def parts(self) -> list:
        return list(self.models)

    @classmethod
    def restore(cls, values: dict, parts: list) -> "SoftVoteModel":
        return cls(parts, values["weights"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df, kept = dataset, dataset.columns
        for i, m in enumerate(self.models):
            out = m.transform(df)
            proba = vector_to_array("probability") if "probability" in out.columns else F.col("probability_array")
            weight = F.lit(self.weights[i])
            df = out.withColumn(f"_vote{i}", F.transform(proba, lambda x: x * weight)).select(*kept, *[f"_vote{j}" for j in range(i + 1)])
        total = F.col("_vote0")
        for i in range(1, len(self.models)):
            total = F.zip_with(total, F.col(f"_vote{i}"), lambda a, b: a + b)
        df = df.withColumn("probability_array", F.transform(total, lambda x: x / F.lit(float(sum(self.weights)))))
        best = F.array_position("probability_array", F.array_max("probability_array")) - 1
        return df.withColumn("prediction", best.cast("double")).drop(*[f"_vote{i}" for i in range(len(self.models))])


class SoftVote(Estimator):
    """Fits its members side by side and averages their class probabilities (first class on ties)."""

    def __init__(self, estimators: list, weights: list[float] | None = None):
        super().__init__()
        self.estimators, self.weights = estimators, [float(w) for w in weights or [1.0] * len(estimators)]

    def _fit(self, dataset: DataFrame) -> SoftVoteModel:
        return SoftVoteModel(each([lambda e=e: e.fit(dataset) for e in self.estimators]), self.weights)


# --- search, comparison, selection, persistence ----------------------------------------------------------

def grid_search(estimator, grid: dict, evaluator, folds: int = 5, parallelism: int = 4) -> CrossValidator:
    """Exhaustive grid × k-fold cross validation."""
    b = ParamGridBuilder()
    for param, values in grid.items():
        b = b.addGrid(estimator.getParam(param), values)
    return CrossValidator(estimator=estimator, estimatorParamMaps=b.build(), evaluator=evaluator,
                          numFolds=folds, parallelism=parallelism, seed=SEED)


def important_features(model, names: list[str], threshold: float = 0.02) -> list[tuple[str, float]]:
    """Features whose importance reaches the threshold (from a tree ensemble)."""
    imp = model.featureImportances.toArray()
    return [(n, float(v)) for n, v in zip(names, imp) if v >= threshold]


def select_features(names: list[str], keep: list[str], in_col: str = "features", out: str = "selected") -> VectorSlicer:
    return VectorSlicer(inputCol=in_col, outputCol=out, indices=[names.index(k) for k in keep])


def save_model(model: PipelineModel, name: str, spark) -> str:
    """K7: persist under the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """S18."""
    return PipelineModel.load(path)


def fit_pipeline(stages, train: DataFrame) -> PipelineModel:
    return Pipeline(stages=stages).fit(train)


def positive_probability(df: DataFrame, col: str = "probability") -> DataFrame:
    if col in df.columns:
        return df.withColumn("p1", vector_to_array(col)[1])
    return df.withColumn("p1", F.col("probability_array")[1])
