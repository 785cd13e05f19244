"""Feature layer: flattening, cleaning, alignment, scaling, splits, weights, pooling
(P11–P17, P19, P24, M1–M4, M8, M9, J10, J11, A29–A33).

Fitted statistics (means, deviations) are one aggregate row; only that row reaches the
driver and is applied as literals, as Spark ML's own estimators do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import md5_int
from colloquy.operators.indicators import INDICATOR_COLUMNS
from colloquy.operators.sequence import dense_ordinal, prefix_sums, quantile_blocks

DROP_PREFIXES = ("has_unit.", "ratio_unit.")
SPLIT_SEED = 42
HASH_BLOCK = 1 << 22          # order-value block for the hash-ranked splits (1024 blocks)


def indicator_schema(by_category: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.LongType() if c in ("repetition_cons_rate", "total_words",
                                                     "range_freq_words", "Score_AFINN") else T.DoubleType())
              for c in INDICATOR_COLUMNS]
    has = (T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType())) if by_category
           else T.MapType(T.StringType(), T.LongType()))
    return T.StructType(fields + [T.StructField("has_unit", has),
                                  T.StructField("ratio_unit", T.MapType(T.StringType(), T.DoubleType()))])


def encode_indicators(df: DataFrame, cols=INDICATOR_COLUMNS, maps=("has_unit", "ratio_unit"),
                      out: str = "indicateur") -> DataFrame:
    """the indicator row as one JSON column (the storage format of the participant table)."""
    present = [c for c in maps if c in df.columns]
    return df.withColumn(out, F.to_json(F.struct(*cols, *present)))


def flatten_indicators(df: DataFrame, col: str = "indicateur", by_category: bool = True) -> DataFrame:
    """JSON → typed struct → one column per numeric field; maps become ``dotted``
    names only in the long form (:func:`map_entries_long`)."""
    parsed = df.withColumn("_ind", F.from_json(F.col(col), indicator_schema(by_category)))
    keep = [c for c in df.columns if c != col]
    return parsed.select(*keep, *[F.col(f"_ind.{c}").alias(c) for c in INDICATOR_COLUMNS],
                         F.col("_ind.has_unit").alias("has_unit"), F.col("_ind.ratio_unit").alias("ratio_unit"))


def top_level(df: DataFrame, col: str = "indicateur_struct") -> DataFrame:
    """Expand a struct column one level."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, f"{col}.*")


def drop_prefixed(df: DataFrame, prefixes=DROP_PREFIXES, maps=("has_unit", "ratio_unit")) -> DataFrame:
    """Drop flattened map columns by prefix (and the maps themselves)."""
    return df.select([c for c in df.columns
                      if not any(c.startswith(p) for p in prefixes) and c not in maps])


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric coercion, failures become null."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """P14."""
    return df.fillna(0, cols)


def column_stats(train: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """(mean, population std) of each column, one aggregate row."""
    row = train.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def fill_means(df: DataFrame, stats: dict) -> DataFrame:
    """Missing values and absent columns take the train mean."""
    out = []
    for c, (mean, _) in stats.items():
        base = F.col(c) if c in df.columns else F.lit(None).cast("double")
        out.append(F.coalesce(base.cast("double"), F.lit(mean).cast("double")).alias(c))
    extra = [c for c in df.columns if c not in stats]
    return df.select(*extra, *out)


def zscore(df: DataFrame, stats: dict) -> DataFrame:
    """M3: (x − mean) / population std; a constant column gives 0."""
    cols = []
    for c, (mean, std) in stats.items():
        if std is None or std == 0 or mean is None:
            cols.append(F.lit(0.0).alias(c))
        else:
            cols.append(((F.col(c) - F.lit(mean)) / F.lit(std)).alias(c))
    extra = [c for c in df.columns if c not in stats]
    return df.select(*extra, *cols)


def label_indexer(col: str, out: str = "label_idx") -> StringIndexer:
    """M4: sorted classes, unseen label → error."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")


def assemble(cols: list[str], out: str = "features") -> VectorAssembler:
    """Feature vector from the numeric indicator columns (maps excluded)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def hash_rank(df: DataFrame, keys: list[str], id_col: str, seed: int = SPLIT_SEED, out: str = "_rank") -> DataFrame:
    """0-based rank of each row inside ``keys`` by md5(id:seed), ties by id; blocked on
    the hash value so that a big class is ranked by many tasks."""
    h = df.withColumn("_h", md5_int(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))))
    return dense_ordinal(h, keys, ["_h", id_col], out=out, block_col="_h", block=HASH_BLOCK)


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.3,
                     seed: int = SPLIT_SEED) -> DataFrame:
    """M1: adds ``is_test``: the ceil(test_size · n_c) lowest-hash rows of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    r = hash_rank(df, [label], id_col, seed).join(F.broadcast(counts), label)
    quota = F.ceil(F.col("_n") * F.lit(test_size))
    return r.withColumn("is_test", F.col("_rank") < quota).drop("_h", "_rank", "_n")


def random_split(df: DataFrame, id_col: str, test_size: float = 0.5, seed: int = SPLIT_SEED) -> DataFrame:
    """M2: seeded split without strata: the ceil(test_size · n) lowest-hash rows are test."""
    n = df.count()
    r = hash_rank(df.withColumn("_all", F.lit(0)), ["_all"], id_col, seed)
    return r.withColumn("is_test", F.col("_rank") < F.lit(math.ceil(n * test_size))).drop("_h", "_rank", "_all")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """M8: n / (classes · n_c) for each row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))
    k = counts.count()
    n = df.count()
    return df.join(F.broadcast(counts), label).withColumn(
        out, F.lit(float(n)) / (F.lit(float(k)) * F.col("_n_c"))).drop("_n_c")


def positive_scale(weighted: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """M9: Σ weights / number of positive rows (one row)."""
    return weighted.agg((F.sum(weight) / F.sum((F.col(label) == 1).cast("long"))).alias("scale_pos_weight"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A29."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean of array vectors per key (positions explode, then average)."""
    e = df.select(key, F.posexplode(vec).alias("_i", "_x"))
    per = e.groupBy(key, "_i").agg(F.avg("_x").alias("_m"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))),
                                            lambda s: s["_m"]).alias("mean_vector"))


def join_vectors(left: DataFrame, right: DataFrame, key: str, a: str, b: str, out: str = "fused") -> DataFrame:
    """Text vector ⋈ tabular vector on the id, concatenated."""
    return left.join(right, key).withColumn(out, F.concat(F.col(a), F.col(b)))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair (a < b) over the rows that have both, long form, one pass; null where a
    column is constant there.

    A task sums all pairs by matrix products, one batch about its means after the other, and sends one row of moments.
    """
    k, spark = len(cols), df.sparkSession

    def measure(batches):
        held = None
        for b in batches:
            if b.num_rows:
                held = _merged_moments(held, _pair_moments(b))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["moments"])

    def finish(batches):
        held = None
        for b in batches:
            for v in b.column("moments").to_pylist():
                if v is not None:
                    held = _merged_moments(held, np.frombuffer(v).reshape(7, k, k))
        corr = np.full((k, k), None, object) if held is None else _correlation(held)
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array([cols[x] for x in i], pa.string()), pa.array([cols[x] for x in j], pa.string()), pa.array(list(corr[i, j]), pa.float64())],
                                         names=["a", "b", "corr"])

    moments = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(measure, "moments binary")
    always = spark.range(1).select(F.lit(None).cast("binary").alias("moments"))     # without any row the pairs are null
    return moments.unionByName(always).repartition(1).mapInArrow(finish, "a string, b string, corr double")


def _pair_moments(b: pa.RecordBatch) -> np.ndarray:
    """Of a batch, for each column a (rows of a matrix) over the rows that have b (its columns): the rows, mean, sum of squares about it,
    minimum and maximum of a, the sum of products about both means, and the rows where a is not finite."""
    some = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
    x = np.stack([c.fill_null(0.0).to_numpy() for c in b.columns], axis=1)
    wrong = some & ~np.isfinite(x)
    x = np.where(wrong, 0.0, x)
    m = some.astype(float)
    at = (x * m).sum(0) / np.maximum(m.sum(0), 1)
    y = (x - at) * m
    n = m.T @ m
    mean = y.T @ m / np.maximum(n, 1)
    square, product = (y * y).T @ m - n * mean * mean, y.T @ y - n * mean * mean.T
    low, high = np.empty_like(n), np.empty_like(n)
    for j in range(x.shape[1]):
        both = some & some[:, j:j + 1]
        low[:, j], high[:, j] = np.where(both, x, np.inf).min(0), np.where(both, x, -np.inf).max(0)
    return np.stack([n, np.where(n > 0, mean + at[:, None], 0.0), np.maximum(square, 0.0), product, low, high, wrong.astype(float).T @ m])


def _merged_moments(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    delta = b[1] - a[1]
    return np.stack([n, a[1] + delta * share, a[2] + b[2] + delta * delta * a[0] * share, a[3] + b[3] + delta * delta.T * a[0] * share,
                     np.minimum(a[4], b[4]), np.maximum(a[5], b[5]), a[6] + b[6]])


def _correlation(m: np.ndarray) -> np.ndarray:
    n, _, square, product, low, high, wrong = m
    under = np.sqrt(square) * np.sqrt(square.T)
    known = (n > 0) & (low < high) & (low < high).T & (under > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(known, product / under, 0.0).astype(object)
    out[~known] = None
    out[(wrong + wrong.T) > 0] = np.nan
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys``, linear between neighbouring ranks (nulls don't count).

    Rows are reduced to counts of distinct values; running counts over quantile blocks give each value its
    last rank, and the values at the two ranks around a quantile are conditional minima. No task sorts a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(quantile_blocks(counts, keys, "_v", "_block"), keys, "_v", ["_c"], block_col="_block")
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    totals = totals.select(F.struct(*keys).alias("_t"), "_n", "min", "max")
    r = ranked.join(totals, [F.col(f"_t.{k}").eqNullSafe(F.col(k)) for k in keys])
    found, shown = [], []
    for i, (name, p) in enumerate(probabilities.items()):
        at = F.lit(p) * (F.col("_n") - 1)
        found += [F.min(F.when(F.col("_c_cum") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("_c_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}")]
        shown.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(name))
    out = r.groupBy(*keys).agg(F.first("_n").alias("_n"), F.first("min").alias("min"), F.first("max").alias("max"), *found)
    return out.select(*keys, "min", *shown, "max")


def distribution_by_class(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Exact quartiles, min and max of each column per class."""
    long = df.select(label, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [label], cols, "indicator", "value")
    return exact_quantiles(long, [label, "indicator"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def vector_column(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])
