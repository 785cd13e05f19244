"""Correlations of all pairs: moments of tasks against pairs taken one by one."""
import math

import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import features as Fe

COLS = ["a", "b", "c", "d", "e", "f"]


def test_correlations_equal_pairs_taken_alone(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        a = float(rng.normal() + 1e3)
        b = float(a * 2 + rng.normal()) if i % 3 else None
        c = None if i % 5 == 0 else float(rng.integers(0, 9))
        d = 0.1                                                     # constant
        e = 0.1 if c is not None else float(rng.normal())           # constant where c is known
        f = None if b is not None else 1.5                          # never together with b
        rows.append((a, b, c, d, e, f))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS)).repartition(5)
    got = {(r["a"], r["b"]): r["corr"] for r in Fe.correlations(df, COLS).collect()}
    assert list(got) == [(x, y) for i, x in enumerate(COLS) for y in COLS[i + 1:]]
    for (x, y), v in got.items():
        both = np.array([(r[COLS.index(x)], r[COLS.index(y)]) for r in rows if None not in (r[COLS.index(x)], r[COLS.index(y)])])
        if not len(both) or (both.min(0) == both.max(0)).any():
            assert v is None, (x, y)
        else:
            assert abs(v - np.corrcoef(both.T)[0, 1]) < 1e-9, (x, y)
    assert got["c", "e"] is None and got["b", "f"] is None and abs(got["a", "e"]) < 1


def test_correlations_of_no_rows_and_of_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, float("nan"), 4.0), (3.0, 1.0, 1.0), (4.0, None, 0.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in Fe.correlations(df, ["a", "b", "c"]).collect()}
    assert math.isnan(got["a", "b"]) and math.isnan(got["b", "c"]) and abs(got["a", "c"] - np.corrcoef([1, 2, 3, 4], [5, 4, 1, 0])[0, 1]) < 1e-12
    assert [r["corr"] for r in Fe.correlations(df.limit(0), ["a", "b", "c"]).collect()] == [None] * 3


def test_correlations_plan_has_no_aggregate_for_each_pair(spark):
    df = spark.range(10).select(*[(F.col("id") * i).cast("double").alias(f"x{i}") for i in range(34)])
    plan = Fe.correlations(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "covar_pop" not in plan and "stddev_pop" not in plan
