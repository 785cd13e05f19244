"""Rebalancing samplers: exact k nearest neighbours, SMOTE, ADASYN (M5–M7).

Exact kNN without enumerating pairs in the plan: rows are cut into blocks of at most
``block_rows`` (by hash rank inside each group), every unordered pair of blocks is one group
that finds with numpy the ``k`` best of each row of either block in the other: a matrix product
rules out pairs beyond its rounding bound, exact differences decide among the rest; a
``row_number() <= k`` per row then merges the block winners (Spark cuts each row's
candidates to ``k`` per map task before the shuffle). Memory per task is two blocks.

Synthetic rows are generated from per-row quotas with ``sequence``/``explode``; the
neighbour and the interpolation factor of sample *s* of row *i* come from md5(i, s, seed),
so the output does not depend on partitioning or on task retries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import md5_int
from colloquy.operators.features import hash_rank
from colloquy.session import cut_lineage

K_NEIGHBOURS = 5          # fixed value: library default of both samplers
SEED = 42
BLOCK_ROWS = 16384
SMALL_BLOCK_ROWS, SMALL_BLOCKS = 1024, 8      # groups of up to 8 blocks are cut into blocks of 1024 rows or more
LEFT_ROWS = 256           # rows of a block whose distances are held at once
PAIRS_HELD = 1 << 22      # pairs of rows whose distances are held at once


def _nearest(a: np.ndarray, lid: np.ndarray, b: np.ndarray, rid: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest of the rows ``b`` (in id order) for each of ``a``; rows of the same id are not compared.

    One matrix product gives all distances up to a rounding error with a known bound. Only pairs that may be among a
    row's ``k`` within that bound are measured by exact differences, so the result is that of measuring all.
    """
    dims = a.shape[1]
    middle = b.mean(axis=0)
    ac, bc = a - middle, b - middle
    an, bn = (ac * ac).sum(axis=1), (bc * bc).sum(axis=1)
    bound = 16 * (dims + 8) * np.finfo(float).eps * (an + bn.max())
    finite = bool(np.isfinite(bound).all())
    starts = np.unique(np.linspace(0, len(b), max(64, 4 * k), endpoint=False).astype(int))
    shared = np.flatnonzero(np.isin(lid, rid))
    ac *= -2
    out = []
    step = max(1, min(LEFT_ROWS, PAIRS_HELD // len(b)))
    for at in range(0, len(a), step):
        part = slice(at, at + step)
        own = [(i - at, lid[i] == rid) for i in shared[(shared >= at) & (shared < at + step)]]
        near = np.ones((len(a[part]), len(b)), dtype=bool)
        if finite and len(starts) >= k:
            d2 = ac[part] @ bc.T                            # squared distances less the left row's own square
            d2 += bn
            for i, same in own:
                d2[i, same] = np.inf
            # k stretches have a row at or below the k-th lowest minimum, so the k-th nearest is not above it
            limit = np.partition(np.minimum.reduceat(d2, starts, axis=1), k - 1, axis=1)[:, k - 1]
            np.less_equal(d2, (limit + bound[part])[:, None], out=near)
        for i, same in own:
            near[i, same] = False
        rows, cols = np.nonzero(near)
        d2 = np.zeros(len(rows))
        for c in range(dims):                               # exact differences, a column at a time
            d2 += (a[part][rows, c] - b[cols, c]) ** 2
        order = np.lexsort((cols, d2, rows))                # right rows stand by id: ties go to the lowest
        rows, cols, d2 = rows[order], cols[order], d2[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append(pd.DataFrame({"id": lid[part][rows[best]], "nid": rid[cols[best]], "dist": np.sqrt(d2[best])}))
    return pd.concat(out)


def _knn_block(k: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        first, second = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        one_block = pdf["_bi"].iloc[0] == pdf["_bj"].iloc[0]
        if first.empty or (second.empty and not one_block):
            return pd.DataFrame({"_g": [], "id": [], "nid": [], "dist": []})
        sides = [(np.stack(s["vec"].to_numpy()).astype(float), s["id"].to_numpy()) for s in ((first,) if one_block else (first, second))]
        found = [_nearest(*sides[0], *sides[-1], k)]
        if not one_block:
            found.append(_nearest(*sides[1], *sides[0], k))
        out = pd.concat(found)
        out.insert(0, "_g", pdf["_g"].iloc[0])
        return out
    return fn


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = K_NEIGHBOURS, group: str | None = None,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """M7: ``(group, id, nid, dist, rank)`` — the ``k`` nearest rows (Euclidean, same group).

    Ties in distance are broken by neighbour id. ``group`` restricts neighbours to rows
    with the same value (e.g. the class); ``None`` searches all rows.
    """
    g = F.col(group) if group else F.lit(0)
    base = df.select(g.cast("long").alias("_g"), F.col(id_col).cast("long").alias("id"),
                     F.col(vec_col).cast("array<double>").alias("vec"))
    sizes = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # blocks of at most block_rows; a small group is cut finer, so that its pairs of blocks keep the cores busy
    blocks = F.greatest(F.ceil(F.col("_n") / block_rows), F.least(F.ceil(F.col("_n") / SMALL_BLOCK_ROWS), F.lit(SMALL_BLOCKS)))
    sizes = sizes.withColumn("_nb", blocks.cast("long"))
    r = hash_rank(base, ["_g"], "id").join(F.broadcast(sizes), "_g")
    r = r.withColumn("_blk", F.floor(F.col("_rank") * F.col("_nb") / F.col("_n")).cast("long"))
    # each pair of blocks once, i <= j: a row goes to the pairs of its block, on the left or on the right
    places = F.expr("concat(transform(sequence(_blk, _nb - 1), j -> struct(_blk AS _bi, j AS _bj, 0 AS _side)), "
                    "IF(_blk = 0, array(), transform(sequence(0L, _blk - 1), i -> struct(i AS _bi, _blk AS _bj, 1 AS _side))))")
    pairs = r.select("_g", F.inline(places), "id", "vec").groupBy("_g", "_bi", "_bj").applyInPandas(
        _knn_block(k), "_g long, id long, nid long, dist double")
    from pyspark.sql import Window
    w = Window.partitionBy("_g", "id").orderBy("dist", "nid")
    best = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    out = best.select("_g", "id", "nid", "dist", (F.col("rank") - 1).alias("rank"))
    return out.withColumnRenamed("_g", group) if group else out.drop("_g")


def _interpolate(base: DataFrame, neighbours: DataFrame, id_col: str, vec_col: str, label: str,
                 minority, k: int, seed: int) -> DataFrame:
    """Synthetic rows for ``base`` rows with a ``_quota`` column (shared by M5 and M6).

    The neighbour is drawn among those a row has: fewer than ``k`` in a class of ``k`` rows or less.
    """
    s = base.filter(F.col("_quota") > 0).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
        F.explode(F.sequence(F.lit(0), F.col("_quota") - 1)).alias("s"))
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("s").cast("string"), F.lit(str(seed)))
    s = s.join(neighbours.groupBy("id").agg(F.count(F.lit(1)).alias("_n_nb")), "id")
    s = s.withColumn("_nb_rank", (md5_int(F.concat(key, F.lit(":nb"))) % F.col("_n_nb")).cast("long")) \
         .withColumn("_gap", (md5_int(F.concat(key, F.lit(":gap")), 6) / F.lit(float(1 << 24))))
    nvec = neighbours.select("id", F.col("rank").alias("_nb_rank"), "nid")
    vecs = base.select(F.col(id_col).cast("long").alias("nid"), F.col(vec_col).cast("array<double>").alias("nvec"))
    j = s.join(nvec, ["id", "_nb_rank"]).join(vecs, "nid")
    new = F.zip_with("vec", "nvec", lambda a, b: a + F.col("_gap") * (b - a))
    return j.select(F.lit(None).cast("long").alias(id_col), F.lit(minority).alias(label), new.alias(vec_col),
                    F.lit(True).alias("synthetic"), F.col("id").alias("source_id"), "s")


def _classes(df: DataFrame, label: str):
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c if isinstance(c, (int, float)) else 0))
    if counts[minority] < 2 <= counts[majority]:
        raise ValueError(f"class {minority!r} has one row: it has no neighbour to interpolate with")
    return minority, counts[minority], counts[majority]


def smote(df: DataFrame, id_col: str, vec_col: str, label: str, k: int = K_NEIGHBOURS,
          seed: int = SEED) -> DataFrame:
    """M5: oversample the minority class to the majority count; a synthetic row lies on the
    segment between a minority row and one of its ``k`` minority neighbours."""
    minority, n_min, n_maj = _classes(df, label)
    g = n_maj - n_min
    mino = df.filter(F.col(label) == minority)
    nbrs = knn(mino, id_col, vec_col, k)
    ranked = hash_rank(mino.withColumn("_one", F.lit(0)), ["_one"], id_col, seed)
    quota = F.lit(g // n_min) + (F.col("_rank") < F.lit(g % n_min)).cast("long")
    base = ranked.withColumn("_quota", quota)
    synth = _interpolate(base, nbrs, id_col, vec_col, label, minority, k, seed)
    orig = df.select(F.col(id_col).cast("long").alias(id_col), label, F.col(vec_col).cast("array<double>").alias(vec_col),
                     F.lit(False).alias("synthetic"), F.lit(None).cast("long").alias("source_id"),
                     F.lit(None).cast("int").alias("s"))
    return orig.unionByName(synth)


def adasyn(df: DataFrame, id_col: str, vec_col: str, label: str, k: int = K_NEIGHBOURS,
           seed: int = SEED) -> DataFrame:
    """M6: quota of each minority row ∝ share of other-class rows among its ``k`` nearest
    neighbours in the whole set; interpolation toward minority neighbours as in M5."""
    minority, n_min, n_maj = _classes(df, label)
    g = n_maj - n_min
    all_nbrs = knn(df, id_col, vec_col, k)
    lab = df.select(F.col(id_col).cast("long").alias("nid"), F.col(label).alias("_nl"))
    ratio = (all_nbrs.join(lab, "nid").groupBy("id")
             .agg((F.sum((F.col("_nl") != minority).cast("double")) / F.lit(float(k))).alias("_r")))
    mino = df.filter(F.col(label) == minority)
    # read for the total, the quotas and the vectors: the neighbours of all rows are searched once
    m = cut_lineage(mino.join(ratio.withColumnRenamed("id", id_col), id_col, "left").fillna(0.0, ["_r"]))
    total = m.agg(F.sum("_r")).first()[0] or 0.0
    if total == 0:
        quota = F.lit(0).cast("long")
    else:
        quota = F.bround(F.col("_r") / F.lit(total) * F.lit(float(g)), 0).cast("long")
    base = m.withColumn("_quota", quota)
    nbrs = knn(mino, id_col, vec_col, k)
    synth = _interpolate(base, nbrs, id_col, vec_col, label, minority, k, seed)
    orig = df.select(F.col(id_col).cast("long").alias(id_col), label, F.col(vec_col).cast("array<double>").alias(vec_col),
                     F.lit(False).alias("synthetic"), F.lit(None).cast("long").alias("source_id"),
                     F.lit(None).cast("int").alias("s"))
    return orig.unionByName(synth)
