"""Ordered operations inside a group that stay parallel when one group is huge.

A plain ``Window.partitionBy(conv).orderBy(turn)`` sorts a whole conversation in one
task; if one conversation holds a third of all turns, that task holds a third of the
data. Here the order column is cut into blocks of ``block`` consecutive values:

* inside a block, an ordinary window (a partition holds at most ``block`` order values);
* across blocks, one row per block (``rows / block`` rows per group) carries the block's
  total or its last value, and a window over those small rows gives the offsets;
* the offsets are joined back on ``(group, block)``.

Results equal the plain window exactly; only the partition sizes change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("long"))


def quantile_blocks(df: DataFrame, keys: list[str], order: str, out: str, blocks: int = 1024) -> DataFrame:
    """Adds a block number that rises with ``order`` and cuts each group into about equal parts, however its
    values cluster: the place of the value among approximate quantiles of its group (equal values share a block).

    The cuts are one row per group. A value is placed in two steps, among every 32nd cut and then between two of them.
    """
    step = 32
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 8 * blocks).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % step == step - 1))
    on = [F.col(f"_q.{k}").eqNullSafe(F.col(k)) for k in keys]
    cuts = cuts.select(F.struct(*keys).alias("_q"), "_cuts", "_coarse")

    def below(a):
        return F.size(F.filter(a, lambda c: c < F.col(order)))

    first = below("_coarse") * step
    placed = df.join(cuts, on).withColumn("_first", first)
    return placed.withColumn(out, (F.col("_first") + below(F.slice("_cuts", F.col("_first") + 1, F.lit(step)))).cast("long")).drop(
        "_q", "_cuts", "_coarse", "_first")


def prefix_sums(df: DataFrame, keys: list[str], order: str, values: list[str],
                block: int = DEFAULT_BLOCK, suffix: str = "_cum",
                tiebreak: list[str] | None = None, block_col: str | None = None) -> DataFrame:
    """Running sums (current row included) of ``values`` per ``keys`` in ``order``.

    ``order`` must be numeric; ``tiebreak`` columns complete the order inside equal values. ``block_col`` names a
    block number that rises with ``order`` (:func:`quantile_blocks`) in place of blocks of equal width.
    """
    tiebreak = tiebreak or []
    b = df.withColumn("_blk", F.col(block_col)) if block_col else _blocked(df, order, block)
    inner_w = (Window.partitionBy(*keys, "_blk").orderBy(order, *tiebreak)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for v in values:
        b = b.withColumn(f"_in_{v}", F.sum(v).over(inner_w))
    blk = b.groupBy(*keys, "_blk").agg(*[F.sum(v).alias(f"_bs_{v}") for v in values])
    outer_w = (Window.partitionBy(*keys).orderBy("_blk")
               .rowsBetween(Window.unboundedPreceding, -1))
    blk = blk.select(F.struct(*keys, "_blk").alias("_of"), *[
        F.coalesce(F.sum(f"_bs_{v}").over(outer_w), F.lit(0)).alias(f"_off_{v}") for v in values])
    out = b.join(blk, [F.col(f"_of.{k}").eqNullSafe(F.col(k)) for k in [*keys, "_blk"]]).drop("_of")  # a null key is a group
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_off_{v}") + F.col(f"_in_{v}"))
    return out.drop("_blk", *[f"_in_{v}" for v in values], *[f"_off_{v}" for v in values])


def previous_values(df: DataFrame, keys: list[str], order: str, values: list[str],
                    block: int = DEFAULT_BLOCK, prefix: str = "prev_") -> DataFrame:
    """``lag(value, 1)`` per ``keys`` in ``order`` (null on the first row of a group).

    ``order`` must be unique within a group.
    """
    b = _blocked(df, order, block)
    inner_w = Window.partitionBy(*keys, "_blk").orderBy(order)
    for v in values:
        b = b.withColumn(f"_lag_{v}", F.lag(v).over(inner_w))
    last = b.groupBy(*keys, "_blk").agg(
        F.max_by(F.struct(*[F.col(v).alias(v) for v in values]), F.col(order)).alias("_last"))
    outer_w = Window.partitionBy(*keys).orderBy("_blk")
    last = last.select(*keys, "_blk", F.lag("_last").over(outer_w).alias("_prev_blk"))
    out = b.join(last, [*keys, "_blk"])
    for v in values:
        out = out.withColumn(f"{prefix}{v}", F.coalesce(F.col(f"_lag_{v}"), F.col(f"_prev_blk.{v}")))
    return out.drop("_blk", "_prev_blk", *[f"_lag_{v}" for v in values])


def dense_ordinal(df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal",
                  block_col: str | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """0-based ``row_number() - 1`` per ``keys`` in ``order``, blocked on ``block_col``
    (the first, numeric order column by default)."""
    block_col = block_col or order[0]
    one = df.withColumn("_one", F.lit(1))
    res = prefix_sums(one, keys, block_col, ["_one"], block=block, tiebreak=order[1:])
    return res.withColumn(out, (F.col("_one_cum") - 1).cast("long")).drop("_one", "_one_cum")


def first_difference(x: Column, prev: Column) -> Column:
    """``x − previous x``; the first row keeps its level."""
    return F.when(prev.isNull(), x).otherwise(x - prev)
