"""Writers for the reference's outputs (K1–K6); K7 lives with the models.

All sinks are distributed writes (one file per task); entity keys that the layouts keep
in file names become partition folders (``key=value``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.features import encode_indicators


def write_tsv(df: DataFrame, path: str, partition_by: str | None = None, header: bool = True) -> None:
    """K1: tab-separated text with header (values with tabs or newlines are quoted)."""
    w = df.write.mode("overwrite").option("sep", "\t").option("header", header)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", partition_by: list[str] | None = None) -> None:
    """K2 and the other CSV layouts: header, quotes doubled inside quoted fields."""
    w = (df.write.mode("overwrite").option("sep", sep).option("header", True)
         .option("quote", '"').option("escape", '"'))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_participants(df: DataFrame, path: str) -> None:
    """K3: participants with the indicator row JSON-encoded, partitioned by split id so that
    a split filter prunes folders."""
    out = encode_indicators(df) if "indicateur" not in df.columns else df
    out.write.mode("overwrite").partitionBy("partof").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """K4 (re-aimed): the population result as JSON Lines, one object per document; the
    reference's single dict-of-lists object would pass every row through one task."""
    df.write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """K5: evaluation report lines per variant (text), from the metrics table."""
    line = F.format_string("%-14s %9.2f %9.2f %9.2f %9d", F.col("row"), F.coalesce("precision", F.lit(0.0)),
                           F.coalesce("recall", F.lit(0.0)), F.col("f1"), F.col("support"))
    metrics.select("variant", line.alias("value")).write.mode("overwrite").partitionBy("variant").text(path)
