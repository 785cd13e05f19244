"""All named queries, imported for their registration side effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans import (dialogue_queries, feature_queries, metric_queries, model_queries,  # noqa: F401
                            running_queries, sampling_queries, text_queries)
from colloquy.plans import stream_queries  # noqa: F401,E402  (reuses the W3/W4 oracles)
from colloquy.plans import io_queries, misc_queries  # noqa: F401,E402
from colloquy.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY 7.2 slice: lexical profile of every patient dialogue."""
    return QUERIES["slice"].run(spark, sf_dir)
