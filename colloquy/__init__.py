"""colloquy: dialogue analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   – readers for the turn, transcript, note, lexicon and participant layouts,
                  plus the stand-in tables derived from the driver parquet files, and sinks;
* ``functions`` – column-expression helpers (segmentation, hashing, formatting, JSON);
* ``operators`` – token table, lexical / lexicon / syntax aggregates, the wide indicator
                  row, dialogue shaping, running indicators, report rows, ML features,
                  rebalancing samplers, models and evaluation metrics;
* ``streaming`` – the live session as Structured Streaming state;
* ``plans``     – the named queries (and their SQL oracles) run by the driver and the bench.
"""

from colloquy.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
