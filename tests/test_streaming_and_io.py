"""Stream = batch for the live session; file layouts round-trip; the driver contract."""
import os

from pyspark.sql import functions as F

from colloquy.operators import running as R
from colloquy.plans.registry import rounded
from colloquy.sources import files as Fi
from colloquy.sources import tables as S
from colloquy.streaming import session as St

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    turns = S.turns(spark, SF).filter("conv_id < 6")
    phr = S.session_clock(R.phrases(turns)).select("conv_id", "phrase", "turn", "ts", "text")
    vocab = S.vocabulary(spark, SF)
    val, emo = S.valence_lexicon(vocab), S.emotion_lexicon(vocab)
    from colloquy.operators import lexicon as X
    units = X.unit_set(val, emo)
    src = str(tmp_path / "src")
    mx = phr.agg(F.max("phrase")).first()[0]
    for lo in range(0, mx + 1, 3):
        phr.filter((F.col("phrase") >= lo) & (F.col("phrase") < lo + 3)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(St.PHRASE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    sink = str(tmp_path / "sink")
    St.run_to_end(St.session_stream(stream, emo, units), sink, str(tmp_path / "ckpt"))
    got = rounded(spark.read.parquet(sink).select("conv_id", "phrase", *R.RUNNING_SERIES,
                                                  *[f"delta_{s}" for s in R.RUNNING_SERIES]))
    batch = R.running_levels(R.session_counters(turns, emo, units), with_differences=True)
    want = rounded(batch.drop("turn"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_read_or_empty_and_existing(spark, tmp_path):
    missing = str(tmp_path / "nothing")
    assert Fi.read_or_empty(spark, missing, "a long").count() == 0
    assert Fi.existing(spark, [missing, str(tmp_path)]) == [str(tmp_path)]


def test_split_argument_check(spark):
    df = spark.createDataFrame([(1, 1, 0)], "participant_id long, partof int, phq_binary int")
    try:
        Fi.participant_column(df, 4, "phq_binary")
        raise AssertionError("split 4 must be refused")
    except ValueError:
        pass


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "Brunet_index" in df.columns
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
