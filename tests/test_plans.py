"""Plan shapes behind the scale claims: no shuffle to build tokens, partial aggregation,
pruned scans, partition pruning, size-checked broadcast, bounded top-k."""
import contextlib
import io

from pyspark.sql import functions as F

from colloquy.operators import lexicon as X
from colloquy.operators import syntax as Y
from colloquy.operators.running import top_words
from colloquy.operators.tokens import annotate
from colloquy.sources import tables as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_token_table_is_narrow(spark):
    docs = S.documents(spark, SF)
    p = plan(annotate(docs))
    assert "Exchange" not in p and "Generate" in p


def test_sentence_aggregate_is_partial(spark):
    p = plan(Y.sentence_stats(annotate(S.documents(spark, SF))))
    assert "partial_sum" in p or "partial_count" in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(S.documents(spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_split_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "participants")
    S.participants(spark, SF).drop("dialogue").write.partitionBy("partof").parquet(path)
    p = plan(spark.read.parquet(path).filter(F.col("partof") == 1).select("participant_id"))
    assert "PartitionFilters: [isnotnull(partof" in p and "(partof#" in p


def test_no_lexicon_is_forced_into_a_broadcast(spark):
    """Nothing is counted or hinted while the plan is built: Spark decides from sizes it knows."""
    lex = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "word string, value int, line_no long")
    words = spark.createDataFrame([("a",), ("c",)], "word string")
    out = X.valence_lookup(words, lex)
    assert "strategy=broadcast" not in out._jdf.queryExecution().logical().toString()
    assert {r["word"]: r["value"] for r in out.collect()} == {"a": 1, "c": 0}


def test_top_k_is_cut_before_shuffle(spark):
    counts = spark.createDataFrame([(1, f"w{i}", i % 7) for i in range(200)], "doc_id long, unit string, count long")
    p = plan(top_words(counts, k=5))
    assert "WindowGroupLimit" in p


def test_group_windows_are_blocked(spark):
    """A conversation holding most turns is never one window partition: every window of
    the running sums is partitioned by (group, block) or runs over one row per block."""
    from colloquy.operators.sequence import prefix_sums
    rows = [(1, i, 1) for i in range(5000)] + [(2, i, 1) for i in range(10)]       # one hot group
    df = spark.createDataFrame(rows, "g long, o long, v long")
    out = prefix_sums(df, ["g"], "o", ["v"], block=256)
    p = plan(out)
    assert "_blk" in p and "Window" in p
    got = {r["o"]: r["v_cum"] for r in out.filter("g = 1").collect()}
    assert got[0] == 1 and got[4999] == 5000 and got[256] == 257
    counts = out.filter("g = 1").groupBy((F.floor(F.col("o") / 256)).alias("b")).count().agg(F.max("count")).first()[0]
    assert counts <= 256
