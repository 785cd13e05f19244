"""Driver tables and the stand-ins derived from them.

Every stand-in is a Spark transformation of the given parquet tables, so its size grows
with them: turns come from ``conversations``, participants from ``documents`` ⋈ ``labels``,
lexicons from the corpus vocabulary by an md5 rule (the same rule the SQL oracle uses).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import WORD_RE, md5_int

# --- fixed values: stand-in rules ---------------------------------------------------------
SPEAKER_OF_ROLE = {"assistant": 1, "user": 2}      # clinician 1, patient 2; others dropped
EMOTIONS = ("joy", "fear", "sadness", "anger", "surprise", "disgust")
UNIT_CATEGORIES = ("ACTEURS", "OBJETS", "LIEUX", "ACTIONS")
VALENCE_MOD, VALENCE_DUP_MOD = 7, 49               # word in lexicon / listed twice
EMOTION_MOD, EMOTION_DUP_MOD = 5, 25
UNIT_MOD = 11
SPREAD_ROWS = 1 << 14                              # texts in a task
SESSION_BASE_EPOCH = 1704067200                    # session clock: 2024-01-01 UTC + conv·1h + turn·30s


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over tasks of at most ``SPREAD_ROWS``, one for each core at least, when the scan yields fewer.

    A split of a text table holds far more words than one of numbers, and the text work of a small single-file table
    otherwise runs in one task. The rows are counted by the scan (from a Parquet file's footer).
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    if df.rdd.getNumPartitions() < tasks:
        return df.repartition(tasks)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 turn table ``(conv_id, turn, speaker, text)`` (P1/P5 on the role)."""
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    speaker = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 2)
    return (c.filter(F.col("role").isin(list(SPEAKER_OF_ROLE)))
             .select("conv_id", "turn", speaker.cast("int").alias("speaker"), "text"))


def split_of(doc_id) -> "F.Column":
    """D8 split id from the participant id: 0-1 → 1 test, 2 → 2 validation, else 3 train."""
    m = F.pmod(doc_id, F.lit(10))
    return F.when(m <= 1, 1).when(m == 2, 2).otherwise(3).cast("int")


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 stand-in: labelled documents with a split id."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    lab = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return (d.join(lab, "doc_id")
             .select(F.col("doc_id").alias("participant_id"), F.col("text").alias("dialogue"),
                     F.col("toxic").alias("phq_binary"), F.col("quality"),
                     split_of(F.col("doc_id")).alias("partof")))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case words of documents and conversations, with their md5 integer."""
    pat = F.lit(WORD_RE)
    d = read(spark, sf_dir, "documents", "text")
    c = read(spark, sf_dir, "conversations", "text")
    w = (spread(d.unionByName(c))
          .select(F.explode(F.regexp_extract_all(F.lower("text"), pat, 0)).alias("word"))
          .distinct())
    # three lexicons and their size checks read it: computed once, kept (identical plans
    # share the cache entry, so repeated calls do not recompute it either)
    return w.withColumn("h", md5_int("word")).persist(StorageLevel.MEMORY_AND_DISK)


def valence_lexicon(vocab: DataFrame) -> DataFrame:
    """``(word, value, line_no)``; some words are listed twice (the later line wins, S4)."""
    base = vocab.filter(F.col("h") % VALENCE_MOD == 0)
    first = base.select("word", ((F.floor(F.col("h") / VALENCE_MOD) % 11) - 5).cast("int").alias("value"),
                        (F.col("h") * 2).alias("line_no"))
    dup = base.filter(F.col("h") % VALENCE_DUP_MOD == 0).select(
        "word", ((F.floor(F.col("h") / VALENCE_DUP_MOD) % 11) - 5).cast("int").alias("value"),
        (F.col("h") * 2 + 1).alias("line_no"))
    return first.unionByName(dup)


def emotion_lexicon(vocab: DataFrame) -> DataFrame:
    """``(word, joy … disgust, line_no)`` 0/1 flags; duplicates: the first line wins."""
    base = vocab.filter(F.col("h") % EMOTION_MOD == 1)

    def flags(shift):
        return [(F.shiftright("h", shift + i) % 2).cast("int").alias(e) for i, e in enumerate(EMOTIONS)]

    first = base.select("word", *flags(4), (F.col("h") * 2).alias("line_no"))
    dup = base.filter(F.col("h") % EMOTION_DUP_MOD == 1).select(
        "word", *flags(12), (F.col("h") * 2 + 1).alias("line_no"))
    return first.unionByName(dup)


def unit_dictionary(vocab: DataFrame) -> DataFrame:
    """Classified units ``(mot, ACTEURS, OBJETS, LIEUX, ACTIONS, provenance)``.

    A category cell holds the word when the unit belongs to it and is null otherwise.
    """
    base = vocab.filter(F.col("h") % UNIT_MOD == 3)
    cats = [F.when(F.shiftright("h", 5 + i) % 2 == 1, F.col("word")).alias(c)
            for i, c in enumerate(UNIT_CATEGORIES)]
    return base.select(F.col("word").alias("mot"), *cats, F.lit("vocabulary").alias("provenance"))


def session_clock(turns_df: DataFrame) -> DataFrame:
    """Adds ``ts`` = base + conv_id hours + turn · 30 s (the live-session stand-in)."""
    secs = F.lit(SESSION_BASE_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 30
    return turns_df.withColumn("ts", F.timestamp_seconds(secs))
