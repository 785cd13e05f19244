"""Set operations and word classes (U2, U3, U4) and scalar helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import NUM_TEST_RE, WORD_RE
from colloquy.operators.tokens import _pos

# fixed values: place-name endings standing in for a named-entity tagger (U4)
PLACE_SUFFIXES = ("ville", "bourg", "burg", "stadt", "land", "polis")
UNIT_CLASS_COLUMNS = ("ACTEURS", "OBJETS", "LIEUX", "ACTIONS")


def union_splits(*parts: DataFrame) -> DataFrame:
    """Union of split tables by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_ragged(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of tables with different columns (missing ones null) and a provenance."""
    tagged = [df.withColumn("provenance", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def classify_words(words: DataFrame, vocabulary: DataFrame, word: str = "mot") -> DataFrame:
    """U4: each word goes to one class by priority place > verb > proper noun > common noun;
    common nouns only when the word is in ``vocabulary`` (a ``word`` column). A column
    holds the word when it is the word's class and an empty string otherwise."""
    w = words.select(F.col(word).alias("mot")).distinct()
    tok = F.struct(F.col("mot").alias("text"), F.lower("mot").alias("lw"), F.lit(0).alias("tok_id"),
                   (~F.col("mot").rlike("^" + WORD_RE)).alias("is_punct"), F.col("mot").rlike(NUM_TEST_RE).alias("is_num"))
    w = w.withColumn("_pos", _pos(tok))
    vocab = vocabulary.select(F.col("word").alias("mot"), F.lit(True).alias("_known")).distinct()
    w = w.join(vocab, "mot", "left")
    place = F.lit(False)
    for s in PLACE_SUFFIXES:
        place = place | F.lower("mot").endswith(s)
    cls = (F.when(place, "LIEUX").when(F.col("_pos") == "VERB", "ACTIONS").when(F.col("_pos") == "PROPN", "ACTEURS")
            .when((F.col("_pos") == "NOUN") & F.coalesce(F.col("_known"), F.lit(False)), "OBJETS"))
    w = w.withColumn("_cls", cls)
    return w.select("mot", *[F.when(F.col("_cls") == c, F.col("mot")).otherwise(F.lit("")).alias(c)
                             for c in UNIT_CLASS_COLUMNS])


def is_blank(text: Column) -> Column:
    """P20: null or whitespace only (Python ``not s.strip()``)."""
    return text.isNull() | text.rlike(r"^\s*$")


def accept_reject(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """P20: (accepted, rejected) — a blank text is rejected, never raised."""
    return df.filter(~is_blank(F.col(text))), df.filter(is_blank(F.col(text)))


def phrase_at(phrases: DataFrame, index: int) -> DataFrame:
    """The phrase at an ordinal; an empty result replaces the out-of-range error."""
    return phrases.filter(F.col("phrase") == index)


def duration_seconds(start: Column, end: Column) -> Column:
    """F8: whole seconds between two timestamps."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(1_000_000)).cast("bigint")
