"""Word-frequency statistics and lexical diversity.

Input is a token table (see :mod:`colloquy.operators.tokens`). Three different counters
exist on purpose: ``n_doc`` counts every token (punctuation included), the frequency list
excludes punctuation, stop words and line breaks, and the frequency statistics also drop
determiners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE_BRUNET_A = 0.165       # fixed value: Brunet exponent of the batch indicators
POPULATION_BRUNET_A = 0.5        # fixed value: exponent used by the population run


def _countable() -> Column:
    return ~F.col("is_punct") & ~F.col("is_stop") & ~F.col("text").contains("\n")


def word_frequency(tokens: DataFrame, lower: bool = False, drop_det: bool = False) -> DataFrame:
    """A1: ``(doc_id, word, freq)`` over countable tokens (case kept unless ``lower``)."""
    cond = _countable()
    if drop_det:
        cond = cond & (F.col("pos") != "DET")
    word = F.lower("text") if lower else F.col("text")
    return (tokens.filter(cond).groupBy("doc_id", word.alias("word"))
                  .agg(F.count(F.lit(1)).alias("freq")))


def text_frequencies(tokens: DataFrame) -> DataFrame:
    """One pass for A2–A6: per ``(doc, text)`` the count without stop words and the count
    without stop words and determiners. Partial aggregation collapses a document's
    repeated words before the shuffle."""
    cond = _countable()
    return (tokens.filter(cond).groupBy("doc_id", "text").agg(
        F.count(F.lit(1)).alias("freq"),
        F.sum((F.col("pos") != "DET").cast("int")).alias("freq_nodet")))


def word_table(tokens: DataFrame) -> DataFrame:
    """One aggregate for every word-level measure: per ``(doc, text, lemma)`` the countable
    frequency (``freq``), the same without determiners (``freq_nodet``) and all occurrences
    (``n_all``, for unit look-ups by lemma)."""
    cond = _countable()
    return tokens.groupBy("doc_id", "text", "lemma").agg(
        F.sum(cond.cast("long")).alias("freq"),
        F.sum((cond & (F.col("pos") != "DET")).cast("long")).alias("freq_nodet"),
        F.count(F.lit(1)).alias("n_all"))


def text_table(words: DataFrame) -> DataFrame:
    """Per ``(doc, text)`` sums of :func:`word_table` (a text under two lemmas counts once)."""
    return words.groupBy("doc_id", "text").agg(F.sum("freq").alias("freq"),
                                                 F.sum("freq_nodet").alias("freq_nodet"),
                                                 F.sum("n_all").alias("n_all"))


def word_measures(texts: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """A2 + A3 per document in one aggregation over :func:`text_table` rows, plus ``extra``
    aggregates over the same rows (e.g. emotion sums)."""
    nd = F.when(F.col("freq_nodet") > 0, F.col("freq_nodet"))
    return texts.groupBy("doc_id").agg(
        F.sum((F.col("freq") > 0).cast("long")).alias("V"),
        F.sum((F.col("freq") == 1).cast("long")).alias("v1"),
        F.avg(nd).alias("mean_freq_words"),
        (F.max(nd) - F.min(nd)).cast("bigint").alias("range_freq_words"),
        F.stddev_pop(nd).alias("std_freq_words"),
        F.sum("n_all").alias("n_doc"),
        *(extra or []))


def frequency_stats(freqs: DataFrame) -> DataFrame:
    """A2: mean, range (max − min) and population std of the non-DET frequencies."""
    f = freqs.filter(F.col("freq_nodet") > 0)
    return f.groupBy("doc_id").agg(
        F.avg("freq_nodet").alias("mean_freq_words"),
        (F.max("freq_nodet") - F.min("freq_nodet")).cast("bigint").alias("range_freq_words"),
        F.stddev_pop("freq_nodet").alias("std_freq_words"))


def vocabulary_counts(freqs: DataFrame) -> DataFrame:
    """A3: V (distinct countable words) and v1 (words seen once)."""
    return freqs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("V"), F.sum((F.col("freq") == 1).cast("long")).alias("v1"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """``n_doc`` = all tokens, ``total_words`` = non-punct, non-line-break tokens."""
    return tokens.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_doc"),
        F.sum((~F.col("is_punct") & ~F.col("text").contains("\n")).cast("long")).alias("total_words"))


def diversity(n_doc: Column, V: Column, v1: Column, a: float = REFERENCE_BRUNET_A) -> list[Column]:
    """A4–A6 from the counters; undefined values are null (N = 0, V = 0, all hapax)."""
    n = n_doc.cast("double")
    brunet = F.when((n > 0) & (V > 0), F.pow(n, F.pow(V.cast("double"), F.lit(-a))))
    honore_den = F.lit(1.0) - v1 / F.nullif(n, F.lit(0.0))
    honore = F.when((n > 0) & (honore_den != 0), F.lit(100.0) * F.ln(n) / honore_den)
    ttr = v1 / F.nullif(n, F.lit(0.0))
    return [brunet.alias("Brunet_index"), honore.alias("Honore_statistic"), ttr.alias("TTR")]


def lexical_diversity(tokens: DataFrame, a: float = REFERENCE_BRUNET_A) -> DataFrame:
    """A3–A6 per document: ``n_doc, V, v1, Brunet_index, Honore_statistic, TTR`` — one pass:
    N is the sum of all occurrences in the same word-level aggregate."""
    d = word_measures(text_table(word_table(tokens)))
    return d.select("doc_id", "n_doc", "V", "v1", *diversity(F.col("n_doc"), F.col("V"), F.col("v1"), a))
