"""Lexicon look-ups and lexicon aggregates.

Lexicons are joined, never scanned per word. No side is forced: the join is planned as a
shuffle join and adaptive execution turns it into a broadcast from the bytes it has measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import STOP_WORDS, blank_split
from colloquy.sources.tables import EMOTIONS, UNIT_CATEGORIES

# --- deduplication of keyed lexicons ---------------------------------------------------

def last_wins(lex: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """One row per key, the values of the highest ``order`` (dict overwrite)."""
    picked = F.max_by(F.struct(*values), F.col(order))
    return lex.groupBy(key).agg(picked.alias("_v")).select(key, "_v.*")


def first_wins(lex: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """One row per key, the values of the lowest ``order`` (``.iloc[0]``)."""
    picked = F.min_by(F.struct(*values), F.col(order))
    return lex.groupBy(key).agg(picked.alias("_v")).select(key, "_v.*")


def first_wins_window(lex: DataFrame, key: str, order: str) -> DataFrame:
    """W6 written as ``row_number() = 1`` (same result as :func:`first_wins`)."""
    w = Window.partitionBy(key).orderBy(F.col(order))
    return lex.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# --- look-ups -----------------------------------------------------------------------------

def valence_lookup(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """Adds ``value`` (0 when the word is absent); duplicates resolved last-wins."""
    lex = last_wins(lexicon, "word", "line_no", ["value"])
    out = words.join(lex.withColumnRenamed("word", word_col), word_col, "left")
    return out.withColumn("value", F.coalesce(F.col("value"), F.lit(0)))


def emotion_lookup(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """Inner join with the emotion flags, duplicates resolved first-wins."""
    lex = first_wins(lexicon, "word", "line_no", list(EMOTIONS))
    return words.join(lex.withColumnRenamed("word", word_col), word_col, "inner")


def unit_set(*lexicons: DataFrame) -> DataFrame:
    """Lower-cased distinct union of the word columns of several lexicons."""
    out = None
    for lx in lexicons:
        w = lx.select(F.lower(F.col("word")).alias("unit"))
        out = w if out is None else out.unionByName(w)
    return out.distinct()


def unit_categories(dictionary: DataFrame) -> DataFrame:
    """Unpivot of the classified dictionary to ``(unit, category)``; the first row of a
    word decides, empty category cells are dropped."""
    d = dictionary.withColumn("_line", F.monotonically_increasing_id()) \
        if "_line" not in dictionary.columns else dictionary
    d = d.withColumn("unit", F.lower("mot"))
    first = first_wins(d, "unit", "_line", list(UNIT_CATEGORIES))
    stacked = first.select("unit", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).isNotNull().alias("present"))
        for c in UNIT_CATEGORIES])).alias("c"))
    return stacked.filter("c.present").select("unit", F.col("c.category").alias("category"))


def unit_membership(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """Tokens whose lower-cased lemma is a unit (left semi join)."""
    t = tokens.withColumn("unit", F.lower("lemma"))
    return t.join(units.select("unit").distinct(), "unit", "left_semi")


def stop_word_table(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def drop_stop_words(words: DataFrame, spark=None, word_col: str = "word") -> DataFrame:
    """Left anti join with the stop-word list (a fixed, broadcast table)."""
    spark = spark or words.sparkSession
    sw = F.broadcast(stop_word_table(spark).withColumnRenamed("word", word_col))
    return words.join(sw, F.lower(words[word_col]) == sw[word_col], "left_anti")


# --- aggregates -----------------------------------------------------------------------------

def emotion_sums(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per document Σ freq × flag over lower-cased non-punct, non-stop tokens."""
    freq = (tokens.filter(~F.col("is_punct") & ~F.col("is_stop"))
                  .groupBy("doc_id", F.lower("text").alias("word")).count())
    hit = emotion_lookup(freq, lexicon)
    return hit.groupBy("doc_id").agg(*[
        F.sum(F.col("count") * F.col(e)).cast("bigint").alias(e) for e in EMOTIONS])


def valence_scores(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Σ lexicon value over whitespace words of the lower-cased sentences."""
    w = (sentences.select("doc_id", F.explode(blank_split(F.lower("sentence"))).alias("word"))
         .groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")))
    hit = w.join(last_wins(lexicon, "word", "line_no", ["value"]), "word")
    return hit.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("n")).cast("bigint").alias("Score_AFINN"))


def unit_counts(tokens: DataFrame, dictionary: DataFrame | None = None,
                units: DataFrame | None = None) -> DataFrame:
    """A16 long form ``(doc_id, category, unit, count)``.

    By-category mode (a classified ``dictionary``): a unit counts once per category it
    belongs to. Flat mode (a ``units`` set): category is null.
    """
    # a document's words are counted where they are read; the look-up then meets one row a word, and a unit has a category once
    t = tokens.groupBy("doc_id", F.lower("lemma").alias("unit")).agg(F.count(F.lit(1)).alias("count"))
    if dictionary is not None:
        t = t.join(unit_categories(dictionary), "unit")
    else:
        t = t.join(units.select("unit").distinct(), "unit").withColumn("category", F.lit(None).cast("string"))
    return t.select("doc_id", "category", "unit", "count")


def unit_counts_from_words(words: DataFrame, dictionary: DataFrame | None = None,
                           units: DataFrame | None = None) -> DataFrame:
    """A16 from the ``(doc, text, lemma, n_all)`` word table (no second pass over tokens)."""
    w = words.select("doc_id", F.lower("lemma").alias("unit"), "n_all")
    if dictionary is not None:
        w = w.join(unit_categories(dictionary), "unit")
    else:
        w = w.join(units.select("unit").distinct(), "unit") \
             .withColumn("category", F.lit(None).cast("string"))
    return w.groupBy("doc_id", "category", "unit").agg(F.sum("n_all").alias("count"))


def unit_maps(counts: DataFrame, total_words: DataFrame, by_category: bool = True) -> DataFrame:
    """A16/A17 as maps: ``has_unit`` (nested or flat) and ``ratio_unit`` = count / words."""
    c = counts.join(total_words, "doc_id")
    if by_category:
        inner = (c.groupBy("doc_id", "category")
                  .agg(F.map_from_entries(F.collect_list(F.struct("unit", "count"))).alias("m")))
        has = inner.groupBy("doc_id").agg(F.map_from_entries(
            F.collect_list(F.struct("category", "m"))).alias("has_unit"))
    else:
        has = c.groupBy("doc_id").agg(F.map_from_entries(
            F.collect_list(F.struct("unit", "count"))).alias("has_unit"))
    ratio = unit_ratios(counts, total_words).groupBy("doc_id").agg(F.map_from_entries(
        F.collect_list(F.struct("unit", F.col("ratio").alias("r")))).alias("ratio_unit"))
    return has.join(ratio, "doc_id")


def unit_ratios(counts: DataFrame, total_words: DataFrame) -> DataFrame:
    """A17 long form ``(doc_id, unit, ratio)``; a unit in two categories keeps the ratio of its last category (dict overwrite)."""
    one = counts.groupBy("doc_id", "unit").agg(F.max_by(F.col("count"), F.coalesce("category", F.lit(""))).alias("count"))
    return one.join(total_words, "doc_id").select("doc_id", "unit", (F.col("count") / F.col("total_words")).alias("ratio"))


def lookup_table(valence: DataFrame | None, emotions: DataFrame, dictionary: DataFrame | None = None,
                 units: DataFrame | None = None) -> DataFrame:
    """All lexicons as one table keyed by ``(kind, word)``: emotion flags, valence ``value`` and unit ``categories``
    (one null entry in flat mode); ``known`` marks a hit of a left join."""
    emo = first_wins(emotions, "word", "line_no", list(EMOTIONS)).select(F.lit("emotion").alias("kind"), "word", *EMOTIONS)
    if dictionary is not None:
        u = unit_categories(dictionary).groupBy("unit").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    else:
        u = units.select("unit").distinct().withColumn("categories", F.array(F.lit(None).cast("string")))
    u = u.select(F.lit("unit").alias("kind"), F.col("unit").alias("word"), "categories")
    out = emo.unionByName(u, allowMissingColumns=True)
    if valence is not None:
        val = last_wins(valence, "word", "line_no", ["value"]).select(F.lit("valence").alias("kind"), "word", "value")
        out = out.unionByName(val, allowMissingColumns=True)
    return out.withColumn("known", F.lit(True))


def entry_maps(entries: Column, total_words: Column, by_category: bool) -> list[Column]:
    """A16/A17 from a document's unit entries ``(categories, unit, count)``: ``has_unit`` (nested or flat) and
    ``ratio_unit`` = count / words; null without a unit."""
    def pairs(e: Column) -> Column:
        return F.map_from_entries(F.transform(e, lambda x: F.struct(x["unit"], x["count"])))

    if by_category:
        names = F.array_sort(F.array_distinct(F.flatten(F.transform(entries, lambda x: x["categories"]))))
        has = F.map_from_entries(F.transform(names, lambda c: F.struct(
            c, pairs(F.filter(entries, lambda x: F.array_contains(x["categories"], c))))))
    else:
        has = pairs(entries)
    ratio = F.map_from_entries(F.transform(entries, lambda x: F.struct(x["unit"], x["count"] / total_words)))
    some = F.size(entries) > 0
    return [F.when(some, has).alias("has_unit"), F.when(some, ratio).alias("ratio_unit")]


def concept_measures(counts: DataFrame, total_words: DataFrame, duration: Column) -> DataFrame:
    """Unique and total concept density (per word) and efficiency (per second).

    ``total_words`` holds ``(doc_id, total_words)`` for every document; ``duration`` is a
    column of it or a literal. Zero words or a duration ≤ 0 give 0.
    """
    per_doc = counts.groupBy("doc_id").agg(
        F.countDistinct("unit").alias("n_unique"), F.sum("count").alias("n_total"))
    d = total_words.join(per_doc, "doc_id", "left").withColumn("_dur", duration)
    nu = F.coalesce("n_unique", F.lit(0))
    nt = F.coalesce("n_total", F.lit(0))
    words = F.col("total_words")

    def guarded(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    return d.select(
        "doc_id",
        guarded(nu, words).alias("unique_concept_density"),
        guarded(nu, F.col("_dur")).alias("unique_concept_efficiency"),
        guarded(nt, words).alias("total_concept_density"),
        guarded(nt, F.col("_dur")).alias("total_concept_efficiency"),
    )
