"""The wide indicator row per document (A20) and the population run.

A text's measures are computed on its own row; only its distinct words are looked up in the lexicons,
all of them in one join, and one aggregation by ``doc_id`` brings the sums back.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators import arrays, lexical, lexicon, syntax
from colloquy.operators.tokens import sentence_rows
from colloquy.sources.tables import EMOTIONS

# fixed values: the indicator row, in order (34 numbers; the two maps follow)
INDICATOR_COLUMNS = [
    "adj_rate", "adp_rate", "adv_rates", "conj_rate", "det_rate", "noun_rate", "pron_rate",
    "verb_rate", "propn_rate", "verb_aux_rate", "verb_obj_rate", "verb_subj_rate",
    "sub_prop_rate", "repetition_cons_rate", "verb_conj_rate", "verb_inf_rate", "total_words",
    "mean_freq_words", "range_freq_words", "std_freq_words", "Brunet_index",
    "Honore_statistic", "TTR", "anger_rate", "disgust_rate", "fear_rate", "joy_rate",
    "sadness_rate", "surprise_rate", "Score_AFINN", "unique_concept_density",
    "unique_concept_efficiency", "total_concept_density", "total_concept_efficiency",
]
MAP_COLUMNS = ["has_unit", "ratio_unit"]
BATCH_DURATION_SECONDS = 360     # fixed value: duration used by the batch load


def indicator_row(docs: DataFrame, valence: DataFrame, emotions: DataFrame,
                  dictionary: DataFrame | None = None, units: DataFrame | None = None,
                  duration: Column | None = None, a: float = lexical.REFERENCE_BRUNET_A,
                  emotion_normalised: bool = True, with_maps: bool = True,
                  tokens: DataFrame | None = None, conj_tags: tuple[str, ...] = ("CONJ",)) -> DataFrame:
    """``docs`` holds ``(doc_id, text[, duration column])``, one row a document.

    Exactly one of ``dictionary`` (units by category) and ``units`` (flat) is given. The measures of a text are array
    expressions on its own row (:mod:`colloquy.operators.arrays`); only its distinct words leave the row, as look-ups
    ``(kind, word, n)`` in one table of all lexicons, and come back in one aggregation by document. A caller that holds real parses passes
    them as ``tokens``; these are aggregated as they are.
    """
    duration = duration if duration is not None else F.lit(float(BATCH_DURATION_SECONDS))
    if tokens is not None:
        return _row_of_tokens(docs, tokens, valence, emotions, dictionary, units, duration, a, emotion_normalised, with_maps, conj_tags)
    st = arrays.with_statistics(docs.select("doc_id", duration.alias("duration"), F.coalesce("text", F.lit("")).alias("text")),
                                conj_tags=conj_tags).select("doc_id", "duration", "st.*")
    words = F.col("st.words")
    amounts = F.transform(words, lambda x: x["n"])
    scalars = {
        "duration": F.col("duration"), **{c: F.col(f"st.counts.{c}") for c in ("n_punct", *[f"n_{t}" for t in syntax.RATE_TAGS])},
        **{c: F.col(f"st.{c}") for c in ("n_doc", "n_vinf", "n_sentences", "n_sub", "n_obj", "n_subj", "n_aux", "repetition")},
        "V": F.size(words).cast("bigint"), "v1": F.size(F.filter(amounts, lambda n: n == 1)).cast("bigint"),
        "n_freq": F.aggregate(amounts, F.lit(0).cast("bigint"), lambda x, n: x + n),
        "sq_freq": F.aggregate(amounts, F.lit(0).cast("bigint"), lambda x, n: x + n * n),
        "range_freq_words": F.array_max(amounts) - F.array_min(amounts)}
    # the counters travel once, on the row of kind "row"; the look-up rows stay narrow. They are part of that entry, as a
    # generator copies every column beside it into each of its rows: a long text's word lists once for each of its words
    counters = F.struct(*[c.alias(n) for n, c in scalars.items()])
    st = st.select("doc_id", counters.alias("counters"), F.concat(
        F.transform(words, lambda x: F.struct(F.lit("emotion").alias("kind"), F.lower(x["word"]).alias("word"), x["n"].alias("n"))),
        arrays.repeated_words("st.lemmas", "unit"), arrays.repeated_words("blank_words", "valence")).alias("asked"))
    rows = st.select("doc_id", F.inline(F.concat(
        F.array(F.struct(F.lit("row").alias("kind"), F.col("doc_id").cast("string").alias("word"), F.lit(0).cast("bigint").alias("n"), "counters")),
        F.transform("asked", lambda x: F.struct(x["kind"].alias("kind"), x["word"].alias("word"), x["n"].alias("n"),
                                                F.lit(None).cast(st.schema["counters"].dataType).alias("counters"))))))
    # a lexicon has each key once, so its hashed partitions are even: no need to sort the look-ups
    found = (rows.join(lexicon.lookup_table(valence, emotions, dictionary, units).hint("shuffle_hash"), ["kind", "word"], "left")
             .filter((F.col("kind") == "row") | F.col("known")))
    unit = F.col("kind") == "unit"
    sums = [F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).cast("bigint").alias(c) for c in (*EMOTIONS, "value")]
    entries = [F.collect_list(F.when(unit, F.struct("categories", F.col("word").alias("unit"), F.col("n").alias("count")))).alias("entries")]
    d = found.groupBy("doc_id").agg(
        F.get(F.collect_list("counters"), F.lit(0)).alias("counters"), *sums, F.sum(F.when(unit, 1).otherwise(0)).alias("n_unique"),
        F.sum(F.when(unit, F.col("n") * F.size("categories")).otherwise(0)).alias("n_total"), *(entries if with_maps else []))
    return _finished(d.select("*", "counters.*"), a, emotion_normalised, with_maps, dictionary is not None)


def _finished(d: DataFrame, a: float, emotion_normalised: bool, with_maps: bool, by_category: bool) -> DataFrame:
    """The indicator row from the counters of each document."""
    total = F.col("n_doc") - F.col("n_punct")
    some = F.nullif(total.cast("double"), F.lit(0.0))
    sentences = F.nullif(F.col("n_sentences").cast("double"), F.lit(0.0))
    verbs, v = F.col("n_VERB"), F.nullif(F.col("V").cast("double"), F.lit(0.0))
    share = lambda n, den: F.when(den > 0, n / den).otherwise(F.lit(0.0))
    out = d.select(
        "doc_id", *[(F.col(f"n_{t}") / some).alias(name) for t, name in syntax.RATE_NAMES.items()],
        (F.col("n_aux") / sentences).alias("verb_aux_rate"), (F.col("n_obj") / sentences).alias("verb_obj_rate"),
        (F.col("n_subj") / sentences).alias("verb_subj_rate"), (F.col("n_sub") / sentences).alias("sub_prop_rate"),
        F.when(F.col("n_doc") > 0, F.col("repetition")).alias("repetition_cons_rate"),
        F.when(F.col("n_doc") > 0, share(verbs - F.col("n_vinf"), verbs)).alias("verb_conj_rate"),
        F.when(F.col("n_doc") > 0, share(F.col("n_vinf"), verbs)).alias("verb_inf_rate"),
        total.cast("bigint").alias("total_words"), (F.col("n_freq") / v).alias("mean_freq_words"), "range_freq_words",
        # exact integers under the root
        (F.sqrt((F.col("V") * F.col("sq_freq") - F.col("n_freq") * F.col("n_freq")).cast("double")) / v).alias("std_freq_words"),
        *lexical.diversity(F.col("n_doc"), F.col("V"), F.col("v1"), a),
        *[((F.col(e) / some) if emotion_normalised else F.col(e).cast("double")).alias(f"{e}_rate") for e in EMOTIONS],
        F.col("value").alias("Score_AFINN"),
        share(F.col("n_unique"), total).alias("unique_concept_density"), share(F.col("n_unique"), F.col("duration")).alias("unique_concept_efficiency"),
        share(F.col("n_total"), total).alias("total_concept_density"), share(F.col("n_total"), F.col("duration")).alias("total_concept_efficiency"),
        *(lexicon.entry_maps(F.col("entries"), total, by_category) if with_maps else []))
    return out.select("doc_id", *INDICATOR_COLUMNS, *(MAP_COLUMNS if with_maps else []))


def _row_of_tokens(docs, tokens, valence, emotions, dictionary, units, duration, a, emotion_normalised, with_maps, conj_tags) -> DataFrame:
    """The indicator row from a token table (real parses)."""
    base = docs.select("doc_id", duration.alias("duration"))
    # several aggregates read the token table: keep it (memory, then disk)
    tok = tokens.persist(StorageLevel.MEMORY_AND_DISK)
    syn = syntax.syntax_rates(tok, conj_tags)                      # aggregate 1: (doc, sentence)
    words = lexical.word_table(tok)                                  # aggregate 2: (doc, text, lemma)
    texts = lexical.text_table(words)
    emo = lexicon.first_wins(emotions, "word", "line_no", list(EMOTIONS))
    texts = texts.withColumn("word", F.lower("text")).join(emo, "word", "left")
    emo_sums = [F.sum(F.when(F.col("freq") > 0, F.col("freq") * F.coalesce(F.col(e), F.lit(0))))
                .cast("bigint").alias(e) for e in EMOTIONS]
    wm = lexical.word_measures(texts, emo_sums)
    val = lexicon.valence_scores(sentence_rows(docs), valence)
    counts = lexicon.unit_counts_from_words(words, dictionary=dictionary, units=units)

    row = (base.join(syn.drop("n_doc"), "doc_id", "left").join(wm, "doc_id", "left")
               .join(val, "doc_id", "left"))
    row = row.fillna(0, ["total_words", "V", "v1", "n_doc", "Score_AFINN", *EMOTIONS])
    words = F.col("total_words").cast("double")
    emo_cols = [
        ((F.col(e) / F.nullif(words, F.lit(0.0))) if emotion_normalised else F.col(e).cast("double"))
        .alias(f"{e}_rate") for e in EMOTIONS]
    row = row.select("*", *lexical.diversity(F.col("n_doc"), F.col("V"), F.col("v1"), a), *emo_cols)
    concepts = lexicon.concept_measures(
        counts, row.select("doc_id", "total_words", "duration"), F.col("duration"))
    out = row.join(concepts, "doc_id", "left")
    cols = ["doc_id", *INDICATOR_COLUMNS]
    if with_maps:
        maps = lexicon.unit_maps(counts, row.select("doc_id", "total_words"),
                                 by_category=dictionary is not None)
        out = out.join(maps, "doc_id", "left")
        cols += MAP_COLUMNS
    return out.select(*cols)


def population_run(docs: DataFrame, valence: DataFrame, emotions: DataFrame,
                   duration: Column | None = None, n_files: int | None = None) -> DataFrame:
    """Indicators over a corpus with the population settings (flat units from the
    union of the two lexicons, Brunet a = 0.5, raw emotion sums); optionally only the
    first ``n_files`` documents by id (S12/W8)."""
    if n_files is not None:
        keep = docs.select("doc_id").distinct().orderBy("doc_id").limit(n_files)
        docs = docs.join(keep, "doc_id", "left_semi")
    units = lexicon.unit_set(valence, emotions)
    return indicator_row(docs, valence, emotions, units=units, duration=duration,
                         a=lexical.POPULATION_BRUNET_A, emotion_normalised=False)
