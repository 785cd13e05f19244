"""Running analytics of a session, phrase by phrase.

A session is a conversation; its phrases are the sentences of the patient's turns in order.
The live service recomputed every indicator on the whole accumulated text after each
phrase (quadratic). Here each indicator is a ratio of counters that add up over phrases,
so the level after phrase *k* is a running sum (blocked, see
:mod:`colloquy.operators.sequence`) — linear work. The hapax count uses +1 at a word's first
occurrence and −1 at its second. Each phrase is annotated on its own, as it arrives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.text import sentences
from colloquy.operators import arrays
from colloquy.operators import lexicon as X
from colloquy.operators.sequence import DEFAULT_BLOCK, dense_ordinal, first_difference, previous_values
from colloquy.session import write_stage
from colloquy.sources.tables import EMOTIONS

# fixed values: the series the live client plots
RUNNING_SERIES = ["TTR", "adv_rates", "verb_conj_rate", "total_concept_density",
                  *[f"{e}_rate" for e in ("anger", "disgust", "fear", "joy", "sadness", "surprise")]]
COUNTERS = ["n_doc", "total", "n_adv", "n_verb", "n_vconj", "n_units", "hapax", *EMOTIONS]


def phrases(turns: DataFrame) -> DataFrame:
    """``(conv_id, phrase, turn, text)``: patient sentences with their order in the session."""
    s = turns.filter(F.col("speaker") == 2).select(
        "conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("pos", "text"))
    s = s.withColumn("pos", F.col("pos").cast("int"))
    return dense_ordinal(s, ["conv_id"], ["turn", "pos"], out="phrase").select("conv_id", "phrase", "turn", "text")


def phrase_statistics(phr: DataFrame) -> DataFrame:
    """Counters of each phrase ``(…, text)`` on its own row, and the run lengths of its words and lemmas."""
    infinitive = " OR ".join(f"endswith(a.lw, '{x}')" for x in T.VERB_INF_SUFFIXES)

    def count(t: str, condition: str) -> str:
        return f"CAST(size(filter({t}, a -> {condition})) AS BIGINT)"

    st = arrays.let(arrays.tagged_tokens("array(text)"), lambda t: (
        f"""named_struct('n_doc', CAST(size({t}) AS BIGINT), 'total', {count(t, "a.pos <> 'PUNCT'")}, 'n_adv', {count(t, "a.pos = 'ADV'")}, """
        f"""'n_verb', {count(t, "a.pos = 'VERB'")}, 'n_vconj', {count(t, f"a.pos = 'VERB' AND NOT ({infinitive})")}, """
        f"""'words', {arrays.run_lengths(f"transform(filter({t}, a -> a.pos <> 'PUNCT' AND NOT {T.is_stop_sql('a.lw')}), a -> a.text)")}, """
        f"""'lemmas', {arrays.run_lengths(f"transform({t}, a -> a.lw)")})"""))
    return phr.withColumn("st", F.expr(st)).select(*[c for c in phr.columns if c != "text"], "st.*")


def session_counters(turns: DataFrame, emotions: DataFrame, units: DataFrame) -> DataFrame:
    """One row of additive counters per phrase: ``(conv_id, turn, pos, *COUNTERS)``.

    The turns are read once; the phrases' own counters and distinct words are written to the shared folder. From there the words are looked up, and
    the first two phrases of a word in its session give the hapax steps (ranked per word, cut to two rows before the
    shuffle). All contributions are added up in one aggregation.
    """
    keys = ["conv_id", "turn", "pos"]
    phr = turns.filter(F.col("speaker") == 2).select(
        "conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("pos", "text"))
    st = write_stage(phrase_statistics(phr), "phrases")
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*keys, *[F.coalesce(given.get(c, zero), zero).cast("bigint").alias(c) for c in COUNTERS])

    own = part(st, **{c: F.col(c) for c in ("n_doc", "total", "n_adv", "n_verb", "n_vconj")})
    asked = st.select(*keys, F.explode(F.concat(
        F.transform("words", lambda x: F.struct(F.lit("emotion").alias("kind"), F.lower(x["word"]).alias("word"), x["n"].alias("n"))),
        arrays.repeated_words("lemmas", "unit"))).alias("w")).select(*keys, "w.*")
    found = asked.join(X.lookup_table(None, emotions, units=units).hint("shuffle_hash"), ["kind", "word"])
    looked_up = part(found, n_units=F.when(F.col("kind") == "unit", F.col("n")), **{e: F.col("n") * F.col(e) for e in EMOTIONS})
    # hapax: +1 at a word's first phrase if it occurs once there; −1 at its second phrase if it was one until then
    w = Window.partitionBy("conv_id", "word").orderBy("turn", "pos")
    seen = st.select(*keys, F.explode("words").alias("w")).select(*keys, "w.*").withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    seen = seen.withColumn("_before", F.lag("n").over(w))
    step = F.when(F.col("_rank") == 1, F.when(F.col("n") == 1, 1).otherwise(0)).otherwise(F.when(F.col("_before") == 1, -1).otherwise(0))
    rows = own.unionByName(looked_up).unionByName(part(seen, hapax=step))
    return write_stage(rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS]), "phrase-counters")


def _levels(counter: Callable[[str], Column]) -> dict[str, Column]:
    """Level of each series from its cumulated counters."""
    total = counter("total").cast("double")

    def per_word(c: str) -> Column:
        return F.when(total > 0, counter(c) / total)

    return {
        "TTR": counter("hapax") / F.nullif(counter("n_doc").cast("double"), F.lit(0.0)),
        "adv_rates": per_word("n_adv"),
        "verb_conj_rate": F.when(counter("n_verb") > 0, counter("n_vconj") / counter("n_verb")).otherwise(F.lit(0.0)),
        "total_concept_density": F.when(total > 0, counter("n_units") / total).otherwise(F.lit(0.0)),
        **{f"{e}_rate": per_word(e) for e in ("anger", "disgust", "fear", "joy", "sadness", "surprise")}}


def running_levels(counters: DataFrame, with_differences: bool = False, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Level of each series after every phrase; W4 as well on demand.

    A fused scan over blocks of turns: block totals give each block's offset (one row a block), and one window inside
    the blocks adds up. A phrase's counters are its cumulated ones less those before it, so the previous
    level comes from the same row and no lag has to reach over a block's border.
    """
    b = counters.withColumn("_blk", F.floor(F.col("turn") / F.lit(block)).cast("long")).withColumn("_one", F.lit(1).cast("bigint"))
    names = [*COUNTERS, "_one"]
    earlier = Window.partitionBy("conv_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("conv_id", "_blk").agg(*[F.sum(c).alias(c) for c in names]).select(
        "conv_id", "_blk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off_{c}") for c in names])
    inside = Window.partitionBy("conv_id", "_blk").orderBy("turn", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = b.join(offsets, ["conv_id", "_blk"]).select(
        "conv_id", "turn", *names, *[(F.col(f"_off_{c}") + F.sum(c).over(inside)).alias(f"{c}_cum") for c in names])
    now = _levels(lambda x: F.col(f"{x}_cum"))
    out = [*[v.alias(k) for k, v in now.items()]]
    if with_differences:
        before = _levels(lambda x: F.col(f"{x}_cum") - F.col(x))
        first = F.col("_one_cum") == 1
        out += [F.when(first | before[s].isNull(), now[s]).otherwise(now[s] - before[s]).alias(f"delta_{s}") for s in RUNNING_SERIES]
    return c.select("conv_id", (F.col("_one_cum") - 1).alias("phrase"), "turn", *out)


def differences(levels: DataFrame, series: list[str] = RUNNING_SERIES) -> DataFrame:
    """W4 on a table of levels: first difference of each series (the first phrase keeps its level)."""
    p = previous_values(levels, ["conv_id"], "phrase", series, prefix="_prev_")
    return p.select("conv_id", "phrase", "turn", *series, *[
        first_difference(F.col(s), F.col(f"_prev_{s}")).alias(f"delta_{s}") for s in series])


def running_text(phr: DataFrame, block: int = 256) -> DataFrame:
    """Accumulated text after each phrase (output grows quadratically; on request only).

    Blocked like :mod:`colloquy.operators.sequence`: a running join inside each block of
    ``block`` phrases, plus the joined text of all earlier blocks (one row per block)."""
    b = phr.withColumn("_blk", F.floor(F.col("phrase") / F.lit(block)).cast("long"))
    inner = (Window.partitionBy("conv_id", "_blk").orderBy("phrase")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = b.withColumn("_in", F.array_join(F.collect_list("text").over(inner), " "))
    blocks = b.groupBy("conv_id", "_blk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("phrase", "text"))), lambda x: x["text"]), " ").alias("_bt"))
    outer = Window.partitionBy("conv_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_blk", F.array_join(F.collect_list("_bt").over(outer), " ").alias("_pre"))
    out = b.join(blocks, ["conv_id", "_blk"])
    texte = F.when(F.col("_pre") == "", F.col("_in")).otherwise(F.concat(F.col("_pre"), F.lit(" "), F.col("_in")))
    return out.select("conv_id", "phrase", texte.alias("texte"))


def elapsed_seconds(events: DataFrame, key: str = "conv_id", ts: str = "ts") -> DataFrame:
    """Whole seconds since the session's first event; the partial route floors at 1."""
    start = events.groupBy(key).agg(F.min(ts).alias("_start"))
    e = events.join(start, key)
    secs = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 1_000_000
    e = e.withColumn("elapsed", F.floor(secs).cast("bigint"))
    return e.withColumn("elapsed_partial", F.greatest(F.lit(1).cast("bigint"), F.col("elapsed"))).drop("_start")


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` keys in key order (a top-k, not a sample)."""
    return df.select(key).distinct().orderBy(key).limit(n)


def top_words(counts: DataFrame, k: int = 200, key: str = "doc_id", word: str = "unit",
              count: str = "count") -> DataFrame:
    """The ``k`` most frequent words per document (ties by word); the ``<= k`` filter
    lets Spark cut each group to ``k`` rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(count).desc(), F.col(word))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nth_row(df: DataFrame, key: str, n: int) -> DataFrame:
    """The row at 0-based position ``n`` in key order."""
    return df.orderBy(key).offset(n).limit(1)
