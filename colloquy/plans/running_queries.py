"""Named queries of the running-session analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import lexicon as X
from colloquy.operators import running as R
from colloquy.operators.tokens import tagged
from colloquy.plans.dialogue_queries import TURNS_SQL
from colloquy.plans.registry import register, rounded, rsql
from colloquy.plans.sqlparts import lexicon_ctes, tokens_cte
from colloquy.sources import tables as S
from colloquy.sources.tables import EMOTIONS

PHRASES_SQL = (TURNS_SQL + ", ph0 AS (SELECT conv_id, turn, CAST(generate_subscripts(regexp_extract_all(text, "
               "'[^.!?\\n]+[.!?]*'), 1) - 1 AS INTEGER) AS pos, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS text "
               "FROM turns WHERE speaker = 2), phrases AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id "
               "ORDER BY turn, pos) - 1 AS BIGINT) AS phrase, turn, text FROM ph0)")
_W = "NOT is_punct AND NOT contains(text, chr(10))"
_COUNTERS_SQL = (
    "WITH " + PHRASES_SQL + ", src AS (SELECT struct_pack(c := conv_id, p := phrase) AS doc_id, text FROM phrases), "
    + tokens_cte("src").lstrip() + "," + lexicon_ctes() + f""",
  tk AS (SELECT doc_id.c AS conv_id, doc_id.p AS phrase, * EXCLUDE (doc_id) FROM tok),
  base AS (SELECT conv_id, phrase, count(*) AS n_doc, sum(CASE WHEN {_W} THEN 1 ELSE 0 END) AS total,
      sum(CASE WHEN {_W} AND pos = 'ADV' THEN 1 ELSE 0 END) AS n_adv,
      sum(CASE WHEN {_W} AND pos = 'VERB' THEN 1 ELSE 0 END) AS n_verb,
      sum(CASE WHEN {_W} AND pos = 'VERB' AND verb_form <> 'Inf' THEN 1 ELSE 0 END) AS n_vconj FROM tk GROUP BY 1, 2),
  un AS (SELECT conv_id, phrase, count(*) AS n_units FROM tk JOIN unit_flat ON lower(tk.lemma) = unit_flat.unit GROUP BY 1, 2),
  ew AS (SELECT conv_id, phrase, lower(text) AS word, count(*) AS c FROM tk WHERE NOT is_punct AND NOT is_stop GROUP BY 1, 2, 3),
  em AS (SELECT conv_id, phrase, {", ".join(f"sum(c * {e}) AS {e}" for e in EMOTIONS)} FROM ew JOIN emotion USING (word) GROUP BY 1, 2),
  occ AS (SELECT conv_id, text, phrase, count(*) AS c FROM tk WHERE {_W} AND NOT is_stop GROUP BY 1, 2, 3),
  occ2 AS (SELECT *, sum(c) OVER (PARTITION BY conv_id, text ORDER BY phrase) AS cum FROM occ),
  hp AS (SELECT conv_id, phrase, sum(CASE WHEN cum = 1 THEN 1 ELSE 0 END - CASE WHEN cum - c = 1 THEN 1 ELSE 0 END) AS hapax
         FROM occ2 GROUP BY 1, 2),
  cnt AS (SELECT p.conv_id, p.phrase, p.turn, coalesce(n_doc, 0) AS n_doc, coalesce(total, 0) AS total,
      coalesce(n_adv, 0) AS n_adv, coalesce(n_verb, 0) AS n_verb, coalesce(n_vconj, 0) AS n_vconj,
      coalesce(n_units, 0) AS n_units, coalesce(hapax, 0) AS hapax,
      {", ".join(f"coalesce({e}, 0) AS {e}" for e in EMOTIONS)}
    FROM phrases p LEFT JOIN base USING (conv_id, phrase) LEFT JOIN un USING (conv_id, phrase)
      LEFT JOIN em USING (conv_id, phrase) LEFT JOIN hp USING (conv_id, phrase)),
  cum AS (SELECT conv_id, phrase, turn, {", ".join(f"sum({c}) OVER (PARTITION BY conv_id ORDER BY phrase ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in R.COUNTERS)} FROM cnt),
  lvl AS (SELECT conv_id, phrase, turn,
      hapax / nullif(n_doc, 0) AS TTR,
      CASE WHEN total > 0 THEN n_adv / total END AS adv_rates,
      CASE WHEN n_verb > 0 THEN n_vconj / n_verb ELSE 0 END AS verb_conj_rate,
      CASE WHEN total > 0 THEN n_units / total ELSE 0 END AS total_concept_density,
      {", ".join(f"CASE WHEN total > 0 THEN {e} / total END AS {e}_rate" for e in ("anger", "disgust", "fear", "joy", "sadness", "surprise"))}
    FROM cum)""")


def _turns(spark, sf):
    return S.spread(S.turns(spark, sf))


def _levels(spark, sf, with_differences=False):
    vocab = S.vocabulary(spark, sf)
    val, emo = S.valence_lexicon(vocab), S.emotion_lexicon(vocab)
    return R.running_levels(R.session_counters(_turns(spark, sf), emo, X.unit_set(val, emo)), with_differences)


@register("w3", _COUNTERS_SQL + "\nSELECT conv_id, phrase, turn, " + ", ".join(f"{rsql(s)} AS {s}" for s in R.RUNNING_SERIES) + " FROM lvl")
def q_w3(spark, sf):
    """Running indicators after each patient phrase (TTR, adverbs, conjugated verbs,
    concept density, six emotions) by running sums — no recomputation of the whole text."""
    return rounded(_levels(spark, sf))


@register("w4", _COUNTERS_SQL + "\nSELECT conv_id, phrase, turn, " + ", ".join(f"{rsql(s)} AS {s}" for s in R.RUNNING_SERIES) + ", "
          + ", ".join(f"{rsql(f'coalesce({s} - lag({s}) OVER (PARTITION BY conv_id ORDER BY phrase), {s})')} AS delta_{s}"
                      for s in R.RUNNING_SERIES) + " FROM lvl")
def q_w4(spark, sf):
    """First differences of the running indicators (first phrase keeps its level)."""
    return rounded(_levels(spark, sf, with_differences=True))


@register("w2", "WITH " + PHRASES_SQL + " SELECT conv_id, phrase, array_to_string(list(text) OVER (PARTITION BY conv_id "
                "ORDER BY phrase ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ' ') AS texte FROM phrases")
def q_w2(spark, sf):
    """Accumulated session text after each phrase."""
    return R.running_text(R.phrases(_turns(spark, sf)))


@register("w7", f"""WITH {TURNS_SQL}, c AS (SELECT conv_id, turn, to_timestamp({S.SESSION_BASE_EPOCH} + conv_id * 3600 + turn * 30) AS ts FROM turns),
  s AS (SELECT conv_id, min(ts) AS st FROM c GROUP BY 1)
SELECT conv_id, turn, CAST(floor(epoch(ts) - epoch(st)) AS BIGINT) AS elapsed,
       greatest(1, CAST(floor(epoch(ts) - epoch(st)) AS BIGINT)) AS elapsed_partial FROM c JOIN s USING (conv_id)""")
def q_w7(spark, sf):
    """Seconds since the session's first turn (partial route floors at 1)."""
    t = S.session_clock(_turns(spark, sf))
    return R.elapsed_seconds(t).select("conv_id", "turn", "elapsed", "elapsed_partial")


@register("w8", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def q_w8(spark, sf):
    """The first 100 documents by id (the population run's file cap)."""
    return R.first_n(S.documents(spark, sf), "doc_id", 100)


_UNITS_FLAT_SQL = ("WITH src AS (SELECT doc_id, text FROM documents)," + tokens_cte("src") + "," + lexicon_ctes() +
                   ", uc AS (SELECT doc_id, lower(lemma) AS unit, count(*) AS count FROM tok JOIN unit_flat ON lower(tok.lemma) = unit_flat.unit GROUP BY 1, 2)")


@register("w9", _UNITS_FLAT_SQL + "\nSELECT * FROM (SELECT doc_id, unit, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, unit) AS rank FROM uc) WHERE rank <= 200")
def q_w9(spark, sf):
    """Word-cloud input: the 200 most frequent units per document."""
    vocab = S.vocabulary(spark, sf)
    val, emo = S.valence_lexicon(vocab), S.emotion_lexicon(vocab)
    c = X.unit_counts(tagged(S.spread(S.documents(spark, sf))), units=X.unit_set(val, emo)).drop("category")
    return R.top_words(c).withColumn("rank", F.col("rank").cast("bigint"))


@register("w10", "SELECT doc_id AS participant_id, toxic AS phq_binary FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 1 OFFSET 6")
def q_w10(spark, sf):
    """The participant at position 6 in id order."""
    p = S.participants(spark, sf).select("participant_id", "phq_binary")
    return R.nth_row(p, "participant_id", 6)
