"""Named queries of the token, lexical, lexicon, syntax and indicator operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import STOP_WORDS, SUBCLAUSE_DEPS, WORD_RE, sql_list
from colloquy.operators import indicators as I
from colloquy.operators import lexical as L
from colloquy.operators import lexicon as X
from colloquy.operators import syntax as Y
from colloquy.operators.tokens import annotate, sentence_rows, tagged, words_of
from colloquy.plans.registry import register, rounded, rsql
from colloquy.plans.sqlparts import lexicon_ctes, tokens_cte
from colloquy.sources import tables as S
from colloquy.sources.tables import EMOTIONS

DOCS = "SELECT doc_id, text FROM documents"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return S.spread(S.documents(spark, sf))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token table of the documents. Not kept: it is many times the text, and each query reads a few of its columns."""
    return annotate(_docs(spark, sf))


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """The same without ``tok_id``, ``dep`` and ``head_id``, for queries that don't read them."""
    return tagged(_docs(spark, sf))


def _lexicons(spark: SparkSession, sf: str):
    vocab = S.vocabulary(spark, sf)
    return S.valence_lexicon(vocab), S.emotion_lexicon(vocab), S.unit_dictionary(vocab)


def _tok_sql(body: str, lex: bool = False) -> str:
    """Oracle: WITH src (documents), token CTEs [, lexicon CTEs] then ``body``."""
    lx = ("," + lexicon_ctes()) if lex else ""
    return f"WITH src AS ({DOCS}),{tokens_cte('src')}{lx}\n{body}"


# --- F2 / F3 / F4 / F14 ---------------------------------------------------------------------

@register("f14", _tok_sql("SELECT doc_id, sent_id, tok_id, text, lemma, pos, verb_form, dep, head_id, "
                          "is_punct, is_stop FROM tok"))
def q_f14(spark, sf):
    """Token annotation table of every document (rule-based stand-in for the parser)."""
    return _tokens(spark, sf).drop("is_space")


@register("f2", "WITH s AS (SELECT doc_id, CAST(generate_subscripts(regexp_extract_all(text, "
                "'[^.!?\\n]+[.!?]*'), 1) - 1 AS INTEGER) AS sent_id, unnest(regexp_extract_all(text, "
                "'[^.!?\\n]+[.!?]*')) AS sentence FROM documents) SELECT doc_id, sent_id, sentence FROM s")
def q_f2(spark, sf):
    """Sentence segmentation of every document, one row per sentence (F2 + F4)."""
    return sentence_rows(_docs(spark, sf))


@register("f3", f"SELECT doc_id, CAST(generate_subscripts(regexp_extract_all(lower(text), '{WORD_RE}'), 1) - 1 "
                f"AS INTEGER) AS w_pos, unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS word FROM documents")
def q_f3(spark, sf):
    """Word segmentation of every document (lower case, punctuation excluded)."""
    return words_of(_docs(spark, sf)).withColumn("w_pos", F.col("w_pos").cast("int"))


# --- A1 – A6 ---------------------------------------------------------------------------------

_COUNTABLE = "NOT is_punct AND NOT is_stop AND NOT contains(text, chr(10))"


@register("a1", _tok_sql(f"SELECT doc_id, text AS word, count(*) AS freq FROM tok WHERE {_COUNTABLE} GROUP BY 1, 2"))
def q_a1(spark, sf):
    """Token frequency per document (case kept, no punctuation or stop words)."""
    return L.word_frequency(_tagged(spark, sf))


@register("a2", _tok_sql(f""", f AS (SELECT doc_id, text, count(*) AS c FROM tok
      WHERE {_COUNTABLE} AND pos <> 'DET' GROUP BY 1, 2)
  SELECT doc_id, {rsql('avg(c)')} AS mean_freq_words, CAST(max(c) - min(c) AS BIGINT) AS range_freq_words,
         {rsql('stddev_pop(c)')} AS std_freq_words FROM f GROUP BY doc_id"""))
def q_a2(spark, sf):
    """Mean, range and population std of word frequencies (determiners excluded)."""
    return rounded(L.frequency_stats(L.text_frequencies(_tagged(spark, sf))))


_DIV_SQL = f""", n AS (SELECT doc_id, count(*) AS n_doc FROM tok GROUP BY doc_id),
  f AS (SELECT doc_id, text, count(*) AS c FROM tok WHERE {_COUNTABLE} GROUP BY 1, 2),
  v AS (SELECT doc_id, count(*) AS V, CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS v1 FROM f GROUP BY 1),
  d AS (SELECT n.doc_id, n.n_doc, coalesce(v.V, 0) AS V, coalesce(v.v1, 0) AS v1 FROM n LEFT JOIN v USING (doc_id))"""


def _div_sql(a: float) -> str:
    return _DIV_SQL + f""",
  r AS (SELECT doc_id, n_doc, V, v1,
      CASE WHEN n_doc > 0 AND V > 0 THEN pow(n_doc, pow(V, -{a})) END AS Brunet_index,
      CASE WHEN n_doc > 0 AND v1 <> n_doc THEN 100.0 * ln(n_doc) / (1.0 - v1 / n_doc) END AS Honore_statistic,
      v1 / nullif(n_doc, 0) AS TTR FROM d)"""


@register("a3", _tok_sql(_div_sql(L.REFERENCE_BRUNET_A) + "\nSELECT doc_id, n_doc, V, v1 FROM r"))
def q_a3(spark, sf):
    """Token count N (punctuation included), vocabulary V and hapax count v1."""
    return L.lexical_diversity(_tagged(spark, sf)).select("doc_id", "n_doc", "V", "v1")


@register("a4", _tok_sql(_div_sql(L.REFERENCE_BRUNET_A) + f"\nSELECT doc_id, {rsql('Brunet_index')} AS Brunet_index FROM r"))
def q_a4(spark, sf):
    """Brunet index N^(V^-0.165)."""
    return rounded(L.lexical_diversity(_tagged(spark, sf)).select("doc_id", "Brunet_index"))


@register("a5", _tok_sql(_div_sql(L.REFERENCE_BRUNET_A) + f"\nSELECT doc_id, {rsql('Honore_statistic')} AS Honore_statistic FROM r"))
def q_a5(spark, sf):
    """Honoré statistic variant 100·ln N / (1 − v1/N)."""
    return rounded(L.lexical_diversity(_tagged(spark, sf)).select("doc_id", "Honore_statistic"))


@register("a6", _tok_sql(_div_sql(L.REFERENCE_BRUNET_A) + f"\nSELECT doc_id, {rsql('TTR')} AS TTR FROM r"))
def q_a6(spark, sf):
    """Hapax ratio v1/N (named TTR)."""
    return rounded(L.lexical_diversity(_tagged(spark, sf)).select("doc_id", "TTR"))


# --- A7 – A12, J9 ------------------------------------------------------------------------------

_WORD = "NOT is_punct AND NOT contains(text, chr(10))"
_RATE_SQL = ", ".join(
    f"{rsql(f'sum(CASE WHEN {_WORD} AND pos = {chr(39)}{t}{chr(39)} THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN {_WORD} THEN 1 ELSE 0 END), 0)')} AS {Y.RATE_NAMES[t]}"
    for t in Y.RATE_NAMES)

_SYN_SQL = f""", kids AS (
    SELECT c.doc_id, c.sent_id, c.dep AS child_dep, c.pos AS child_pos
    FROM tok c JOIN tok h ON c.doc_id = h.doc_id AND c.sent_id = h.sent_id AND c.head_id = h.tok_id
    WHERE h.pos = 'VERB' AND NOT h.is_punct AND NOT contains(h.text, chr(10))),
  sflag AS (SELECT doc_id, sent_id,
      max(CASE WHEN child_dep IN ('obj', 'iobj') THEN 1 ELSE 0 END) AS has_obj,
      max(CASE WHEN child_dep IN ('nsubj', 'csubj') THEN 1 ELSE 0 END) AS has_subj,
      max(CASE WHEN child_pos = 'AUX' THEN 1 ELSE 0 END) AS has_aux FROM kids GROUP BY 1, 2),
  srep AS (SELECT doc_id, sent_id, count(*) - count(DISTINCT lemma) AS rep FROM tok
      WHERE {_WORD} AND lemma NOT IN {sql_list(STOP_WORDS)} GROUP BY 1, 2),
  base AS (SELECT doc_id, count(DISTINCT sent_id) AS n_sent,
      sum(CASE WHEN {_WORD} THEN 1 ELSE 0 END) AS total,
      sum(CASE WHEN {_WORD} AND pos = 'VERB' THEN 1 ELSE 0 END) AS n_verb,
      sum(CASE WHEN {_WORD} AND pos = 'VERB' AND verb_form = 'Inf' THEN 1 ELSE 0 END) AS n_inf,
      sum(CASE WHEN {_WORD} AND pos = 'VERB' AND verb_form <> 'Inf' THEN 1 ELSE 0 END) AS n_conj,
      sum(CASE WHEN dep IN {sql_list(SUBCLAUSE_DEPS)} THEN 1 ELSE 0 END) AS n_sub,
      {_RATE_SQL}
    FROM tok GROUP BY doc_id),
  fl AS (SELECT doc_id, sum(has_obj) AS n_obj, sum(has_subj) AS n_subj, sum(has_aux) AS n_aux FROM sflag GROUP BY 1),
  rp AS (SELECT doc_id, sum(rep) AS rep FROM srep GROUP BY 1),
  syn AS (SELECT b.*, coalesce(fl.n_obj, 0) AS n_obj, coalesce(fl.n_subj, 0) AS n_subj,
      coalesce(fl.n_aux, 0) AS n_aux, coalesce(rp.rep, 0) AS rep
    FROM base b LEFT JOIN fl USING (doc_id) LEFT JOIN rp USING (doc_id))"""


@register("a7", _tok_sql(_SYN_SQL + "\nSELECT doc_id, " + ", ".join(Y.RATE_NAMES.values()) + " FROM syn"))
def q_a7(spark, sf):
    """Part-of-speech rates over the words of each document (CONJ as in the reference tag set)."""
    r = Y.syntax_rates(_tokens(spark, sf))
    return rounded(r.select("doc_id", *Y.RATE_NAMES.values()))


@register("a8", _tok_sql(_SYN_SQL + f"""
SELECT doc_id, {rsql('CASE WHEN n_verb > 0 THEN n_conj / n_verb ELSE 0 END')} AS verb_conj_rate,
       {rsql('CASE WHEN n_verb > 0 THEN n_inf / n_verb ELSE 0 END')} AS verb_inf_rate FROM syn"""))
def q_a8(spark, sf):
    """Conjugated and infinitive shares of the verbs (0 without verbs)."""
    return rounded(Y.syntax_rates(_tokens(spark, sf)).select("doc_id", "verb_conj_rate", "verb_inf_rate"))


@register("a9", _tok_sql(_SYN_SQL + f"""
SELECT doc_id, {rsql('n_aux / nullif(n_sent, 0)')} AS verb_aux_rate, {rsql('n_obj / nullif(n_sent, 0)')} AS verb_obj_rate,
       {rsql('n_subj / nullif(n_sent, 0)')} AS verb_subj_rate FROM syn"""))
def q_a9(spark, sf):
    """Share of sentences with a verb that has an auxiliary, object or subject child."""
    return rounded(Y.syntax_rates(_tokens(spark, sf)).select(
        "doc_id", "verb_aux_rate", "verb_obj_rate", "verb_subj_rate"))


@register("a10", _tok_sql(_SYN_SQL + "\nSELECT doc_id, CAST(rep AS BIGINT) AS repetition_cons_rate FROM syn"))
def q_a10(spark, sf):
    """Repeated non-stop lemmas within a sentence, summed per document."""
    return Y.syntax_rates(_tokens(spark, sf)).select("doc_id", "repetition_cons_rate")


@register("a11", _tok_sql(_SYN_SQL + f"\nSELECT doc_id, {rsql('n_sub / nullif(n_sent, 0)')} AS sub_prop_rate FROM syn"))
def q_a11(spark, sf):
    """Subordinate clause labels per sentence."""
    return rounded(Y.syntax_rates(_tokens(spark, sf)).select("doc_id", "sub_prop_rate"))


@register("a12", _tok_sql(_SYN_SQL + "\nSELECT doc_id, CAST(total AS BIGINT) AS total_words, "
                                     "CAST(n_sent AS BIGINT) AS n_sentences FROM syn"))
def q_a12(spark, sf):
    """Words (no punctuation) and sentences per document."""
    return Y.syntax_rates(_tokens(spark, sf)).select("doc_id", "total_words", "n_sentences")


@register("j9", _tok_sql(""", sl AS (SELECT doc_id, sent_id, list(struct_pack(i := tok_id, h := head_id, d := dep, p := pos, u := is_punct) ORDER BY tok_id) AS ts
      FROM tok GROUP BY 1, 2),
  ch AS (SELECT doc_id, sent_id, ts, unnest(ts) AS c FROM sl)
SELECT doc_id, sent_id, c.i AS child_id, c.h AS head_id, c.d AS child_dep, c.p AS child_pos, ts[c.h + 1].p AS head_pos, ts[c.h + 1].u AS head_is_punct
  FROM ch WHERE c.h IS NOT NULL"""))
def q_j9(spark, sf):
    """Every token with the POS of its head (children ⋈ heads)."""
    docs = S.documents(spark, sf).filter(F.col("doc_id").isNotNull())
    often = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    single = annotate(S.spread(docs.join(often, "doc_id", "left_anti")), heads=True)
    repeated = annotate(docs.join(often, "doc_id", "left_semi"))  # rows of one id are children of each other's heads
    return Y.children_heads(single).unionByName(Y.children_heads(repeated))


# --- lexicons: S4, W6, J4 – J8, U1, A13 – A19 -----------------------------------------------------

def _lex_sql(body: str) -> str:
    return "WITH " + lexicon_ctes().lstrip() + "\n" + body


@register("s4", _lex_sql("SELECT word, value FROM valence"))
def q_s4(spark, sf):
    """Valence lexicon with duplicate keys resolved last-wins."""
    val, _, _ = _lexicons(spark, sf)
    return X.last_wins(val, "word", "line_no", ["value"])


@register("w6", _lex_sql("SELECT word, " + ", ".join(EMOTIONS) + " FROM emotion"))
def q_w6(spark, sf):
    """Emotion lexicon with duplicate keys resolved first-wins (row_number = 1)."""
    _, emo, _ = _lexicons(spark, sf)
    return X.first_wins_window(emo, "word", "line_no").select("word", *EMOTIONS)


@register("u1", _lex_sql("SELECT unit FROM unit_flat"))
def q_u1(spark, sf):
    """Flat unit set: lower-cased union of the valence and emotion lexicon words."""
    val, emo, _ = _lexicons(spark, sf)
    return X.unit_set(val, emo)


@register("j7", _lex_sql("SELECT unit, category FROM unit_cat"))
def q_j7(spark, sf):
    """Classified dictionary unpivoted to (unit, category), empty cells dropped."""
    _, _, d = _lexicons(spark, sf)
    return X.unit_categories(d)


_CONV_WORDS = (f"conv_words AS (SELECT conv_id AS doc_id, CAST(generate_subscripts(regexp_extract_all(lower(text), "
               f"'{WORD_RE}'), 1) - 1 AS INTEGER) AS w_pos, turn, unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS word "
               f"FROM conversations)")


def _conv_words(spark, sf):
    c = S.read(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select(F.col("conv_id").alias("doc_id"), "turn",
                    F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_RE), 0)).alias("w_pos", "word")
                    ).withColumn("w_pos", F.col("w_pos").cast("int"))


@register("j4", _lex_sql(", " + _CONV_WORDS + """
SELECT w.doc_id, w.turn, w.w_pos, w.word, coalesce(v.value, 0) AS value FROM conv_words w LEFT JOIN valence v USING (word)"""))
def q_j4(spark, sf):
    """Every conversation word with its valence (0 when absent from the lexicon)."""
    val, _, _ = _lexicons(spark, sf)
    return X.valence_lookup(_conv_words(spark, sf), val).select("doc_id", "turn", "w_pos", "word", "value")


@register("j5", _lex_sql(", " + _CONV_WORDS + "\nSELECT w.doc_id, w.turn, w.w_pos, w.word, " +
                         ", ".join(f"e.{e}" for e in EMOTIONS) + " FROM conv_words w JOIN emotion e USING (word)"))
def q_j5(spark, sf):
    """Conversation words found in the emotion lexicon, with their six flags."""
    _, emo, _ = _lexicons(spark, sf)
    return X.emotion_lookup(_conv_words(spark, sf), emo).select("doc_id", "turn", "w_pos", "word", *EMOTIONS)


@register("j8", f"WITH {_CONV_WORDS} SELECT doc_id, turn, w_pos, word FROM conv_words WHERE word NOT IN {sql_list(STOP_WORDS)}")
def q_j8(spark, sf):
    """Conversation words without stop words (anti join with the fixed stop list)."""
    return X.drop_stop_words(_conv_words(spark, sf)).select("doc_id", "turn", "w_pos", "word")


@register("j6", _tok_sql("SELECT doc_id, sent_id, tok_id, lower(lemma) AS unit FROM tok WHERE lower(lemma) IN (SELECT unit FROM unit_flat)", lex=True))
def q_j6(spark, sf):
    """Tokens whose lemma belongs to the flat unit set (semi join)."""
    val, emo, _ = _lexicons(spark, sf)
    t = X.unit_membership(_tokens(spark, sf), X.unit_set(val, emo))
    return t.select("doc_id", "sent_id", "tok_id", "unit")


_EMO_SQL = f""", fr AS (SELECT doc_id, lower(text) AS word, count(*) AS c FROM tok WHERE NOT is_punct AND NOT is_stop GROUP BY 1, 2),
  es AS (SELECT doc_id, {", ".join(f"CAST(sum(c * {e}) AS BIGINT) AS {e}" for e in EMOTIONS)} FROM fr JOIN emotion USING (word) GROUP BY 1)"""


@register("a13", _tok_sql(_EMO_SQL + "\nSELECT * FROM es", lex=True))
def q_a13(spark, sf):
    """Emotion sums Σ freq × flag per document."""
    _, emo, _ = _lexicons(spark, sf)
    return X.emotion_sums(_tagged(spark, sf), emo)


@register("a14", _tok_sql(_EMO_SQL + f""", tw AS (SELECT doc_id, sum(CASE WHEN {_WORD} THEN 1 ELSE 0 END) AS total FROM tok GROUP BY 1)
SELECT tw.doc_id, {", ".join(f"{rsql(f'coalesce(es.{e}, 0) / nullif(tw.total, 0)')} AS {e}_rate" for e in EMOTIONS)}
FROM tw LEFT JOIN es USING (doc_id)""", lex=True))
def q_a14(spark, sf):
    """Emotion rates: emotion sums divided by the words of the document."""
    _, emo, _ = _lexicons(spark, sf)
    tok = _tagged(spark, sf)
    sums = X.emotion_sums(tok, emo)
    tw = L.token_counts(tok).select("doc_id", "total_words")
    d = tw.join(sums, "doc_id", "left").fillna(0, list(EMOTIONS))
    den = F.nullif(F.col("total_words").cast("double"), F.lit(0.0))
    return rounded(d.select("doc_id", *[(F.col(e) / den).alias(f"{e}_rate") for e in EMOTIONS]))


def _sent_sql(table: str = "documents") -> str:
    return (f"o_sent2 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS sentence FROM {table}), "
            "vw AS (SELECT doc_id, unnest(regexp_split_to_array(lower(sentence), '\\s+')) AS word FROM o_sent2)")


_SENT_SQL = _sent_sql()


@register("a15", _lex_sql(", " + _SENT_SQL + """,
  vs AS (SELECT doc_id, CAST(sum(value) AS BIGINT) AS s FROM vw JOIN valence USING (word) WHERE word <> '' GROUP BY 1)
SELECT d.doc_id, coalesce(vs.s, 0) AS Score_AFINN FROM documents d LEFT JOIN vs USING (doc_id)"""))
def q_a15(spark, sf):
    """Valence score: Σ lexicon value over whitespace words of the lower-cased sentences."""
    val, _, _ = _lexicons(spark, sf)
    docs = _docs(spark, sf)
    s = X.valence_scores(sentence_rows(docs), val)
    return docs.select("doc_id").join(s, "doc_id", "left").fillna(0, ["Score_AFINN"])


_UNIT_SQL = f""", uc AS (SELECT doc_id, category, lower(lemma) AS unit, count(*) AS count FROM tok JOIN unit_cat ON lower(tok.lemma) = unit_cat.unit GROUP BY 1, 2, 3),
  tw AS (SELECT doc_id, sum(CASE WHEN {_WORD} THEN 1 ELSE 0 END) AS total FROM tok GROUP BY 1)"""


@register("a16", _tok_sql(_UNIT_SQL + "\nSELECT doc_id, category, unit, count FROM uc", lex=True))
def q_a16(spark, sf):
    """Unit counts per document, category and unit (long form of ``has_unit``)."""
    _, _, d = _lexicons(spark, sf)
    return X.unit_counts(_tagged(spark, sf), dictionary=d)


@register("a17", _tok_sql(_UNIT_SQL + f""", u1 AS (SELECT doc_id, unit, arg_max(count, category) AS count FROM uc GROUP BY 1, 2)
SELECT u1.doc_id, u1.unit, {rsql('u1.count / nullif(tw.total, 0)')} AS ratio FROM u1 JOIN tw USING (doc_id)""", lex=True))
def q_a17(spark, sf):
    """Unit ratio count / words per document and unit (long form of ``ratio_unit``)."""
    _, _, d = _lexicons(spark, sf)
    tok = _tagged(spark, sf)
    return rounded(X.unit_ratios(X.unit_counts(tok, dictionary=d), L.token_counts(tok).select("doc_id", "total_words")))


_CONCEPT_SQL = _UNIT_SQL + """, cm AS (SELECT tw.doc_id, tw.total, coalesce(x.nu, 0) AS nu, coalesce(x.nt, 0) AS nt
    FROM tw LEFT JOIN (SELECT doc_id, count(DISTINCT unit) AS nu, sum(count) AS nt FROM uc GROUP BY 1) x USING (doc_id))"""


@register("a18", _tok_sql(_CONCEPT_SQL + f"""
SELECT doc_id, {rsql('CASE WHEN total > 0 THEN nu / total ELSE 0 END')} AS unique_concept_density,
       {rsql('nu / 360.0')} AS unique_concept_efficiency FROM cm""", lex=True))
def q_a18(spark, sf):
    """Unique concept density (per word) and efficiency (per second, duration 360 s)."""
    return rounded(_concepts(spark, sf).select("doc_id", "unique_concept_density", "unique_concept_efficiency"))


@register("a19", _tok_sql(_CONCEPT_SQL + f"""
SELECT doc_id, {rsql('CASE WHEN total > 0 THEN nt / total ELSE 0 END')} AS total_concept_density,
       {rsql('nt / 360.0')} AS total_concept_efficiency FROM cm""", lex=True))
def q_a19(spark, sf):
    """Total concept density and efficiency (a unit counts once per category)."""
    return rounded(_concepts(spark, sf).select("doc_id", "total_concept_density", "total_concept_efficiency"))


def _concepts(spark, sf):
    _, _, d = _lexicons(spark, sf)
    tok = _tagged(spark, sf)
    tw = L.token_counts(tok).select("doc_id", "total_words")
    return X.concept_measures(X.unit_counts(tok, dictionary=d), tw, F.lit(float(I.BATCH_DURATION_SECONDS)))


# --- A20 / A21: the wide row ----------------------------------------------------------------------

def _wide_sql(a: float, emotion_normalised: bool, flat_units: bool, sent_table: str = "documents") -> str:
    unit_join = ("JOIN unit_flat ON lower(tok.lemma) = unit_flat.unit" if flat_units
                 else "JOIN unit_cat ON lower(tok.lemma) = unit_cat.unit")
    cat = "CAST(NULL AS VARCHAR)" if flat_units else "category"
    emo = ", ".join(
        (f"{rsql(f'coalesce(es.{e}, 0) / nullif(syn.total, 0)')} AS {e}_rate" if emotion_normalised
         else f"{rsql(f'coalesce(es.{e}, 0)')} AS {e}_rate") for e in EMOTIONS)
    rates = ", ".join(f"syn.{c}" for c in Y.RATE_NAMES.values())
    return (_SYN_SQL + _div_sql(a) + _EMO_SQL + "," + _sent_sql(sent_table) + f""",
  vs AS (SELECT doc_id, CAST(sum(value) AS BIGINT) AS s FROM vw JOIN valence USING (word) WHERE word <> '' GROUP BY 1),
  fs AS (SELECT doc_id, avg(c) AS mean_f, max(c) - min(c) AS range_f, stddev_pop(c) AS std_f FROM
         (SELECT doc_id, text, count(*) AS c FROM tok WHERE {_COUNTABLE} AND pos <> 'DET' GROUP BY 1, 2) GROUP BY 1),
  uc AS (SELECT doc_id, {cat} AS category, lower(lemma) AS unit, count(*) AS count FROM tok {unit_join} GROUP BY 1, 2, 3),
  cm AS (SELECT doc_id, count(DISTINCT unit) AS nu, sum(count) AS nt FROM uc GROUP BY 1),
  hu AS (SELECT doc_id, string_agg(coalesce(category, '') || '/' || unit || '=' || count, ',' ORDER BY coalesce(category, '') || '/' || unit || '=' || count) AS h FROM uc GROUP BY 1),
  ru AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS u FROM (
         SELECT DISTINCT uc.doc_id, unit || '=' || CAST(round(1000000 * count / total) AS BIGINT) AS x FROM uc JOIN syn USING (doc_id)) GROUP BY 1)
SELECT src.doc_id, {rates},
  {rsql('syn.n_aux / nullif(syn.n_sent, 0)')} AS verb_aux_rate, {rsql('syn.n_obj / nullif(syn.n_sent, 0)')} AS verb_obj_rate,
  {rsql('syn.n_subj / nullif(syn.n_sent, 0)')} AS verb_subj_rate, {rsql('syn.n_sub / nullif(syn.n_sent, 0)')} AS sub_prop_rate,
  CAST(syn.rep AS BIGINT) AS repetition_cons_rate,
  {rsql('CASE WHEN syn.n_verb > 0 THEN syn.n_conj / syn.n_verb ELSE 0 END')} AS verb_conj_rate,
  {rsql('CASE WHEN syn.n_verb > 0 THEN syn.n_inf / syn.n_verb ELSE 0 END')} AS verb_inf_rate,
  CAST(coalesce(syn.total, 0) AS BIGINT) AS total_words,
  {rsql('fs.mean_f')} AS mean_freq_words, CAST(fs.range_f AS BIGINT) AS range_freq_words, {rsql('fs.std_f')} AS std_freq_words,
  {rsql('r.Brunet_index')} AS Brunet_index, {rsql('r.Honore_statistic')} AS Honore_statistic, {rsql('r.TTR')} AS TTR,
  {emo},
  coalesce(vs.s, 0) AS Score_AFINN,
  {rsql('CASE WHEN syn.total > 0 THEN coalesce(cm.nu, 0) / syn.total ELSE 0 END')} AS unique_concept_density,
  {rsql('coalesce(cm.nu, 0) / 360.0')} AS unique_concept_efficiency,
  {rsql('CASE WHEN syn.total > 0 THEN coalesce(cm.nt, 0) / syn.total ELSE 0 END')} AS total_concept_density,
  {rsql('coalesce(cm.nt, 0) / 360.0')} AS total_concept_efficiency,
  coalesce(hu.h, '') AS has_unit, coalesce(ru.u, '') AS ratio_unit
FROM src LEFT JOIN hu USING (doc_id) LEFT JOIN ru USING (doc_id) LEFT JOIN syn USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN es USING (doc_id)
  LEFT JOIN vs USING (doc_id) LEFT JOIN fs USING (doc_id) LEFT JOIN cm USING (doc_id)""")


@register("a20", _tok_sql(_wide_sql(L.REFERENCE_BRUNET_A, True, False), lex=True))
def q_a20(spark, sf):
    """Wide indicator row (34 numbers, two maps) of every document, by-category units, 360 s."""
    val, emo, d = _lexicons(spark, sf)
    return _told_maps(rounded(I.indicator_row(_docs(spark, sf), val, emo, dictionary=d)), nested=True)


def _told_maps(row: DataFrame, nested: bool) -> DataFrame:
    """The two maps as sorted text, which both engines compare alike: ``category/unit=count`` and ``unit=ratio`` in millionths."""
    def told(m, value):
        return F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries(m), value)), ","), F.lit(""))

    if nested:
        has = F.flatten(F.transform(F.map_entries("has_unit"), lambda c: F.transform(
            F.map_entries(c["value"]), lambda u: F.concat(c["key"], F.lit("/"), u["key"], F.lit("="), u["value"].cast("string")))))
        has = F.coalesce(F.array_join(F.array_sort(has), ","), F.lit(""))
    else:
        has = told(F.col("has_unit"), lambda u: F.concat(F.lit("/"), u["key"], F.lit("="), u["value"].cast("string")))
    ratio = told(F.col("ratio_unit"), lambda u: F.concat(u["key"], F.lit("="), F.round(u["value"] * 1000000).cast("bigint").cast("string")))
    return row.withColumn("has_unit", has).withColumn("ratio_unit", ratio)


@register("a21", _tok_sql(_wide_sql(L.POPULATION_BRUNET_A, False, True), lex=True))
def q_a21(spark, sf):
    """Population run: flat unit set, Brunet a = 0.5, raw emotion sums, both maps, over all documents."""
    val, emo, _ = _lexicons(spark, sf)
    return _told_maps(rounded(I.population_run(_docs(spark, sf), val, emo)), nested=False)
