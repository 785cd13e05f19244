"""Named queries of the set operations, word classes and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.text import NUM_TEST_RE, WORD_RE, pos_sql
from colloquy.operators import features as Fe
from colloquy.operators import lexicon as X
from colloquy.operators import running as R
from colloquy.operators import setops as U
from colloquy.operators.tokens import annotate, tagged
from colloquy.plans.feature_queries import PART_SQL, _indicators
from colloquy.plans.registry import register, rounded, rsql
from colloquy.plans.running_queries import PHRASES_SQL
from colloquy.plans.sqlparts import lexicon_ctes, tokens_cte
from colloquy.plans.text_queries import DOCS
from colloquy.sources import sinks as K
from colloquy.sources import tables as S
from colloquy.streaming.session import scratch

_PARTS = ("SELECT doc_id AS participant_id, toxic AS phq_binary, "
          "CAST(CASE WHEN doc_id % 10 <= 1 THEN 1 WHEN doc_id % 10 = 2 THEN 2 ELSE 3 END AS INTEGER) AS partof "
          "FROM documents JOIN labels USING (doc_id)")


@register("u2", f"{_PARTS}")
def q_u2(spark, sf):
    """Union of the three split tables."""
    p = S.participants(spark, sf).select("participant_id", "phq_binary", "partof")
    return U.union_splits(*[p.filter(F.col("partof") == k) for k in (1, 2, 3)])


_CONV_VOCAB_SQL = (f"cv AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS word FROM conversations)")
_U4_BODY = (f"cls0 AS (SELECT DISTINCT unit AS mot FROM unit_flat), "
            f"cls1 AS (SELECT mot, {pos_sql('mot', 'lower(mot)', '0', f'NOT regexp_matches(mot, {chr(39)}^{WORD_RE}{chr(39)})', f'regexp_matches(mot, {chr(39)}{NUM_TEST_RE}{chr(39)})')} AS pos, "
            "mot IN (SELECT word FROM cv) AS known FROM cls0), "
            "cls2 AS (SELECT mot, CASE WHEN " + " OR ".join(f"lower(mot) LIKE '%{s}'" for s in U.PLACE_SUFFIXES) +
            " THEN 'LIEUX' WHEN pos = 'VERB' THEN 'ACTIONS' WHEN pos = 'PROPN' THEN 'ACTEURS' WHEN pos = 'NOUN' AND known THEN 'OBJETS' END AS c FROM cls1), "
            "cls AS (SELECT mot, " + ", ".join(f"CASE WHEN c = '{c}' THEN mot ELSE '' END AS {c}" for c in U.UNIT_CLASS_COLUMNS) + " FROM cls2)")


def _classified(spark, sf):
    vocab = S.vocabulary(spark, sf)
    val, emo = S.valence_lexicon(vocab), S.emotion_lexicon(vocab)
    conv_vocab = S.read(spark, sf, "conversations", "text").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_RE), 0)).alias("word")).distinct()
    return U.classify_words(X.unit_set(val, emo).withColumnRenamed("unit", "mot"), conv_vocab), val, emo


@register("u4", "WITH " + lexicon_ctes().lstrip() + ", " + _CONV_VOCAB_SQL + ", " + _U4_BODY + " SELECT * FROM cls")
def q_u4(spark, sf):
    """Word classes of the unit words: place > verb > proper noun > known common noun."""
    return _classified(spark, sf)[0]


@register("u3", "WITH " + lexicon_ctes().lstrip() + ", " + _CONV_VOCAB_SQL + ", " + _U4_BODY +
          " SELECT c.mot, c.ACTEURS, c.OBJETS, NULL AS LIEUX, c.ACTIONS, 'valence' AS provenance FROM cls c WHERE c.mot IN (SELECT lower(word) FROM valence_lex)"
          " UNION ALL SELECT c.mot, c.ACTEURS, NULL, c.LIEUX, c.ACTIONS, 'emotion' FROM cls c WHERE c.mot IN (SELECT lower(word) FROM emotion_lex)")
def q_u3(spark, sf):
    """Union of two classified dictionaries with provenance; ragged columns padded with null."""
    cls, val, emo = _classified(spark, sf)
    a = cls.join(val.select(F.lower("word").alias("mot")).distinct(), "mot", "left_semi").drop("LIEUX")
    b = cls.join(emo.select(F.lower("word").alias("mot")).distinct(), "mot", "left_semi").drop("OBJETS")
    return U.union_ragged({"valence": a, "emotion": b}).select("mot", "ACTEURS", "OBJETS", "LIEUX", "ACTIONS", "provenance")


@register("p20", "SELECT doc_id, CASE WHEN text IS NULL OR regexp_matches(text, '^\\s*$') THEN 'rejected' ELSE 'accepted' END AS status FROM documents")
def q_p20(spark, sf):
    """Blank texts rejected (to a reject table), the others accepted."""
    d = S.read(spark, sf, "documents", "doc_id", "text")
    ok, bad = U.accept_reject(d)
    return ok.select("doc_id", F.lit("accepted").alias("status")).unionByName(
        bad.select("doc_id", F.lit("rejected").alias("status")))


@register("p21", "WITH " + PHRASES_SQL + " SELECT conv_id, phrase, text FROM phrases WHERE phrase = 3")
def q_p21(spark, sf):
    """The phrase at ordinal 3 of every session (empty where the session is shorter)."""
    phr = R.phrases(S.turns(spark, sf))
    return U.phrase_at(phr, 3).select("conv_id", "phrase", "text")


@register("p23", f"WITH src AS ({DOCS}),{tokens_cte('src')} SELECT doc_id, "
                 "CAST(sum(CASE WHEN is_punct THEN 1 ELSE 0 END) AS BIGINT) AS n_punct, CAST(sum(CASE WHEN is_stop THEN 1 ELSE 0 END) AS BIGINT) AS n_stop, "
                 "CAST(sum(CASE WHEN pos = 'DET' THEN 1 ELSE 0 END) AS BIGINT) AS n_det, "
                 "CAST(sum(CASE WHEN contains(text, chr(10)) OR is_space THEN 1 ELSE 0 END) AS BIGINT) AS n_space "
                 "FROM tok GROUP BY doc_id")
def q_p23(spark, sf):
    """Token predicates per document: punctuation, stop words, determiners, blanks."""
    t = tagged(S.spread(S.documents(spark, sf)))
    return t.groupBy("doc_id").agg(
        F.sum(F.col("is_punct").cast("long")).alias("n_punct"), F.sum(F.col("is_stop").cast("long")).alias("n_stop"),
        F.sum((F.col("pos") == "DET").cast("long")).alias("n_det"),
        F.sum((F.col("text").contains("\n") | F.col("is_space")).cast("long")).alias("n_space"))


@register("f1", "SELECT conv_id, turn, lower(text) AS lowered, starts_with(trim(text), 'The') AS starts_the, "
                "contains(text, chr(10)) AS multi_line, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_pieces, "
                "array_to_string(string_split(trim(lower(text)), ' '), '_') AS joined FROM conversations")
def q_f1(spark, sf):
    """String helpers: lower, strip, split, join, startswith, newline test."""
    c = S.read(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.lower("text").alias("lowered"),
                    F.trim("text").startswith("The").alias("starts_the"), F.col("text").contains("\n").alias("multi_line"),
                    F.size(F.split("text", " ")).cast("int").alias("n_pieces"),
                    F.array_join(F.split(F.trim(F.lower("text")), " "), "_").alias("joined"))


@register("f5", f"SELECT doc_id, {rsql('ln(n_chars)')} AS ln_chars, {rsql('pow(n_chars, -0.165)')} AS pow_chars, "
                f"{rsql('1.0 / nullif(n_chars - 400, 0)')} AS guarded FROM documents")
def q_f5(spark, sf):
    """Log, power and a zero-guarded ratio."""
    d = S.read(spark, sf, "documents", "doc_id", "n_chars")
    return rounded(d.select("doc_id", F.ln("n_chars").alias("ln_chars"), F.pow("n_chars", F.lit(-0.165)).alias("pow_chars"),
                            (F.lit(1.0) / F.nullif(F.col("n_chars") - 400, F.lit(0))).alias("guarded")))


@register("f6", "SELECT doc_id, quality, toxic FROM labels")
def q_f6(spark, sf):
    """JSON encode and decode of a nested record."""
    lab = S.read(spark, sf, "labels", "doc_id", "quality", "toxic")
    js = lab.select("doc_id", F.to_json(F.struct("quality", F.struct("toxic").alias("flags"))).alias("j"))
    back = js.select("doc_id", F.from_json("j", "quality INT, flags STRUCT<toxic: INT>").alias("r"))
    return back.select("doc_id", "r.quality", "r.flags.toxic")


@register("f7", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels")
def q_f7(spark, sf):
    """Optional JSON keys read as null."""
    lab = S.read(spark, sf, "labels", "doc_id", "quality", "toxic")
    full = F.to_json(F.struct("doc_id", "quality", "toxic"))
    part = F.to_json(F.struct("doc_id", "toxic"))
    js = lab.select(F.when(F.col("doc_id") % 3 == 0, part).otherwise(full).alias("j"))
    r = js.select(F.from_json("j", "doc_id LONG, quality INT, toxic INT").alias("r"))
    return r.select("r.doc_id", "r.quality", "r.toxic")


@register("f8", "SELECT user_id, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY user_id")
def q_f8(spark, sf):
    """Seconds between each user's first and last event."""
    e = S.read(spark, sf, "events", "user_id", "ts")
    g = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", U.duration_seconds(F.col("a"), F.col("b")).alias("seconds"))


@register("k3", f"{PART_SQL} SELECT participant_id, partof, {rsql('TTR')} AS TTR, total_words FROM part WHERE partof = 1")
def q_k3(spark, sf):
    """Participant table written with JSON-encoded indicators, partitioned by split; split 1 read back."""
    path = scratch(spark, "participant-table")
    ind = _indicators(spark, sf)
    lab = S.read(spark, sf, "labels", "doc_id", "toxic")
    p = ind.join(lab, "doc_id").select(F.col("doc_id").alias("participant_id"), F.col("toxic").alias("phq_binary"),
                                       S.split_of(F.col("doc_id")).alias("partof"), *[c for c in ind.columns if c != "doc_id"])
    K.write_participants(Fe.encode_indicators(p).select("participant_id", "phq_binary", "partof", "indicateur"), path)
    back = spark.read.parquet(path).filter(F.col("partof") == 1)
    dec = back.select("participant_id", "partof", F.from_json("indicateur", Fe.indicator_schema()).alias("i"))
    return dec.select("participant_id", "partof", F.col("i.TTR").alias("TTR"), F.col("i.total_words").alias("total_words"))


# --- inventory items otherwise covered only inside larger queries --------------------------------

from colloquy.operators import dialogue as D  # noqa: E402
from colloquy.operators import lexical as L  # noqa: E402
from colloquy.plans.dialogue_queries import NOTES_SQL, SENTS_SQL  # noqa: E402
from colloquy.plans.registry import QUERIES  # noqa: E402


@register("j1", f"WITH {NOTES_SQL} SELECT DISTINCT t.conv_id FROM turns t JOIN notes n USING (conv_id)")
def q_j1(spark, sf):
    """Transcripts joined to their case notes on the conversation key."""
    t = S.turns(spark, sf)
    sents = D.transcript_sentences(t)
    notes = D.standin_notes(sents)
    return t.select("conv_id").distinct().join(notes.select("conv_id").distinct(), "conv_id")


@register("f4", f"WITH {SENTS_SQL} SELECT conv_id, turn, pos, sentence FROM ts0")
def q_f4(spark, sf):
    """List of sentences of each turn → one row per sentence with its position."""
    t = S.turns(spark, sf)
    from colloquy.functions.text import sentences
    return t.select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")) \
            .withColumn("pos", F.col("pos").cast("int"))


_SLICE_SRC = ("SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations "
              "WHERE role = 'user' GROUP BY conv_id")
_SLICE_SQL = (f"WITH src AS ({_SLICE_SRC}),{tokens_cte('src')}, n AS (SELECT doc_id, count(*) AS n_doc FROM tok GROUP BY 1), "
              "f AS (SELECT doc_id, text, count(*) AS c, sum(CASE WHEN pos <> 'DET' THEN 1 ELSE 0 END) AS cn FROM tok "
              "WHERE NOT is_punct AND NOT is_stop AND NOT contains(text, chr(10)) GROUP BY 1, 2), "
              "v AS (SELECT doc_id, count(*) AS V, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS v1, "
              "avg(CASE WHEN cn > 0 THEN cn END) AS mf, max(CASE WHEN cn > 0 THEN cn END) - min(CASE WHEN cn > 0 THEN cn END) AS rf, "
              "stddev_pop(CASE WHEN cn > 0 THEN cn END) AS sf FROM f GROUP BY 1) "
              "SELECT n.doc_id AS conv_id, n.n_doc, CAST(coalesce(v.V, 0) AS BIGINT) AS V, CAST(coalesce(v.v1, 0) AS BIGINT) AS v1, "
              f"{rsql('CASE WHEN coalesce(v.V, 0) > 0 THEN pow(n.n_doc, pow(v.V, -0.165)) END')} AS Brunet_index, "
              f"{rsql('CASE WHEN coalesce(v.v1, 0) <> n.n_doc THEN 100.0 * ln(n.n_doc) / (1.0 - coalesce(v.v1, 0) / n.n_doc) END')} AS Honore_statistic, "
              f"{rsql('coalesce(v.v1, 0) / n.n_doc')} AS TTR, {rsql('v.mf')} AS mean_freq_words, CAST(v.rf AS BIGINT) AS range_freq_words, "
              f"{rsql('v.sf')} AS std_freq_words FROM n LEFT JOIN v USING (doc_id)")


@register("slice", _SLICE_SQL)
def q_slice(spark, sf):
    """SURVEY 7.2 slice: patient dialogue of each conversation → tokens → N, V, hapax, Brunet,
    Honoré, TTR and frequency mean/range/std."""
    dia = D.patient_dialogue(S.turns(spark, sf)).select(F.col("conv_id").alias("doc_id"), F.col("dialogue").alias("text"))
    tok = annotate(S.spread(dia))
    d = L.word_measures(L.text_table(L.word_table(tok)))
    out = d.select(F.col("doc_id").alias("conv_id"), "n_doc", F.coalesce("V", F.lit(0)).alias("V"),
                   F.coalesce("v1", F.lit(0)).alias("v1"),
                   *L.diversity(F.col("n_doc"), F.coalesce("V", F.lit(0)), F.coalesce("v1", F.lit(0))),
                   "mean_freq_words", "range_freq_words", "std_freq_words")
    return rounded(out)


@register("k6", QUERIES["w3"].sql)
def q_k6(spark, sf):
    """Session snapshot sink: every row written by the foreachBatch writer, read back."""
    from colloquy.plans.stream_queries import _lex, _staged_phrases
    from colloquy.streaming import session as St
    emo, units = _lex(spark, sf)
    stream = St.session_stream(_staged_phrases(spark, sf), emo, units)
    snap, ckpt = St.scratch(spark, "snapshot-k6"), St.scratch(spark, "snapshot-k6-ckpt")
    St.run_to_end(stream, snap, ckpt, batch_fn=St.snapshot_writer(snap))
    return rounded(spark.read.parquet(snap).select("conv_id", "phrase", "turn", *R.RUNNING_SERIES))


@register("s18")
def q_s18(spark, sf):
    """Persisted pipeline model loaded back and applied to the test split (rows-only)."""
    from colloquy.operators import models as Mo
    from colloquy.plans.model_queries import frames
    train, test = frames(spark, sf)
    path = Mo.save_model(Mo.fit_pipeline([Mo.gradient_boosting()], train), "s18_boosting", spark)
    return Mo.load_model(path).transform(test).select("participant_id", "label", "prediction")
