"""Named queries of the dialogue-shaping operators (over ``conversations``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.text import TOKEN_RE, WORD_RE, md5_int_sql
from colloquy.operators import dialogue as D
from colloquy.plans.registry import register
from colloquy.sources import tables as S

TURNS_SQL = ("turns AS (SELECT conv_id, turn, CAST(CASE role WHEN 'assistant' THEN 1 ELSE 2 END AS INTEGER) AS speaker, "
             "text FROM conversations WHERE role IN ('assistant', 'user'))")
EXPORT_SQL = ("export AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Ellie' WHEN 'user' THEN 'Participant' "
              "ELSE role END AS speaker_name, text AS value FROM conversations)")
SENTS_SQL = (TURNS_SQL + ", ts0 AS (SELECT conv_id, turn, speaker, CAST(generate_subscripts(regexp_extract_all(text, "
             "'[^.!?\\n]+[.!?]*'), 1) - 1 AS INTEGER) AS pos, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS sentence "
             "FROM turns), sents AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS ordinal FROM ts0)")
NOTES_SQL = (SENTS_SQL + ", nh AS (SELECT *, " + md5_int_sql("CAST(conv_id AS VARCHAR) || ':1:' || CAST(ordinal AS VARCHAR)")
             + " AS h, max(ordinal) OVER (PARTITION BY conv_id) + 1 AS past FROM sents), notes AS (SELECT conv_id, ordinal AS elem_id, CAST(h % 8 AS INTEGER) AS categoryId, "
             "'noted: ' || lower(trim(sentence)) AS formalText, CAST(CASE WHEN h % 40 = 9 THEN past + ordinal ELSE ordinal END AS BIGINT) "
             "AS sourceId FROM nh WHERE h % 3 = 0), cats AS (SELECT * FROM (VALUES " +
             ", ".join(f"({i}, '{c}')" for i, c in enumerate(D.NOTE_CATEGORIES)) + ") v(categoryId, category)), "
             "elems AS (SELECT n.*, s.sentence AS source, c.category FROM notes n JOIN sents s ON n.conv_id = s.conv_id "
             "AND n.sourceId = s.ordinal JOIN cats c USING (categoryId))")
RENDER_SQL = ("rendered AS (SELECT conv_id, string_agg((CASE WHEN speaker = 1 THEN 'Doctor' ELSE 'Patient' END) || ': ' || "
              "text || chr(10), '' ORDER BY turn) AS dialogue FROM turns GROUP BY conv_id)")
CASENOTE_SQL = ("sections AS (SELECT conv_id, categoryId, category || ':' || chr(10) || chr(10) || string_agg({item}, chr(10) "
                "ORDER BY elem_id) || chr(10) || chr(10) AS section FROM elems GROUP BY conv_id, categoryId, category), "
                "casenote AS (SELECT conv_id, string_agg(section, '' ORDER BY categoryId) AS note FROM sections GROUP BY conv_id)")
SOURCE_ITEM = "'\"' || source || '\" => ' || formalText"


def _turns(spark, sf):
    return S.spread(S.turns(spark, sf))


def _export(spark, sf):
    c = S.read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    name = (F.when(F.col("role") == "assistant", D.CLINICIAN_NAME)
             .when(F.col("role") == "user", D.PATIENT_NAME).otherwise(F.col("role")))
    return c.select("conv_id", "turn", name.alias("speaker_name"), F.col("text").alias("value"))


@register("p1", f"WITH {EXPORT_SQL} SELECT conv_id, turn, speaker_name, CAST(CASE WHEN speaker_name = 'Ellie' "
                "THEN 1 ELSE 2 END AS INTEGER) AS speaker FROM export")
def q_p1(spark, sf):
    """Speaker name → code (clinician 1, everyone else 2)."""
    e = _export(spark, sf)
    return e.select("conv_id", "turn", "speaker_name", D.speaker_code(F.col("speaker_name")).alias("speaker"))


@register("p2", f"WITH {TURNS_SQL} SELECT conv_id, turn, speaker, CASE WHEN speaker = 1 THEN 'Doctor' ELSE 'Patient' END AS role_label FROM turns")
def q_p2(spark, sf):
    """Speaker code → role label."""
    return _turns(spark, sf).select("conv_id", "turn", "speaker", D.role_label(F.col("speaker")).alias("role_label"))


@register("p3", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND text <> '[]'")
def q_p3(spark, sf):
    """Utterances kept after dropping null and "[]" ones."""
    return D.drop_empty_utterances(S.read(spark, sf, "conversations", "conv_id", "turn", "text")).select("conv_id", "turn")


@register("p4", f"WITH {EXPORT_SQL} SELECT conv_id, turn FROM export WHERE value <> '<sync>'")
def q_p4(spark, sf):
    """Export rows without <sync> markers."""
    return D.drop_sync(_export(spark, sf)).select("conv_id", "turn")


@register("p5", f"WITH {EXPORT_SQL} SELECT conv_id, turn, speaker_name FROM export WHERE speaker_name IN ('Ellie', 'Participant')")
def q_p5(spark, sf):
    """Rows of the two known speakers only."""
    return D.keep_speakers(_export(spark, sf), "speaker_name").select("conv_id", "turn", "speaker_name")


@register("p6", f"WITH {TURNS_SQL} SELECT conv_id, turn, text FROM turns WHERE speaker = 2")
def q_p6(spark, sf):
    """Patient turns."""
    return D.patient_only(_turns(spark, sf)).select("conv_id", "turn", "text")


@register("p7", f"WITH {EXPORT_SQL} SELECT conv_id, turn, CASE WHEN regexp_matches(value, '\\((.*?)\\)') THEN "
                "regexp_extract(value, '\\((.*?)\\)', 1) ELSE value || '.' END AS prompt FROM export WHERE speaker_name = 'Ellie'")
def q_p7(spark, sf):
    """Clinician prompt text: inside the first parentheses, else the content plus a period."""
    e = _export(spark, sf).filter(F.col("speaker_name") == D.CLINICIAN_NAME)
    return e.select("conv_id", "turn", D.prompt_text(F.col("value")).alias("prompt"))


@register("p8", "SELECT conv_id, arg_max(text, turn) AS summary FROM conversations WHERE role = 'system' GROUP BY conv_id")
def q_p8(spark, sf):
    """Metadata rows split off: the summary note per conversation (last one wins)."""
    c = S.read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    rows = c.withColumn("tag", F.when(F.col("role") == "system", "summary").otherwise("dialogue"))
    _, notes = D.split_metadata(rows, "tag", "text", "turn")
    return notes


@register("p9", "SELECT DISTINCT conv_id FROM conversations WHERE role <> 'system' AND conv_id NOT IN "
                "(SELECT conv_id FROM conversations WHERE role = 'system')")
def q_p9(spark, sf):
    """Dialogues without a summary note (violation report)."""
    c = S.read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    rows = c.withColumn("tag", F.when(F.col("role") == "system", "summary").otherwise("dialogue"))
    turns, notes = D.split_metadata(rows, "tag", "text", "turn")
    return D.missing_notes(turns, notes)


@register("p10", f"WITH {TURNS_SQL} SELECT conv_id, turn, speaker FROM turns")
def q_p10(spark, sf):
    """Column drop: the turn table without its text."""
    return _turns(spark, sf).drop("text")


@register("w1", f"WITH {TURNS_SQL}, f AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) "
                "IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS nw FROM turns) SELECT conv_id, turn, speaker, "
                "CAST(sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_id FROM f")
def q_w1(spark, sf):
    """Run id of consecutive same-speaker turns (blocked windows)."""
    return D.run_ids(_turns(spark, sf)).select("conv_id", "turn", "speaker", "run_id")


@register("a28", f"WITH {TURNS_SQL}, f AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) "
                 "IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS nw FROM turns), r AS (SELECT *, CAST(sum(nw) OVER "
                 "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_id FROM f) "
                 "SELECT conv_id, run_id, first(speaker) AS speaker, min(turn) AS first_turn, string_agg(text, ' ' ORDER BY turn) AS text "
                 "FROM r GROUP BY conv_id, run_id")
def q_a28(spark, sf):
    """Speaker runs merged into one row each, texts joined in turn order."""
    return D.merge_runs(_turns(spark, sf))


@register("w5", f"WITH {SENTS_SQL} SELECT conv_id, turn, pos, CAST(ordinal AS BIGINT) AS ordinal, sentence FROM sents")
def q_w5(spark, sf):
    """Global sentence ordinal across the turns of a conversation."""
    return D.transcript_sentences(_turns(spark, sf)).select("conv_id", "turn", "pos", "ordinal", "sentence")


@register("j2", f"WITH {NOTES_SQL} SELECT conv_id, elem_id, sourceId, source FROM elems")
def q_j2(spark, sf):
    """Note elements joined to their source sentence by global ordinal."""
    t = _turns(spark, sf)
    sents = D.transcript_sentences(t)
    return D.note_elements(D.standin_notes(sents), sents).select("conv_id", "elem_id", "sourceId", "source")


@register("j2r", f"WITH {NOTES_SQL} SELECT n.conv_id, n.elem_id, n.sourceId FROM notes n WHERE NOT EXISTS "
                 "(SELECT 1 FROM sents s WHERE s.conv_id = n.conv_id AND s.ordinal = n.sourceId)")
def q_j2r(spark, sf):
    """Note elements whose source sentence does not exist (report)."""
    t = _turns(spark, sf)
    sents = D.transcript_sentences(t)
    return D.unmatched_elements(D.standin_notes(sents), sents).select("conv_id", "elem_id", "sourceId")


@register("j3", f"WITH {NOTES_SQL} SELECT conv_id, elem_id, categoryId, category FROM elems")
def q_j3(spark, sf):
    """Section name of every note element (category dimension look-up)."""
    t = _turns(spark, sf)
    sents = D.transcript_sentences(t)
    return D.note_elements(D.standin_notes(sents), sents).select("conv_id", "elem_id", "categoryId", "category")


@register("a22", f"WITH {TURNS_SQL} SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS dialogue FROM turns WHERE speaker = 2 GROUP BY conv_id")
def q_a22(spark, sf):
    """Patient dialogue text: patient turns joined in order."""
    return D.patient_dialogue(_turns(spark, sf))


@register("a23", f"WITH {TURNS_SQL}, {RENDER_SQL} SELECT conv_id, dialogue AS conversation FROM rendered")
def q_a23(spark, sf):
    """Conversation rendering, one "Role: text" line per turn."""
    return D.render_conversation(_turns(spark, sf))


@register("a24", f"WITH {NOTES_SQL}, {CASENOTE_SQL.format(item=SOURCE_ITEM)} SELECT conv_id, note FROM casenote")
def q_a24(spark, sf):
    """Case-note text with sources: sections in category order, elements in note order."""
    t = _turns(spark, sf)
    sents = D.transcript_sentences(t)
    return D.casenote_text(D.standin_notes(sents), sents, include_source=True)


@register("a25", f"WITH {NOTES_SQL}, {RENDER_SQL}, {CASENOTE_SQL.format(item='formalText')} "
                 "SELECT r.conv_id, r.dialogue, c.note FROM rendered r JOIN casenote c USING (conv_id)")
def q_a25(spark, sf):
    """(dialogue, note) pairs per conversation."""
    return D.note_dataset(_turns(spark, sf))


@register("a26", "WITH r AS (SELECT conv_id, string_agg((CASE WHEN role = 'user' THEN 'Patient' ELSE 'Doctor' END) || ': ' || "
                 "text || chr(10), '' ORDER BY turn) AS dialogue FROM conversations WHERE role <> 'system' GROUP BY conv_id), "
                 "n AS (SELECT conv_id, arg_max(text, turn) AS summary FROM conversations WHERE role = 'system' GROUP BY conv_id) "
                 "SELECT conv_id, dialogue, summary, CASE WHEN conv_id % 10 <= 1 THEN 'Test' WHEN conv_id % 10 = 2 THEN 'Validation' "
                 "ELSE 'Train' END AS split FROM r JOIN n USING (conv_id)")
def q_a26(spark, sf):
    """Dialogue + summary dataset with split names."""
    return D.summary_dataset(S.read(spark, sf, "conversations", "conv_id", "turn", "role", "text"))


@register("a27", f"WITH {EXPORT_SQL} SELECT conv_id, string_agg(CASE WHEN speaker_name = 'Ellie' THEN 'Doctor: ' || "
                 "(CASE WHEN regexp_matches(value, '\\((.*?)\\)') THEN regexp_extract(value, '\\((.*?)\\)', 1) ELSE value || '.' END) "
                 "|| chr(10) ELSE 'Patient: ' || value || '.' || chr(10) END, '' ORDER BY turn) AS dialogue FROM export "
                 "WHERE value <> '<sync>' AND speaker_name IN ('Ellie', 'Participant') GROUP BY conv_id")
def q_a27(spark, sf):
    """Interview export → dialogue text with Doctor/Patient lines."""
    return D.interview_dialogue(_export(spark, sf))


@register("f13", f"""WITH {TURNS_SQL},
  vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS word
            FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)),
  bil AS (SELECT word, 'w' || substr(md5(word), 1, 6) AS target FROM vocab WHERE {md5_int_sql('word')} % 3 = 0),
  src AS (SELECT DISTINCT text FROM turns),
  tk AS (SELECT text, generate_subscripts(regexp_extract_all(text, '{TOKEN_RE}'), 1) AS p,
                unnest(regexp_extract_all(text, '{TOKEN_RE}')) AS tok FROM src),
  gl AS (SELECT tk.text, string_agg(coalesce(bil.target, tk.tok), ' ' ORDER BY p) AS traduit
         FROM tk LEFT JOIN bil ON lower(tk.tok) = bil.word GROUP BY tk.text)
SELECT t.conv_id, t.turn, coalesce(gl.traduit, '') AS traduit FROM turns t LEFT JOIN gl USING (text)""")
def q_f13(spark, sf):
    """Dictionary gloss of every turn (distinct texts glossed once, joined back)."""
    lex = D.standin_bilingual(S.vocabulary(spark, sf))
    return D.gloss(_turns(spark, sf), "text", lex).select("conv_id", "turn", "traduit")
