"""Dialogue shaping: speaker codes, filters, runs, ordinals, rendered texts, notes (P1–P9,
W1, W5, A22–A28, J1–J3, F13).

Turn tables have the layout ``(conv_id, turn, speaker, text)``; 1 is the clinician, 2 the
patient. Ordered string building always sorts ``(order, text)`` structs explicitly and never
relies on the arrival order of ``collect_list``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import TOKEN_RE, md5_int, sentences
from colloquy.operators import arrays
from colloquy.operators.sequence import dense_ordinal, prefix_sums, previous_values
from colloquy.session import write_stage

# --- fixed values ---------------------------------------------------------------------------
CLINICIAN_NAME = "Ellie"
PATIENT_NAME = "Participant"
SYNC_MARKER = "<sync>"
EMPTY_UTTERANCE = "[]"
PROMPT_RE = r"\((.*?)\)"
NOTE_CATEGORIES = [
    "Client Details",
    "Chief Complaint",
    "History of Present Illness",
    "Past Psychiatric History",
    "History of Substance Use",
    "Social History",
    "Family History",
    "Review of Systems",
]
SUMMARY_TAGS = ("summary", "Summary", "summary ")
TOPIC_TAGS = ("primary_topic", "secondary_topic")


# --- P1 – P7 -------------------------------------------------------------------------------------

def speaker_code(name: Column, clinician: str = CLINICIAN_NAME) -> Column:
    """The clinician's name → 1, any other speaker → 2."""
    return F.when(name == clinician, 1).otherwise(2).cast("int")


def role_label(code: Column) -> Column:
    """Speaker code → ``Doctor`` (1) / ``Patient`` (else)."""
    return F.when(code == 1, "Doctor").otherwise("Patient")


def role_from_type(type_col: Column) -> Column:
    """Utterance type ``P`` → ``Patient``, anything else → ``Doctor``."""
    return F.when(type_col == "P", "Patient").otherwise("Doctor")


def drop_empty_utterances(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop null and ``"[]"`` utterances."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != EMPTY_UTTERANCE))


def drop_sync(df: DataFrame, col: str = "value") -> DataFrame:
    """Drop ``<sync>`` marker rows."""
    return df.filter(F.col(col) != SYNC_MARKER)


def keep_speakers(df: DataFrame, col: str, names=(CLINICIAN_NAME, PATIENT_NAME)) -> DataFrame:
    """P5: keep the two known speakers."""
    return df.filter(F.col(col).isin(list(names)))


def patient_only(df: DataFrame, col: str = "speaker") -> DataFrame:
    """P6."""
    return df.filter(F.col(col) == 2)


def prompt_text(content: Column) -> Column:
    """The text inside the first parentheses, else the content with a final period."""
    return (F.when(content.rlike(PROMPT_RE), F.regexp_extract(content, PROMPT_RE, 1))
            .otherwise(F.concat(content, F.lit("."))))


# --- ordered string aggregation -------------------------------------------------------------------

def ordered_join(order: Column, text: Column, sep: str) -> Column:
    """Aggregate: texts joined with ``sep`` in ``order`` (explicit sort of structs)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))),
                                    lambda x: x["t"]), sep)


def patient_dialogue(turns: DataFrame) -> DataFrame:
    """``(conv_id, dialogue)`` = patient turns joined with a blank, in turn order."""
    return (patient_only(turns).groupBy("conv_id")
            .agg(ordered_join(F.col("turn"), F.col("text"), " ").alias("dialogue")))


def render_conversation(turns: DataFrame, label: Column | None = None) -> DataFrame:
    """``(conv_id, conversation)`` with one ``Role: text`` line per turn."""
    label = label if label is not None else role_label(F.col("speaker"))
    line = F.concat(label, F.lit(": "), F.col("text"), F.lit("\n"))
    return turns.groupBy("conv_id").agg(ordered_join(F.col("turn"), line, "").alias("conversation"))


# --- W1 / A28: speaker runs --------------------------------------------------------------------------

def run_ids(turns: DataFrame, key: str = "conv_id", order: str = "turn",
            speaker: str = "speaker") -> DataFrame:
    """``run_id`` (from 1) numbering runs of consecutive turns of one speaker."""
    p = previous_values(turns, [key], order, [speaker])
    p = p.withColumn("_new", (F.col(f"prev_{speaker}").isNull()
                              | (F.col(f"prev_{speaker}") != F.col(speaker))).cast("long"))
    r = prefix_sums(p, [key], order, ["_new"])
    return r.withColumn("run_id", F.col("_new_cum")).drop("_new", "_new_cum", f"prev_{speaker}")


def merge_runs(turns: DataFrame, texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per run with the run's texts joined by a blank in turn order."""
    r = run_ids(turns)
    return r.groupBy("conv_id", "run_id").agg(
        F.first("speaker").alias("speaker"), F.min("turn").alias("first_turn"),
        *[ordered_join(F.col("turn"), F.col(t), " ").alias(t) for t in texts])


# --- W5 / J1 – J3 / A24 – A25: transcripts and case notes --------------------------------------------

def transcript_sentences(turns: DataFrame) -> DataFrame:
    """Sentences of every turn with the global ordinal across the conversation."""
    s = turns.select("conv_id", "turn", "speaker",
                     F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("pos", F.col("pos").cast("int"))
    return dense_ordinal(s, ["conv_id"], ["turn", "pos"], out="ordinal")


def standin_notes(sents: DataFrame, annotator: int = 1) -> DataFrame:
    """D3 stand-in from the transcript sentences: an md5 of (conversation, annotator,
    ordinal) picks about one sentence in three and its category; one element in forty
    points past the transcript end so the unmatched-id report is exercised."""
    h = md5_int(F.concat_ws(":", F.col("conv_id"), F.lit(annotator), F.col("ordinal")))
    picked = sents.withColumn("_h", h).filter(F.col("_h") % 3 == 0)
    last = sents.groupBy("conv_id").agg((F.max("ordinal") + 1).alias("_past"))
    picked = picked.join(last, "conv_id")
    source = F.when(F.col("_h") % 40 == 9, F.col("_past") + F.col("ordinal")).otherwise(F.col("ordinal"))
    return picked.select(
        "conv_id", F.col("ordinal").alias("elem_id"),
        (F.col("_h") % 8).cast("int").alias("categoryId"),
        F.concat(F.lit("noted: "), F.lower(F.trim(F.col("sentence")))).alias("formalText"),
        source.cast("long").alias("sourceId"))


def category_table(spark) -> DataFrame:
    """The eight section names by position."""
    return spark.createDataFrame(list(enumerate(NOTE_CATEGORIES)), "categoryId int, category string")


def note_elements(notes: DataFrame, sents: DataFrame) -> DataFrame:
    """J2 + J3: note elements with their source sentence and section name."""
    src = sents.select("conv_id", F.col("ordinal").alias("sourceId"), F.col("sentence").alias("source"))
    cats = F.broadcast(category_table(notes.sparkSession))
    return notes.join(src, ["conv_id", "sourceId"]).join(cats, "categoryId")


def unmatched_elements(notes: DataFrame, sents: DataFrame) -> DataFrame:
    """J2 report: elements whose ``sourceId`` finds no sentence (reported, not raised)."""
    src = sents.select("conv_id", F.col("ordinal").alias("sourceId"))
    return notes.join(src, ["conv_id", "sourceId"], "left_anti")


def casenote_text(notes: DataFrame, sents: DataFrame, include_source: bool = False) -> DataFrame:
    """``(conv_id, note)``: sections in category order, elements in note order."""
    e = note_elements(notes, sents)
    item = (F.concat(F.lit('"'), F.col("source"), F.lit('" => '), F.col("formalText"))
            if include_source else F.col("formalText"))
    sec = (e.groupBy("conv_id", "categoryId", "category")
            .agg(ordered_join(F.col("elem_id"), item, "\n").alias("_body"))
            .withColumn("_section", F.concat(F.col("category"), F.lit(":\n\n"), F.col("_body"), F.lit("\n\n"))))
    return sec.groupBy("conv_id").agg(ordered_join(F.col("categoryId"), F.col("_section"), "").alias("note"))


def note_dataset(turns: DataFrame, annotator: int = 1, include_source: bool = False) -> DataFrame:
    """``(conv_id, dialogue, note)`` for conversations that have a note."""
    sents = transcript_sentences(turns)
    notes = standin_notes(sents, annotator)
    dia = render_conversation(turns).withColumnRenamed("conversation", "dialogue")
    return dia.join(casenote_text(notes, sents, include_source), "conv_id")


# --- P8 / P9 / A26 / A27 ----------------------------------------------------------------------------

def split_metadata(rows: DataFrame, tag_col: str, text_col: str, order: str, key: str = "conv_id"):
    """``(turns, notes)``: summary rows become the note (last one wins), topic rows are
    dropped, the rest are turns."""
    is_summary = F.col(tag_col).isin(list(SUMMARY_TAGS))
    is_topic = F.col(tag_col).isin(list(TOPIC_TAGS))
    notes = (rows.filter(is_summary).groupBy(key)
             .agg(F.max_by(F.col(text_col), F.col(order)).alias("summary")))
    turns = rows.filter(~is_summary & ~is_topic)
    return turns, notes


def missing_notes(dialogues: DataFrame, notes: DataFrame, key: str = "conv_id") -> DataFrame:
    """Dialogues without a note (the reference asserts; we report)."""
    return dialogues.select(key).distinct().join(notes.select(key), key, "left_anti")


def split_name(key: Column) -> Column:
    m = F.pmod(key, F.lit(10))
    return F.when(m <= 1, "Test").when(m == 2, "Validation").otherwise("Train")


def summary_dataset(conversations: DataFrame) -> DataFrame:
    """Dialogue + summary per conversation with its split. Stand-in layout: system rows
    are the ``summary`` metadata rows, ``user`` rows have type ``P``."""
    rows = conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "system", "summary").otherwise("dialogue").alias("tag"),
        F.when(F.col("role") == "user", "P").otherwise("T").alias("type"), "text")
    turns, notes = split_metadata(rows, "tag", "text", "turn")
    dia = render_conversation(turns, role_from_type(F.col("type"))).withColumnRenamed("conversation", "dialogue")
    return (dia.join(notes, "conv_id")
               .select("conv_id", "dialogue", "summary", split_name(F.col("conv_id")).alias("split")))


def interview_dialogue(export: DataFrame) -> DataFrame:
    """``(conv_id, dialogue)`` from ``(conv_id, turn, speaker_name, value)`` rows."""
    rows = keep_speakers(drop_sync(export, "value"), "speaker_name")
    line = (F.when(F.col("speaker_name") == CLINICIAN_NAME,
                   F.concat(F.lit("Doctor: "), prompt_text(F.col("value")), F.lit("\n")))
             .otherwise(F.concat(F.lit("Patient: "), F.col("value"), F.lit(".\n"))))
    return rows.groupBy("conv_id").agg(ordered_join(F.col("turn"), line, "").alias("dialogue"))


# --- F13: dictionary gloss -------------------------------------------------------------------------

def gloss(df: DataFrame, text_col: str, lexicon: DataFrame, out_col: str = "traduit") -> DataFrame:
    """every token of a text replaced by its lexicon target (unknown tokens kept),
    tokens joined by a blank in order. Works on the distinct texts, joined back.

    A text's distinct words leave its row as ``(id, word, places)`` and only the known ones come back; the text itself
    is never carried by its tokens.
    """
    texts = df.select(F.col(text_col).alias("_src")).where(F.col(text_col).isNotNull()).distinct()
    texts = write_stage(texts.withColumn("_id", F.monotonically_increasing_id()), "gloss-texts")
    token_array = f"regexp_extract_all(_src, '{arrays.literal(TOKEN_RE)}', 0)"
    # places of each distinct word: the sorted (word, place) pairs cut where the word changes
    pairs = f"sort_array(transform({token_array}, (t, i) -> named_struct('w', lower(t), 'p', i)))"
    places = arrays.let(pairs, lambda s: arrays.let(
        f"IF(size({s}) = 0, CAST(array() AS ARRAY<INT>), filter(sequence(0, size({s}) - 1), i -> i = 0 OR get({s}, i).w <> get({s}, i - 1).w))",
        lambda at: f"transform({at}, (b, k) -> named_struct('_w', get({s}, b).w, '_ps', "
                   f"transform(slice({s}, b + 1, coalesce(get({at}, k + 1), size({s})) - b), x -> x.p)))"))
    asked = texts.select("_id", F.expr(f"inline({places})"))
    lex = lexicon.select(F.col("word").alias("_w"), F.col("target").alias("_tgt"))
    known = asked.join(lex, "_w").groupBy("_id").agg(F.collect_list(F.struct("_ps", "_tgt")).alias("_known"))
    # of the pairs (place, 0, target) and (place, 1, token) in order, a token stays if its place has no target
    merged = (f"sort_array(concat(transform(_toks, (t, i) -> named_struct('p', i, 'k', 1, 'x', t)), flatten(transform("
              "coalesce(_known, array()), e -> transform(e._ps, q -> named_struct('p', q, 'k', 0, 'x', coalesce(e._tgt, get(_toks, q))))))))")
    kept = arrays.let(merged, lambda m: f"transform(filter({m}, (x, i) -> x.k = 0 OR i = 0 OR get({m}, i - 1).p <> x.p), x -> x.x)")
    out = (texts.join(known, "_id", "left").withColumn("_toks", F.expr(token_array))
                .select("_src", F.array_join(F.expr(kept), " ").alias(out_col)))
    return df.join(out, df[text_col] == out["_src"], "left").drop("_src") \
             .withColumn(out_col, F.coalesce(F.col(out_col), F.lit("")))


def standin_bilingual(vocab: DataFrame) -> DataFrame:
    """Bilingual lexicon stand-in: a word with md5 ≡ 0 (mod 3) maps to a code word."""
    return vocab.filter(F.col("h") % 3 == 0).select(
        "word", F.concat(F.lit("w"), F.substring(F.md5("word"), 1, 6)).alias("target"))
