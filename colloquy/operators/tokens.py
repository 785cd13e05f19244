"""Sentence rows and the token annotation table.

The token table has the layout of a parser's output (D9):

    doc_id, sent_id, tok_id, text, lemma, pos, verb_form, dep, head_id,
    is_punct, is_stop, is_space

Callers holding real parses pass such a table straight to the aggregates. Without one,
:func:`annotate` derives it with closed word classes and suffix rules and attaches each
token to the nearest verb of its sentence. This is a rule-based stand-in, not a parser.

Plan shape: a document row becomes sentence rows and then token rows through generators
only; every per-token rule (including "nearest verb") is evaluated on the sentence's token
array with higher-order functions, so building the table needs no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import arrays

TOKEN_COLUMNS = ["doc_id", "sent_id", "tok_id", "text", "lemma", "pos", "verb_form", "dep",
                 "head_id", "is_punct", "is_stop", "is_space"]


def sentence_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """one row per sentence ``(doc_id, sent_id, sentence)``; ``sent_id`` from 0."""
    return df.select(
        F.col(id_col).alias("doc_id"), *keep,
        F.posexplode(T.sentences(F.col(text_col))).alias("sent_id", "sentence"),
    ).withColumn("sent_id", F.col("sent_id").cast("int"))


def _annotated_array() -> Column:
    """Array of token structs for the column ``sentence`` with every rule applied."""
    base = F.expr(f"""transform(regexp_extract_all(sentence, '{arrays.literal(T.TOKEN_RE)}', 0), (t, i) ->
        named_struct('text', t, 'lw', lower(t), 'tok_id', i,
                     'is_punct', NOT (t rlike '{arrays.literal(T.PUNCT_TEST_RE)}'),
                     'is_num', t rlike '{arrays.literal(T.NUM_TEST_RE)}'))""")
    tagged = F.transform(base, lambda a: F.struct(
        a["text"].alias("text"), a["lw"].alias("lw"), a["tok_id"].alias("tok_id"),
        a["is_punct"].alias("is_punct"), _pos(a).alias("pos")))
    return tagged


def _pos(a: Column) -> Column:
    """The shared POS rule, applied to the struct ``a`` of :func:`_annotated_array`."""
    lw, text, tok, punct, num = a["lw"], a["text"], a["tok_id"], a["is_punct"], a["is_num"]

    def isin(words):
        return lw.isin(list(words))

    def ends(suffixes):
        cond = F.lit(False)
        for s in suffixes:
            cond = cond | lw.endswith(s)
        return cond

    return (F.when(punct, "PUNCT").when(num, "NUM")
            .when(isin(T.DET_WORDS), "DET").when(isin(T.AUX_WORDS), "AUX")
            .when(isin(T.PRON_WORDS), "PRON").when(isin(T.ADP_WORDS), "ADP")
            .when(isin(T.CCONJ_WORDS), "CCONJ").when(isin(T.SCONJ_WORDS), "SCONJ")
            .when(isin(T.ADV_WORDS), "ADV")
            .when((tok > 0) & (F.substring(text, 1, 1) != F.lower(F.substring(text, 1, 1))), "PROPN")
            .when(ends(T.ADV_SUFFIXES), "ADV").when(ends(T.NOUN_SUFFIXES), "NOUN")
            .when(ends(T.VERB_INF_SUFFIXES + T.VERB_FIN_SUFFIXES), "VERB")
            .when(ends(T.ADJ_SUFFIXES), "ADJ").otherwise("NOUN"))


def tagged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token table without ``tok_id`` and the links (``dep``, ``head_id``): a text is tagged in its own row, and no verb is looked for."""
    sentences = f"regexp_extract_all(`{text_col}`, '{arrays.literal(T.SENTENCE_RE)}', 0)"
    rows = df.select(F.col(id_col).alias("doc_id"), F.expr(f"inline({arrays.tagged_tokens(sentences)})"))
    return rows.select("doc_id", F.col("sent").alias("sent_id"), "text", F.col("lw").alias("lemma"), "pos",
                       F.expr(T.verb_form_sql("pos", "lw")).alias("verb_form"), (F.col("pos") == "PUNCT").alias("is_punct"),
                       F.expr(T.is_stop_sql("lw")).alias("is_stop"), F.lit(False).alias("is_space"))


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = (), heads: bool = False) -> DataFrame:
    """rule-based token table from ``(id, text)`` rows; see the module docstring.

    ``keep`` columns of the input are carried to every token row (after ``doc_id``). ``heads`` adds each token's
    ``head_pos`` and ``head_is_punct``, read in its sentence's row."""
    keep = tuple(keep)
    sents = sentence_rows(df, id_col, text_col, keep)
    toks = sents.select("doc_id", *keep, "sent_id", _annotated_array().alias("toks"))
    # linear in the sentence: each verb is repeated over the stretch to its neighbour, and the token
    # before is the array shifted by one
    toks = toks.withColumn("verbs", F.expr(arrays.verb_places("toks")))
    toks = toks.withColumns({"prev_verbs": F.expr(arrays.verb_before("verbs", "toks")), "next_verbs": F.expr(arrays.verb_after("verbs", "toks"))})
    zipped = [F.col("toks").alias("tok"), F.col("prev_verbs").alias("prev_verb"), F.col("next_verbs").alias("next_verb"),
              F.expr("IF(size(toks) = 0, toks, concat(array(NULL), slice(toks, 1, size(toks) - 1)))").alias("before")]
    if heads:
        zipped.append(F.expr("transform(toks, (t, i) -> get(toks, IF(t.pos = 'VERB', IF(i = get(verbs, 0), NULL, get(verbs, 0)), "
                             "coalesce(get(prev_verbs, i), get(next_verbs, i)))))").alias("head"))
    linked = toks.select("doc_id", *keep, "sent_id", F.get("verbs", F.lit(0)).alias("first_verb"), F.inline(F.arrays_zip(*zipped)))
    of_head = [F.col("head.pos").alias("head_pos"), F.col("head.is_punct").alias("head_is_punct")] if heads else []
    rows = linked.select("doc_id", *keep, "sent_id", "tok", "prev_verb", "next_verb", "first_verb",
                         F.col("before.pos").alias("prev_pos"), F.col("before.lw").alias("prev_lw"), *of_head)
    head = (F.when(F.col("tok.pos") == "VERB",
                   F.when(F.col("tok.tok_id") == F.col("first_verb"), F.lit(None).cast("int"))
                   .otherwise(F.col("first_verb")))
            .otherwise(F.coalesce("prev_verb", "next_verb")))
    rows = rows.select(
        "doc_id", *keep, "sent_id", F.col("tok.tok_id").alias("tok_id"), F.col("tok.text").alias("text"),
        F.col("tok.lw").alias("lw"), F.col("tok.pos").alias("pos"),
        F.col("tok.is_punct").alias("is_punct"), head.alias("head_id"),
        "first_verb", "prev_pos", "prev_lw", *(["head_pos", "head_is_punct"] if heads else []))
    return rows.select(
        "doc_id", *keep, "sent_id", "tok_id", "text",
        F.col("lw").alias("lemma"), "pos",
        F.expr(T.verb_form_sql("pos", "lw")).alias("verb_form"),
        F.expr(T.dep_sql("pos", "head_id", "tok_id", "prev_pos", "prev_lw", "first_verb")).alias("dep"),
        "head_id", "is_punct",
        F.expr(T.is_stop_sql("lw")).alias("is_stop"),
        F.lit(False).alias("is_space"), *(["head_pos", "head_is_punct"] if heads else []),
    )


def words_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lower: bool = True) -> DataFrame:
    """Word rows ``(doc_id, pos_in_doc, word)`` (punctuation excluded), for vocabularies."""
    txt = F.lower(F.col(text_col)) if lower else F.col(text_col)
    return df.select(F.col(id_col).alias("doc_id"),
                     F.posexplode(T.words(txt)).alias("w_pos", "word"))
