"""DuckDB building blocks for the SQL oracles.

The oracle is an independent formulation: the Spark side annotates tokens on sentence
arrays with higher-order functions, the oracle with window functions over exploded rows;
the Spark side computes sentence flags with set overlap, the oracle with a self join.
Only the *rules* (word lists, suffixes, patterns) are shared.
"""

from __future__ import annotations

from colloquy.functions import text as T


def explode_sql(table: str, id_expr: str, text_expr: str, pattern: str,
                out_id: str, out_pos: str, out_val: str, extra: str = "") -> str:
    """Rows of ``regexp_extract_all`` with 0-based positions."""
    extra = (extra + ", ") if extra else ""
    return (f"SELECT {extra}{id_expr} AS {out_id}, "
            f"CAST(generate_subscripts(regexp_extract_all({text_expr}, '{pattern}'), 1) - 1 AS INTEGER) AS {out_pos}, "
            f"unnest(regexp_extract_all({text_expr}, '{pattern}')) AS {out_val} FROM {table}")


def tokens_cte(source: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """CTE list (without WITH) producing ``tok`` with the token-table columns."""
    sents = explode_sql(source, id_col, text_col, T.SENTENCE_RE, "doc_id", "sent_id", "sentence")
    return f"""
  o_sent AS ({sents}),
  o_t0 AS (SELECT doc_id, sent_id,
             CAST(generate_subscripts(regexp_extract_all(sentence, '{T.TOKEN_RE}'), 1) - 1 AS INTEGER) AS tok_id,
             unnest(regexp_extract_all(sentence, '{T.TOKEN_RE}')) AS text FROM o_sent),
  o_t1 AS (SELECT *, lower(text) AS lw, NOT regexp_matches(text, '{T.PUNCT_TEST_RE}') AS is_punct,
             regexp_matches(text, '{T.NUM_TEST_RE}') AS is_num FROM o_t0),
  o_t2 AS (SELECT *, {T.pos_sql()} AS pos FROM o_t1),
  o_t3 AS (SELECT *,
      max(CASE WHEN pos = 'VERB' THEN tok_id END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_verb,
      min(CASE WHEN pos = 'VERB' THEN tok_id END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id
          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_verb,
      min(CASE WHEN pos = 'VERB' THEN tok_id END) OVER (PARTITION BY doc_id, sent_id) AS first_verb,
      lag(pos) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS prev_pos,
      lag(lw) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS prev_lw
    FROM o_t2),
  o_t4 AS (SELECT *, CASE WHEN pos = 'VERB' THEN CASE WHEN tok_id = first_verb THEN NULL ELSE first_verb END
                     ELSE coalesce(prev_verb, next_verb) END AS head_id FROM o_t3),
  tok AS (SELECT doc_id, sent_id, tok_id, text, lw AS lemma, pos,
             {T.verb_form_sql('pos', 'lw')} AS verb_form,
             {T.dep_sql()} AS dep, head_id, is_punct, {T.is_stop_sql('lw')} AS is_stop,
             false AS is_space FROM o_t4)"""


def with_tokens(source_select: str, body: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """``WITH src AS (...), <token ctes> <body>`` where body starts with ``, name AS (...)`` or SELECT."""
    return f"WITH src AS ({source_select}),{tokens_cte('src', id_col, text_col)}\n{body}"


def lexicon_ctes() -> str:
    """CTEs ``vocab_h, valence_lex, valence, emotion_lex, emotion, unit_dict, unit_cat, unit_flat``."""
    from colloquy.sources import tables as S
    h = "h"
    emo_first = ", ".join(f"CAST(({h} >> {4 + i}) & 1 AS INTEGER) AS {e}" for i, e in enumerate(S.EMOTIONS))
    emo_dup = ", ".join(f"CAST(({h} >> {12 + i}) & 1 AS INTEGER) AS {e}" for i, e in enumerate(S.EMOTIONS))
    emo_pick = ", ".join(f"arg_min({e}, line_no) AS {e}" for e in S.EMOTIONS)
    cats = ", ".join(f"CASE WHEN ({h} >> {5 + i}) & 1 = 1 THEN word END AS {c}"
                     for i, c in enumerate(S.UNIT_CATEGORIES))
    cat_rows = " UNION ALL ".join(f"SELECT lower(mot) AS unit, '{c}' AS category FROM unit_dict WHERE {c} IS NOT NULL"
                                  for c in S.UNIT_CATEGORIES)
    return f"""
  vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{T.WORD_RE}')) AS word
            FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)),
  vocab_h AS (SELECT word, {T.md5_int_sql('word')} AS h FROM vocab),
  valence_lex AS (
    SELECT word, CAST((h // {S.VALENCE_MOD}) % 11 - 5 AS INTEGER) AS value, h * 2 AS line_no
      FROM vocab_h WHERE h % {S.VALENCE_MOD} = 0
    UNION ALL
    SELECT word, CAST((h // {S.VALENCE_DUP_MOD}) % 11 - 5 AS INTEGER) AS value, h * 2 + 1 AS line_no
      FROM vocab_h WHERE h % {S.VALENCE_MOD} = 0 AND h % {S.VALENCE_DUP_MOD} = 0),
  valence AS (SELECT word, arg_max(value, line_no) AS value FROM valence_lex GROUP BY word),
  emotion_lex AS (
    SELECT word, {emo_first}, h * 2 AS line_no FROM vocab_h WHERE h % {S.EMOTION_MOD} = 1
    UNION ALL
    SELECT word, {emo_dup}, h * 2 + 1 AS line_no FROM vocab_h
      WHERE h % {S.EMOTION_MOD} = 1 AND h % {S.EMOTION_DUP_MOD} = 1),
  emotion AS (SELECT word, {emo_pick} FROM emotion_lex GROUP BY word),
  unit_dict AS (SELECT word AS mot, {cats}, 'vocabulary' AS provenance FROM vocab_h WHERE h % {S.UNIT_MOD} = 3),
  unit_cat AS ({cat_rows}),
  unit_flat AS (SELECT DISTINCT lower(word) AS unit FROM (SELECT word FROM valence_lex UNION ALL SELECT word FROM emotion_lex))"""
