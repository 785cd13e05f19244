"""Text segmentation, hashing and the rule-based annotator, as column expressions.

Every rule here is written once as an SQL expression string over named columns so that the
Spark plan (through ``F.expr``) and the independent DuckDB oracle evaluate the *same rule*
with their own engines.  Nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: segmentation patterns ---------------------------------------------
# A sentence is a run of characters without a terminator, followed by its terminators.
SENTENCE_RE = r"[^.!?\n]+[.!?]*"
# A token is a run of letters/digits, or one single other non-blank character.
TOKEN_RE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
# A word (no punctuation) for the vocabulary and the running indicators.
WORD_RE = r"[\p{L}\p{N}]+"
# Whitespace split used by the valence score (punctuation stays glued to words).
BLANK_RE = r"\s+"

# --- fixed values: closed word classes (four languages, own lists) --------------------
DET_WORDS = (
    "the a an this these those "
    "le la les un une des du au aux ce cet cette ces "
    "der die das den dem des ein eine einen einem einer "
    "el los las una unos unas"
).split()
PRON_WORDS = (
    "i you he she it we they me him us them who which what "
    "je tu il elle nous vous ils elles on qui lui leur "
    "ich du er sie es wir ihr sich "
    "yo él ella nosotros ellos ellas lo"
).split()
ADP_WORDS = (
    "of in on at by for with from to into about "
    "de à dans par pour sur avec sans sous en chez "
    "an auf mit von zu für bei aus nach über "
    "con por para sin sobre"
).split()
CCONJ_WORDS = "and or but nor et ou mais donc ni car und oder aber denn y o pero".split()
SCONJ_WORDS = "because if when while although that que parce quand si dass weil wenn ob porque cuando".split()
AUX_WORDS = (
    "is are was were be been am has have had do does did will would can could "
    "est sont était être avoir ai as a avons ont suis "
    "ist sind war waren sein haben hat habe wird werden "
    "son era ser estar está han ha"
).split()
ADV_WORDS = "not very also too so ne pas plus très aussi bien nicht auch sehr noch no muy también".split()
# Relative pronouns open a relative clause when they precede a verb.
REL_WORDS = "who which qui der welche".split()

# Suffix rules, tried in this order after the closed classes.
ADV_SUFFIXES = ("ly", "ment", "mente")
NOUN_SUFFIXES = ("tion", "sion", "ness", "ity", "ung", "heit", "keit", "dad")
VERB_INF_SUFFIXES = ("er", "ir", "re", "ar")
VERB_FIN_SUFFIXES = ("ing", "ed", "ait", "ons", "ez", "te", "aba")
ADJ_SUFFIXES = ("ble", "ous", "ful", "ive", "eux", "euse", "ique", "lich", "ig", "isch", "oso", "osa")

STOP_WORDS = tuple(dict.fromkeys(
    DET_WORDS + PRON_WORDS + ADP_WORDS + CCONJ_WORDS + SCONJ_WORDS + AUX_WORDS + ADV_WORDS))

# Clause-opening dependency labels counted as subordinate clauses.
SUBCLAUSE_DEPS = ("advcl", "csubj", "ccomp", "relcl")
OBJECT_DEPS = ("obj", "iobj")
SUBJECT_DEPS = ("nsubj", "csubj")
# POS tags exported as rates, in the order of the indicator row.
RATE_TAGS = ("ADJ", "ADP", "ADV", "CONJ", "DET", "NOUN", "PRON", "VERB", "PROPN")


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _suffix_sql(col: str, suffixes) -> str:
    return " OR ".join(f"{col} LIKE '%{s}'" for s in suffixes)


def pos_sql(text: str = "text", lw: str = "lw", tok_id: str = "tok_id",
            is_punct: str = "is_punct", is_num: str = "is_num") -> str:
    """Part-of-speech rule over the raw token, its lower case, its position in the sentence
    and the two character-class flags computed by each engine's own regex."""
    return f"""CASE
      WHEN {is_punct} THEN 'PUNCT'
      WHEN {is_num} THEN 'NUM'
      WHEN {lw} IN {sql_list(DET_WORDS)} THEN 'DET'
      WHEN {lw} IN {sql_list(AUX_WORDS)} THEN 'AUX'
      WHEN {lw} IN {sql_list(PRON_WORDS)} THEN 'PRON'
      WHEN {lw} IN {sql_list(ADP_WORDS)} THEN 'ADP'
      WHEN {lw} IN {sql_list(CCONJ_WORDS)} THEN 'CCONJ'
      WHEN {lw} IN {sql_list(SCONJ_WORDS)} THEN 'SCONJ'
      WHEN {lw} IN {sql_list(ADV_WORDS)} THEN 'ADV'
      WHEN {tok_id} > 0 AND substr({text}, 1, 1) <> lower(substr({text}, 1, 1)) THEN 'PROPN'
      WHEN {_suffix_sql(lw, ADV_SUFFIXES)} THEN 'ADV'
      WHEN {_suffix_sql(lw, NOUN_SUFFIXES)} THEN 'NOUN'
      WHEN {_suffix_sql(lw, VERB_INF_SUFFIXES + VERB_FIN_SUFFIXES)} THEN 'VERB'
      WHEN {_suffix_sql(lw, ADJ_SUFFIXES)} THEN 'ADJ'
      ELSE 'NOUN' END""".replace("\n", " ")


# Character classes (each engine applies the pattern with its own regex library).
PUNCT_TEST_RE = r"^[\p{L}\p{N}]"
NUM_TEST_RE = r"^\p{N}+$"


def verb_form_sql(pos: str = "pos", lw: str = "lw") -> str:
    return (f"CASE WHEN {pos} = 'VERB' THEN CASE WHEN {_suffix_sql(lw, VERB_INF_SUFFIXES)} "
            f"THEN 'Inf' ELSE 'Fin' END END")


def is_stop_sql(lw: str = "lw") -> str:
    return f"({lw} IN {sql_list(STOP_WORDS)})"


def dep_sql(pos: str = "pos", head_id: str = "head_id", tok_id: str = "tok_id",
            prev_pos: str = "prev_pos", prev_lw: str = "prev_lw", first_verb: str = "first_verb") -> str:
    """Dependency label from the position of a token relative to its head verb."""
    return f"""CASE
      WHEN {pos} = 'PUNCT' THEN 'punct'
      WHEN {pos} = 'VERB' AND {tok_id} = {first_verb} THEN 'root'
      WHEN {pos} = 'VERB' AND {prev_pos} = 'SCONJ' THEN 'advcl'
      WHEN {pos} = 'VERB' AND {prev_lw} IN {sql_list(REL_WORDS)} THEN 'relcl'
      WHEN {pos} = 'VERB' AND {prev_pos} = 'PRON' THEN 'ccomp'
      WHEN {pos} = 'VERB' THEN 'conj'
      WHEN {head_id} IS NULL THEN 'dep'
      WHEN {pos} IN ('NOUN', 'PRON', 'PROPN') AND {tok_id} < {head_id} THEN 'nsubj'
      WHEN {pos} IN ('NOUN', 'PRON', 'PROPN') AND {prev_pos} = 'ADP' THEN 'iobj'
      WHEN {pos} IN ('NOUN', 'PRON', 'PROPN') THEN 'obj'
      WHEN {pos} = 'AUX' THEN 'aux'
      WHEN {pos} = 'DET' THEN 'det'
      WHEN {pos} = 'ADJ' THEN 'amod'
      WHEN {pos} = 'ADV' THEN 'advmod'
      WHEN {pos} = 'ADP' THEN 'case'
      WHEN {pos} = 'CCONJ' THEN 'cc'
      WHEN {pos} = 'SCONJ' THEN 'mark'
      ELSE 'dep' END""".replace("\n", " ")


# --- hashing --------------------------------------------------------------------------

def md5_int(col: Column | str, chars: int = 8) -> Column:
    """First ``chars`` hex digits of md5 as a non-negative BIGINT (portable to DuckDB)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, chars), 16, 10).cast("bigint")


def md5_int_sql(expr: str, chars: int = 8) -> str:
    """DuckDB twin of :func:`md5_int`."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, {chars}))::BIGINT"


# --- segmentation ---------------------------------------------------------------------

def sentences(text: Column) -> Column:
    """array of sentences (terminators kept, blank-only pieces kept as they are)."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_RE), 0)


def tokens(text: Column) -> Column:
    """array of tokens, punctuation included (one character each)."""
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), 0)


def words(text: Column) -> Column:
    """array of words, punctuation excluded."""
    return F.regexp_extract_all(text, F.lit(WORD_RE), 0)


def blank_split(text: Column) -> Column:
    """Whitespace split without empty pieces (Python ``str.split()``)."""
    return F.filter(F.split(text, BLANK_RE), lambda w: w != "")
