"""Indicators of a text as array expressions on its own row: no explode, no shuffle.

The tokens of a text are one array of structs. Everything that the token table would be grouped
for is computed on that array in linear steps (and one sort for the word counts):

* the nearest verb on either side of each token comes from the list of verb places: between
  two verbs it is the same for all tokens, so it is repeated over the stretch;
* counters are differences of array sizes;
* frequencies are run lengths of the sorted words.

An intermediate array that is read more than once is bound to a lambda variable
(:func:`let`), so that it is evaluated once whatever the optimizer does with projections.
Element access by position is constant, hence every step is linear in the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T

_unique = iter(range(1 << 30))


def literal(pattern: str) -> str:
    """Pattern as a Spark SQL string literal body (backslashes doubled, quotes escaped)."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` with a name for ``value``, which is evaluated once."""
    name = f"v{next(_unique)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


# --- tokens of a text ------------------------------------------------------------------------

def verb_places(tokens: str) -> str:
    """Places of the verbs in an array of tokens with ``pos``, ascending."""
    return f"filter(transform({tokens}, (a, i) -> IF(a.pos = 'VERB', i, NULL)), v -> v IS NOT NULL)"


def _repeated(verbs: str, tokens: str, ahead: bool) -> str:
    """For each token the place of the nearest verb before (or after) it, itself excluded: each
    verb repeated over the stretch to its neighbour."""
    if ahead:
        value, end, begin = f"get({verbs}, k)", f"coalesce(get({verbs}, k), size({tokens}))", f"coalesce(get({verbs}, k - 1), 0)"
    else:
        value, end, begin = f"get({verbs}, k - 1)", f"coalesce(get({verbs}, k), size({tokens}) - 1)", f"coalesce(get({verbs}, k - 1), -1)"
    return f"flatten(transform(sequence(0, size({verbs})), k -> array_repeat({value}, {end} - {begin})))"


def verb_before(verbs: str, tokens: str) -> str:
    return _repeated(verbs, tokens, ahead=False)


def verb_after(verbs: str, tokens: str) -> str:
    return _repeated(verbs, tokens, ahead=True)


def tagged_tokens(sentences: str) -> str:
    """Tokens of all sentences end to end: ``(sent, text, lw, pos)``.

    Same rule as :func:`colloquy.functions.text.pos_sql`; closed classes are asked first, as no closed word is
    punctuation or a number.
    """
    closed = {"DET": T.DET_WORDS, "AUX": T.AUX_WORDS, "PRON": T.PRON_WORDS, "ADP": T.ADP_WORDS, "CCONJ": T.CCONJ_WORDS,
              "SCONJ": T.SCONJ_WORDS, "ADV": T.ADV_WORDS}
    classes = " ".join(f"WHEN x.lw IN {T.sql_list(w)} THEN '{c}'" for c, w in closed.items())
    ends = lambda suffixes: "(" + " OR ".join(f"endswith(x.lw, '{end}')" for end in suffixes) + ")"
    pos = (f"CASE WHEN x.lw IN {T.sql_list(dict.fromkeys(w for ws in closed.values() for w in ws))} THEN CASE {classes} END "
           f"WHEN NOT (x.text rlike '{literal(T.PUNCT_TEST_RE)}') THEN 'PUNCT' WHEN x.text rlike '{literal(T.NUM_TEST_RE)}' THEN 'NUM' "
           f"WHEN i > 0 AND left(x.text, 1) <> lower(left(x.text, 1)) THEN 'PROPN' WHEN {ends(T.ADV_SUFFIXES)} THEN 'ADV' "
           f"WHEN {ends(T.NOUN_SUFFIXES)} THEN 'NOUN' WHEN {ends(T.VERB_INF_SUFFIXES + T.VERB_FIN_SUFFIXES)} THEN 'VERB' "
           f"WHEN {ends(T.ADJ_SUFFIXES)} THEN 'ADJ' ELSE 'NOUN' END")
    return (f"flatten(transform({sentences}, (s, k) -> transform(transform(regexp_extract_all(s, '{literal(T.TOKEN_RE)}', 0), "
            f"t -> named_struct('text', t, 'lw', lower(t))), (x, i) -> named_struct('sent', k, 'text', x.text, 'lw', x.lw, 'pos', {pos}))))")


#: What the sentence measures ask of a token: numbers of :func:`token_roles`.
OBJECT, SUBJECT, AUXILIARY, SUBCLAUSE = 1, 2, 3, 4


def token_roles(tokens: str) -> str:
    """For each token the role that its dependency label gives it, 0 for none.

    A head is the nearest verb before the token in its sentence, else the nearest after it; a verb without a verb
    before it in its sentence is the sentence's first.
    """

    def role(x: str) -> str:
        same = lambda place: f"IF(get({tokens}, {place}).sent = a.sent, {place}, NULL)"
        before, after, prev = same(f"get({x}.before, i)"), same(f"get({x}.after, i)"), f"get({tokens}, i - 1)"
        in_sentence = f"{prev}.sent = a.sent AND"
        nominal = (f"CASE WHEN {before} IS NULL THEN IF({after} IS NULL, 0, {SUBJECT}) ELSE {OBJECT} END")
        verb = (f"IF({before} IS NOT NULL AND {in_sentence} ({prev}.pos IN ('SCONJ', 'PRON') OR {prev}.lw IN {T.sql_list(T.REL_WORDS)}), {SUBCLAUSE}, 0)")
        return (f"transform({tokens}, (a, i) -> CASE WHEN a.pos IN ('NOUN', 'PRON', 'PROPN') THEN {nominal} WHEN a.pos = 'VERB' THEN {verb} "
                f"WHEN a.pos = 'AUX' AND coalesce({before}, {after}) IS NOT NULL THEN {AUXILIARY} ELSE 0 END)")

    return let(verb_places(tokens), lambda v: let(
        f"named_struct('before', {verb_before(v, tokens)}, 'after', {verb_after(v, tokens)})", role))


# --- counters --------------------------------------------------------------------------------

def run_lengths(words: str) -> str:
    """``(word, n)`` for each distinct word of an array, in word order."""
    return let(f"sort_array({words})", lambda s: let(
        f"IF(size({s}) = 0, CAST(array() AS ARRAY<INT>), filter(sequence(0, size({s}) - 1), i -> i = 0 OR get({s}, i) <> get({s}, i - 1)))",
        lambda at: f"transform({at}, (p, k) -> named_struct('word', get({s}, p), 'n', CAST(coalesce(get({at}, k + 1), size({s})) - p AS BIGINT)))"))


def tag_counts(tokens: str, tags: dict[str, tuple[str, ...]]) -> str:
    """Struct with the number of tokens that have one of the tags of each name: what is gone when a tag is removed from the array
    of all tags, in compiled passes. (A fold would interpret every condition and build a struct for each token.)"""
    def counts(pos: str) -> str:
        n = lambda tag: f"size({pos}) - size(array_remove({pos}, '{tag}'))"
        return "named_struct(" + ", ".join(f"'{name}', CAST({' + '.join(n(t) for t in dict.fromkeys(of))} AS BIGINT)" for name, of in tags.items()) + ")"

    return let(f"transform({tokens}, a -> a.pos)", counts)


def text_statistics(sentences: str, conj_tags: tuple[str, ...] = ("CONJ",)) -> str:
    """Everything that the indicators need from a text, as one struct: counters, the run lengths ``words`` (case kept,
    no punctuation or stop words, hence no determiners) and ``lemmas`` (of all tokens) for the frequency measures and look-ups."""
    tags = {"n_punct": ("PUNCT",), **{f"n_{t}": conj_tags if t == "CONJ" else (t,) for t in T.RATE_TAGS}}
    infinitive = " OR ".join(f"endswith(a.lw, '{x}')" for x in T.VERB_INF_SUFFIXES)

    def sentences_with(t: str, roles: str, role: int) -> str:
        return f"CAST(size(array_remove(array_distinct(transform({roles}, (r, i) -> IF(r = {role}, get({t}, i).sent, -1))), -1)) AS BIGINT)"

    def of(t: str, content: str, roles: str) -> str:
        return (
            f"named_struct('n_doc', CAST(size({t}) AS BIGINT), 'counts', {tag_counts(t, tags)}, "
            f"'n_vinf', CAST(size(filter({t}, a -> a.pos = 'VERB' AND ({infinitive}))) AS BIGINT), "
            f"'n_sentences', CAST(size(array_distinct(transform({t}, a -> a.sent))) AS BIGINT), "
            f"'n_sub', CAST(size(filter({roles}, r -> r = {SUBCLAUSE})) AS BIGINT), "
            f"'n_obj', {sentences_with(t, roles, OBJECT)}, 'n_subj', {sentences_with(t, roles, SUBJECT)}, 'n_aux', {sentences_with(t, roles, AUXILIARY)}, "
            f"'repetition', CAST(size({content}) - size(array_distinct(transform({content}, a -> concat(a.sent, ' ', a.lw)))) AS BIGINT), "
            f"'words', {run_lengths(f'transform({content}, a -> a.text)')}, 'lemmas', {run_lengths(f'transform({t}, a -> a.lw)')})")

    return let(tagged_tokens(sentences), lambda t: let(
        f"filter({t}, a -> a.pos <> 'PUNCT' AND NOT {T.is_stop_sql('a.lw')})", lambda content: let(
            token_roles(t), lambda roles: of(t, content, roles))))


def blank_words(sentences: str) -> str:
    """Run lengths of the whitespace words of the lower-cased sentences (valence look-up)."""
    return run_lengths(f"flatten(transform({sentences}, s -> filter(split(lower(s), '{literal(T.BLANK_RE)}'), w -> w <> '')))")


def with_statistics(docs: DataFrame, text: str = "text", out: str = "st", conj_tags: tuple[str, ...] = ("CONJ",)) -> DataFrame:
    """Adds the struct of :func:`text_statistics` and the run lengths ``blank_words`` of a text column."""
    sentences = f"regexp_extract_all({text}, '{literal(T.SENTENCE_RE)}', 0)"
    both = let(sentences, lambda s: f"named_struct('st', {text_statistics(s, conj_tags)}, 'blank_words', {blank_words(s)})")
    return docs.withColumn(out, F.expr(both))


def repeated_words(column: str, kind: str) -> Column:
    """Array of look-up rows ``(kind, word, n)`` from run lengths."""
    return F.transform(F.col(column), lambda x: F.struct(F.lit(kind).alias("kind"), x["word"].alias("word"), x["n"].alias("n")))
