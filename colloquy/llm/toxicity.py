"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes and clauses (between punctuation marks and line ends) as strings of
classes. Five small weighted transducers, each a table from (state, class) to (next state, weight), are
composed by product construction into one table that reads a clause once, left to right:

* insult - arcs are word stems; their weights are learned from labelled rows;
* threat - a verb of harm after a first-person or future marker (fixed words);
* target - a person addressed, anywhere in the clause, raises what its insults and threats weigh;
* negation - a negator before a match lowers it;
* reported speech - a verb of saying or a quotation mark, before or after, lowers the clause's matches.

A composed state is a tuple of the parts' states; an arc's weight is the product of theirs, and a final state has the product
of the parts' final weights, by which the clause's sum is multiplied. A document's score is
a logistic function of its matched clauses: total weight, matches, matches that stand reported or
negated. The logistic weights are learned from the same labelled rows.

Learning uses only rows of ``labels`` outside fold 0 (see :func:`common.fold_of`), at most
``SAMPLE_DOCS`` of each label (lowest hashed ids first). ``labels``, ``lang``, ``source`` and ``doc_id``
are never inputs of a score.

Defined cases: null and empty texts get the score of a text without matches; very long texts and clauses are read whole, once; equal rows get
equal results, a row each; of arcs of equal evidence whole words and longer units come first; with no usable labels no insult is known and only threats count; an
empty table gives an empty result; other columns are ignored by :func:`score` and passed
through by :func:`clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import common as C

SAMPLE_DOCS = 8_000         #: bound on labelled rows of each label that the grammar is fitted on
STEM = (3, 8)               #: lengths of stems that may become insult arcs, beside whole words
MIN_DOCS = 5                #: toxic sample documents that an arc must occur in
MIN_LOG_ODDS = 3.0          #: of the two classes' document rates
MIN_EVIDENCE = 35.0         #: likelihood-ratio statistic; chance arcs among millions of units stay below
EXPLAINED = 0.45

# --- fixed values: closed-class words of the grammar (four languages) --------------------
TARGET = frozenset("you your youre yours he she they him her them u "
                   "tu toi vous ton ta tes votre vos il elle ils elles "
                   "du dich dir dein deine ihr euch euer sie er "
                   "tú tu ti vosotros usted ustedes él ella ellos ellas vuestro".split())
NEGATION = frozenset("not no never isn't aren't wasn't don't doesn't didn't cannot without "
                     "ne pas jamais non sans nicht kein keine nie niemals ohne nunca jamás ni sin".split())
REPORTED = frozenset("said says saying quoted reported reportedly alleged wrote called accused claimed "
                     "dit disait écrit déclaré accusé sagte sagt schrieb behauptete nannte dijo dice escribió llamó acusó".split())
THREAT = frozenset("kill hurt destroy murder stab shoot strangle tuer frapper détruire étrangler "
                   "töten umbringen schlagen vernichten matar destruir golpear estrangular".split())
INTENT = frozenset("will gonna shall i'll we'll vais allons vas werde werden voy vamos".split())
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.,;:!?\n\r]+")
QUOTES = "\"“”«»„‘"

NEGATED_FACTOR, REPORTED_FACTOR, TARGET_FACTOR, THREAT_WEIGHT = 0.25, 0.25, 1.5, 4.0


# --- transducers -------------------------------------------------------------------------
#: Word classes that the transducers read: INSULT is any word with a learned arc, OTHER any word without a class.
OTHER, NEGATOR, SAYING, QUOTE, ADDRESS, MARKER, HARM, INSULT = range(8)
CLASSES = range(8)


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][class]`` is (next state, weight of a match read there); ``final[state]`` multiplies the clause's sum."""

    arcs: tuple[tuple[tuple[int, float], ...], ...]
    final: tuple[float, ...]

    def run(self, classes: list[int]) -> tuple[list[float], float]:
        """Weight of every word read, and the final weight."""
        state, weights = 0, []
        for c in classes:
            state, w = self.arcs[state][c]
            weights.append(w)
        return weights, self.final[state]


def _two_states(opens: tuple[int, ...], weight: Callable[[int, int], float], final: tuple[float, float] = (1.0, 1.0)) -> Transducer:
    """State 1 once a class of ``opens`` was read; ``weight(state, class)`` of the arcs."""
    return Transducer(tuple(tuple((1 if s or c in opens else 0, weight(s, c)) for c in CLASSES) for s in (0, 1)), final)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Product construction: both read the same word, weights multiply; state (i, j) is number i * |b| + j."""
    n = len(b.final)
    arcs = tuple(tuple((a.arcs[i][c][0] * n + b.arcs[j][c][0], a.arcs[i][c][1] * b.arcs[j][c][1]) for c in CLASSES)
                 for i in range(len(a.final)) for j in range(n))
    return Transducer(arcs, tuple(x * y for x in a.final for y in b.final))


#: 1 for a match of its kind: an insult anywhere, a verb of harm after a marker of intent.
MATCHES = _two_states((MARKER,), lambda s, c: float(c == INSULT) or (THREAT_WEIGHT if s and c == HARM else 0.0))
NEGATION_PART = _two_states((NEGATOR,), lambda s, c: NEGATED_FACTOR if s else 1.0)
TARGET_PART = _two_states((ADDRESS,), lambda s, c: 1.0, (1.0, TARGET_FACTOR))
REPORTED_PART = _two_states((SAYING, QUOTE), lambda s, c: 1.0, (1.0, REPORTED_FACTOR))
CLAUSE = compose(compose(compose(MATCHES, NEGATION_PART), TARGET_PART), REPORTED_PART)
_OF_WORD = {**dict.fromkeys(THREAT, HARM), **dict.fromkeys(INTENT, MARKER), **dict.fromkeys(TARGET, ADDRESS),
            **dict.fromkeys(REPORTED, SAYING), **dict.fromkeys(NEGATION, NEGATOR)}


@dataclass
class Grammar:
    """Learned arcs (stem or whole word to weight) and the weights of the document score."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    theta: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 0.0, 0.0, 1.0]))

    def finder(self) -> re.Pattern:
        """One pattern that finds the words that may start a match; the automaton runs on those clauses only."""
        any_of = lambda xs: "|".join(map(re.escape, sorted(xs, key=lambda x: (-len(x), x))))
        parts = [rf"(?:{any_of([*self.words, *THREAT])})(?![^\W\d_])"]
        if self.stems:
            parts.append(rf"(?:{any_of(self.stems)})")
        return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})")

    def weight(self, word: str) -> float:
        """Weight of the insult arc that reads ``word``: the whole word or its longest stem."""
        if (w := self.words.get(word)) is not None:
            return w
        for n in range(min(len(word), STEM[1]), STEM[0] - 1, -1):
            if (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0

    def clause(self, text: str) -> tuple[float, int, int, int]:
        """Path of one clause: weight, plain matches, lowered matches, threats."""
        classes, weights, at = [], [], 0
        for m in WORD.finditer(text):
            if any(q in text[at:m.start()] for q in QUOTES):
                classes.append(QUOTE)
                weights.append(0.0)
            at, word = m.end(), m[0]
            w = self.weight(word)
            classes.append(INSULT if w else _OF_WORD.get(word, OTHER))
            weights.append(w or 1.0)
        if any(q in text[at:] for q in QUOTES):
            classes.append(QUOTE)
            weights.append(0.0)
        read, final = CLAUSE.run(classes)
        negated = NEGATION_PART.run(classes)[0]
        reported = any(c in (SAYING, QUOTE) for c in classes)
        matched = [i for i, w in enumerate(read) if w]
        lowered = sum(reported or negated[i] < 1 for i in matched)
        return (final * sum(read[i] * weights[i] for i in matched), len(matched) - lowered, lowered, sum(classes[i] == HARM for i in matched))

    def features(self, text: str | None, finder: re.Pattern) -> np.ndarray:
        """Intercept, log of the matched clauses' weight, lowered matches, matched clauses, two or more matches."""
        out = np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        if not text:
            return out
        text = text.lower()
        done, weight, plain, lowered, clauses = -1, 0.0, 0, 0, 0
        ends, start = CLAUSE_END.finditer(text), 0
        end = next(ends, None)
        for m in finder.finditer(text):
            if m.start() < done:
                continue
            while end is not None and end.start() < m.start():  # the clause's start moves along with the text
                start, end = end.end(), next(ends, None)
            done = end.start() if end is not None else len(text)
            w, p, low, threats = self.clause(text[start:done])
            weight, plain, lowered, clauses = weight + w, plain + p + threats, lowered + low, clauses + bool(w)
        out[1:] = np.log1p(weight), np.log1p(lowered), np.log1p(clauses), plain + lowered >= 2
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.theta, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``limit`` labelled rows of each label outside fold 0.

    The chosen ids are bounded, so they are sent to the scan instead of shuffling the texts.
    """
    usable = (labels.where("toxic in (0, 1) and doc_id is not null").where(C.fold_of(F.col("doc_id")) != 0)
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _document_counts(sampled: DataFrame) -> DataFrame:
    """(unit, whole, label, documents) over the sample: whole words and word beginnings, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        for b in batches:
            for text, y in zip(b.column("text"), b.column("toxic"), strict=True):
                words = set(WORD.findall((text.as_py() or "").lower()))
                units = {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
                seen[y.as_py()].update(units)
                seen[y.as_py()].update("=" + w for w in words if len(w) >= STEM[0])
        for y, found in enumerate(seen):
            keys = list(found)
            for at in range(0, len(keys), 50_000):
                part = keys[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([y] * len(part), pa.int32()),
                                                  pa.array([found[k] for k in part], pa.int64())], names=["unit", "toxic", "n"])

    counts = sampled.select("text", "toxic").mapInArrow(run, "unit string, toxic int, n long")
    pick = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    return counts.groupBy("unit").agg(pick(0).alias("clean"), pick(1).alias("toxic"))


def _evidence_column(base: float):
    """Likelihood-ratio statistic of a unit's labels against the sample's share of toxic rows."""
    both = F.col("toxic") + F.col("clean")
    part = lambda k, rate: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / both / rate)).otherwise(0.0)
    return 2 * (part("toxic", base) + part("clean", 1 - base))


def _holding(toxic: DataFrame, units: list[str]) -> DataFrame:
    """For each toxic sample document the numbers of the candidate units that it holds."""
    number = {u: i for i, u in enumerate(units)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for t in b.column("text"):
                words = set(WORD.findall((t.as_py() or "").lower()))
                found = {number["=" + w] for w in words if "=" + w in number}
                found.update(number[w[:n]] for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1) if w[:n] in number)
                held.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], names=["held"])

    return toxic.select("text").mapInArrow(run, "held array<int>").where(F.size("held") > 0)


def _choose(grammar: Grammar, counts: list, held: list[np.ndarray], base: float) -> None:
    """Takes arcs by the evidence that is left, strongest first.

    A document that a taken arc explains counts ``EXPLAINED`` times as much for the next ones, so words that
    merely stand in copies of a toxic text gather no evidence of their own. A unit is passed over
    where a taken one reads its words or is read by it.
    """
    if not held:
        return
    docs = np.repeat(np.arange(len(held)), [len(x) for x in held])
    units = np.concatenate(held)
    order = np.argsort(units, kind="stable")
    at = np.searchsorted(units[order], np.arange(len(counts) + 1))
    of_unit = [docs[order[at[u]:at[u + 1]]] for u in range(len(counts))]
    clean = np.array([r["clean"] for r in counts], float)
    open_, weight = np.ones(len(counts), bool), np.ones(len(held))
    with np.errstate(divide="ignore", invalid="ignore"):
        while open_.any():
            t = np.bincount(units, weights=weight[docs], minlength=len(counts))
            share = t / (t + clean)
            g = 2 * (t * np.log(share / base) + np.where(clean > 0, clean * np.log((1 - share) / (1 - base)), 0.0))
            g = np.where(open_ & (share > base), np.round(g, 6), -1.0)
            best = int(np.argmax(g))  # of equals the first: whole words and long stems stand first
            if g[best] < MIN_EVIDENCE:
                break
            open_[best] = False
            unit, whole = counts[best]["unit"].lstrip("="), counts[best]["unit"][0] == "="
            if any(unit[:k] in grammar.stems for k in range(STEM[0], len(unit) + 1)):
                continue
            if not whole and any(x.startswith(unit) for x in (*grammar.words, *grammar.stems)):
                continue
            (grammar.words if whole else grammar.stems)[unit] = counts[best]["w"]
            weight[of_unit[best]] *= EXPLAINED


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learns the insult arcs, then the weights of the document score."""
    sampled = C.stored(sample(docs, labels), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    grammar = Grammar()
    if not n.get(0) or not n.get(1):
        return grammar
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1 - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n[0] - F.col("clean") + 0.5))
    counts = (_document_counts(sampled).where(F.col("toxic") >= MIN_DOCS).withColumn("w", odds)
              .withColumn("evidence", F.round(_evidence_column(n[1] / (n[0] + n[1])), 6))
              .where((F.col("w") >= MIN_LOG_ODDS) & (F.col("evidence") >= MIN_EVIDENCE))
              .orderBy(F.desc("evidence"), F.desc(F.length("unit")), "unit").collect())  # bounded by the sample
    held = [np.array(r["held"]) for r in _holding(sampled.where("toxic = 1"), [r["unit"] for r in counts]).collect()]
    _choose(grammar, counts, held, n[1] / (n[0] + n[1]))
    rows = _featured(sampled.select(F.col("toxic").cast("long").alias("doc_id"), "text"), grammar).toArrow()
    x = np.column_stack([rows.column(f"x{i}").to_numpy() for i in range(5)])
    y = rows.column("doc_id").to_numpy().astype(float)
    weight = rows.column("n").to_numpy().astype(float)
    weight = weight * np.where(y == 1, (weight[y == 0].sum() / weight[y == 1].sum()), 1.0)
    grammar.theta = _logistic(x, y, weight)
    return grammar


def _featured(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """Distinct feature vectors by label with their number of rows: at most a few thousand, whatever the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for b in batches:
            x = np.array([grammar.features(t.as_py(), finder) for t in b.column("text")]).reshape(-1, 5).round(3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x[:, i]) for i in range(5))], names=["doc_id", *(f"x{i}" for i in range(5))])

    schema = "doc_id long, " + ", ".join(f"x{i} double" for i in range(5))
    return rows.mapInArrow(run, schema).groupBy("doc_id", *(f"x{i}" for i in range(5))).agg(F.count("*").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression with row weights (five weights)."""
    theta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return theta


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Score of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for b in batches:
            s = grammar.score(np.array([grammar.features(t.as_py(), finder) for t in b.column("text")]).reshape(-1, 5))
            held = [None if i is None else C.fold_number(i) == 0 for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The documents scored below 0.5, with all their columns."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for b in batches:
            s = grammar.score(np.array([grammar.features(t.as_py(), finder) for t in b.column(at)]).reshape(-1, 5))
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
