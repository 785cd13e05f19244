"""Language identification with interpolated Kneser-Ney character models.

One model a language, of order ``ORDER`` over lower-cased letters, where a run of other
characters is one blank. Counts come from the whole texts of all training rows and of every language named
there: tasks count exact n-grams (two code points packed in a number, so nothing shares a count), a Spark shuffle
adds up, and continuation counts (distinct left neighbours), context masses, back-off weights and
probabilities are Spark aggregations and joins, order by order. The log probabilities are kept in
arrays sorted by n-gram hash, those of each language for itself.

A text's cross-entropy under a language is the mean cost of its characters; the lowest wins. The
score is the winner's posterior share, where the mean costs count as from ``EFFECTIVE_CHARS``
characters at most (longer texts aren't independent evidence).

Rejection is calibrated: the excess of a text's cross-entropy over the language's training mean, times the
root of its characters (``EFFECTIVE_CHARS`` at most), is compared with the ``CALIBRATED`` quantile of that
measure among all training rows that are predicted as the language. Beyond it the text is
marked ``rejected``; ``lang_pred`` stays a learned value wherever there is a letter.

Every counted n-gram is part of its language's model, and what the driver and a worker hold is bounded nevertheless: a language of more
than ``BLOCK_GRAMS`` distinct n-grams of the highest order is cut into stretches of contexts, each with the lower orders that
its contexts fall back on. Languages and stretches are dealt into blocks of at most ``BLOCK_GRAMS`` n-grams (one
stretch at least); more than one block stay in their stored tables until it is their turn, and the texts
are written with the costs so far between two blocks. A character is charged in the stretch of its context alone, so this changes no result.

Learning uses rows with a known ``lang`` outside fold 0; ``lang``, ``source`` and ``doc_id`` are never inputs
of a prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any training row every
text is ``und``; of equal costs the first language by name wins; very long texts are read whole; equal rows get equal
results, a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import common as C
from colloquy.operators.features import exact_quantiles

ORDER = 4
DISCOUNT = 0.75
EFFECTIVE_CHARS = 40
CALIBRATED = 0.999
BLOCK_GRAMS = 1 << 22       #: n-grams of the highest order that a worker holds at once
HELD_GRAMS = 1 << 19        #: distinct n-grams that a counting task holds before it hands them on
_BLANK = 32
_BITS = 21                  #: of a code point
_LOW = (1 << _BITS) - 1
_ALL = (0, (1 << 63) - 1)   #: the stretch of all contexts


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in lower case, a blank after each run of them, and the texts' offsets."""
    texts = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    borders = np.cumsum([1, *(len(t) + 1 for t in texts)])
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    before = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, code, _BLANK)[keep], before[borders]


def grams(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ``ORDER`` characters that ends at each one, two code points in a number: its first two
    characters and its last two. Before a text's first character stand blanks."""
    at = np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
    x = []
    for k in range(ORDER):
        c = np.full(len(code), _BLANK, np.int64)
        c[k:] = code[:len(code) - k]
        c[at < k] = _BLANK
        x.append(c)
    return (x[3] << _BITS) | x[2], (x[1] << _BITS) | x[0]


def hashed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram's leading characters and its last two."""
    return C.mix(C.mix(high.astype(np.uint64)) + low.astype(np.uint64))


def suffix(k: int, high, low):
    """An n-gram of order k without its first character, for arrays as for columns."""
    if k == 2:
        return high, _and(low, _LOW)
    return (_and(high, _LOW) if k == 4 else _and(high, 0)), low


def context(high, low):
    """An n-gram without its last character, for arrays as for columns."""
    if isinstance(high, np.ndarray):
        return high >> _BITS, (high & _LOW) << _BITS | low >> _BITS
    return F.shiftright(high, _BITS), F.shiftleft(high.bitwiseAND(_LOW), _BITS).bitwiseOR(F.shiftright(low, _BITS))


def context_number(high, low):
    """A number of an n-gram's context, its last character first, for arrays as for columns: contexts that fall
    back on the same shorter ones stand together."""
    if isinstance(high, np.ndarray):
        return (low >> _BITS) << 2 * _BITS | (high & _LOW) << _BITS | high >> _BITS
    last, before, first = F.shiftright(low, _BITS), _and(high, _LOW), F.shiftright(high, _BITS)
    return F.shiftleft(last, 2 * _BITS).bitwiseOR(F.shiftleft(before, _BITS)).bitwiseOR(first)


def _within(at, stretch: tuple[int, int], k: int):
    """Whether a context's number at order k is one that the contexts of a stretch are or fall back on."""
    missing = _BITS * (ORDER - k)
    return (at >= F.lit(stretch[0] >> missing << missing)) & (at < F.lit(stretch[1]))


def _and(x, mask: int):
    return x & mask if isinstance(x, np.ndarray) else x.bitwiseAND(F.lit(mask).cast("long"))


# --- learning ----------------------------------------------------------------------------
def count(rows: DataFrame, langs: list[str]) -> DataFrame:
    """Counts of the n-grams of the highest order over whole texts (``lang``, ``text``)."""
    number = {x: i for i, x in enumerate(langs)}
    keys = ["lang", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for s in C.slices(b):
                names = s.column("lang").to_pylist()
                texts = s.column("text").to_pylist()
                for name in sorted(set(names)):
                    high, low = grams(*characters([t for t, x in zip(texts, names, strict=True) if x == name]))
                    at, n = distinct(hashed(high, low))
                    held.append(pd.DataFrame({"lang": np.full(len(at), number[name], np.int32), "high": high[at], "low": low[at], "n": np.bincount(n, minlength=len(at))}))
                    size += len(at)
                    if size > 2 * HELD_GRAMS:
                        held = [pd.concat(held).groupby(keys, as_index=False, sort=False)["n"].sum()]
                        size = len(held[0])
                        if size > HELD_GRAMS:
                            yield pa.RecordBatch.from_pandas(held.pop(), preserve_index=False)
                            size = 0
        if held:
            yield pa.RecordBatch.from_pandas(pd.concat(held).groupby(keys, as_index=False, sort=False)["n"].sum(), preserve_index=False)

    return rows.mapInArrow(run, "lang int, high long, low long, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first occurrence of each distinct hash, and the number of the hash at each place."""
    numbers, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[numbers[::-1]] = np.arange(len(hashes))[::-1]
    return first, numbers


@dataclass
class Tables:
    """Stored n-grams and contexts of all languages, for each order."""

    grams: list[DataFrame]
    contexts: list[DataFrame]

    def load(self, models: list[Model]) -> list[Model]:
        """The models with their arrays; no others reach the driver."""
        if not models or models[0].keys:
            return models
        found = []
        for tables, column in ((self.grams, "p"), (self.contexts, "weight")):
            arrays = []
            for k, t in enumerate(tables, 1 + ORDER - len(tables)):
                at = context_number(F.col("high"), F.col("low")) if column == "p" else context_number(*_shifted(F.col("high"), F.col("low")))
                mine = [(F.col("lang") == m.number) & _within(at, m.stretch, k) for m in models]
                arrays.append(_by_part(t.withColumn("parts", F.array_compact(F.array(*[F.when(x, i) for i, x in enumerate(mine)]))).where(F.size("parts") > 0)
                                       .select(F.explode("parts").alias("part"), "high", "low", column), column, len(models)))
            found.append(arrays)
        grams_, backoffs = found
        backoffs = [[(np.zeros(0, np.uint64), np.zeros(0, np.float32))] * len(models), *backoffs]
        return [replace(m, keys=[a[i][0] for a in grams_], costs=[a[i][1] for a in grams_], contexts=[b[i][0] for b in backoffs], backoff=[b[i][1] for b in backoffs], tables=None)
                for i, m in enumerate(models)]

    def discard(self) -> None:
        C.discard(*self.grams, *self.contexts)


def _shifted(high, low):
    """A context as an n-gram with any last character."""
    return F.shiftleft(high, _BITS).bitwiseOR(F.shiftright(low, _BITS)), F.shiftleft(_and(low, _LOW), _BITS)


@dataclass
class Model:
    """A language, or a stretch of its contexts: for each order the sorted n-gram hashes with their log probabilities, and the sorted
    context hashes with their log back-off weights. One that isn't loaded has its ``tables`` instead."""

    lang: str
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float               #: log probability of a letter that the language doesn't have
    mean: float                 #: cross-entropy of the training rows
    limit: float = np.inf       #: calibrated bound of the excess
    stretch: tuple[int, int] = _ALL
    size: int = 0               #: n-grams of the highest order
    number: int = 0             #: of the language in ``tables``
    tables: Tables | None = None

    def log_probabilities(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character after the others: the longest learned n-gram's, or
        the context's back-off weight and the next order's."""
        out = np.zeros(len(high))
        left = np.arange(len(high))
        for k in range(ORDER, 0, -1):
            at, hit = _find(self.keys[k - 1], hashed(high, low))
            out[left[hit]] += self.costs[k - 1][at[hit]]
            left, high, low = left[~hit], high[~hit], low[~hit]
            if not len(left):
                return out
            if k > 1:
                at, hit = _find(self.contexts[k - 1], hashed(*context(high, low)))
                out[left[hit]] += self.backoff[k - 1][at[hit]]
                high, low = suffix(k, high, low)
        out[left] += self.unseen
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def stored_grams(counted: DataFrame, bound: int):
    """Which n-grams a model of at most ``bound`` n-grams stores (only a caller of :func:`estimate` asks for one): in languages of more than ``bound`` those of the highest counts, by powers of two, and of
    the power that no longer fits whole the share that does, drawn by hash. None if there are no counts."""
    power = F.floor(F.log2("n")).cast("int")
    sizes: dict[int, dict[int, int]] = {}
    for r in counted.groupBy("lang", power.alias("e")).count().collect():
        sizes.setdefault(r["lang"], {})[r["e"]] = r["count"]
    if not sizes:
        return None
    kept = F.lit(True)
    drawn = F.pmod(F.xxhash64("high", "low"), F.lit(1 << 20))
    for lang, by in sizes.items():
        left = bound
        for e in sorted(by, reverse=True):
            if by[e] > left:
                own = (power > e) | ((power == e) & (drawn < int(left / by[e] * (1 << 20))))
                kept = F.when(F.col("lang") == lang, own).otherwise(kept)
                break
            left -= by[e]
    return kept


def estimate(langs: list[str], counted: DataFrame, bound: int | None = None) -> list[Model]:
    """Interpolated Kneser-Ney, from the lowest order up: raw counts at the highest order, below it
    the number of distinct n-grams of the next order that end so. All counted n-grams are kept, unless a caller sets a ``bound``
    for each language. Models of one block come loaded; more than that stay in their tables."""
    key = ["lang", "high", "low"]
    kept = F.lit(True) if bound is None else stored_grams(counted, bound)
    if kept is None:
        return []
    levels = {ORDER: counted.withColumn("kept", kept)}
    for k in range(ORDER, 1, -1):
        high, low = suffix(k, F.col("high"), F.col("low"))
        levels[k - 1] = levels[k].where("kept").select("lang", high.alias("high"), low.alias("low")).groupBy(*key).agg(F.count("*").alias("n")).withColumn("kept", F.lit(True))

    first = levels[1].groupBy("lang").agg(F.sum("n").alias("mass"))
    letters = levels[1].select("low").distinct().count()
    p = C.stored(levels[1].join(first, "lang").select(*key, ((F.col("n") + 0.5) / (F.col("mass") + 0.5 * (letters + 1))).alias("p")), "langid-p")
    unseen = {r["lang"]: np.log(0.5 / (r["mass"] + 0.5 * (letters + 1))) for r in first.collect()}
    tables = Tables([p], [])
    for k in range(2, ORDER + 1):
        high, low = context(F.col("high"), F.col("low"))
        grams_ = levels[k].select(*key, "n", "kept", high.alias("c_high"), low.alias("c_low"))
        ctx = (grams_.groupBy("lang", "c_high", "c_low").agg(F.sum("n").alias("mass"), F.sum(F.expr(f"if(kept, n - {DISCOUNT}D, 0D)")).alias("own"), F.max("kept").alias("kept"))
               .where("kept").select("lang", F.col("c_high").alias("high"), F.col("c_low").alias("low"), "mass", (1 - F.col("own") / F.col("mass")).alias("weight")))
        ctx = C.stored(ctx, "langid-contexts")
        s_high, s_low = suffix(k, F.col("high"), F.col("low"))
        lower = p.select("lang", F.col("high").alias("s_high"), F.col("low").alias("s_low"), F.col("p").alias("lower"))
        p = C.stored(grams_.where("kept").withColumns({"s_high": s_high, "s_low": s_low}).join(ctx.withColumnsRenamed({"high": "c_high", "low": "c_low"}), ["lang", "c_high", "c_low"])
                     .join(lower, ["lang", "s_high", "s_low"])
                     .select(*key, ((F.col("n") - DISCOUNT) / F.col("mass") + F.col("weight") * F.col("lower")).alias("p"), "n"), "langid-p")
        tables.contexts.append(ctx)
        tables.grams.append(p)
    sums = {r["lang"]: r for r in p.groupBy("lang").agg((-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("mean"), F.count("*").alias("size")).collect()}
    models = [Model(name, [], [], [], [], unseen[i], sums[i]["mean"], stretch=stretch, size=size, number=i, tables=tables)
              for i, name in enumerate(langs) if i in unseen for stretch, size in _stretches(p, i, sums[i]["size"])]
    if len(blocks(models)) > 1:
        return models
    models = tables.load(models)
    tables.discard()
    return models


def _stretches(p: DataFrame, lang: int, size: int) -> list[tuple[tuple[int, int], int]]:
    """Stretches of a language's contexts with at most ``BLOCK_GRAMS`` n-grams each, as far as approximate cuts
    and whole contexts allow, and their sizes."""
    if size <= BLOCK_GRAMS:
        return [(_ALL, size)]
    at = p.where(F.col("lang") == lang).select(context_number(F.col("high"), F.col("low")).alias("at"))
    n = -(-size // BLOCK_GRAMS)
    found = at.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 10_000).alias("cuts")).first()["cuts"]
    cuts = [_ALL[0], *sorted({c for c in found if c > 0}), _ALL[1]]
    stretch = F.lit(0)
    for c in cuts[1:-1]:
        stretch = stretch + (F.col("at") >= F.lit(c)).cast("int")
    sizes = {r["i"]: r["count"] for r in at.groupBy(stretch.alias("i")).count().collect()}
    return [((a, b), sizes[i]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i in sizes]


def _by_part(table: DataFrame, column: str, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part the sorted hashes of a table's n-grams and the logs of their values."""
    t = table.select("part", "high", "low", F.log(column).cast("float").alias("v")).toArrow()
    part, high, low, v = (t.column(c).to_numpy() for c in ("part", "high", "low", "v"))
    key = hashed(high, low)
    at = np.lexsort((key, part))
    cuts = np.searchsorted(part[at], np.arange(n + 1))
    return [(key[at[a:e]], v[at[a:e]]) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]


def fit(docs: DataFrame) -> list[Model]:
    """Models of all languages, in the order of their names, with calibrated limits."""
    rows = docs.where("lang is not null and doc_id is not null").where(C.fold_of(F.col("doc_id")) != 0)
    known = rows.select("lang", "text")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not langs:
        return []
    counted = C.stored(count(known, langs), "langid-counts")
    models = estimate(langs, counted)
    C.discard(counted)
    passed, last = _pass(known.withColumn("doc_id", F.lit(0).cast("long")), models)
    measured = C.stored(passed.mapInArrow(_decide(models, last), SCHEMA).where("lang_pred <> 'und' or score > 0").select("lang_pred", "excess"), "langid-excess")
    limits = {r["lang_pred"]: r["limit"] for r in exact_quantiles(measured, ["lang_pred"], "excess", {"limit": CALIBRATED}).collect()}
    C.discard(measured, passed)
    for m in models:
        m.limit = limits.get(m.lang, np.inf)
    return models


# --- prediction --------------------------------------------------------------------------
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double, excess double"


def blocks(models: list[Model]) -> list[list[Model]]:
    """Consecutive models of at most ``BLOCK_GRAMS`` n-grams together, one at least."""
    out: list[list[Model]] = [[]]
    for m in models:
        if out[-1] and sum(x.size for x in out[-1]) + m.size > BLOCK_GRAMS:
            out.append([])
        out[-1].append(m)
    return out


def costs(texts: list[str | None], models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each text under each model (0 without a letter), and the texts' characters. Characters
    of contexts outside a model's stretch cost nothing there."""
    code, off = characters(texts)
    n = np.diff(off)
    out = np.zeros((len(n), len(models)))
    if len(code):
        high, low = grams(code, off)
        key = hashed(high, low)
        at, numbers = distinct(key)
        by_key = np.argsort(key[at])  # neighbouring look-ups meet neighbouring places of the sorted arrays
        place = np.empty(len(at), np.int64)
        place[by_key] = np.arange(len(at))
        numbers, high, low = place[numbers], high[at][by_key], low[at][by_key]
        filled = n > 0
        for j, m in enumerate(models):
            if m.stretch == _ALL:
                logs = m.log_probabilities(high, low)
            else:
                where = context_number(high, low)
                mine = (where >= m.stretch[0]) & (where < m.stretch[1])
                logs = np.zeros(len(high))
                logs[mine] = m.log_probabilities(high[mine], low[mine])
            out[filled, j] = -np.add.reduceat(logs[numbers], off[:-1][filled]) / n[filled]
    return out, n


def languages(models: list[Model]) -> list[Model]:
    """The first model of each language."""
    return list({m.lang: m for m in reversed(models)}.values())[::-1]


def _pass(docs: DataFrame, models: list[Model]) -> tuple[DataFrame, list[Model]]:
    """Rows with their costs in all blocks but the last, and the last block, loaded. Between two blocks the rows are stored, so
    the driver and the workers hold one block at a time."""
    *earlier, last = blocks(models)
    names = [m.lang for m in languages(models)]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.array_repeat(F.lit(0.0), max(1, len(names))).alias("costs"))
    for block in earlier:
        passed = C.stored(rows.mapInArrow(_add_costs(_loaded(block), names), "doc_id long, text string, costs array<double>"), "langid-costs")
        C.discard(rows)
        rows = passed
    return rows, _loaded(last)


def _loaded(block: list[Model]) -> list[Model]:
    return block[0].tables.load(block) if block and block[0].tables else block


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """Language of every whole text. No shuffle: a text passes the blocks of models in turn."""
    rows, last = _pass(docs, models)
    return rows.mapInArrow(_decide(models, last), SCHEMA)


def _all_costs(s: pa.RecordBatch, block: list[Model], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found, n = costs(s.column("text").to_pylist(), block)
    out = s.column("costs").flatten().to_numpy().reshape(len(n), -1).copy()
    for j, m in enumerate(block):
        out[:, names.index(m.lang)] += found[:, j]
    return out, n


def _add_costs(block: list[Model], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b):
                cost, n = _all_costs(s, block, names)
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("text"), C.ragged(cost.ravel(), np.arange(len(n) + 1) * cost.shape[1], pa.float64())], names=["doc_id", "text", "costs"])

    return run


def _decide(models: list[Model], last: list[Model]):
    langs = languages(models)
    known = [m.lang for m in langs]
    names = np.array([*known, "und"], object)
    means, limits = np.array([m.mean for m in langs] or [0.0]), np.array([m.limit for m in langs] or [np.inf])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b):
                cost, n = _all_costs(s, last, known)
                filled = n > 0 if len(names) > 1 else np.zeros(len(n), bool)
                best = cost.argmin(1)
                low = cost[np.arange(len(n)), best]
                weight = np.minimum(n, EFFECTIVE_CHARS)
                share = 1 / np.exp(-(cost - low[:, None]) * weight[:, None]).sum(1)
                excess = np.where(filled, (low - means[best]) * np.sqrt(weight), 0.0)
                ids = s.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([None if i is None else C.fold_number(i) == 0 for i in ids.to_pylist()], pa.bool_()),
                     pa.array(names[np.where(filled, best, len(names) - 1)], pa.string()), pa.array(np.where(filled, share, 0.0)),
                     pa.array(~filled | (excess > limits[best])), pa.array(np.where(filled, low, 0.0)), pa.array(excess)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy", "excess"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    models = fit(docs)
    found = predict(docs, models)
    for m in models[:1]:
        if m.tables:
            m.tables.discard()
    return found
