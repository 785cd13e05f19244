"""Near-duplicate groups by circulant MinHash.

A document's set are the hashes of its distinct five-word shingles. One permutation (sigma) scatters
them over a universe of ``2**LOG2_UNIVERSE`` places; a second one (pi), circularly shifted by k, gives
coordinate k of the signature: the least pi(place - k) over the set. As the shifts are
consecutive, all ``BANDS * ROWS`` coordinates of a shingle are one stretch of the table of pi, so a
signature is the minimum of such stretches. It is kept as a sketch, a hashed byte a coordinate. ``ROWS`` coordinates make a band;
documents that agree on a band are candidates, and every link is confirmed on the full sets
(``100 * intersection >= 75 * union``). At similarity 0.75 a pair shares no band with probability
``(1 - 0.75**ROWS)**BANDS``, about 4e-6; at 0.5 it shares one with 0.63, at 0.33 with 0.08.

Equal sets form a class first, so exact copies are one node however many there are. Buckets never
emit all their pairs. A round takes the bands up to its bound in ``ROUNDS``: the members of a bucket are sorted by a stretch of their
sketches that is drawn for the bucket, so that those alike come together, and each is compared with the next one, in
buckets of up to ``WHOLE`` members with all, unless they are in one component by then. Sketches are compared first: of pairs that
agree in less than ``LEAST`` coordinates (five deviations below 0.75) the sets aren't shipped. Links join components (large-star and
small-star steps over written tables) before the next round's bands are read, so what is plainly alike is joined by the first rounds and every band row
is read once.

What is left is finished exactly: in every bucket of more than ``WHOLE`` members that still holds several
components, all sketches of different components are compared, block by block of ``BLOCK`` members so that
no task holds a bucket; a pair that agrees in ``LEAST`` coordinates is compared on the sets in the first band it shares, where its two blocks
meet, and only links leave it. Blocks of one large component never meet each other. This is quadratic in the members that stay apart while sharing bands, and only in those.

The full sets are made for candidates only: their ids pass a bitmap of fixed size on the scan.

Defined cases: null and empty texts have no shingles and are linked with nothing; very long texts are one set like any other; fewer words than five
are one shingle; rows without an id come out unlinked with a null component and kept; an id is one
node: an id with several texts has a row for each and their links count for it; repeated rows
give one row; of tied ids the least names the component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import common as C

WORDS = 5
ROWS, BANDS = 6, 64
LEAST = round(0.64 * ROWS * BANDS)
ROUNDS = (2, 8, 24, BANDS)  #: bands from the last bound to this one are a round's; the first are few, as they join most
LOG2_UNIVERSE = 22
WHOLE, PREFIX = 4, 8
BLOCK = 256
LOG2_BITS = 24
_SIGMA = C.U(0xA0761D6478BD642F)


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row's text."""
    raw, off = C.utf8(col)
    raw = C.LOWER[raw]
    starts, stops, at = C.word_spans(raw, off, C.NOT_SPACE)
    words = C.word_hashes(raw, starts, stops)
    grams = C.gram_hashes(words, WORDS)
    out = []
    for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(grams[a:e - WORDS + 1] if e - a >= WORDS else C.gram_hashes(words[a:e], e - a) if e > a else words[:0]))
    return out


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, whatever its order."""
    return (int(C.mix(shingles ^ C.U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)),
            int(C.mix(shingles + C.U(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))


class Signer:
    """The table of pi, extended so that every stretch of shifts is contiguous."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS):
        self.rows, self.bands = rows, bands
        pi = np.arange(1 << LOG2_UNIVERSE, dtype=np.int32)
        np.random.default_rng(7).shuffle(pi)
        n = rows * bands
        self.stretch = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi[-n:], pi]), n)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """All coordinates: the least stretch of the set."""
        place = (C.mix(shingles ^ _SIGMA) >> C.U(64 - LOG2_UNIVERSE)).astype(np.int64)
        least = None
        for a in range(0, len(place), 2048):
            m = self.stretch[place[a:a + 2048]].min(axis=0)
            least = m if least is None else np.minimum(least, m)
        return least.astype(np.uint64)

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key a band."""
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for c in self.signature(shingles).reshape(self.bands, self.rows).T:
            key = C.mix(key * C.U(0x9E3779B97F4A7C15) + c)
        return key.view(np.int64)

    def sketch(self, shingles: np.ndarray) -> bytes:
        """One byte a coordinate."""
        return (C.mix(self.signature(shingles) + C.U(0x2545F4914F6CDD1D)) >> C.U(56)).astype(np.uint8).tobytes()


@cache
def signer_of_worker() -> Signer:
    """One table a Python worker, however many tasks it runs."""
    return Signer()


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): size, digest and sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = signer_of_worker()
        for b in batches:
            for s in C.slices(b):
                sets = shingle_sets(s.column("text"))
                d = [digests(x) for x in sets]
                sketches = [signer.sketch(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()),
                     pa.array([x[1] for x in d], pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch binary")


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents whose id passes the bitmap of ``wanted`` (rep), made on the scan."""
    bits = C.bitmap(wanted, "rep", LOG2_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(C.in_bitmap(bits, b.column("rep").to_numpy())))
            for s in C.slices(b):
                sets = shingle_sets(s.column("text"))
                full = pa.array([len(x) > 0 for x in sets])
                sets = [x for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([s.column("rep").filter(full), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "shingles"])

    return docs.where("doc_id is not null").select(docs["doc_id"].cast("long").alias("rep"), "text").mapInArrow(run, "rep long, shingles binary")


def passing(rows: DataFrame, column: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose ``column`` passes the bitmap of ``wanted``'s column of that name, or those that don't."""
    bits = C.bitmap(wanted, column, LOG2_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(C.in_bitmap(bits, b.column(column).to_numpy()) == inside))

    return rows.mapInArrow(run, rows.schema)


def promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, agree): the pairs whose sketches agree in ``LEAST`` coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, y = (C.utf8(rows.column(c))[0].reshape(-1, ROWS * BANDS) for c in ("x", "y"))
            agree = (x == y).sum(axis=1)
            made = pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(agree, pa.int64())], names=["a", "b", "agree"])
            yield made.filter(pa.array(agree >= LEAST))

    few = passing(sketches, "rep", pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    of = lambda c, name: few.select(F.col("rep").alias(c), F.col("sketch").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long, agree long").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def most_alike(pairs: DataFrame) -> DataFrame:
    """Of every document its pair (a, b) of most agreement."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("agree", "a", "b").alias("pair"))
    return ends.groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. Each a's set comes first, then the sets of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for rows in batches:
            a, b, shingles = rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("shingles")
            found = []
            for i in range(len(a)):
                x = np.frombuffer(shingles[i].as_py(), np.uint64)
                if a[i] != at:
                    at, own = a[i], []
                if b[i] is None:
                    own += [] if any(np.array_equal(x, y) for y in own) else [x]
                elif any(alike(x, y) for y in own):
                    found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    wanted = pairs.select(F.col("a").alias("rep"), "a", F.lit(None).cast("long").alias("b")).distinct().unionByName(
        pairs.select(F.col("b").alias("rep"), "a", "b"))
    both = wanted.join(passing(sets, "rep", wanted), "rep").select("a", "b", "shingles").repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))
    return both.mapInArrow(run, "a long, b long").distinct()


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 100 * small < 75 * large:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (small + large - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps; each result is written down. A node's minimum is found
    with partial aggregation, and the joins' large sides can be split by adaptive execution.
    """
    edges = C.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not starred(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = C.stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def starred(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u > v, distinct) hangs on one root: no u has two edges or is the v of another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    split = ends.groupBy("node").agg(F.sum("up").alias("edges"), F.min("up").alias("least")).where("edges > 1 or edges = 1 and least = 0")
    return split.agg(F.count("*")).first()[0] == 0


def representatives(valid: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, sketch) of one document a class. The sketch of a set that occurs once isn't shuffled for it."""
    several = classes.where("many")
    alone = passing(valid, "d1", several, inside=False).select(F.col("doc_id").alias("rep"), "sketch")
    first = passing(valid, "d1", several).join(classes.select("n", "d1", "d2", F.col("rep").alias("doc_id"), "rep"), ["doc_id", "n", "d1", "d2"])
    return alone.unionByName(first.select("rep", "sketch")).dropDuplicates(["rep", "sketch"])


def buckets(reps: DataFrame) -> DataFrame:
    """(key, band, rep, near) of all bands that several documents share; ``near`` orders a bucket's members."""
    rows = reps.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select(
        "rep", "sketch", F.col("band").cast("byte").alias("band"), F.expr(f"xxhash64(band, substring(sketch, {ROWS} * band + 1, {ROWS}))").alias("key"))
    rows = rows.select("key", "band", "rep", F.expr(
        f"substring(sketch, cast(1 + pmod(xxhash64(key, 1), {ROWS * BANDS - PREFIX}) as int), {PREFIX})").alias("near"))
    w = Window.partitionBy("key").orderBy("rep")
    return (rows.withColumn("p", F.lag("rep").over(w)).withColumn("q", F.lead("rep").over(w))
            .where("p is not null or q is not null").select("key", "band", "rep", "near"))


def still_open(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The bucket rows with their components and bucket sizes; buckets within one component are done for good."""
    rows = shared.withColumn("comp", F.col("rep")) if labels is None else (
        shared.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
    w = Window.partitionBy("key")
    return (rows.withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).withColumn("size", F.count("*").over(w))
            .where("lo <> hi").drop("lo", "hi"))


def round_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of neighbours in their bucket's order that lie in different components; all pairs of small buckets."""
    w = Window.partitionBy("key").orderBy("near", "rep")
    ahead = F.array(*[F.struct(F.lag("rep", j).over(w).alias("rep"), F.lag("comp", j).over(w).alias("comp"), (F.lit(j == 1) | (F.col("size") <= WHOLE)).alias("use"))
                      for j in range(1, WHOLE)])
    other = F.filter("ahead", lambda x: x["use"] & x["rep"].isNotNull() & (x["comp"] != F.col("comp")))
    pairs = rows.withColumn("ahead", ahead).select("rep", F.explode(other).alias("x"))
    return pairs.select(F.least("rep", "x.rep").alias("a"), F.greatest("rep", "x.rep").alias("b")).distinct()


def cells(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(cell, band, within, first, rep, comp, sketch): the large buckets' rows, dealt so that any two of a bucket that lie in
    different components meet in one cell: within a block, or as the first and the other block of two.

    A component of more than ``BLOCK`` rows of a bucket has blocks of its own, the others share theirs."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") > BLOCK, F.col("comp")))
    split = (parts.groupBy("key", "own").agg(F.sum("n").alias("n")).groupBy("key")
             .agg(F.sum("n").alias("size"), F.collect_list(F.struct("own", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))).alias("split"))
             .where(F.col("size") > WHOLE))
    dealt = rows.select("key", "band", "rep", "comp").join(parts.select("key", "comp", "own"), ["key", "comp"]).join(split, "key")
    blocks = "filter(split, x -> x.own <=> own)[0].blocks"
    dealt = dealt.withColumn("me", F.expr(f"struct(own, cast(pmod(xxhash64(rep), {blocks}) as int) as block)"))
    met = dealt.select("key", "band", "rep", "comp", "me", F.explode(F.expr(
        "flatten(transform(filter(split, x -> own is null or not x.own <=> own), x -> transform(sequence(0, x.blocks - 1), b -> struct(x.own as own, b as block))))")).alias("other"))
    met = met.select("rep", "band", "comp", F.expr("xxhash64(key, least(me, other).own, least(me, other).block, greatest(me, other).own, greatest(me, other).block)").alias("cell"),
                     F.expr("me = other or (me.own <=> other.own and me.block = other.block)").alias("within"), F.expr("least(me, other) <=> me").alias("first"))
    return met.join(sketches, "rep").select("cell", "band", "within", "first", "rep", "comp", "sketch")


def hopeful(cell: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of a cell each row with the later rows (or, between two blocks, the other block's) of other components whose sketch agrees
    in ``LEAST`` coordinates or more, where the cell's band is the first that the two share: an earlier one's bucket
    is compared as well, or was whole."""
    comp = cell.column("comp").to_numpy()
    if (comp == comp[0]).all():
        return
    band, within = cell.column("band")[0].as_py(), cell.column("within")[0].as_py()
    first = cell.column("first").to_numpy(zero_copy_only=False)
    signs = C.utf8(cell.column("sketch").combine_chunks())[0].reshape(-1, ROWS * BANDS)
    for i in range(len(comp)) if within else np.flatnonzero(first).tolist():
        apart = comp != comp[i]
        if within:
            apart[:i] = False
        else:
            apart &= ~first
        js = np.flatnonzero(apart)
        same = signs[js] == signs[i]
        enough = same.sum(axis=1) >= LEAST
        js, same = js[enough], same[enough]
        js = js[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(js):
            yield i, js


def hopeful_rows(cell: pa.Table) -> pa.Table:
    """The rows of a cell that have a partner to be compared with."""
    kept = np.zeros(cell.num_rows, bool)
    for i, js in hopeful(cell):
        kept[i] = kept[js] = True
    return cell.filter(pa.array(kept))


def cell_links(cell: pa.Table) -> pa.Table:
    """Links (a, b) of a cell on the full sets; components that a link has joined aren't compared again."""
    rep, comp, shingles = cell.column("rep").to_pylist(), cell.column("comp").to_pylist(), cell.column("shingles")
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in shingles]
    root = {c: c for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    found = []
    for i, js in hopeful(cell):
        for j in js.tolist():
            x, y = find(comp[i]), find(comp[j])
            if x != y and alike(sets[i], sets[j]):
                root[max(x, y)] = min(x, y)
                found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def by_cell(dealt: DataFrame, compared: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies a function to each cell's rows, cell after cell, one held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column("cell").to_numpy()
            if held and held[-1].column("cell")[0].as_py() != cell[0]:
                yield from compared(pa.Table.from_batches(held)).to_batches()
                held = []
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                held.append(b.slice(a, e - a))
                if e < b.num_rows:
                    yield from compared(pa.Table.from_batches(held)).to_batches()
                    held = []
        if held:
            yield from compared(pa.Table.from_batches(held)).to_batches()

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def rest_links(rows: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components within large buckets, all pairs considered: first the rows are kept that have a partner by their
    sketches, then only their sets are shipped and compared where they meet. No pair leaves a cell but the links."""
    kind = "cell long, band byte, within boolean, first boolean, rep long, comp long, sketch binary"
    kept = C.stored(by_cell(cells(rows, sketches), hopeful_rows, kind), "hopeful")
    full = kept.join(passing(sets, "rep", kept), "rep").select("cell", "band", "within", "first", "rep", "comp", "sketch", "shingles")
    found = C.stored(by_cell(full, cell_links, "a long, b long").distinct(), "links")
    C.discard(kept)
    return found


def crossing(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    if labels is None:
        return pairs.select("a", "b")
    at = lambda c: labels.select(F.col("rep").alias(c), F.col("comp").alias(f"{c}_comp"))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(a_comp, a) <> coalesce(b_comp, b)").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its set's size, its component and whether it is the one that stays."""
    made = C.stored(features(docs), "features")
    valid = made.where("n > 0 and doc_id is not null")
    classes = C.stored(valid.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), (F.count("*") > 1).alias("many")), "classes")
    sketches = C.stored(representatives(valid, classes), "sketches")
    shared = C.stored(buckets(sketches), "buckets")
    sets = C.stored(candidate_sets(docs, shared.select("rep")), "sets")
    # an id with several texts ties their classes together
    member = C.stored(valid.select("doc_id", "n", "d1", "d2").join(classes.drop("many"), ["n", "d1", "d2"]).distinct(), "members")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    links = member.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("lo").alias("b")).where("a <> b")

    labels, tested = None, sketches.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)

    def confirmed(pairs: DataFrame) -> None:
        """Compares the pairs on their sets and joins the components of those alike."""
        nonlocal labels, tested
        chosen = C.stored(crossing(pairs, labels), "chosen")
        tested = tested.unionByName(chosen)
        found = C.stored(linked(chosen, sets), "links")
        if not found.isEmpty():
            labels = merged(labels, found)
        C.discard(found)

    if not links.isEmpty():
        labels = merged(labels, links)
    for first, end in zip((0, *ROUNDS), ROUNDS):  # noqa: B905
        met = C.stored(round_pairs(still_open(shared.where(F.col("band").between(first, end - 1)), labels)).join(tested, ["a", "b"], "left_anti"), "met")
        pairs = C.stored(promising(met, sketches), "pairs")
        if first == 0:  # one pair a document joins most of what is alike; the rest only where it still lies apart
            confirmed(most_alike(pairs))
        confirmed(pairs.join(tested, ["a", "b"], "left_anti"))
        C.discard(met, pairs)
    rows = C.stored(still_open(shared, labels).where(F.col("size") > WHOLE), "open")
    found = rest_links(rows, sketches, sets)
    if not found.isEmpty():
        labels = merged(labels, found)
    C.discard(found, shared, sets, rows, sketches)
    if labels is None:
        placed = member.withColumn("comp", F.col("rep"))
    else:
        placed = member.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    unlinked = made.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "d1", "d2").distinct()
    return (placed.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id")).unionByName(unlinked.drop("d1", "d2"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (rep, comp) after the links; works on the components that stand, not on their members."""
    if labels is not None:
        at = lambda c: labels.select(F.col("rep").alias(c), F.col("comp").alias(f"{c}_comp"))
        links = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
            F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    roots = components(links)
    if labels is None:
        return C.stored(roots.select(F.col("node").alias("rep"), F.col("root").alias("comp")), "labels")
    moved = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp"))
    fresh = roots.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(labels.select("rep"), "rep", "left_anti")
    return C.stored(moved.unionByName(fresh), "labels")


def one_row_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group, the others go; the nodes are the pairs of id (or no id) and text.

    The row of the least id stays, one without an id only if none has one, and one of equal rows. Texts without shingles all stay."""
    doc_id, key = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    node = F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0).cast("long")), key)
    grouped = near_duplicates(docs.select(node.alias("doc_id"), docs["text"])).where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id")
    pairs = docs.select(doc_id.alias("id"), key.alias("key"), node.alias("node")).groupBy("id", "key", "node").agg(F.count("*").alias("copies"))
    pairs = C.stored(pairs.join(grouped, "node").withColumn("rank", F.expr("struct(id is null as none, id, key)")), "pairs")
    first = pairs.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = C.stored(pairs.join(first, "component_id").where("not rank <=> first or copies > 1").select(
        F.col("id").alias("gone_id"), F.col("key").alias("gone_key"), F.expr("rank <=> first").alias("stays")), "gone")

    def matched(rows: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        return rows.alias("rows").join(pairs.alias("gone"), F.col("rows.doc_id").cast("long").eqNullSafe(F.col("gone.gone_id")) & (
            F.xxhash64(F.coalesce("rows.text", F.lit(""))) == F.col("gone.gone_key")), how).select(*docs.columns)

    kept = matched(docs, gone, "left_anti")
    copies = gone.where("stays")
    return kept if copies.isEmpty() else kept.unionByName(matched(docs, copies, "left_semi").dropDuplicates(["doc_id", "text"]))
