"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Of 192 minima per set, 32 bands of
six make candidate buckets; the low four bits of each minimum are packed into twelve
longs, whose equal positions, counted with bit operations and corrected for chance
collisions, estimate the similarity of a candidate pair. Pairs that pass are confirmed on
their full sets.

Buckets are not multiplied out. Copies of one set are one node. Each bucket ties its
members to its most central one; only buckets that still hold several components go on,
and there only members of different components meet, where neither the number of shingles
that no other member has nor the estimate rules the link out. Pairs inside one component
cannot change it, so components are those of all links.

A pair of similarity 0.85 meets in some band with probability 1 - 3e-7, and the estimate
lies six standard deviations below the threshold before it rejects.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.components import components
from lamella.llm.rows import WordHashes, hold, map_rows, mixed, release, spaced_words


@dataclass(frozen=True)
class MinHash:
    """Words per shingle, similarity in hundredths, and the shape of the sketch."""

    words: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 6
    bits: int = 4
    margin: float = 6.0

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return self.minima * self.bits // 64

    @property
    def floor(self) -> float:
        """Share of equal packed positions below which a pair is given up."""
        chance, s = 0.5**self.bits, self.percent / 100
        equal = s + (1 - s) * chance
        return equal - self.margin * math.sqrt(equal * (1 - equal) / self.minima)


DEFAULT = MinHash()


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    each = hashes.of(words)
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total ^ each[k : len(each) - size + 1 + k])
    return np.unique(total)


def _sketcher(how: MinHash):
    random = np.random.default_rng(7)
    factors = random.integers(0, 1 << 32, how.minima, dtype=np.uint32) | np.uint32(1)
    weights = random.integers(0, 1 << 63, (how.bands, how.rows), dtype=np.uint64) | np.uint64(1)
    numbers = np.arange(how.bands, dtype=np.uint64)
    per_long = 64 // how.bits
    places = (np.arange(per_long) * how.bits).astype(np.uint64)

    def sketch(shingles: np.ndarray) -> tuple[list[int], list[int]]:
        keys = (shingles >> np.uint64(32)).astype(np.uint32)
        minima = np.full(how.minima, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            for k in range(0, how.minima, 32):
                values = part * factors[k : k + 32, None]
                values ^= values >> np.uint32(15)
                np.minimum(minima[k : k + 32], values.min(1), out=minima[k : k + 32])
        wide = minima.astype(np.uint64)
        bands = mixed((mixed(wide.reshape(how.bands, how.rows) * weights)).sum(1) + numbers)
        low = wide & np.uint64((1 << how.bits) - 1)
        packed = (low.reshape(-1, per_long) << places).sum(1, dtype=np.uint64)
        return packed.view(np.int64).tolist(), bands.view(np.int64).tolist()

    return sketch


def sketches(docs: DataFrame, how: MinHash = DEFAULT) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), packed, bands; the last three null for empty sets."""

    def start():
        hashes, sketch = WordHashes(), _sketcher(how)

        def body(doc_id, text):
            found = shingle_set(spaced_words(text), hashes, how.words)
            if not len(found):
                return [(doc_id, 0, None, None, None)]
            return [(doc_id, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), *sketch(found))]

        return body

    return map_rows(
        docs.select("doc_id", "text"), start,
        "doc_id long, n_shingles long, set_key binary, packed array<long>, bands array<long>",
    )


def shingle_sets(docs: DataFrame, how: MinHash = DEFAULT) -> DataFrame:
    """node, shingles: the sorted distinct 64-bit hashes, packed."""

    def start():
        hashes = WordHashes()
        return lambda node, text: [(node, shingle_set(spaced_words(text), hashes, how.words).tobytes())]

    return map_rows(docs.select("doc_id", "text"), start, "node long, shingles binary")


def equal_positions(a: str, b: str, how: MinHash) -> Column:
    """Packed positions in which two sketches agree, by bit counts."""
    total = F.lit(0)
    ones = sum(1 << k for k in range(0, 64, how.bits))
    ones -= (1 << 64) * (ones >> 63)
    for k in range(how.longs):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        step = how.bits // 2
        while step:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step //= 2
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return F.lit(how.minima) - total


def estimate(a: str, b: str, how: MinHash = DEFAULT) -> Column:
    """Similarity by equal positions, less the share that agrees by chance."""
    chance = 0.5**how.bits
    return (equal_positions(a, b, how) / how.minima - chance) / (1 - chance)


def _plausible(a: str, b: str, how: MinHash) -> Column:
    return equal_positions(a, b, how) >= math.floor(how.floor * how.minima)


def _confirmed(pairs: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    percent = how.percent

    def start():
        def body(a, b, of_a, of_b):
            x, y = np.frombuffer(of_a, np.uint64), np.frombuffer(of_b, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            return [(a, b)] if 100 * shared >= percent * (len(x) + len(y) - shared) else []

        return body

    return map_rows(with_both.select("a", "b", "of_a", "of_b"), start, "a long, b long")


def _alone(sets: DataFrame) -> DataFrame:
    """node, alone: how many of its shingles no other node has."""

    def start():
        return lambda node, shingles: [(node, x) for x in np.frombuffer(shingles, np.int64).tolist()]

    each = map_rows(sets.select("node", "shingles"), start, "node long, shingle long")
    held = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return held.where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))


MARKS = 1 << 18  # rows of 64 bits each


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose id is in ``wanted``.

    Bits of hashed ids, a table of at most ``MARKS`` rows, go to all tasks and keep most other texts
    out of the shuffle; the join behind them is exact.
    """
    hashed = F.xxhash64(F.lit("mark"), "doc_id")
    place, bit = F.shiftrightunsigned(hashed, 6).bitwiseAND(MARKS - 1), F.call_function(
        "shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(63).cast("int")
    )
    marks = wanted.groupBy(place.alias("_place")).agg(F.bit_or(bit).alias("_bits"))
    near = docs.select("doc_id", "text", place.alias("_place"), bit.alias("_bit")).join(F.broadcast(marks), "_place")
    near = near.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select("doc_id", "text")
    return near.join(wanted.distinct(), "doc_id")  # a semi-join would be moved before the filter


def near_duplicates(docs: DataFrame, how: MinHash = DEFAULT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row per row.

    A null, empty or blank text has no shingles and is linked with nothing. Rows that share
    a doc_id count as one document. A null doc_id is no node: its row takes the component of
    an equal set that has an id, and is kept only if there is none. Other columns of
    ``docs`` are ignored. The result is computed when this is called, into tables of the
    shared folder.
    """
    sketched = hold(sketches(docs, how), "sketches")
    full = sketched.where("n_shingles > 0")
    nodes = hold(
        full.groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"),
            F.first("packed").alias("packed"), F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    known = nodes.where("node is not null")

    rows = known.select("node", F.posexplode("bands").alias("k", "band")).select("band", "node")
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    live = hold(rows.join(sizes, "band"), "live")
    # the member of the most and fullest buckets is most like the others; ties go to the smallest
    central = live.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = live.join(central, "node")
    centres = weighed.groupBy("band").agg(F.max_by("node", F.struct("weight", F.negative("node"))).alias("centre"))
    star = weighed.join(centres, "band").where("node <> centre")
    star = star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()

    packed = known.select("node", "packed")
    a = packed.select(F.col("node").alias("a"), F.col("packed").alias("p"))
    b = packed.select(F.col("node").alias("b"), F.col("packed").alias("q"))
    pairs = hold(star.join(a, "a").join(b, "b").where(_plausible("p", "q", how)).select("a", "b"), "pairs")
    sets = hold(shingle_sets(_texts_of(docs, live.select(F.col("node").alias("doc_id"))), how), "sets")
    links = hold(_confirmed(pairs, sets, how), "links")

    label = components(links)
    labelled = live.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("label"))
    open_bands = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    unsettled = hold(labelled.join(open_bands.select("band"), "band", "left_semi"), "unsettled")
    members = unsettled.select("node").distinct()
    alone = _alone(sets.join(members, "node", "left_semi"))
    facts = known.join(members, "node", "left_semi").join(alone, "node", "left")
    facts = facts.select("node", "packed", "bands", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    # shingles of its own alone keep a document below the threshold with any other
    facts = facts.where(F.lit(100) * (F.col("n") - F.col("alone")) >= how.percent * F.col("n"))
    side = unsettled.join(facts, "node")
    x, y = side.alias("x"), side.alias("y")
    shared = F.least(F.expr("x.n - x.alone"), F.expr("y.n - y.alone"))
    union = F.expr("x.alone + y.alone") + F.greatest(F.expr("x.n - x.alone"), F.expr("y.n - y.alone"))
    met = x.join(
        y,
        (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
        & (100 * shared >= how.percent * union) & _plausible("x.packed", "y.packed", how)
        # a pair comes from the first of the bands it shares, not from each
        & (F.col("x.band") == F.array_min(F.array_intersect("x.bands", "y.bands"))),
    )
    rest = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()  # bands may repeat in one document
    more = hold(_confirmed(rest, sets, how), "links")
    bridges = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(bridges.union(more))
    release(live, pairs, sets, links, unsettled, more)

    of_set = nodes.join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    joined = sketched.join(of_set, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, how: MinHash = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that are kept: of each component the document with the smallest id.

    Rows of one id are one document and stay or go together; so do all rows without an id,
    which stay unless each is a copy of a document that has one.
    """
    kept = near_duplicates(docs, how).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
