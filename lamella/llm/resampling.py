"""Importance resampling towards a target distribution.

Texts are bags of hashed features. An array holds, per bucket, the gain of the target over
the corpus as a scaled logarithm of their smoothed shares; a document's weight is the sum
of its features' gains. To that comes noise drawn from its id, and the highest scores are
kept, which draws without replacement in proportion to the weights.

The k-th highest is found by quickselect over the stored scores: some random keys become
pivots, one pass counts exactly what lies before, at and after each, and the search goes on
between two of them. Keys are composite, of score, id and place in the table, so no two are
equal, however many rows are copies. Only the winners are sorted, in slices.

The driver holds one number per bucket, the pivots of a round, and one count per slice.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.rows import WORDS_KEPT, hold, map_rows, plain_words


@dataclass(frozen=True)
class Resampling:
    """Feature runs of up to ``longest`` words, buckets, and the share of long enough documents that is drawn."""

    longest: int = 1
    buckets: int = 10_000
    scale: int = 1000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10
    pivots: int = 15
    rows_per_slice: int = 1_000_000


DEFAULT = Resampling()


class Features:
    """Buckets of the word runs of a text. Words already met are looked up; memory is bounded."""

    def __init__(self, how: Resampling):
        self.how = how
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            found = self.known[word] = zlib.crc32(word) % self.how.buckets
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        out = [np.fromiter(map(self.word, words), np.int64, len(words))]
        for size in range(2, self.how.longest + 1):
            runs = [zlib.crc32(b" ".join(words[k : k + size])) % self.how.buckets for k in range(len(words) - size + 1)]
            out.append(np.asarray(runs, np.int64))
        return np.concatenate(out)


def bucket_counts(texts: DataFrame, how: Resampling = DEFAULT) -> np.ndarray:
    """Features per bucket in the column ``text``, added up within each task before they are shuffled."""

    def run(batches):
        features, counts = Features(how), np.zeros(how.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(features.of(plain_words(text.as_py())), minlength=how.buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(how.buckets, np.int64)
    for bucket, n in rows.collect():  # at most one row per bucket
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray, how: Resampling = DEFAULT) -> np.ndarray:
    """Scaled logarithm of the target's share of each bucket over the corpus's, one added to each count."""
    s, t = float(corpus.sum() + how.buckets), float(target.sum() + how.buckets)
    ratio = ((target + 1.0) * s) / ((corpus + 1.0) * t)
    return np.asarray([math.floor(how.scale * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: str, how: Resampling = DEFAULT) -> Column:
    """Gumbel noise from the id, scaled; a null id draws as an empty one."""
    named = F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-how.scale * F.ln(-F.ln((drawn + 0.5) / 4294967296.0)))


def score(docs: DataFrame, gain: np.ndarray, how: Resampling = DEFAULT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row per row of ``docs``. A null text has no words."""

    def start():
        features = Features(how)

        def one(doc_id, text):
            words = plain_words(text)
            found = features.of(words)
            return [(doc_id, len(words), len(found), int(gain[found].sum()))]

        return one

    weighed = map_rows(docs.select("doc_id", "text"), start, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise("doc_id", how))


KEY = ("worse", "nameless", "id", "features", "heavier", "place")


def with_key(scored: DataFrame) -> DataFrame:
    """The columns of ``KEY``: best first by score, then id, nulls last; the place tells copies apart."""
    return scored.withColumns(
        {
            "worse": -F.col("score"), "nameless": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)),
            "features": F.col("n_features"), "heavier": F.col("weight"), "place": F.monotonically_increasing_id(),
        }
    )


def _key() -> Column:
    return F.struct(*KEY)


def _literal(key: tuple) -> Column:
    return F.struct(*(F.lit(v).cast("boolean" if name == "nameless" else "bigint").alias(name) for name, v in zip(KEY, key)))


def kth_key(keys: DataFrame, k: int, how: Resampling = DEFAULT) -> tuple:
    """The k-th smallest key of a stored table, k from 1 to its number of rows.

    Each round takes one pass for random pivots and one that counts; what lies between two
    pivots next to each other is a sixteenth of the round before on average.
    """
    inside, before, turn = keys.select(*KEY), 0, 0
    while True:
        picked = inside.orderBy(F.rand(how.seed + turn)).limit(how.pivots).collect()
        pivots = sorted(tuple(p) for p in picked)
        counts = [F.struct(F.count_if(_key() < _literal(p)).alias("less"), F.count_if(_key() == _literal(p)).alias("equal")) for p in pivots]
        found = inside.agg(*(c.alias(f"c{i}") for i, c in enumerate(counts))).first()
        low, high, passed = None, None, before
        for pivot, (less, equal) in zip(pivots, found):
            if before + less < k <= before + less + equal:
                return pivot
            if k <= before + less:
                high = pivot
                break
            low, passed = pivot, before + less + equal
        if low:
            inside = inside.where((F.col("worse") >= low[0]) & (_key() > _literal(low)))  # the number reaches the scan
        if high:
            inside = inside.where((F.col("worse") <= high[0]) & (_key() < _literal(high)))
        before, turn = passed, turn + 1


def ranked(winners: DataFrame, rows: int, how: Resampling = DEFAULT) -> DataFrame:
    """The rows with ``rank``, from 1 in order of their keys: one shuffle into ordered slices, each sorted."""
    slices = math.ceil(rows / how.rows_per_slice)
    placed = winners.repartitionByRange(slices, *KEY).sortWithinPartitions(*KEY)
    number = F.monotonically_increasing_id()  # slice number in the upper 31 bits, place in the lower 33
    placed = hold(placed.withColumn("number", number), "winners")
    slice_, at = F.shiftright("number", 33), F.col("number").bitwiseAND((1 << 33) - 1)
    sizes = dict(placed.groupBy(slice_).count().collect())
    first, total = {}, 0
    for number in sorted(sizes):
        first[number], total = total, total + sizes[number]
    starts = placed.sparkSession.createDataFrame(list(first.items()), "slice long, first long")
    return placed.join(F.broadcast(starts), slice_ == F.col("slice")).withColumn("rank", F.col("first") + at + 1)


def resample(docs: DataFrame, target: DataFrame, how: Resampling = DEFAULT) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of ``docs``, rank null where not drawn.

    Of the N documents with at least ``least_words`` words, ``percent`` of N, rounded down,
    are drawn: the highest scores, ties to the smaller id, a null id last. Rows that share an
    id are documents of their own. Empty tables, and a share below one document, draw nothing.
    Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, how), bucket_counts(target, how), how)
    scored = hold(with_key(score(docs, gain, how)), "scored")
    columns = ["doc_id", "n_features", "weight", "score"]
    long_enough = scored.where(F.col("n_words") >= how.least_words)
    k = how.percent * long_enough.count() // 100
    if not k:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    drawn = (F.col("n_words") >= how.least_words) & (_key() <= _literal(kth_key(long_enough, k, how)))
    winners = ranked(scored.where(drawn), k, how).select(*columns, "rank")
    return winners.union(scored.where(~drawn).select(*columns, F.lit(None).cast("bigint")))
