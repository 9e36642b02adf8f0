"""Language-model scores from a weighted backoff automaton.

Counts of words and of pairs of words come from all training texts, added up by Spark. The
model is a bigram model with absolute discounting. Its automaton has a state for each word
that pairs start from, and a root: an arc of a state is a pair that the model holds, with
its log-probability; the failure arc leads to the root and costs the state's backoff
weight; the root's arcs are single words with add-one estimates. One pass from left to
right carries the state and adds up log-probabilities, for all texts of a batch at once.

What tasks hold is bounded by parameters and is a cache only: the most frequent pairs, and
the most frequent words with their backoff weights. The pass follows the failure arc for a
pair that it does not hold and hands on the pair's hash; a join adds what each such pair
that the model has gains over that arc. Words beyond the cache are joined alike, so every
count, and every pair of at least ``least`` occurrences, enters the scores whatever the
size of the input. A bit set of fixed
size keeps most pairs that the model does not have out of the join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.rows import WORDS_KEPT, LocalWords, hold, release, spaced_words

TOGETHER = 2_000_000  # tokens that a task adds up at a time
ROWS = 1 << 16  # of a batch that a task hands to Spark
END = np.uint64(0x2545F4914F6CDD1D)  # of the end token, and of the place before the first word
PRIMES = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]  # of XXH64


@dataclass(frozen=True)
class Backoff:
    """Pairs and words that a task holds, the least count of a pair, the discount, and bits for the pairs not held.

    ``least`` is the cut-off of the model: a pair that occurs less often in all training
    texts is no arc, and is scored by its words. The README says what that does to held-out scores.
    """

    pairs: int = 1 << 20
    words: int = 1 << 20
    least: int = 2
    discount: float = 0.75
    bits: int = 1 << 26  # a power of two, 64 at least


DEFAULT = Backoff()


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Documents that are scored only; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


class _Texts:
    """Tokens of some texts one after the other: word numbers, those before them, and where each text starts."""

    def __init__(self, texts: list[str | None], words: LocalWords):
        flat: list[bytes] = []
        starts = []
        for text in texts:
            starts.append(len(flat))
            flat += spaced_words(text)
            flat.append(LocalWords.END)
        self.starts = np.array(starts, np.int64)
        self.second = words.numbers(flat)
        self.first = np.concatenate([[0], self.second[:-1]])  # an end stands before each first word
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.append(self.starts, len(flat))))
        self.pairs = (self.first << 32) | self.second


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of two longs."""
    a, b, c, d, e = (np.uint64(x) for x in PRIMES)
    seed = np.full(1, 42, np.uint64)
    for values in (first, second):
        seed = (seed + e + np.uint64(8)) ^ (_turned(values * b, 31) * a)
        seed = _turned(seed, 27) * a + d
        seed = (seed ^ (seed >> np.uint64(33))) * b
        seed = (seed ^ (seed >> np.uint64(29))) * c
        seed = seed ^ (seed >> np.uint64(32))
    return seed


def _counts(texts: DataFrame, least: int) -> DataFrame:
    """first, second, n: counts of words, with a null first, and of pairs that occur ``least`` times.

    Both come from one scan, added up in tasks first.
    """

    def added(words: LocalWords, held: list[np.ndarray]):
        """Batches of at most ``ROWS`` rows; ``held`` is emptied."""
        pairs = np.concatenate(held)
        held.clear()
        pairs.sort()
        ends = np.append(np.flatnonzero(pairs[1:] != pairs[:-1]), len(pairs) - 1)
        totals = np.zeros(len(words), np.int64)
        for at in range(0, len(pairs), ROWS):
            totals += np.bincount(pairs[at : at + ROWS] & 0xFFFFFFFF, minlength=len(words))
        pairs, n = pairs[ends], np.diff(ends, prepend=-1)
        hashes, seen = words.hashes(), np.flatnonzero(totals)
        for at in range(0, len(pairs), ROWS):
            part = pairs[at : at + ROWS]
            columns = hashes[part >> 32].view(np.int64), hashes[part & 0xFFFFFFFF].view(np.int64), n[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)
        for at in range(0, len(seen), ROWS):
            part = seen[at : at + ROWS]
            columns = [pa.nulls(len(part), pa.int64()), pa.array(hashes[part].view(np.int64)), pa.array(totals[part])]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        words, held, size = LocalWords(int(END)), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(_Texts(batch.column(0).slice(at, 256).to_pylist(), words).pairs)
                size += len(held[-1])
                if size > TOGETHER or len(words) > WORDS_KEPT:
                    yield from added(words, held)
                    size = 0
                    words = words if len(words) <= WORDS_KEPT else LocalWords(int(END))
        if held:
            yield from added(words, held)

    names = ["first", "second", "n"]
    each = texts.select("text").mapInArrow(run, "first long, second long, n long")
    return each.groupBy("first", "second").agg(F.sum("n").alias("n")).where(F.col("first").isNull() | (F.col("n") >= least))


@dataclass
class Automaton:
    """Sorted hashes with their values: words with count and backoff weight, and pair arcs; ``rare`` marks the other pairs."""

    words: np.ndarray
    word_counts: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    pair_scores: np.ndarray
    rare: np.ndarray
    tokens: int
    vocabulary: int

    def scorer(self) -> Scorer:
        return Scorer(self)

    def marked(self, pairs: np.ndarray) -> np.ndarray:
        if not len(self.rare):
            return np.zeros(len(pairs), bool)
        bits = self.rare[(pairs >> np.uint64(6)) & np.uint64(len(self.rare) - 1)]
        return (bits >> (pairs & np.uint64(63))) & np.uint64(1) > 0


class Scorer:
    """The automaton's pass over batches of texts; what it knows of words met stays from batch to batch."""

    def __init__(self, model: Automaton):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.words = LocalWords(int(END))
        self.hashes = np.empty(0, np.uint64)
        self.held = np.empty(0, bool)
        self.base = self.backoff = np.empty(0)  # 0 for words not held

    def _learn(self) -> None:
        new = self.words.hashes(len(self.hashes))
        if len(new):
            place, held = _find(self.model.words, new)
            base, backoff = np.zeros(len(new)), np.zeros(len(new))
            base[held] = np.log10((self.model.word_counts[place[held]] + 1) / (self.model.tokens + self.model.vocabulary + 1))
            backoff[held] = self.model.backoff[place[held]]
            self.hashes = np.concatenate([self.hashes, new])
            self.held = np.concatenate([self.held, held])
            self.base = np.concatenate([self.base, base])
            self.backoff = np.concatenate([self.backoff, backoff])

    def score(self, texts: list[str | None]) -> list[pa.Array]:
        """Columns n_tokens, n_known, base, total of what is held, and lists of what is to be joined.

        Of words not held: hashes, how often they occur, are reached through the root, and are
        left by the failure arc. Of pairs not held, which count as failures here: hashes and
        how often they occur.
        """
        if len(self.words) > WORDS_KEPT:
            self._clear()
        t = _Texts(texts, self.words)
        self._learn()
        rows = len(texts)
        pairs, which = np.unique(t.pairs, return_inverse=True)
        keys = _pair(self.hashes[pairs >> 32], self.hashes[pairs & 0xFFFFFFFF])
        arc, there = _find(self.model.pairs, keys)
        scores = np.zeros(len(pairs))
        scores[there] = self.model.pair_scores[arc[there]]
        scored, base = there[which], self.base[t.second]
        each = np.where(scored, scores[which], base + self.backoff[t.first])
        held, missed = self.held[t.second], ~scored
        totals = [np.add.reduceat(x, t.starts) for x in (np.ones(len(t.second), np.int64), held.astype(np.int64), base, each)]

        rest, left = ~held, missed & ~self.held[t.first]
        place = np.concatenate([(t.row[rest] << 32) | t.second[rest], (t.row[left] << 32) | t.first[left]])
        words, of = np.unique(place, return_inverse=True)
        none, some = np.zeros(left.sum()), np.zeros(rest.sum())
        counts = [np.concatenate(x) for x in ([some + 1, none], [missed[rest], none], [some, none + 1])]
        counts = [np.bincount(of, weights=c, minlength=len(words)).astype(np.int64) for c in counts]
        marked = missed & self.model.marked(keys)[which]
        rare, times = np.unique((t.row[marked] << 32) | which[marked], return_counts=True)
        lists = [_lists(words, v, rows) for v in (self.hashes[words & 0xFFFFFFFF].view(np.int64), *counts)]
        lists += [_lists(rare, v, rows) for v in (keys[rare & 0xFFFFFFFF].view(np.int64), times)]
        return [*map(pa.array, totals), *lists]


def _lists(places: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """Values by row, which the upper half of each ascending place is."""
    offsets = np.searchsorted(places, np.arange(rows + 1) << 32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


@dataclass
class Tables:
    """What tasks do not hold: (key, n, backoff) of all words, and (key, gain) of the pairs beyond the cache.

    A pair's gain is what its arc's log-probability is above the failure arc and the root's arc.
    """

    words: DataFrame
    pairs: DataFrame


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_, wanted)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == wanted


def _bound(counts: DataFrame, most: int) -> int:
    """The least count at which there are no more than ``most`` rows; what is below stays out of the cache."""
    per = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("rows"))
    rows = sorted(((r.n, r.rows) for r in per.collect()), reverse=True)  # at most 100,000 counts
    total, bound = 0, 1 << 62
    for n, many in rows:
        total += many
        if total > most:
            return bound
        bound = n
    return 0


def _bits(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit set with the bit of each ``key``, in 64-bit words; empty without keys."""
    place = F.shiftrightunsigned("key", 6).bitwiseAND(bits // 64 - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(63).cast("int"))
    got = keys.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64 if got.num_rows else 0, np.uint64)
    out[got.column("place").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def train(texts: DataFrame, how: Backoff = DEFAULT) -> tuple[Automaton, Tables]:
    """The automaton of the texts, and the tables of all words and of the pairs that it does not hold."""
    counts = hold(_counts(texts, how.least), "counts")
    words = counts.where("first is null").select(F.col("second").alias("key"), "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = float(totals.n + totals.v + 1)
    pairs = counts.where("first is not null")
    pairs = hold(pairs.join(words.select(F.col("key").alias("second"), F.col("n").alias("word_n")), "second"), "pairs")
    # something follows every word, and the end stands for the beginning: totals are the words' counts
    states = pairs.groupBy(F.col("first").alias("key")).agg(
        F.sum(F.col("n") - how.discount).alias("held"), F.sum((F.col("word_n") + 1) / size).alias("q"),
    )
    left, unseen = (F.greatest(1 - x, F.lit(1e-12)) for x in (F.col("held") / F.col("n"), F.col("q")))
    words = words.join(states, "key", "left").select("key", "n", F.coalesce(F.log10(left / unseen), F.lit(0.0)).alias("backoff"))
    words = hold(words, "states")
    release(counts)

    bound = _bound(pairs, how.pairs)
    firsts = words.select(F.col("key").alias("first"), F.col("n").alias("total"), "backoff")
    key, score = F.xxhash64("first", "second"), F.log10((F.col("n") - how.discount) / F.col("total"))
    got = pairs.where(F.col("n") >= bound).join(firsts, "first").select(key.alias("key"), score.alias("score")).toArrow()  # at most how.pairs rows
    pair, pair_score = got.column("key").to_numpy().view(np.uint64), got.column("score").to_numpy()
    by_pair = np.argsort(pair)
    rare = pairs.where(F.col("n") < bound)
    gain = score - F.col("backoff") - F.log10((F.col("word_n") + 1) / size)
    marks = _bits(rare.select(key.alias("key")), how.bits) if bound else np.zeros(0, np.uint64)
    rare = rare.join(firsts, "first").select(key.alias("key"), gain.alias("gain"))

    head = words.where(F.col("n") >= _bound(words, how.words)).toArrow()  # at most how.words rows
    word, n, backoff = (head.column(c).to_numpy() for c in ("key", "n", "backoff"))
    by_word = np.argsort(word := word.view(np.uint64))
    automaton = Automaton(
        word[by_word], n[by_word], backoff[by_word], pair[by_pair], pair_score[by_pair], marks, totals.n, totals.v
    )
    return automaton, Tables(words, rare)


def score_documents(docs: DataFrame, automaton: Automaton, tables: Tables) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, one row per row of ``docs``.

    Null and empty texts are one end token. A word that was never counted has count 0 and
    the root's share for it. Rows are told apart by their own number, so ids may repeat or
    be null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], names)

    names = ["doc_id", "n_tokens", "n_known", "base", "total", "word", "times", "root", "fails", "pair", "pair_times"]
    schema = "doc_id long, n_tokens long, n_known long, base double, total double, " + ", ".join(f"{x} array<long>" for x in names[5:])
    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    scored = hold(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words that no task holds; those on a pair's arc count for the base alone
    rest = scored.select("row", F.inline(F.arrays_zip(F.col("word").alias("key"), "times", "root", "fails")))
    found = rest.join(tables.words.withColumnRenamed("n", "c"), "key", "left").na.fill(0, ["c", "backoff"])
    share = F.log10((F.col("c") + 1) / F.lit(float(automaton.tokens + automaton.vocabulary + 1)))
    found = found.select(
        "row", (F.col("times") * share).alias("base_more"), (F.col("root") * share + F.col("fails") * F.col("backoff")).alias("more"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("also"),
    )
    if len(automaton.rare):
        rare = scored.select("row", F.inline(F.arrays_zip(F.col("pair").alias("key"), F.col("pair_times").alias("times"))))
        rare = rare.join(tables.pairs, "key")
        found = found.union(rare.select("row", F.lit(0.0), F.col("times") * F.col("gain"), F.lit(0).cast("long")))
    added = found.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("base_more", "more", "also")))
    whole = scored.drop(*names[5:]).join(added, "row", "left").na.fill(0, ["base_more", "more", "also"])
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("also")).alias("n_known"), F.lit(automaton.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_more")).alias("base_score"), (F.col("total") + F.col("more")).alias("score"),
    )
