"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all items go into one automaton that accepts every run of words
of every item. Training words are streamed through it; the state carries the longest run
that ends here and occurs in some item. Once that run is as long as a window (ten words,
or a whole shorter item), the window's words are hit, and the states on the suffix path
name the items.

The automaton is broadcast and therefore bounded: items are dealt into blocks of at most
``max_block_bytes`` of text, and each block's automaton passes over the documents in turn.
Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.rows import map_rows, plain_words

SPANS = "array<struct<first:long,last:long>>"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # either case


@dataclass(frozen=True)
class Overlap:
    """Words per window, and the bytes of item text whose automaton a task may hold."""

    window: int = 10
    max_block_bytes: int = 8 << 20


DEFAULT = Overlap()


class SuffixAutomaton:
    """Runs of words of all items; states know the items whose windows end in them."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.arcs: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for item, words in items:
            last, path = 0, []
            for word in words:
                last = self._extend(last, word)
                path.append(last)
            paths.append((item, path))
        self.items: list[set] = [set() for _ in self.link]
        self.short: list[dict[int, set]] = [{} for _ in self.link]
        for item, path in paths:
            if 0 < len(path) < window:
                self.short[path[-1]].setdefault(len(path), set()).add(item)
            for at, state in enumerate(path):
                if at + 1 < window:
                    continue
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                self.items[state].add(item)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in order:  # short items that end a state's runs
            above = self.short[self.link[state]]
            if above:
                self.short[state] = {**above, **self.short[state]}

    def _extend(self, last: int, word: bytes) -> int:
        arcs, link, length = self.arcs, self.link, self.length
        if word in arcs[last]:
            following = arcs[last][word]
            if length[following] == length[last] + 1:
                return following
            return self._split(last, word, following)
        new = self._state({}, -1, length[last] + 1)
        state = last
        while state >= 0 and word not in arcs[state]:
            arcs[state][word] = new
            state = link[state]
        if state < 0:
            link[new] = 0
        else:
            following = arcs[state][word]
            whole = length[following] == length[state] + 1
            link[new] = following if whole else self._split(state, word, following)
        return new

    def _state(self, arcs: dict, link: int, length: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, following: int) -> int:
        """A state for the shorter runs of ``following``, which gain an end that it has not."""
        copy = self._state(dict(self.arcs[following]), self.link[following], self.length[state] + 1)
        self.link[following] = copy
        while state >= 0 and self.arcs[state].get(word) == following:
            self.arcs[state][word] = copy
            state = self.link[state]
        return copy

    def overlaps(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit stretches of word numbers (first, last), merged and ascending, and the items."""
        arcs, link, lengths, window = self.arcs, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        found: set = set()
        root, state, run = arcs[0], 0, 0
        for at, word in enumerate(words):
            if state == 0:
                state = root.get(word, 0)
                run = 1 if state else 0
                if not state:
                    continue
            else:
                while state and word not in arcs[state]:
                    state = link[state]
                    run = lengths[state]
                state = arcs[state].get(word, 0)
                run = run + 1 if state else 0
            longest = 0
            if run >= window:
                longest, holder = window, state
                while lengths[link[holder]] >= window:
                    holder = link[holder]
                found |= self.items[holder]
            if self.short[state]:
                for size, items in self.short[state].items():
                    if size <= run:
                        found |= items
                        longest = max(longest, size)
            if longest:
                first = at - longest + 1
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append((first, at))
        return spans, found


def _blocks(items: DataFrame, how: Overlap) -> list[DataFrame]:
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / how.max_block_bytes))
    if n == 1:
        return [items]
    # dealt by text as well, so that one id with many texts spreads
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n))
    return [items.where(block == k) for k in range(2 * n)]


def overlaps(
    docs: DataFrame, items: DataFrame, how: Overlap = DEFAULT, keep: tuple[str, ...] = ("doc_id", "text"), text: str = "text"
) -> DataFrame:
    """The columns ``keep``, among them ``text``, n_words, spans (hit word numbers, first to last) and items.

    ``items`` has ``item_id`` and ``text``. Null and wordless texts have no words, and
    wordless items no windows. An item without an id hits like any other, but is not among
    ``items``; repeated items count once. One row per row of ``docs``; other columns are
    ignored.
    """
    out = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    at, window = list(keep).index(text), how.window
    spark = docs.sparkSession
    once = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    for block in _blocks(once, how):
        texts = [(r.item_id, plain_words(r.text)) for r in block.collect()]
        shared = spark.sparkContext.broadcast(texts)

        def start(shared=shared):
            automaton = SuffixAutomaton(shared.value, window)

            def body(*row):
                words = plain_words(row[at])
                spans, found = automaton.overlaps(words)
                spans = merged([*((s["first"], s["last"]) for s in row[-2]), *spans]) if row[-2] else spans
                named = sorted({*row[-1], *found} - {None}) if found else row[-1]
                return [(*row[:-3], len(words), [{"first": a, "last": b} for a, b in spans], named)]

            return body

        out = map_rows(out, start, _ddl(out))
    return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that touch or overlap joined, ascending."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def n_hit(spans: str = "spans") -> Column:
    """Words inside the stretches."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def items_digest(items: str = "items") -> Column:
    """Hex SHA-256 of the sorted ids, comma-joined; of the empty string where there are none."""
    return F.sha2(F.array_join(items, ","), 256)


def without_overlaps(
    docs: DataFrame, items: DataFrame, how: Overlap = DEFAULT, max_run: int = 0, max_share: float = 0.5
) -> DataFrame:
    """``docs`` without the stretches longer than ``max_run`` hit words.

    A document whose hit words exceed ``max_share`` of its words is removed whole, the text
    of the others loses the stretches, from first to last word. Columns and their order
    stay; ``n_chars``, where there is one, is that of the new text. Null texts stay null.
    """
    names = docs.columns
    plain = [f"_{k}" for k in range(len(names))]
    out = overlaps(docs.toDF(*plain), items, how, tuple(plain), plain[names.index("text")])
    out = out.where(n_hit() <= F.lit(max_share) * F.col("n_words"))
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def start():
        def body(*row):
            row, spans = list(row[: len(names)]), row[-1]
            cut = [s for s in spans or () if s["last"] - s["first"] + 1 > max_run]
            if cut:
                text, places = row[at], list(_WORD.finditer(row[at]))
                kept, begin = [], 0
                for s in cut:
                    kept.append(text[begin : places[s["first"]].start()])
                    begin = places[s["last"]].end()
                row[at] = "".join([*kept, text[begin:]])
                if chars is not None:
                    row[chars] = len(row[at])
            return [tuple(row)]

        return body

    return map_rows(out.select(*plain, "spans"), start, _ddl(docs))
