"""License scans: an exact set-similarity join of windows of words with license templates.

Templates are the paragraphs of whole published texts and the notices that licenses ask
for. A block is a window of as many words as the template has, divided by the threshold,
at every word of the text, whatever its lines; block and template are sets of words. A
block matches when it contains at least ``percent`` of the template's words, that is
``need`` of them. All sets are ordered by the words' frequency over all texts, rarest
first, so that

* prefix: a match shares a word of the template's first ``size - need + 1`` words,
* length: a window with fewer than ``need`` template words, and a text without that many, is not counted,
* position: windows slide over the places of template words only, and what a window leaves is taken off,

and what passes is counted in full. No match is lost; the filters only save work.

Templates are a parameter and small; frequencies are counted for their words alone.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.license_texts import NOTICES, TEXTS
from lamella.llm.rows import map_rows, plain_words

# Fixed values of the base scan: phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}



def paragraphs(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(paragraph, label) of whole license texts."""
    return [(" ".join(p.split()), label) for label, text in texts.items() for p in text.split("\n\n") if plain_words(p)]


TEMPLATES = [*paragraphs(TEXTS), *NOTICES.items()]


def _counts(docs: DataFrame, vocabulary: set[bytes]) -> DataFrame:
    """word, n: texts that hold each word of the vocabulary, added up in each task."""

    def run(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(vocabulary.intersection(plain_words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Matcher:
    """Templates in global word order, with an index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], percent: int, frequency: dict[bytes, int]):
        texts = [(plain_words(text), text, label) for text, label in templates if plain_words(text)]
        ordered = sorted({w for words, _, _ in texts for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {word: place for place, word in enumerate(ordered)}
        self.words = [frozenset(words) for words, _, _ in texts]
        self.need = [math.ceil(len(words) * percent / 100) for words in self.words]
        self.window = [math.ceil(len(words) * 100 / percent) for words, _, _ in texts]
        self.names, self.labels = [text for _, text, _ in texts], [label for _, _, label in texts]
        self.first: list[frozenset[bytes]] = []
        self.prefixes: dict[bytes, list[int]] = {}
        for t, words in enumerate(self.words):
            rarest = sorted(words, key=self.rank.__getitem__)[: len(words) - self.need[t] + 1]
            self.first.append(frozenset(rarest))
            for word in rarest:
                self.prefixes.setdefault(word, []).append(t)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """Template, first and last word, and highest containment of each stretch of matching windows."""
        if self.prefixes.keys().isdisjoint(words):
            return []
        held = [(at, word) for at, word in enumerate(words) if word in self.rank]
        present = {word for _, word in held}
        out = []
        for t in sorted({t for word in present & self.prefixes.keys() for t in self.prefixes[word]}):
            if len(present & self.words[t]) >= self.need[t]:  # length: the whole text holds enough of them
                out += [(t, *stretch) for stretch in self._stretches(t, held)]
        return out

    def _stretches(self, t: int, held: list[tuple[int, bytes]]) -> list[tuple[int, int, float]]:
        own, need, window, rarest = self.words[t], self.need[t], self.window[t], self.first[t]
        places = [(at, word) for at, word in held if word in own]
        found: list[list] = []
        inside: Counter = Counter()
        begin = seeds = 0
        for end, (at, word) in enumerate(places):
            inside[word] += 1
            seeds += word in rarest
            while at - places[begin][0] >= window:
                gone = places[begin][1]
                inside[gone] -= 1
                seeds -= gone in rarest
                if not inside[gone]:
                    del inside[gone]
                begin += 1
            # prefix and length before the count itself; the position filter is that only places inside count
            if seeds and end - begin + 1 >= need and len(inside) >= need:
                first, share = places[begin][0], len(inside) / len(own)
                if found and first <= found[-1][1]:
                    found[-1][1:] = [at, max(found[-1][2], share)]
                else:
                    found.append([first, at, share])
        return [tuple(x) for x in found]


    def named(self, found: list[tuple[int, int, int, float]]) -> set[str]:
        """Labels of the matches that no better one of another label overlaps by half.

        Better is a higher containment, then more words: license texts that differ in a word match each other's templates.
        """
        kept: list[tuple[tuple[float, int], int, int, str]] = []
        for t, first, last, share in sorted(found, key=lambda m: (-m[3], -len(self.words[m[0]]), m[1])):
            rank, label = (share, len(self.words[t])), self.labels[t]
            beaten = any(
                2 * (min(last, b) - max(first, a) + 1) >= min(last - first, b - a) + 1 and other != label and better > rank
                for better, a, b, other in kept
            )
            if not beaten:
                kept.append((rank, first, last, label))
        return {label for *_, label in kept}


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """Word number and label of each place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        last, at = phrase[-1], -1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            first = at - len(phrase) + 1
            if first >= 0 and words[first : at + 1] == phrase:
                out.append((first, label))
    return out


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = 90
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches.

    ``matches`` lists each stretch of windows that contain ``percent`` of a template's words:
    first and last word number, template and highest containment. ``labels`` are those of
    phrases and matches, sorted; where stretches of several labels overlap, the highest
    containment counts, then the larger template, and equal ones all count. ``score`` is 1
    where a phrase was found, else the highest containment, else 0. Null and empty texts have no words and no labels. One row per row of ``docs``,
    whose other columns are ignored.
    """
    vocabulary = {w for text, _ in templates for w in plain_words(text)}
    frequency = {bytes(r.word): r.n for r in _counts(docs, vocabulary).collect()}  # at most one row per template word
    matcher = Matcher(templates, percent, frequency)
    wanted = [(plain_words(p), label) for p, label in phrases.items()]

    def start():
        def body(doc_id, text):
            words = plain_words(text)
            places = phrase_places(words, wanted)
            base = {label for _, label in places}
            found = matcher.matches(words)
            labels = base | matcher.named(found)
            firsts = [at for at, _ in places]
            score = 1.0 if places else max((share for _, _, _, share in found), default=0.0)
            return [(
                doc_id, len(words), len(places), min(firsts, default=None), max(firsts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score,
                [{"first": a, "last": b, "template": matcher.names[t], "containment": share} for t, a, b, share in found],
            )]

        return body

    return map_rows(
        docs.select("doc_id", "text"), start,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<first:long,last:long,template:string,containment:double>>",
    )
