"""Language identification with a blended-spectrum string kernel.

A text is the set of its runs of one to three UTF-8 bytes, lower-cased (a blended spectrum,
by presence). The kernel of two texts is the share of runs they have in common,
|A and B| / sqrt(|A| |B|). Landmark texts of every language span a Nystrom approximation,
in which one-versus-rest kernel ridge regression is solved; texts are scored in batches as
products of presence, landmark and weight matrices.

Landmarks and training rows are a sample of bounded size per language, by hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
_BATCH = 128


@dataclass(frozen=True)
class Spectrum:
    """Landmarks and training texts per language, landmarks and texts in all, numbers in the landmarks, the ridge.

    With many languages each has fewer landmarks and texts; one text at least.
    """

    landmarks: int = 32
    training: int = 400
    landmarks_in_all: int = 1024
    texts_in_all: int = 160_000
    numbers: int = 1 << 26  # float32 each
    ridge: float = 1e-3


DEFAULT = Spectrum()


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Documents that nothing is learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def spectrum(text: str) -> np.ndarray:
    """Sorted codes of the runs of one, two and three bytes that occur in the text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int32)
    two = (b[:-1] << 8) + b[1:]
    three = (two[:-1] << 8) + b[2:]
    found = [np.unique(part) for part in (b, two, three)]
    return np.concatenate([found[0], found[1] + (1 << 8), found[2] + (1 << 8) + (1 << 16)])


@dataclass
class Classifier:
    """Runs of the landmarks, their presence there (normalised), and the weights per language."""

    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def kernel(self, spectra: list[np.ndarray]) -> np.ndarray:
        present = np.zeros((len(spectra), len(self.codes)), np.float32)
        for row, codes in zip(present, spectra):
            at = np.searchsorted(self.codes, codes)
            at[at == len(self.codes)] = 0
            row[at[self.codes[at] == codes]] = 1 / np.sqrt(len(codes))
        return present @ self.landmarks.T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score from 0 to 1; unknown, with score 0, where a text has no letter."""
        lettered = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if self.languages and lettered:
            decisions = self.kernel([spectrum(texts[k]) for k in lettered]) @ self.weights
            for k, row in zip(lettered, decisions):
                best = int(row.argmax())
                out[k] = (self.languages[best], float(min(1.0, max(0.0, row[best]))))
        return out


def _first_of_each(texts: list[tuple[str, str]], n: int) -> list[int]:
    taken: dict[str, int] = {}
    chosen = []
    for k, (lang, _) in enumerate(texts):
        if taken.setdefault(lang, 0) < n:
            taken[lang] += 1
            chosen.append(k)
    return chosen


def fitted(texts: list[tuple[str, str]], how: Spectrum = DEFAULT) -> Classifier:
    """Classifier of (language, text) rows; the first of each language are its landmarks."""
    texts = [(lang, text) for lang, text in texts if any(map(str.isalpha, text))]
    languages = sorted({lang for lang, _ in texts})
    spectra = [spectrum(text) for _, text in texts]
    if not texts:
        return Classifier(np.empty(0, np.int32), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32), [])
    each = min(how.landmarks, max(1, how.landmarks_in_all // len(languages)))
    chosen = _first_of_each(texts, each)
    codes = np.unique(np.concatenate([spectra[k] for k in chosen]))
    while len(chosen) * len(codes) > how.numbers and len(chosen) > 1:
        each //= 2  # below one, languages share landmarks
        chosen = _first_of_each(texts, each) if each else chosen[::2]
        codes = np.unique(np.concatenate([spectra[k] for k in chosen]))
    model = Classifier(codes, np.zeros((1, len(codes)), np.float32), np.empty((0, 0)), languages)
    rows = np.zeros((len(chosen), len(codes)), np.float32)
    for row, k in zip(rows, chosen):
        row[np.searchsorted(codes, spectra[k])] = 1 / np.sqrt(len(spectra[k]))
    model.landmarks = rows
    between = (rows @ rows.T).astype(np.float64)
    values, vectors = np.linalg.eigh(between)
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # between^(-1/2), up to a rotation
    features = np.concatenate([model.kernel(spectra[k : k + _BATCH]) for k in range(0, len(spectra), _BATCH)]) @ root
    place = {lang: k for k, lang in enumerate(languages)}
    which = np.array([place[lang] for lang, _ in texts])
    target = np.zeros((len(texts), len(languages)))
    target[np.arange(len(texts)), which] = 1
    # each language weighs the same, however many texts it has
    weight = (1 / np.bincount(which))[which][:, None]
    gram = features.T @ (features * weight) + how.ridge * np.eye(features.shape[1])
    model.weights = (root @ np.linalg.solve(gram, features.T @ (target * weight))).astype(np.float32)
    return model


def training_texts(docs: DataFrame, how: Spectrum = DEFAULT) -> list[tuple[str, str]]:
    """At most ``how.training`` texts or so of each language, of all of them.

    Taken by hash of id and text under a threshold that the language's count sets, so the
    sample is spread over the table; copies of one id and text count once. With more than
    ``texts_in_all`` languages, the more frequent ones are learned.
    """
    known = docs.where("lang is not null and text is not null and trim(text) <> ''").select("doc_id", "text", "lang")
    hashed = F.xxhash64(F.lit("sample"), "doc_id", "text")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(hashed, 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(how.texts_in_all)
    n_languages = counts.count()
    each = min(how.training, max(1, how.texts_in_all // max(1, n_languages)))
    share = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    rows = known.join(F.broadcast(counts), "lang").where(share < each / F.col("n")).dropDuplicates(["doc_id", "text", "lang"])
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").select("lang", "text").collect()
    return [(r.lang, r.text) for r in rows]


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, lang_pred and score, one row per row of ``docs``; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when
    there was nothing to learn from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
