"""Language identification: the kernel by sets, and accuracy on held-out documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lamella.llm.language_id import Spectrum, fitted, held_out, identify, spectrum, training_texts

DOCS = "doc_id long, text string, lang string, score string"


def runs(text):
    b = text.lower().encode()
    return {b[k : k + n] for n in (1, 2, 3) for k in range(len(b) - n + 1)}


def test_kernel_is_the_share_of_common_runs():
    texts = ["Ähnlich", "a", "ab", "the cat sat on the mat", "ÄÖ äö ÄÖ"]
    model = fitted([("x", texts[0]), ("y", texts[3])])
    kernel = model.kernel([spectrum(t) for t in texts])
    for row, t in zip(kernel, texts):
        for value, mark in zip(row, (texts[0], texts[3])):
            a, b = runs(t), runs(mark)
            assert value == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), rel=1e-5)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = fitted(training_texts(df.where(~held_out())))
    got = identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where(held_out())
    right, n, low, high = got.selectExpr("count_if(lang = lang_pred)", "count(*)", "min(score)", "max(score)").first()
    assert right >= 0.99 * n and 0 <= low and high <= 1


def test_sample_is_bounded_and_has_every_language(spark):
    rows = [(k, f"text number {k}", "en" if k % 50 else "xx", "") for k in range(5000)] + [(None, None, "zz", ""), (7, "a", None, "")]
    df = spark.createDataFrame(rows, DOCS)
    sample = training_texts(df, Spectrum(training=60))
    assert {lang for lang, _ in sample} == {"en", "xx"} and len(sample) < 200


def test_five_hundred_languages_are_all_learned(spark):
    name = lambda k: "".join(chr(97 + b % 26) for b in hashlib.md5(str(k).encode()).digest()[:8])
    rows = [(k * 4 + n, f"{name(k) * 4} {name(k)}{n}", name(k), "") for k in range(500) for n in range(4)]
    rows += [(10**6, "one text of many copies", "zz", "")] * 700
    sample = training_texts(spark.createDataFrame(rows, DOCS), Spectrum(landmarks_in_all=600, texts_in_all=3000))
    assert len({lang for lang, _ in sample}) == 501 and len([x for x, _ in sample if x == "zz"]) == 1
    model = fitted(sample, Spectrum(landmarks_in_all=600, texts_in_all=3000, numbers=1 << 22))
    assert len(model.languages) == 501 and model.landmarks.shape[0] == 501
    assert fitted(sample, Spectrum(numbers=1 << 20)).landmarks.size <= 1 << 20
    found = [lang for lang, _ in model.predict([f"{name(k) * 5}" for k in range(500)])]
    assert sum(a == name(k) for k, a in enumerate(found)) >= 495


def plain_prediction(sample, texts, how):
    """Kernel ridge regression on Nystrom features, with dense matrices over all pairs."""
    sample = [(lang, t) for lang, t in sample if any(map(str.isalpha, t))]
    langs = sorted({lang for lang, _ in sample})
    marks = [t for lang in langs for t in [x for y, x in sample if y == lang][: how.landmarks]]
    marks = sorted(marks, key=[t for _, t in sample].index)
    k = lambda a, b: np.array([[len(runs(x) & runs(y)) / np.sqrt(len(runs(x)) * len(runs(y))) for y in b] for x in a])
    values, vectors = np.linalg.eigh(k(marks, marks))
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = k([t for _, t in sample], marks) @ root
    y = np.array([[float(lang == other) for other in langs] for lang, _ in sample])
    w = np.array([1 / sum(other == lang for other, _ in sample) for lang, _ in sample])
    solved = np.linalg.solve(features.T @ (features * w[:, None]) + how.ridge * np.eye(features.shape[1]), features.T @ (y * w[:, None]))
    decisions = k(texts, marks) @ root @ solved
    return [(langs[row.argmax()], min(1.0, max(0.0, row.max()))) for row in decisions]


def test_predictions_against_plain_kernel_ridge(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 30 and 600")
    how = Spectrum(landmarks=4, training=12)
    sample = training_texts(df, how)
    texts = [r.text for r in df.limit(25).collect()]
    for (lang, score), (want, want_score) in zip(fitted(sample, how).predict(texts), plain_prediction(sample, texts, how)):
        assert lang == want and score == pytest.approx(want_score, abs=2e-3)


def test_no_letters_nulls_and_nothing(spark):
    rows = [(1, None, "en", ""), (2, " 12 ?!", "en", ""), (None, "hello there", "en", ""), (None, "hello there", "en", ""), (5, "", "en", "")]
    df = spark.createDataFrame(rows, DOCS)
    model = fitted([("de", "guten tag und auf wiedersehen"), ("en", "hello there the weather is fine")])
    got = sorted((r.doc_id or 0, r.lang_pred) for r in identify(df, model).collect())
    assert got == [(0, "en"), (0, "en"), (1, "und"), (2, "und"), (5, "und")]
    nothing = fitted(training_texts(df.limit(0)))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert identify(df.limit(0), model).count() == 0


def test_very_long_texts(spark):
    model = fitted([("de", "guten tag und auf wiedersehen"), ("en", "hello there the weather is fine")])
    texts = ["hello there the weather is fine ", "guten tag und auf wiedersehen ", "7 "]
    df = spark.createDataFrame([(k, t * 100_000, "", "") for k, t in enumerate(texts)], DOCS)
    assert [r.lang_pred for r in identify(df, model).orderBy("doc_id").collect()] == ["en", "de", "und"]
