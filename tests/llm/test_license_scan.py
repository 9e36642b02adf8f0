"""License scans against comparing every block with every template."""

from __future__ import annotations

import math
import random
import re
import textwrap

from lamella.llm.license_scan import PHRASES, TEMPLATES, scan_licenses
from lamella.llm.license_texts import TEXTS

DOCS = "doc_id long, text string, labels string"


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def by_hand(text, percent):
    """Every window of every template, as sets."""
    words = words_of(text)
    places = [
        (at, label) for phrase, label in PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()
    ]
    found = set()
    for template, _ in TEMPLATES:
        wanted, size = set(words_of(template)), math.ceil(len(words_of(template)) * 100 / percent)
        if not wanted & set(words):
            continue
        stretches = []
        for start in range(max(1, len(words) - size + 1)):
            block = words[start : start + size]
            share = len(wanted & set(block)) / len(wanted)
            if 100 * len(wanted & set(block)) >= percent * len(wanted):
                held = [start + k for k, w in enumerate(block) if w in wanted]
                stretches.append([held[0], held[-1], share])
        merged = []
        for first, last, share in sorted(stretches):
            if merged and first <= merged[-1][1]:
                merged[-1][1:] = [max(last, merged[-1][1]), max(share, merged[-1][2])]
            else:
                merged.append([first, last, share])
        found |= {(first, last, template, share) for first, last, share in merged}
    return words, places, found


def corpus(seed):
    pick = random.Random(seed)
    loose = [w for t, _ in TEMPLATES for w in words_of(t)] + ["zzz", "été", "ÉTÉ", "4"]
    texts = [None, "", "...\n\n?", "MIT license mit LICENSE", "general public general public license", "mit\nlicense x"]
    texts += ["a b c\n" + t.replace(" ", "\n", 4) + " tail\nmore" for t, _ in TEMPLATES]
    for t, _ in TEMPLATES:
        w = t.split()
        w[pick.randrange(len(w))] = pick.choice(loose)
        w.insert(pick.randrange(len(w)), "more words between")
        texts.append(" ".join(w if len(w) > 20 else pick.sample(w, len(w))))
    texts += ["\n".join(" ".join(pick.choices(loose, k=pick.randrange(20))) for _ in range(6)) for _ in range(10)]
    return list(enumerate(texts))


def test_all_blocks_above_the_threshold(spark):
    for percent in (90, 70):
        documents = corpus(percent)
        df = spark.createDataFrame([(d, t, "clash") for d, t in documents], DOCS)
        got = {r.doc_id: r for r in scan_licenses(df, percent=percent).collect()}
        assert len(got) == len(documents)
        for doc_id, text in documents:
            words, places, found = by_hand(text, percent)
            r, starts = got[doc_id], [at for at, _ in places]
            assert (r.n_words, r.n_base) == (len(words), len(places))
            assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
            assert {(m["first"], m["last"], m.template, m.containment) for m in r.matches} == found
            base = {label for _, label in places}
            assert r.base_labels == ",".join(sorted(base))
            assert base <= set(r.labels.split(",")) | {""} and set(r.labels.split(",")) <= base | {l for t, l in TEMPLATES for m in found if m[2] == t} | {""}
            assert r.score == (1.0 if places else max((s for *_, s in found), default=0.0))


def labels_of(spark, texts):
    df = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], DOCS)
    return [r.labels for r in scan_licenses(df).orderBy("doc_id").collect()]


def test_whole_texts_have_their_own_label(spark):
    wanted = [",".join(sorted({label, *(["gpl"] if "General Public" in text else [])})) for label, text in TEXTS.items()]  # base phrases stay
    assert labels_of(spark, list(TEXTS.values())) == wanted
    commented = ["\n".join(f" * {line}" for line in textwrap.wrap(" ".join(t.split()), 40)) for t in TEXTS.values()]
    assert labels_of(spark, commented) == wanted


def test_wrapped_notices_and_words_far_apart(spark):
    mit = "# Permission is hereby\n# granted, free of charge,\n# to any person\n# obtaining a copy\n# of this software and associated documentation"
    rest = TEXTS["mit"].split("documentation", 1)[1]
    old = "the work was licensed to him under the old act of 1999 and by then 4 of 0 cc members"
    words = ["licensed", "under", "cc", "by", "4", "0"]
    scattered = " ".join(words[k // 1000] if k % 1000 == 0 and k < 6000 else "filler" for k in range(7000))
    long = "filler " * 300_000 + "Licensed under\nCC BY 4.0. " + "filler licensed by " * 100_000
    assert labels_of(spark, [mit + rest, old, scattered, long]) == ["mit", "", "", "cc-by"]


def test_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert scan_licenses(df).count() == 0
    one = scan_licenses(spark.createDataFrame([(None, "MIT License", ""), (None, "MIT License", "")], DOCS)).collect()
    assert [(r.doc_id, r.labels) for r in one] == [(None, "mit")] * 2
