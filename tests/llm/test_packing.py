"""Packing: exact token round trip, gapless sequences, bounds against exhaustive search."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamella.llm.packing import Encoder, Packing, best_fit_decreasing, lower_bound, pack, pack_documents, stretches, token_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, piece string, offset string"


def odd_texts():
    pick = random.Random(4)
    marks = ["a", "é", "Ab", " ", "  ", "\n", "\t", "\r\n", "'s", "12", "½", "😀", "<|endoftext|>", "\x1c", " ", ".", "\x0b", "#"]
    return ["", " ", "\n", " \n ", "a  b", "a\n\n b ", *("".join(pick.choices(marks, k=pick.randrange(1, 60))) for _ in range(300))]


def test_stretches_have_the_ids_of_the_whole():
    whole = Tokenizer.from_file(PATH)
    texts = odd_texts()
    assert all("".join(stretches(t)) == t for t in texts)
    for ids, text in zip(Encoder(PATH).ids(texts), texts):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_whole_vocabulary_and_given_texts():
    whole = Tokenizer.from_file(PATH)
    texts = [t for t, in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' limit 1500").fetchall()]
    texts += [whole.decode([k]) for k in range(0, 50256, 7)]
    ids = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH).ids(texts)] == ids


@pytest.mark.parametrize("run", [" ", "\n", "a", "\t", "\u2003", "\r\n"])
def test_long_runs(run):
    whole = Tokenizer.from_file(PATH)
    texts = [run * (2_000_000 // len(run)), "a b" + run * 5000 + "c  d " + run * 4095]
    for ids, text in zip(Encoder(PATH).ids(texts), texts):
        assert "".join(stretches(text)) == text
        assert np.array_equal(np.frombuffer(ids, "<u4"), whole.encode(text, add_special_tokens=False).ids)


def test_added_tokens_have_their_own_ids():
    whole = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "plain", "<|endoftext|><|endoftext|>", "x" * 5000 + " <|endoftext|>\n\n y", "<|endoftext", "<|endoftext|>" + " " * 2_000_000]
    ids = [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH).ids(texts)]
    assert ids == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in ids[0] and 50256 not in ids[4]


def test_texts_are_encoded_in_one_call_each():
    texts = [t for t, in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null limit 300").fetchall()]
    texts += ["a b " * 5000, "x" * 70 + " " * 4000 + "\n" * 95 + "y", "word" + " " * 4095 + "b" * 9000]
    encoder, calls = Encoder(PATH), []
    plain = encoder.encode
    encoder.encode = lambda text: calls.append(text) or plain(text)
    ids = encoder.ids(texts)
    assert calls == texts
    whole = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("before", [0, 1, 63, 64, 65, 4095])
def test_runs_of_the_long_length_are_seen_wherever_they_begin(before):
    encoder = Encoder(PATH)
    for n, seen in ((4095, False), (4096, True), (4160, True)):
        for run in (" " * n, (" \n\t" * n)[:n]):
            assert encoder.has_long_run("x" * before + run + "y") == seen


def check(rows, documents, capacity=1024):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in documents:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            own = np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.ids_crc32 == zlib.crc32(own) and r.length <= capacity
            at += r.length
        assert at == len(ids) and (len(pieces) == 1 or all(r.length == capacity for r in pieces[1:]))
    assert not by_doc
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sequences, tokens = check(pack_documents(df, PATH).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert sequences <= 1.004 * tokens / 1024 + 2


@pytest.mark.parametrize("per_partition", [7, 50])
def test_exchange_between_partitions(spark, per_partition):
    pick = random.Random(per_partition)
    documents = [(k, " word" * (pick.choice([30, 300, 400, 600, 700]) + pick.randrange(80))) for k in range(200)] + [(500, None), (501, " x" * 3000), (502, "")]
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in documents], DOCS)
    how = Packing(per_partition=per_partition)
    sequences, _ = check(pack_documents(df, PATH, how).collect(), documents)
    lengths = np.array([r.length for r in token_pieces(df, PATH).collect()])
    assert sequences <= lower_bound(lengths, 1024) * (1.2 if per_partition < 10 else 1.06) + 1


def test_bound_and_best_fit_against_search():
    pick = random.Random(1)

    def fewest(lengths, capacity):
        best = [len(lengths)]

        def place(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
                place(k + 1, [*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]])
            place(k + 1, [*rooms, capacity - lengths[k]])

        place(0, [])
        return best[0]

    for _ in range(150):
        capacity = pick.randrange(5, 30)
        lengths = sorted((pick.randrange(1, capacity + 1) for _ in range(pick.randrange(1, 9))), reverse=True)
        bins, offsets = best_fit_decreasing(np.array(lengths), capacity)
        load = np.bincount(bins, weights=lengths)
        assert load.max() <= capacity and set(bins.tolist()) == set(range(len(load)))
        assert lower_bound(np.array(lengths), capacity) <= fewest(lengths, capacity) <= len(load)


def test_ids_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b", "", ""), (None, "a b", "", ""), (1, None, "", "")], DOCS)
    out = pack_documents(df, PATH).collect()
    assert len(out) == 3 and len({(r.sequence_id, r.offset) for r in out}) == 3
    assert [r.ids for r in token_pieces(df.where("doc_id = 1"), PATH, keep_ids=True).collect()] == [[2]]
    assert pack_documents(df.limit(0), PATH).count() == 0
    assert pack(token_pieces(df.limit(0), PATH)).count() == 0
