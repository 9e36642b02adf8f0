"""Best-fit packing with certified bin counts.

Documents are tokenized and only those longer than a sequence are cut. Pieces of full
length are sequences of their own. The others are dealt into partitions of bounded size,
each packed by best-fit decreasing. Dual feasible functions give a lower bound of the
sequences that a partition's pieces need; a partition that meets its bound is certified and
its sequences are final. A partition with a gap keeps its full sequences and hands the
pieces of the others on; those pieces are dealt anew, exchanged between partitions, and
packed again. After the last round the remaining partitions are final as they are.

Only ids, lengths and checksums travel; tokens stay where they were made.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.rows import hold

LONG_RUN = 4096  # characters of white space in one run that are left to the library
SAMPLED = 64  # of so many characters the first one is looked at before all are


@dataclass(frozen=True)
class Packing:
    """Tokens per sequence, the id that ends a document, pieces per partition, and rounds of exchange."""

    length: int = 1024
    end: int = 2
    per_partition: int = 20_000
    rounds: int = 4


DEFAULT = Packing()


# The published pattern of byte-level tokenizers, and the bytes that stand for themselves in their files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_pair_encoder(path: str):
    """Function from text to an array of ids, for a byte-level vocabulary file of the ``tokenizers`` library.

    Ids of such a vocabulary rise with the order of merges, so it can be run as ranks, which
    is faster; the tests hold the ids against the library's own.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    others = [b for b in range(256) if b not in PRINTED]
    byte = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): id_ for token, id_ in content["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    if not special:  # the array's way looks for these at every place if there are none
        return lambda text: np.array(encoding.encode_ordinary(text), "<u4")
    return functools.partial(encoding.encode_to_numpy, disallowed_special=())


class Encoder:
    """Token ids of texts.

    A text that holds one of the file's added tokens literally is left to ``tokenizers``,
    which gives these their own ids. The ranks' engine overflows its stack on runs of about a
    million white-space characters, so a text with long runs is cut: a blank or line end after
    another character always begins a new token, so the ids of a text are those of its
    stretches up to such places, one after the other. Stretches with long runs are encoded by
    ``tokenizers``. All other texts are run as ranks as they are, each in one call.
    """

    def __init__(self, path: str):
        self.path = path
        self.encode = byte_pair_encoder(path)
        self.long_run = re.compile(rf"\s{{{LONG_RUN}}}")
        self.sampled_run = re.compile(rf"\s{{{LONG_RUN // SAMPLED}}}")
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file)["added_tokens"]]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def has_long_run(self, text: str) -> bool:
        """Whether ``LONG_RUN`` white-space characters stand together; every so many characters are looked at first."""
        return len(text) >= LONG_RUN and bool(self.sampled_run.search(text[::SAMPLED]) and self.long_run.search(text))

    def _ids(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            found = self.library.encode(text, add_special_tokens=False).ids
        elif not self.has_long_run(text):
            found = self.encode(text)
        else:
            return b"".join(map(self._stretch_ids, stretches(text)))
        return np.asarray(found, "<u4").tobytes()

    def _stretch_ids(self, stretch: str) -> bytes:
        found = self.library.encode(stretch, add_special_tokens=False).ids if self.has_long_run(stretch) else self.encode(stretch)
        return np.asarray(found, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._ids(text) for text in texts]


def stretches(text: str) -> list[str]:
    """The text cut before each blank or line end that follows another character."""
    out: list[str] = []
    for number, line in enumerate(text.split("\n")):
        parts = line.split(" ")
        parts[1:] = [" " + part for part in parts[1:]]
        if number:
            parts[0] = "\n" + parts[0]
        out += parts
    if "  " in text or "\n\n" in text or any(s[-1:].isspace() for s in out) or "" in out:
        whole: list[str] = []
        run: list[str] = []  # white space before a cut stays with what follows
        for part in out:
            if not part or part[-1].isspace():
                run.append(part)
            elif run:
                whole.append("".join(run) + part)
                run = []
            else:
                whole.append(part)
        return [*whole, "".join(run)] if any(run) else whole
    return out


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)  # kept by the Python worker from task to task


def token_pieces(docs: DataFrame, tokenizer: str, how: Packing = DEFAULT, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids themselves.

    The ids of a text, then ``how.end``; a null text is empty. Where they exceed a sequence
    the first piece takes the remainder and the others are full.
    """
    length, end = how.length, np.asarray([how.end], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(texts)):
                    ids += end
                    total = len(ids) // 4
                    first = total % length or length
                    edges = [0, *range(first, total + 1, length)]
                    for number, (a, b) in enumerate(zip(edges, edges[1:])):
                        own = ids[4 * a : 4 * b]
                        row = (doc_id, number, a, b - a, zlib.crc32(own))
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if keep_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: dict[int, list[int]] = {}
    rooms: list[int] = []
    made = 0
    for k, size in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            bin_ = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
        else:
            room, bin_, made = capacity, made, made + 1
        bins[k], offsets[k] = bin_, capacity - room
        left = room - size
        if left:
            if left not in open_at:
                open_at[left] = []
                insort(rooms, left)
            open_at[left].append(bin_)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions.

    The function of t counts pieces longer than capacity - t whole, drops those up to t,
    and takes the others as they are, in units of the capacity; that of k rounds lengths
    down to parts of k + 1, exact multiples excepted.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    upto, mass = np.cumsum(counts), np.cumsum(counts * size)
    for t in range(1, capacity // 2 + 1):
        whole = int(upto[capacity] - upto[capacity - t])
        middle = int(mass[capacity - t] - mass[t - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 51):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _pack(pieces: DataFrame, how: Packing, round_: int, last: bool) -> DataFrame:
    """Pieces with place ``bin``, ``offset`` and ``final``, packed partition by partition."""
    capacity = how.length

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        made = int(bins.max()) + 1
        certified = made == lower_bound(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=made)
        final = np.full(len(group), True) if certified or last else filled[bins] == capacity
        return group.assign(bin=bins, offset=offsets, final=final)

    packed = pieces.groupBy("part").applyInPandas(pack, f"{_DDL}, part long, bin long, offset long, final boolean")
    return packed.withColumn("round", F.lit(round_))


_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(pieces: DataFrame, how: Packing = DEFAULT) -> DataFrame:
    """The pieces with sequence_id and offset.

    Pieces are dealt by a hash of their columns and place in the table, so that equal rows
    spread. An empty table gives an empty one. Written to tables of the shared folder.
    """
    columns = [c.split()[0] for c in _DDL.split(", ")]
    pieces = pieces.select(*columns)
    # the numbers of a full piece's own sequence: negative, unlike the packed ones
    alone = pieces.where(F.col("length") == how.length).select(*columns, F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < how.length)
    done: list[DataFrame] = []
    for round_ in range(how.rounds):
        n = left.count()
        if not n:
            break
        parts = math.ceil(n / how.per_partition)
        last = round_ == how.rounds - 1 or (parts == 1 and round_ > 0)
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(round_), *columns, F.monotonically_increasing_id()), F.lit(parts)))
        packed = hold(_pack(dealt, how, round_, last), "packed")
        done.append(packed.where("final"))
        left = packed.where("not final").select(*columns)
        if last:
            break
    full = alone.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    # round, partition and bin in one number; each has its own digits
    number = (F.col("part") * how.rounds + F.col("round")) * how.per_partition * 8 + F.col("bin")
    out = full.select(*columns, "sequence_id", "offset")
    for packed in done:
        out = out.union(packed.select(*columns, number.alias("sequence_id"), "offset"))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, how: Packing = DEFAULT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    Rows that share a doc_id, or have none, are documents of their own; other columns are
    ignored.
    """
    return pack(hold(token_pieces(docs, tokenizer, how), "pieces"), how)
