"""Fill-in-the-middle: texts cut at two ranks of their units and put together anew.

A unit is a run of ASCII letters or any other single character. The units of a text are
kept in an indexable skip list: a link of lane k spans ``FAN`` ** k units and carries its
width in units and in code points. Descending from the highest lane, a rank is reached by
adding up widths, with at most ``FAN`` links per lane, and the code points passed are the
place of the cut. The lanes are arrays; a text of n units has n (1 + 1/15) links.

Each text is worked on by itself, in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.rows import map_rows

FAN = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class FillInMiddle:
    """Seed of the draws, percent of texts left plain, and percent of the others in suffix-first form."""

    seed: int = 1
    plain_percent: int = 10
    suffix_first_percent: int = 20


DEFAULT = FillInMiddle()


def unit_edges(text: str) -> np.ndarray:
    """Where the units begin, in code points, and the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (points | 32) - np.uint32(97) < 26  # unsigned: wraps below
    starts = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], starts, [len(points)]]) if len(points) else np.zeros(1, np.int64)


class SkipList:
    """Units with express lanes above them; each lane has widths in units and in code points."""

    def __init__(self, edges: np.ndarray):
        self.n = len(edges) - 1
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(len(edges))
        while True:
            self.lanes.append((np.diff(at), np.diff(edges)))
            if len(at) <= FAN + 1:
                break
            kept = np.arange(0, len(at), FAN)
            if kept[-1] != len(at) - 1:
                kept = np.append(kept, len(at) - 1)  # the last link of a lane may be short
            at, edges = at[kept], edges[kept]

    def code_points(self, rank: int) -> int:
        """Code points before the unit of this rank; the rank n is the end."""
        link = units = passed = 0
        for unit_width, point_width in reversed(self.lanes):
            link *= FAN
            while link < len(unit_width) and units + unit_width[link] <= rank:
                units += int(unit_width[link])
                passed += int(point_width[link])
                link += 1
            if units == rank:
                break
        return passed


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the digest of seed and id; a null id is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(docs: DataFrame, how: FillInMiddle = DEFAULT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of ``docs``.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
    ``plain``. Null and empty texts, and those that hold a marker, are plain; their chars are
    null. The draws depend on seed and id only, so rows that share an id are cut by the same
    draws. Other columns are ignored.
    """

    def start():
        def one(doc_id, text):
            text = text or ""
            units = SkipList(unit_edges(text))
            first, second, plain, order = draws(how.seed, doc_id)
            if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or plain % 100 >= 100 - how.plain_percent:
                return [(doc_id, units.n, "plain", None, None, text)]
            ranks = sorted((first % (units.n + 1), second % (units.n + 1)))
            low, high = map(units.code_points, ranks)
            prefix, middle, suffix = text[:low], text[low:high], text[high:]
            if order % 100 < how.suffix_first_percent:
                return [(doc_id, units.n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")]
            return [(doc_id, units.n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")]

        return one

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_rows(docs.select("doc_id", "text"), start, schema)


def restored(form: Column, output: Column) -> Column:
    """The text, rebuilt from form and output. Texts that hold a marker are plain, so the markers found are the three."""
    part = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
    )
