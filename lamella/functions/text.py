"""String expressions for names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_part(c: str | Column, separator: str = ".") -> Column:
    """Text after the last separator; all of it when there is none."""
    return F.substring_index(_col(c), separator, -1)


def part(c: str | Column, index: int, separator: str = ".") -> Column:
    """The part at a 0-based index; null when there are fewer parts."""
    return F.get(F.split(_col(c), rf"\Q{separator}\E"), F.lit(index))


def without(c: str | Column, text: str) -> Column:
    """The string with every occurrence of ``text`` taken out."""
    return F.replace(_col(c), F.lit(text), F.lit(""))


def title_case(c: str | Column) -> Column:
    """Every stretch of letters starts in upper case and goes on in lower case.

    ``initcap`` starts words at white space only; here a digit, hyphen or quote does too.
    """
    words = F.regexp_extract_all(_col(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def label(c: str | Column) -> Column:
    """A name with underscores as a heading: ``order_items`` becomes ``Order Items``."""
    return title_case(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def is_blank(c: str | Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(~_col(c).cast("string").rlike(r"(?U)\S"), F.lit(True))
