"""Column expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words and is stripped from lines.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate`` and does the same to a text of ASCII only, that
    is one with as many bytes as characters.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def own_names(frame: DataFrame, *names: str) -> list[str]:
    """``names`` for columns of an operator's own, changed where the caller's frame has columns of that name."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def quoted(name: str) -> str:
    """A column's name, whatever signs it has, as one name."""
    return "`" + name.replace("`", "``") + "`"


def all_columns(frame: DataFrame) -> list[Column]:
    """A frame's columns, whatever signs their names have."""
    return [F.col(quoted(c)) for c in frame.columns]
