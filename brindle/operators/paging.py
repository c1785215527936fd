"""Pages by number and by cursor."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "rows1."


@dataclass(frozen=True)
class Page:
    """A page and its arithmetic; the rows stay a DataFrame."""

    rows: DataFrame
    number: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)

    @property
    def has_next(self) -> bool:
        return self.number < self.pages

    @property
    def has_previous(self) -> bool:
        return self.number > 1

    @property
    def first_item(self) -> int:
        return (self.number - 1) * self.size + 1 if self.total else 0

    @property
    def last_item(self) -> int:
        return min(self.number * self.size, self.total)


def page(rows: DataFrame, everything: DataFrame, number: int, size: int) -> Page:
    """A page of ``everything``; counting it is one job of its own, which reads no other columns."""
    return Page(rows, number, size, everything.count())


def encode_cursor(values: Sequence[Any]) -> str:
    """The last row's sort values as a text."""
    if any(v is None for v in values):
        raise ValueError("a cursor cannot stand on a null")
    plain = [{"t": v.isoformat()} if isinstance(v, (date, datetime)) else v for v in values]
    return PREFIX + base64.urlsafe_b64encode(json.dumps(plain, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> list[Any]:
    """The sort values of a cursor; anything else is an error."""
    if not cursor.startswith(PREFIX):
        raise ValueError("not a cursor")
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor[len(PREFIX) :]))
    except ValueError as error:  # neither base64 nor JSON
        raise ValueError("not a cursor") from error
    return [datetime.fromisoformat(v["t"]) if isinstance(v, dict) else v for v in values]


def after(orders: Sequence[tuple[str, bool]], cursor: str) -> Column:
    """Rows after a cursor: ``(k0 > v0) or (k0 = v0 and k1 > v1) ...``, less than where descending.

    Spark pushes the first comparison's range to the scan.
    """
    values = decode_cursor(cursor)
    if len(values) != len(orders):
        raise ValueError("the cursor is of another order")
    condition, equal = F.lit(False), F.lit(True)
    for (name, up), value in zip(orders, values, strict=True):
        beyond = F.col(name) > F.lit(value) if up else F.col(name) < F.lit(value)
        condition = condition | (equal & beyond)
        equal = equal & (F.col(name) == F.lit(value))
    first, up = orders[0]
    edge = F.col(first) >= F.lit(values[0]) if up else F.col(first) <= F.lit(values[0])
    return edge & condition
