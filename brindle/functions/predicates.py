"""Predicates and string functions with the semantics that document queries promise.

Comparisons, ``&``, ``|`` and ``~`` are Spark's own; here is what differs from the obvious built-in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_METHODS: dict[str, Callable[..., Column]] = {}


def method(function: Callable[..., Column]) -> Callable[..., Column]:
    """Register a column builder, so that it can be called by name; also for builders of a user's own."""
    _METHODS[function.__name__] = function
    return function


def call(name: str, *args: Any) -> Column:
    """Call a registered builder; an unknown name is an error, never ignored."""
    if name not in _METHODS:
        raise NotImplementedError(f"no method {name!r}; known are {', '.join(sorted(_METHODS))}")
    return _METHODS[name](*args)


@method
def text_length(text: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(text))


@method
def flag_is(flag: Column, value: bool) -> Column:
    """Whether a flag is set to ``value``; a missing flag is neither."""
    return flag == F.lit(value)


@method
def equals(column: Column, value: Any) -> Column:
    """Equality; compared with None it asks for null."""
    return column.isNull() if value is None else column == value


@method
def not_equals(column: Column, value: Any) -> Column:
    """Inequality; compared with None it asks for a value."""
    return column.isNotNull() if value is None else column != value


@method
def is_one_of(column: Column, values: Iterable[Any]) -> Column:
    """Membership in a list; an empty list holds nothing, not even null."""
    values = list(values)
    return column.isin(*values) if values else F.lit(False)


@method
def array_has(array: Column, value: Any) -> Column:
    """Whether an array holds a value; a missing array does not."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


@method
def array_is_empty(array: Column) -> Column:
    """Whether an array has no elements; a missing array has none."""
    return F.coalesce(F.size(array), F.lit(0)) <= 0


@method
def equals_ignore_case(text: Column, value: str) -> Column:
    """Equality whatever the case, by a collation."""
    return F.collate(text, "UNICODE_CI") == F.collate(F.lit(value), "UNICODE_CI")


@method
def null_or_empty(text: Column) -> Column:
    """Null or the empty text."""
    return text.isNull() | (text == "")


@method
def null_or_blank(text: Column) -> Column:
    """Null or nothing but blanks."""
    return text.isNull() | (F.trim(text) == "")


@method
def json_member(text: Column, path: str, kind: str) -> Column:
    """A typed member of a JSON text; null where the text is no JSON, the member is missing, or it has another type."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


@method
def json_object(*columns: Column | str) -> Column:
    """A JSON object of the columns, null members included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
