"""Patches of a struct column: each returns the patched column, so they chain.

A path is dotted; arrays and maps are members of the struct.  Places in arrays count from 0.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def get(data: Column, path: str) -> Column:
    """A member by dotted path."""
    for part in path.split("."):
        data = data.getField(part)
    return data


def set_value(data: Column, path: str, value: Any) -> Column:
    """Set a scalar, array, map or struct, also one that was not there."""
    return data.withField(path, _lit(value))


def increment(data: Column, path: str, by: Any = 1) -> Column:
    """Add a number; null stays null."""
    return data.withField(path, get(data, path) + _lit(by))


def append(data: Column, path: str, value: Any) -> Column:
    """Add to the end of an array."""
    return data.withField(path, F.array_append(get(data, path), _lit(value)))


def append_if_missing(data: Column, path: str, value: Any) -> Column:
    """Add to the end of an array that does not hold the value."""
    array = get(data, path)
    return data.withField(path, F.when(F.array_contains(array, _lit(value)), array).otherwise(F.array_append(array, _lit(value))))


def insert(data: Column, path: str, value: Any, at: int | None = None) -> Column:
    """Insert into an array before place ``at``; without one, or beyond the end, at the end."""
    array = get(data, path)
    place = F.size(array) if at is None else F.least(F.lit(at), F.size(array))
    return data.withField(path, F.concat(F.slice(array, F.lit(1), place), F.array(_lit(value)), F.slice(array, place + 1, F.size(array))))


def insert_if_missing(data: Column, path: str, value: Any, at: int | None = None) -> Column:
    """Insert into an array that does not hold the value."""
    return F.when(F.array_contains(get(data, path), _lit(value)), data).otherwise(insert(data, path, value, at))


def remove_all(data: Column, path: str, value: Any) -> Column:
    """Remove every occurrence of a value."""
    return data.withField(path, F.array_remove(get(data, path), _lit(value)))


def remove_first(data: Column, path: str, value: Any) -> Column:
    """Remove the first occurrence of a value."""
    array = get(data, path)
    at = F.array_position(array, _lit(value)).cast("int")
    without = F.concat(F.slice(array, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(array, at + 1, F.size(array)))
    return data.withField(path, F.when(at > 0, without).otherwise(array))


def remove_where(data: Column, path: str, condition: Any) -> Column:
    """Remove elements for which a function of the element holds."""
    return data.withField(path, F.filter(get(data, path), lambda x: ~F.coalesce(condition(x), F.lit(False))))


def append_unless(data: Column, path: str, value: Any, condition: Any) -> Column:
    """Add to the end of an array unless a function of an element holds for any; null does not hold."""
    array = get(data, path)
    held = F.exists(array, lambda x: F.coalesce(condition(x), F.lit(False)))
    return data.withField(path, F.when(held, array).otherwise(F.array_append(array, _lit(value))))


def insert_unless(data: Column, path: str, value: Any, condition: Any, at: int | None = None) -> Column:
    """Insert into an array unless a function of an element holds for any; null does not hold."""
    held = F.exists(get(data, path), lambda x: F.coalesce(condition(x), F.lit(False)))
    return F.when(held, data).otherwise(insert(data, path, value, at))


def remove_first_where(data: Column, path: str, condition: Any) -> Column:
    """Remove the first element for which a function of the element holds."""
    array = get(data, path)
    hits = F.transform(array, lambda x: F.coalesce(condition(x), F.lit(False)))
    at = F.array_position(hits, F.lit(True)).cast("int")
    without = F.concat(F.slice(array, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(array, at + 1, F.size(array)))
    return data.withField(path, F.when(at > 0, without).otherwise(array))


def put_key(data: Column, path: str, key: Any, value: Any) -> Column:
    """Set a key of a map, also one that is there."""
    return data.withField(path, F.map_concat(F.map_filter(get(data, path), lambda k, _: k != _lit(key)), F.create_map(_lit(key), _lit(value))))


def put_key_if_missing(data: Column, path: str, key: Any, value: Any) -> Column:
    """Set a key that a map does not have."""
    return F.when(F.map_contains_key(get(data, path), key), data).otherwise(put_key(data, path, key, value))


def remove_key(data: Column, path: str, key: Any) -> Column:
    """Remove a key of a map."""
    return data.withField(path, F.map_filter(get(data, path), lambda k, _: k != _lit(key)))


def increment_key(data: Column, path: str, key: Any, by: Any = 1) -> Column:
    """Add to the value of a key; a missing key stays missing."""
    return data.withField(path, F.transform_values(get(data, path), lambda k, v: F.when(k == _lit(key), v + _lit(by)).otherwise(v)))


def delete(data: Column, path: str) -> Column:
    """Drop a member."""
    return data.dropFields(path)


def rename(data: Column, old: str, new: str) -> Column:
    """Move a member to another name."""
    return data.withField(new, get(data, old)).dropFields(old)


def duplicate(data: Column, path: str, *others: str) -> Column:
    """Copy a member to other names."""
    value = get(data, path)
    for other in others:
        data = data.withField(other, value)
    return data
