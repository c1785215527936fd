"""Folds of ordered events to read models, in three tiers.

Declared folds become grouped aggregates, which Spark combines before the shuffle; a fold given as a function of
columns runs over sorted arrays; a fold given in Python runs over each key's sorted events with one state in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A fold of columns with ``merge`` holds at most 2 ** CHUNK_BITS events or states in an array.
CHUNK_BITS = 16
#: States that a fold in Python gives to Spark at once.
OUT_ROWS = 10_000


@dataclass(frozen=True)
class Member:
    """A member of a read model: ``how`` an event of some types changes it.

    ``add`` sums a value, ``subtract`` takes it away, ``count`` counts, ``last`` and ``first`` keep a value, ``set`` keeps a constant.
    """

    name: str
    how: str
    types: tuple[str, ...] = ()
    value: Column | None = None
    zero: Any = 0

    def _of(self) -> Column:
        return F.col("type").isin(*self.types) if self.types else F.lit(True)

    def aggregate(self, over: Callable[[Column], Column] = lambda c: c) -> Column:
        """As an aggregate; ``over`` makes it a running one."""
        on, value = self._of(), F.lit(1) if self.value is None else self.value
        if self.how == "count":
            result = over(F.count(F.when(on, 1)))
        elif self.how in ("add", "subtract"):
            result = F.coalesce(over(F.sum(F.when(on, value if self.how == "add" else -value))), F.lit(self.zero))
        elif self.how in ("last", "set"):
            result = over(F.max_by(value, F.when(on, F.col("seq_id"))))
        elif self.how == "first":
            result = over(F.min_by(value, F.when(on, F.col("seq_id"))))
        else:
            raise ValueError(f"no fold {self.how!r}")
        return result.alias(self.name)


def fold(events: DataFrame, key: str | Sequence[str], members: Sequence[Member], delete: Column | None = None, create: Sequence[str] | Column = ()) -> DataFrame:
    """One row a key: the members over its events in order of seq_id.

    After an event for which ``delete`` holds the state is gone: only later events count, and a key without any
    has no row.  With ``create`` (types, or a condition) a key has a row only if such an event is among those that count.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if delete is not None:
        cut = events.where(delete).groupBy(*keys).agg(F.max("seq_id").alias("_cut"))
        events = events.join(cut, keys, "left").where(F.col("_cut").isNull() | (F.col("seq_id") > F.col("_cut")))
    if not isinstance(create, Column):
        create = F.col("type").isin(*create) if create else F.lit(True)
    made = F.count(F.when(create, 1)).alias("_made")
    return events.groupBy(*keys).agg(*[m.aggregate() for m in members], made).where(F.col("_made") > 0).drop("_made")


def timeline(events: DataFrame, key: str, members: Sequence[Member]) -> DataFrame:
    """The state after each event: the same members as running aggregates."""
    window = Window.partitionBy(key).orderBy("seq_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select(key, "seq_id", "type", *[m.aggregate(lambda c: c.over(window)) for m in members])


def last_known(events: DataFrame, key: str, members: Sequence[Member], delete: Column) -> DataFrame:
    """The last state before a deletion ended the stream; without a final deletion, the state."""
    gone = F.when(delete, F.col("seq_id"))
    cuts = events.groupBy(key).agg(F.max("seq_id").alias("_last"), F.max(gone).alias("_gone"))
    ended = events.join(cuts, key)
    tail = ended.where((F.col("_last") == F.col("_gone")) & (F.col("seq_id") < F.col("_gone")) | (F.col("_last") != F.coalesce("_gone", F.lit(-1))))
    return fold(tail.drop("_last", "_gone"), key, members, delete)


def slice_by(events: DataFrame, *rules: tuple[str, Column], name: str = "slice_key") -> DataFrame:
    """Deal events of a type to keys across streams; an array of keys deals an event to each of them."""
    keys = None
    for kind, key in rules:
        own = F.when(F.col("type") == kind, key)
        keys = own if keys is None else F.coalesce(keys, own)
    sliced = events.withColumn(name, keys).where(F.col(name).isNotNull())
    return sliced.withColumn(name, F.explode(name)) if sliced.schema[name].dataType.typeName() == "array" else sliced


def event_documents(events: DataFrame, *rules: tuple[str, Column, Sequence[Column]], name: str = "id") -> DataFrame:
    """A document for each event of some types: (type, id, members); an event type without a rule makes none.

    Members that a rule does not name are null.  Ids that come twice stand for the later event.
    """
    made = None
    for kind, key, members in rules:
        own = events.where(F.col("type") == kind).select(key.alias(name), F.col("seq_id").alias("_seq"), *members)
        made = own if made is None else made.unionByName(own, allowMissingColumns=True)
    last = made.groupBy(F.col(name).alias("_key")).agg(F.max_by(F.struct("*"), "_seq").alias("_row"))
    return last.select("_row.*").drop("_seq")


def fold_function(
    events: DataFrame, key: str, columns: Sequence[str], zero: Column, step: Callable[[Column, Column], Column], name: str = "state", merge: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """A fold as a function of (state, event) columns.

    ``merge`` joins the states of two stretches of events, each folded from ``zero``, the earlier one first.  With it a
    key's events are folded in stretches of seq_id, so that no array has more than 2 ** CHUNK_BITS elements; without
    it a key's events have to fit in memory, and ``fold_pandas`` is the fold for hot keys.
    """
    if merge is None:
        rows = F.array_sort(F.collect_list(F.struct("seq_id", *columns)))
        return events.groupBy(key).agg(F.aggregate(rows, zero, step).alias(name))
    stretch = F.shiftright("seq_id", CHUNK_BITS)
    rows = F.array_sort(F.collect_list(F.struct("seq_id", *columns)))
    states = events.groupBy(key, stretch.alias("_stretch")).agg(F.aggregate(rows, zero, step).alias(name))
    for last in (False, False, True):  # seq_id has less than four times CHUNK_BITS
        parts = F.sort_array(F.collect_list(F.struct("_stretch", F.struct(F.col(name).alias("state")).alias("of"))))
        parts = F.transform(parts, lambda p: p["of"]["state"])
        folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), merge).alias(name)
        keys = [key] if last else [key, F.shiftright("_stretch", CHUNK_BITS).alias("_stretch")]
        states = states.groupBy(*keys).agg(folded)
    return states


def fold_pandas(events: DataFrame, key: str, columns: Sequence[str], step: Callable[[dict | None, dict], dict | None], schema: str) -> DataFrame:
    """A fold in Python: ``step`` takes the state (None at first) and an event, and None ends a state.

    ``schema`` is that of the key and the state's members.  Events come key by key in the order of seq_id, as a sorted
    stream: besides a batch of them only the state of the current key is in memory.  Null members are None.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        current, started, done = None, False, []
        for batch in batches:
            for event in batch.to_pylist():
                one = event[key]
                if not started or one != current and not (one != one and current != current):
                    if state is not None:
                        done.append({key: current, **state})
                    state, current, started = None, one, True
                    if len(done) >= OUT_ROWS:
                        yield pa.RecordBatch.from_pylist(done, out)
                        done = []
                state = step(state, event)
        if state is not None:
            done.append({key: current, **state})
        yield pa.RecordBatch.from_pylist(done, out)

    rows = events.select(key, "seq_id", *columns).repartition(key).sortWithinPartitions(key, "seq_id")
    return rows.mapInArrow(folded, schema)


@dataclass(frozen=True)
class ColumnMap:
    """How a type of event changes a column of a flat table: map, increment, decrement or set."""

    column: str
    how: str
    value: Column | None = None


def flat_table(events: DataFrame, key: str, maps: Mapping[str, Sequence[ColumnMap]], deletes: Sequence[str] = (), keep_first_sign: bool = False) -> DataFrame:
    """A relational table from events: a row a key, its columns by the maps of each type in order.

    A column set by ``map`` or ``set`` begins anew there, and increments count from it; without one they count from 0.
    With ``keep_first_sign`` the first event of a row that decrements stores its value with a plus sign (or 0 for a
    decrement by one), as a plain insert would.  Types of ``deletes`` remove the row.
    """
    types = [*maps, *deletes]
    rows = events.where(F.col("type").isin(*types))
    if deletes:
        cut = rows.where(F.col("type").isin(*deletes)).groupBy(key).agg(F.max("seq_id").alias("_cut"))
        rows = rows.join(cut, key, "left").where(F.col("_cut").isNull() | (F.col("seq_id") > F.col("_cut"))).drop("_cut")
    columns = list(dict.fromkeys(m.column for ms in maps.values() for m in ms))
    numeric = [c for c in columns if any(m.column == c and m.how in ("increment", "decrement") for ms in maps.values() for m in ms)]
    # Where a key's row begins, and where each of its numbers was set last: one aggregate, joined back.
    marks = [F.min("seq_id").alias("_first")]
    for column in numeric:
        setting = [kind for kind, ms in maps.items() if any(m.column == column and m.how in ("map", "set") for m in ms)]
        marks.append(F.max(F.when(F.col("type").isin(*setting) if setting else F.lit(False), F.col("seq_id"))).alias(f"_since_{column}"))
    rows = rows.join(rows.groupBy(key).agg(*marks), key)
    if not keep_first_sign:
        rows = rows.withColumn("_first", F.lit(None).cast("bigint"))
    for column in columns:
        base = change = F.lit(None)
        sets = F.lit(False)
        for kind, ms in maps.items():
            for m in ms:
                if m.column != column:
                    continue
                on = F.col("type") == kind
                value = F.lit(1) if m.value is None else m.value
                if m.how in ("map", "set"):
                    base, sets = F.when(on, value).otherwise(base), sets | on
                elif m.how == "increment":
                    change = F.when(on, value).otherwise(change)
                elif m.how == "decrement":
                    inserted = F.lit(0) if m.value is None else value
                    change = F.when(on, F.when(F.col("seq_id") == F.col("_first"), inserted).otherwise(-value)).otherwise(change)
                else:
                    raise ValueError(f"no column map {m.how!r}")
        rows = rows.withColumns({f"_base_{column}": base, f"_set_{column}": F.when(sets, F.col("seq_id")), f"_change_{column}": change})
    for column in numeric:
        since = F.col(f"_since_{column}")
        rows = rows.withColumn(f"_change_{column}", F.when(since.isNull() | (F.col("seq_id") > since), F.col(f"_change_{column}")))
    results = []
    for column in columns:
        value = F.max_by(f"_base_{column}", f"_set_{column}")
        if column in numeric:
            value = F.coalesce(value, F.lit(0)) + F.coalesce(F.sum(f"_change_{column}"), F.lit(0))
        results.append(value.alias(column))
    return rows.groupBy(key).agg(*results)
