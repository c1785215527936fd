"""Aggregates: the state of streams, read to decide on new events and written together with them.

A writer fetches states with their versions, decides on events, and appends them; the append fails if a stream has moved
on since.  All of it is over many streams at once: states, decisions and versions are DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.fold import Member, fold
from brindle.sources.events import append, visible


def fetch_for_writing(events: DataFrame, streams: DataFrame, members: Sequence[Member], delete: Column | None = None) -> DataFrame:
    """stream_id, version and members of each of ``streams`` (stream_id); one that is not there has version 0 and no state."""
    wanted = streams.select("stream_id").distinct()
    own = events.join(wanted, "stream_id", "left_semi")
    versions = own.groupBy("stream_id").agg(F.max("version").alias("version"))
    found = wanted.join(versions, "stream_id", "left").join(fold(own, "stream_id", members, delete), "stream_id", "left")
    return found.withColumn("version", F.coalesce("version", F.lit(0)).cast("bigint"))


def write_to_aggregate(
    events: DataFrame, states: DataFrame, decide: Callable[[DataFrame], DataFrame], order: str, now: DataFrame | None = None
) -> DataFrame:
    """The rows to append: what ``decide`` makes of the ``states`` that were fetched for writing, numbered.

    ``now`` is the log at the time of the append (by default the one that was read); a stream of ``states`` whose version
    is another by then is an error, and nothing is appended.
    """
    return append(events if now is None else now, decide(states), order, expected=states.select("stream_id", "version"))


def append_optimistic(events: DataFrame, batch: DataFrame, order: str, seen: DataFrame) -> DataFrame:
    """The rows to append if the streams of ``batch`` are as in ``seen``, the log that the writer read; else an error."""
    touched = batch.select("stream_id").distinct()
    versions = seen.join(touched, "stream_id", "left_semi").groupBy("stream_id").agg(F.max("version").alias("version"))
    expected = touched.join(versions, "stream_id", "left").withColumn("version", F.coalesce("version", F.lit(0)))
    return append(events, batch, order, expected=expected)


def fetch_latest(events: DataFrame, streams: DataFrame, members: Sequence[Member], delete: Column | None = None) -> DataFrame:
    """The states of some streams from all their visible events; a stream without a state has no row."""
    return fold(visible(events).join(streams.select("stream_id").distinct(), "stream_id", "left_semi"), "stream_id", members, delete)


def project_latest(events: DataFrame, pending: DataFrame, order: str, streams: DataFrame, members: Sequence[Member], delete: Column | None = None) -> DataFrame:
    """The states as they will be once ``pending`` (stream_id, ``order`` and event columns) is appended."""
    rows = append(events, pending, order)
    common = [c for c in events.columns if c in rows.columns]
    missing = {c: F.lit(None).cast(events.schema[c].dataType) for c in events.columns if c not in rows.columns}
    if "is_archived" in missing:
        missing["is_archived"] = F.lit(False)
    return fetch_latest(events.unionByName(rows.select(*common).withColumns(missing)), streams, members, delete)


def before_and_after(events: DataFrame, key: str, members: Sequence[Member]) -> DataFrame:
    """The timeline of each key: seq_id, type, and structs ``before`` and ``after`` of the members; the first ``before`` is null.

    ``key`` may be a slice across streams (``slice_by``), so that one state's steps come from many streams.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(key).orderBy("seq_id")
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.struct(*[m.aggregate(lambda c: c.over(running)) for m in members])
    rows = events.select(key, "seq_id", "type", after.alias("after"))
    return rows.withColumn("before", F.lag("after").over(window))
