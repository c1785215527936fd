"""Event logs: append-only rows in one global sequence, grouped to streams with versions.

The envelope has seq_id, stream_id, version, type, timestamp and data, and optionally tenant_id, is_archived,
correlation_id, causation_id, user_name and headers.  A log is a DataFrame; these functions read it, or give the log
as it is after a write.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.operators.paging import Page, page
from brindle.operators.sequence import global_lead, global_row_number
from brindle.sources.shared import materialize


class ConcurrencyError(Exception):
    """A version or boundary is not what the writer saw."""


# --- reading -------------------------------------------------------------------------------


def visible(events: DataFrame, tenant: str | None = None, archived: bool = False) -> DataFrame:
    """Events that a session sees: of its tenant, and not archived unless asked for."""
    if tenant is not None:
        events = events.where(F.col("tenant_id") == tenant)
    if not archived and "is_archived" in events.columns:
        events = events.where(~F.col("is_archived"))
    return events


def of_type(events: DataFrame, kind: str, schema: StructType | str | None = None) -> DataFrame:
    """Events of one type, with ``body`` parsed by a schema; what cannot be parsed is null."""
    found = events.where(F.col("type") == kind)
    return found if schema is None else found.withColumn("body", F.from_json("data", schema))


def split_bodies(events: DataFrame, schemas: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Events whose data parse by their type's schema, and dead letters: unknown types and broken data."""
    known = F.col("type").isin(*schemas)
    broken = F.lit(False)
    for kind, schema in schemas.items():
        parsed = F.from_json("data", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
        broken = F.when(F.col("type") == kind, parsed.isNull() | parsed["_broken"].isNotNull()).otherwise(broken)
    marked = events.withColumn("_bad", F.coalesce(~known | broken, F.lit(True)))
    return marked.where(~F.col("_bad")).drop("_bad"), marked.where("_bad").drop("_bad")


def fetch_stream(events: DataFrame, stream: Any, version: int = 0, until: Any = None, from_version: int = 0) -> DataFrame:
    """A stream in version order; 0 and None are no bounds."""
    found = events.where(F.col("stream_id") == stream)
    if version:
        found = found.where(F.col("version") <= version)
    if until is not None:
        found = found.where(F.col("timestamp") <= F.lit(until))
    if from_version:
        found = found.where(F.col("version") >= from_version)
    return found.orderBy("version")


def stream_states(events: DataFrame) -> DataFrame:
    """stream_id, version, created and timestamp of every stream, archived ones too."""
    return events.groupBy("stream_id").agg(F.max("version").alias("version"), F.min("timestamp").alias("created"), F.max("timestamp").alias("timestamp"))


def recent_streams(events: DataFrame, n: int) -> DataFrame:
    """The streams written to last."""
    return stream_states(events).orderBy(F.desc("timestamp"), "stream_id").limit(n)


def query_events(
    events: DataFrame,
    types: Sequence[str] = (),
    stream: Any = None,
    correlation: str | None = None,
    causation: str | None = None,
    user: str | None = None,
    tenant: str | None = None,
    number: int = 1,
    size: int = 25,
) -> Page:
    """A page of events in sequence order; filters that are not given do not filter."""
    found = visible(events, tenant)
    if types:
        found = found.where(F.col("type").isin(*types))
    for column, value in (("stream_id", stream), ("correlation_id", correlation), ("causation_id", causation), ("user_name", user)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return page(found.orderBy("seq_id").offset((number - 1) * size).limit(size), found, number, size)


def event_page(events: DataFrame, floor: int, ceiling: int, size: int, types: Sequence[str] = ()) -> DataFrame:
    """The next events after ``floor`` up to ``ceiling``; the type filter comes before the limit."""
    found = events.where((F.col("seq_id") > floor) & (F.col("seq_id") <= ceiling))
    found = visible(found.where(F.col("type").isin(*types)) if types else found)
    return found.orderBy("seq_id").limit(size)


def floor_at(events: DataFrame, since: Any) -> DataFrame:
    """The first seq_id at or after a time."""
    return events.where(F.col("timestamp") >= F.lit(since)).agg(F.min("seq_id").alias("seq_id"))


def statistics(events: DataFrame) -> DataFrame:
    """One row: events, streams, sequence."""
    return events.agg(F.count("*").alias("events"), F.countDistinct("stream_id").alias("streams"), F.max("seq_id").alias("sequence"))


# --- high-water mark ---------------------------------------------------------------------------


#: Numbers that a group of the sequence has, when gaps are looked for.
GROUP = 1000


def _holes(ids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Where the sequence (of each of ``keys``) breaks or ends: the keys, gap_after and gap_before (null at the end).

    Only groups of a thousand numbers that are not full are looked at row by row, and what follows a group is found
    range by range, so a log without gaps costs one aggregation and a sort of a thousandth of its rows.
    """
    bucket = F.floor(F.col("seq_id") / GROUP)
    edges = ids.groupBy(*keys, bucket.alias("bucket")).agg(F.min("seq_id").alias("lo"), F.max("seq_id").alias("hi"), F.count_distinct("seq_id").alias("n"))
    edges = materialize(edges, "edges")
    broken = edges.where(F.col("hi") - F.col("lo") + 1 != F.col("n")).select(*keys, "bucket")
    following = F.lead("seq_id").over(Window.partitionBy(*keys, "bucket").orderBy("seq_id"))
    inside = ids.withColumn("bucket", bucket).join(broken, [*keys, "bucket"], "left_semi").select(*keys, F.col("seq_id").alias("gap_after"), following.alias("gap_before"))
    ahead = global_lead(edges, [*map(F.col, keys), F.col("bucket")], F.struct(*keys, "lo"), "_ahead")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_ahead.{key}"))
    between = ahead.select(*keys, F.col("hi").alias("gap_after"), F.when(same, F.col("_ahead.lo")).alias("gap_before"))
    holes = inside.where(F.col("gap_before") - F.col("gap_after") > 1).unionByName(between)
    return holes.where(F.col("gap_before").isNull() | (F.col("gap_before") - F.col("gap_after") > 1))


def gaps(events: DataFrame, after: int = 0) -> DataFrame:
    """Missing stretches of the sequence behind ``after``: gap_after, gap_before, missing."""
    found = _holes(events.where(F.col("seq_id") > after).select("seq_id")).where(F.col("gap_before").isNotNull())
    return found.withColumn("missing", F.col("gap_before") - F.col("gap_after") - 1)


def high_water(events: DataFrame, mark: int = 0, stale_before: Any = None) -> DataFrame:
    """One row, ``mark``: the last seq_id up to which nothing is missing behind ``mark``.

    Without events behind it the mark stays.  With ``stale_before`` gaps are skipped whose next event
    is older than that time: whoever was to fill them is given up.
    """
    behind = events.where(F.col("seq_id") > mark)
    last = behind.agg(F.max("seq_id").alias("last"), F.min("seq_id").alias("first"))
    holes = gaps(events, mark).select("gap_after", "gap_before")
    lead = last.where(F.col("first") > mark + 1).select(F.lit(mark).cast("bigint").alias("gap_after"), F.col("first").alias("gap_before"))
    holes = holes.unionByName(lead)
    if stale_before is not None:
        old = events.where(F.col("timestamp") < F.lit(stale_before)).select(F.col("seq_id").alias("gap_before"))
        holes = holes.join(old, "gap_before", "left_anti")
    stop = holes.agg(F.min("gap_after").alias("stop"))
    both = last.crossJoin(stop)  # a row each
    return both.select(F.coalesce("stop", "last", F.lit(mark)).cast("bigint").alias("mark"))


def high_water_by_tenant(events: DataFrame) -> DataFrame:
    """tenant_id and mark: the last seq_id of each tenant without a gap in the tenant's own numbers."""
    return _holes(events.select("tenant_id", "seq_id"), ["tenant_id"]).groupBy("tenant_id").agg(F.min("gap_after").alias("mark"))


# --- tags ------------------------------------------------------------------------------------


def tags_from(events: DataFrame, **columns: Column) -> DataFrame:
    """A tag table (tag, value, seq_id) from columns of the events; null values are no tags."""
    entries = F.array(*[F.struct(F.lit(k).alias("tag"), v.cast("string").alias("value")) for k, v in columns.items()])
    return events.select("seq_id", F.inline(entries)).where(F.col("value").isNotNull()).select("tag", "value", "seq_id")


def has_tag(events: DataFrame, tags: DataFrame, tag: str, value: Any) -> DataFrame:
    """Events with a tag; chained calls ask for all of them."""
    wanted = tags.where((F.col("tag") == tag) & (F.col("value") == str(value))).select("seq_id")
    return events.join(wanted, "seq_id", "left_semi")


def matching_tags(events: DataFrame, tags: DataFrame, conditions: Sequence[tuple[str, Any, str | None]], archived: bool = False) -> DataFrame:
    """Events that meet any (tag, value, type or None), each once."""
    wanted = F.lit(False)
    for tag, value, kind in conditions:
        one = (F.col("tag") == tag) & (F.col("value") == str(value))
        wanted = wanted | (one & (F.col("_type") == kind) if kind else one)
    hits = tags.join(events.select("seq_id", F.col("type").alias("_type")), "seq_id") if any(k for *_, k in conditions) else tags
    return visible(events, archived=archived).join(hits.where(wanted).select("seq_id"), "seq_id", "left_semi")


def events_exist(events: DataFrame, tags: DataFrame, conditions: Sequence[tuple[str, Any, str | None]], name: str = "exists") -> DataFrame:
    """One row: whether any event meets the conditions."""
    return matching_tags(events, tags, conditions).limit(1).agg((F.count("*") > 0).alias(name))


def boundary_violations(events: DataFrame, tags: DataFrame, conditions: Sequence[tuple[str, Any, str | None]], last_seen: int) -> DataFrame:
    """Events that meet the conditions and came after ``last_seen``: a decision on what was seen does not hold for them."""
    return matching_tags(events.where(F.col("seq_id") > last_seen), tags, conditions)


def assert_boundary(events: DataFrame, tags: DataFrame, conditions: Sequence[tuple[str, Any, str | None]], last_seen: int) -> None:
    """An error if an event that meets the conditions came after ``last_seen``."""
    if boundary_violations(events, tags, conditions, last_seen).take(1):
        raise ConcurrencyError(f"events after {last_seen} are inside the boundary")


def all_tags(events: DataFrame, tags: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Events with every tag, whatever the case of its value."""
    for tag, value in wanted.items():
        hit = tags.where((F.col("tag") == tag) & (F.lower("value") == value.lower())).select("seq_id")
        events = events.join(hit, "seq_id", "left_semi")
    return events


def assign_tag(events: DataFrame, tags: DataFrame, condition: Column, tag: str, value: Any) -> DataFrame:
    """Tag rows to add: events that meet the condition and do not have the tag."""
    there = tags.where((F.col("tag") == tag) & (F.col("value") == str(value))).select("seq_id")
    return events.where(condition).join(there, "seq_id", "left_anti").select(F.lit(tag).alias("tag"), F.lit(str(value)).alias("value"), "seq_id")


# --- writing ----------------------------------------------------------------------------------


def append(events: DataFrame, batch: DataFrame, order: str, expected: Mapping[Any, int] | DataFrame | None = None) -> DataFrame:
    """The rows to append for ``batch`` (stream_id, ``order``, and other columns), numbered.

    Versions go on from each stream's, in ``order``; sequence numbers go on from the log's, in the same order
    over all.  Appending to an archived stream is an error, and so is a stream of ``expected`` (a mapping, or a frame
    of stream_id and version) whose version is another; a stream that is not there has version 0.
    """
    touched = batch.select("stream_id").distinct()
    current = events.join(touched, "stream_id", "left_semi").groupBy("stream_id").agg(F.max("version").alias("_base"), *([F.max("is_archived").alias("_gone")] if "is_archived" in events.columns else []))
    if "is_archived" in events.columns and current.where("_gone").take(1):
        raise ValueError("a stream that is appended to is archived")
    if isinstance(expected, DataFrame) or expected:
        if not isinstance(expected, DataFrame):
            expected = events.sparkSession.createDataFrame(list(expected.items()), ["stream_id", "version"])
        seen = expected.select("stream_id", F.col("version").alias("_expected"))
        versions = events.join(seen.select("stream_id"), "stream_id", "left_semi").groupBy("stream_id").agg(F.max("version").alias("_base"))
        if seen.join(versions, "stream_id", "left").where(F.coalesce("_base", F.lit(0)) != F.col("_expected")).take(1):
            raise ConcurrencyError("a stream is not at the expected version")
    last = events.agg(F.coalesce(F.max("seq_id"), F.lit(0))).first()[0]
    numbered = global_row_number(batch, [F.col(order), F.col("stream_id")], "_place")
    version = F.coalesce("_base", F.lit(0)) + F.row_number().over(Window.partitionBy("stream_id").orderBy("_place"))
    return (
        numbered.join(current.select("stream_id", "_base"), "stream_id", "left")
        .withColumn("version", version.cast("bigint"))
        .withColumn("seq_id", F.lit(last) + F.col("_place"))
        .drop("_place", "_base")
    )


class TagTypes:
    """The registered kinds of tags: a name, and how its value follows from an event; other names are errors."""

    def __init__(self, **columns: Column) -> None:
        self.columns = columns

    def value(self, tag: str) -> Column:
        if tag not in self.columns:
            raise KeyError(f"no tag {tag!r}; known are {', '.join(sorted(self.columns))}")
        return self.columns[tag]


def append_tagged(events: DataFrame, batch: DataFrame, order: str, kinds: TagTypes, tags: Sequence[str], expected: Mapping[Any, int] | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows to append, and the rows of the tag table that belong to them."""
    rows = append(events, batch, order, expected)
    return rows, tags_from(rows, **{t: kinds.value(t) for t in tags})


def start_streams(events: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows to append that begin streams; a stream that is there is an error."""
    if batch.select("stream_id").join(events.select("stream_id"), "stream_id", "left_semi").take(1):
        raise ConcurrencyError("a stream to start exists")
    return append(events, batch, order)


def set_archived(events: DataFrame, streams: DataFrame, archived: bool = True) -> DataFrame:
    """The log with some streams (a DataFrame with stream_id) archived or back."""
    marked = events.join(streams.select("stream_id").distinct().withColumn("_hit", F.lit(True)), "stream_id", "left")
    return marked.withColumn("is_archived", F.when(F.col("_hit"), F.lit(archived)).otherwise(F.col("is_archived"))).drop("_hit")


def tombstone(events: DataFrame, tags: DataFrame, streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log and its tags without some streams."""
    kept = events.join(streams.select("stream_id"), "stream_id", "left_anti")
    gone = events.join(streams.select("stream_id"), "stream_id", "left_semi").select("seq_id")
    return kept, tags.join(gone, "seq_id", "left_anti")


def replace_events(events: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with data (and type) of some events replaced; ``changes`` has seq_id and the new columns.

    Of several changes of an event the greatest as JSON text holds.
    """
    changes = changes.groupBy(F.col("seq_id").alias("_seq")).agg(F.max_by(F.struct("*"), F.to_json(F.struct("*"))).alias("_row")).select("_row.*")
    new = [c for c in changes.columns if c != "seq_id"]
    other = changes.select("seq_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in new])
    merged = events.join(other, "seq_id", "left")
    for c in new:
        merged = merged.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return merged.select(*events.columns)


def mask(events: DataFrame, condition: Column, masked: Column, headers: Mapping[str, str] | None = None) -> DataFrame:
    """The log with the data of some events masked, and headers added to them."""
    events = events.withColumn("data", F.when(condition, masked).otherwise(F.col("data")))
    if headers:
        more = F.create_map(*[F.lit(x) for pair in headers.items() for x in pair])
        events = events.withColumn("headers", F.when(condition, F.map_concat(F.coalesce("headers", F.create_map().cast("map<string,string>")), more)).otherwise(F.col("headers")))
    return events


def compact(events: DataFrame, snapshots: DataFrame, kind: str) -> DataFrame:
    """The log with each stream of ``snapshots`` (stream_id, version, data) up to that version as one event.

    The snapshot takes the place of the last event that it covers.
    """
    marked = events.join(snapshots.select("stream_id", F.col("version").alias("_upto"), F.col("data").alias("_state")), "stream_id", "left")
    kept = marked.where(F.col("_upto").isNull() | (F.col("version") >= F.col("_upto")))
    last = F.coalesce(F.col("version") == F.col("_upto"), F.lit(False))
    return kept.withColumns({"data": F.when(last, F.col("_state")).otherwise(F.col("data")), "type": F.when(last, F.lit(kind)).otherwise(F.col("type"))}).select(*events.columns)


def natural_keys(events: DataFrame, key: Column, retired: Column | None = None) -> DataFrame:
    """stream_id and the latest natural key of each stream; streams whose key was retired later have none."""
    keyed = events.select("stream_id", "seq_id", key.alias("_key"), (retired if retired is not None else F.lit(False)).alias("_retired"))
    latest = keyed.groupBy("stream_id").agg(
        F.max_by("_key", F.when(F.col("_key").isNotNull(), F.col("seq_id"))).alias("natural_key"),
        F.max(F.when(F.col("_key").isNotNull(), F.col("seq_id"))).alias("_at"),
        F.max(F.when(F.col("_retired"), F.col("seq_id"))).alias("_gone"),
    )
    return latest.where(F.col("natural_key").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_at")))).select("natural_key", "stream_id")


def with_natural_key(keys: DataFrame, batch: DataFrame, key: str = "natural_key") -> tuple[DataFrame, DataFrame]:
    """A batch with natural keys as events of streams, and which keys begin new ones: (rows, started).

    ``keys`` (natural_key, stream_id) are those that hold (``natural_keys``).  Rows whose key is known belong to its
    stream; the others begin a stream whose id is the key's hash, the same in every run.  A key that was retired, or
    whose stream was archived, is not known any more and begins a stream anew, numbered by the batch's smallest ``seq``.
    """
    known = batch.join(keys.select(F.col("natural_key").alias(key), "stream_id"), key, "left")
    fresh = known.where(F.col("stream_id").isNull())
    salt = fresh.groupBy(key).agg(F.min("seq").alias("_salt"))
    started = salt.select(F.col(key), F.xxhash64(key, "_salt").alias("_new"))
    rows = known.join(started, key, "left").withColumn("stream_id", F.coalesce("stream_id", "_new")).drop("_new")
    return rows, started.select(F.col(key).alias("natural_key"), F.col("_new").alias("stream_id"))


def without_archived_keys(keys: DataFrame, events: DataFrame) -> DataFrame:
    """Natural keys whose stream is not archived."""
    gone = events.where("is_archived").select("stream_id").distinct()
    return keys.join(gone, "stream_id", "left_anti").select(*keys.columns)


def of_tenant(events: DataFrame, tenant: str | None, archived: bool = False) -> DataFrame:
    """What an explorer reads: all of one tenant, or of all, in sequence order, archived events marked if asked for."""
    return visible(events, tenant, archived).orderBy("seq_id")


def pack(data: Column) -> Column:
    """Event data as the bytes of a binary column."""
    return F.to_binary(data, F.lit("utf-8"))


def unpack(events: DataFrame, data: str = "data", binary: str = "bdata") -> DataFrame:
    """The log with the binary column read back where the text is missing; bytes that are no UTF-8 stay null."""
    return events.withColumn(data, F.coalesce(data, F.try_validate_utf8(F.col(binary).cast("string")))).drop(binary)
