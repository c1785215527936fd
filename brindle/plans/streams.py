"""Queries that run Structured Streaming over the log to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.fold import Member
from brindle.plans.core import query
from brindle.plans.events import _DELETED, _LOG, log
from brindle.sources.shared import fresh_path, materialize
from brindle.sources.store import TableStore
from brindle.streaming.projections import Composite, Projection, append_inline, current, inline_rows, progress, project, publish_composite, refresh, run, running_totals, statuses, subscribe

SCHEMA = "seq_id bigint, stream_id bigint, version bigint, type string, timestamp timestamp_ntz, value double, data string, is_archived boolean"


def _members() -> tuple[Member, ...]:
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (Member("clicks", "count", ("click",)), Member("spent", "add", ("purchase",), cents), Member("last_type", "last", (), F.col("type")))


_STATES = "count(*) FILTER (WHERE type = 'click') AS clicks, coalesce(sum(round(value * 100)::BIGINT) FILTER (WHERE type = 'purchase'), 0)::BIGINT AS spent, arg_max(type, seq_id) AS last_type"


#: Events of an append, at most.
APPEND_ROWS = 1_000_000


def _log_files(s: SparkSession, d: str) -> str:
    """The log as it grows: one append after another, in the order of its sequence; more of them the more events there are."""
    path = fresh_path(s, "log")
    rows = materialize(log(s, d).repartitionByRange("seq_id"), "whole-log")
    last, n = rows.agg(F.max("seq_id"), F.count("*")).first()
    parts = max(6, -(-n // APPEND_ROWS))
    for k in range(parts):
        part = rows.where((F.col("seq_id") > last * k // parts - (k == 0)) & (F.col("seq_id") <= last * (k + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@query("stream_projection_available_now", _LOG + f"SELECT stream_id, {_STATES} FROM log GROUP BY stream_id")
def stream_projection_available_now(s: SparkSession, d: str) -> DataFrame:
    projection = Projection("activity", "stream_id", _members())
    store = TableStore(s, fresh_path(s, "projections"))
    run(s, _log_files(s, d), SCHEMA, projection, store, fresh_path(s, "positions"))
    return current(store, projection)


@query("stream_projection_with_delete", _DELETED + f"SELECT stream_id, {_STATES} FROM log JOIN cuts USING (stream_id) WHERE cut IS NULL OR seq_id > cut GROUP BY stream_id")
def stream_projection_with_delete(s: SparkSession, d: str) -> DataFrame:
    projection = Projection("activity", "stream_id", _members(), delete=lambda: (F.col("type") == "error") & (F.col("value") > 70))
    store = TableStore(s, fresh_path(s, "projections"))
    run(s, _log_files(s, d), SCHEMA, projection, store, fresh_path(s, "positions"))
    return current(store, projection)


@query("stream_progress", _LOG + "SELECT 'activity-v2' AS shard, max(seq_id) AS mark FROM log")
def stream_progress(s: SparkSession, d: str) -> DataFrame:
    projection = Projection("activity", "stream_id", _members(), version=2)
    store = TableStore(s, fresh_path(s, "projections"))
    run(s, _log_files(s, d), SCHEMA, projection, store, fresh_path(s, "positions"))
    return progress(store, projection).select("shard", "mark")


@query("stream_windows", "SELECT date_trunc('hour', ts) AS hour, user_id AS stream_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    events = s.readStream.schema(SCHEMA).parquet(_log_files(s, d)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    store = TableStore(s, fresh_path(s, "windows"))
    totals = running_totals(events, "stream_id", "value", "60 days")
    updates = totals.writeStream.foreachBatch(lambda rows, number: store.append("windows", rows, number)).outputMode("update")
    updates.option("checkpointLocation", fresh_path(s, "positions")).trigger(availableNow=True).start().awaitTermination()
    last = store.read("windows").groupBy("window", "stream_id").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "stream_id", "n")


@query("subscription", _LOG + "SELECT type, count(*) AS n, max(seq_id) AS last FROM log WHERE type IN ('click', 'error') AND seq_id > 500 GROUP BY type")
def subscription(s: SparkSession, d: str) -> DataFrame:
    store = TableStore(s, fresh_path(s, "subscription"))
    count = lambda rows, number: store.append("seen", rows.groupBy("type").agg(F.count("*").alias("n"), F.max("seq_id").alias("last")), number)
    subscribe(s, _log_files(s, d), SCHEMA, "counter", count, store, fresh_path(s, "positions"), types=("click", "error"), after=500)
    return store.read("seen").groupBy("type").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@query("projection_statuses", _LOG + "SELECT shard, CASE shard WHEN 'activity-v1' THEN max(seq_id) END AS mark, CASE shard WHEN 'activity-v1' THEN 5 ELSE max(seq_id) + 5 END AS behind, CASE shard WHEN 'activity-v1' THEN 'behind' ELSE 'not started' END AS status FROM log, (VALUES ('activity-v1'), ('other-v1')) AS v(shard) GROUP BY shard")
def projection_statuses(s: SparkSession, d: str) -> DataFrame:
    first, second = Projection("activity", "stream_id", _members()), Projection("other", "stream_id", _members())
    store = TableStore(s, fresh_path(s, "projections"))
    run(s, _log_files(s, d), SCHEMA, first, store, fresh_path(s, "positions"))
    last = log(s, d).agg(F.max("seq_id")).first()[0] + 5
    return statuses(store, [first, second], last)


@query("composite_published_together", _LOG + f", one AS (SELECT stream_id, {_STATES} FROM log GROUP BY stream_id) SELECT last_type, count(*) AS streams, sum(clicks)::BIGINT AS clicks, (SELECT count(*) FROM one) AS of_streams FROM one GROUP BY last_type")
def composite_published_together(s: SparkSession, d: str) -> DataFrame:
    store = TableStore(s, fresh_path(s, "composite"))
    activity = Projection("activity", "stream_id", _members())
    stages = (
        {"activity": lambda t: project(activity, t["log"])},
        {"by_type": lambda t: t["activity"].groupBy("last_type").agg(F.count("*").alias("streams"), F.sum("clicks").alias("clicks"))},
    )
    publish_composite(store, Composite("both", stages), log(s, d))
    read = store.read_together("both")
    return read["by_type"].crossJoin(F.broadcast(read["activity"].agg(F.count("*").alias("of_streams"))))  # one row


@query("inline_projection", _LOG + f"SELECT stream_id, {_STATES}, (SELECT count(*) FROM log) AS events FROM log GROUP BY stream_id")
def inline_projection(s: SparkSession, d: str) -> DataFrame:
    store, rows = TableStore(s, fresh_path(s, "inline")), log(s, d)
    activity = Projection("activity", "stream_id", _members())
    middle = rows.agg((F.max("seq_id") / 2).cast("bigint")).first()[0]
    append_inline(store, "both", rows.where(F.col("seq_id") <= middle), [activity])
    append_inline(store, "both", rows.where(F.col("seq_id") > middle), [activity])
    n = store.read_together("both")["log"].agg(F.count("*").alias("events"))
    return inline_rows(store, "both", activity).crossJoin(F.broadcast(n))  # one row


@query("snapshot_refreshed", _DELETED + f"SELECT stream_id, {_STATES} FROM log JOIN cuts USING (stream_id) WHERE cut IS NULL OR seq_id > cut GROUP BY stream_id")
def snapshot_refreshed(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    activity = Projection("activity", "stream_id", _members(), delete=lambda: (F.col("type") == "error") & (F.col("value") > 70))
    middle = rows.agg((F.max("seq_id") / 3).cast("bigint")).first()[0]
    store = TableStore(s, fresh_path(s, "snapshots"))
    store.publish("activity", project(activity, rows.where(F.col("seq_id") <= middle)))
    return refresh(activity, store.read("activity"), rows.where(F.col("seq_id") > middle))
