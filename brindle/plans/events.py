"""Queries on the event log: streams, tags, the high-water mark, folds and projections.

The driver's ``events`` are the log: user_id is the stream, and versions count from 1 inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.fold import ColumnMap, Member, event_documents, flat_table, fold, fold_function, fold_pandas, last_known, slice_by, timeline
from brindle.plans.core import query, table
from brindle.sources import events as E


def log(s: SparkSession, d: str) -> DataFrame:
    """The driver's events in the envelope of a log."""
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    rows = table(s, d, "events").withColumn("version", version)
    return rows.select(
        F.col("event_id").alias("seq_id"), F.col("user_id").alias("stream_id"), "version", F.col("event_type").alias("type"),
        F.col("ts").alias("timestamp"), "value", F.col("props").alias("data"), (F.col("user_id") % 10 == 0).alias("is_archived"),
    )


_LOG = """WITH log AS (SELECT event_id AS seq_id, user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version,
    event_type AS type, ts AS timestamp, value, props AS data, user_id % 10 = 0 AS is_archived FROM events) """


# --- reads -----------------------------------------------------------------------------------------


@query("events_all", _LOG + "SELECT seq_id, stream_id, version, type FROM log WHERE NOT is_archived")
def events_all(s: SparkSession, d: str) -> DataFrame:
    return E.visible(log(s, d)).select("seq_id", "stream_id", "version", "type")


@query("events_typed", _LOG + "SELECT seq_id, CAST(json_extract_string(data, '$.k') AS INT) AS k FROM log WHERE type = 'purchase' AND NOT is_archived")
def events_typed(s: SparkSession, d: str) -> DataFrame:
    return E.of_type(E.visible(log(s, d)), "purchase", "k int").select("seq_id", F.col("body.k").alias("k"))


@query("event_by_id", _LOG + "SELECT seq_id, stream_id, version, type, value FROM log WHERE seq_id = 77")
def event_by_id(s: SparkSession, d: str) -> DataFrame:
    return log(s, d).where(F.col("seq_id") == 77).select("seq_id", "stream_id", "version", "type", "value")


@query("fetch_stream", _LOG + "SELECT version, seq_id, type, value FROM log WHERE stream_id = 7 ORDER BY version")
def fetch_stream(s: SparkSession, d: str) -> DataFrame:
    return E.fetch_stream(log(s, d), 7).select("version", "seq_id", "type", "value")


@query("fetch_stream_bounds", _LOG + "SELECT version, seq_id FROM log WHERE stream_id = 7 AND version BETWEEN 3 AND 30 AND timestamp <= TIMESTAMP '2024-01-20' ORDER BY version")
def fetch_stream_bounds(s: SparkSession, d: str) -> DataFrame:
    return E.fetch_stream(log(s, d), 7, 30, F.lit("2024-01-20").cast("timestamp"), 3).select("version", "seq_id")


@query("stream_state", _LOG + "SELECT stream_id, max(version) AS version, min(timestamp) AS created, max(timestamp) AS timestamp FROM log GROUP BY stream_id")
def stream_state(s: SparkSession, d: str) -> DataFrame:
    return E.stream_states(log(s, d))


@query("recent_streams", _LOG + "SELECT stream_id, max(version) AS version, min(timestamp) AS created, max(timestamp) AS timestamp FROM log GROUP BY stream_id ORDER BY 4 DESC, 1 LIMIT 10")
def recent_streams(s: SparkSession, d: str) -> DataFrame:
    return E.recent_streams(log(s, d), 10)


@query("event_query_paged", _LOG + "SELECT seq_id, (SELECT count(*) FROM log WHERE type IN ('click', 'view') AND NOT is_archived) AS total FROM log WHERE type IN ('click', 'view') AND NOT is_archived ORDER BY seq_id LIMIT 25 OFFSET 25")
def event_query_paged(s: SparkSession, d: str) -> DataFrame:
    found = E.query_events(log(s, d), types=["click", "view"], number=2)
    return found.rows.select("seq_id", F.lit(found.total).cast("bigint").alias("total"))


@query("event_page", _LOG + "SELECT seq_id, type FROM log WHERE seq_id > 100 AND seq_id <= 900 AND type = 'error' AND NOT is_archived ORDER BY seq_id LIMIT 50")
def event_page(s: SparkSession, d: str) -> DataFrame:
    return E.event_page(log(s, d), 100, 900, 50, ["error"]).select("seq_id", "type")


@query("floor_at_time", "SELECT min(event_id) AS seq_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def floor_at_time(s: SparkSession, d: str) -> DataFrame:
    return E.floor_at(log(s, d), F.lit("2024-01-15").cast("timestamp"))


@query("log_statistics", "SELECT count(*) AS events, count(DISTINCT user_id) AS streams, max(event_id) AS sequence FROM events")
def log_statistics(s: SparkSession, d: str) -> DataFrame:
    return E.statistics(log(s, d))


@query("dead_letters", _LOG + "SELECT seq_id, type FROM log WHERE type NOT IN ('click', 'purchase') OR seq_id % 13 = 0")
def dead_letters(s: SparkSession, d: str) -> DataFrame:
    broken = log(s, d).withColumn("data", F.when(F.col("seq_id") % 13 == 0, F.lit('{"k": ')).otherwise(F.col("data")))
    _, dead = E.split_bodies(broken, {"click": "k int", "purchase": "k int"})
    return dead.select("seq_id", "type")


@query("dead_letter_counts", _LOG + "SELECT type, count(*) AS n FROM log WHERE type NOT IN ('click', 'purchase') GROUP BY type")
def dead_letter_counts(s: SparkSession, d: str) -> DataFrame:
    _, dead = E.split_bodies(log(s, d), {"click": "k int", "purchase": "k int"})
    return dead.groupBy("type").agg(F.count("*").alias("n"))


@query("conversation_turns", "SELECT conv_id AS stream_id, max(turn) + 1 AS version, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_turns(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversations").groupBy(F.col("conv_id").alias("stream_id"))
    return rows.agg((F.max("turn") + 1).alias("version"), F.max_by("role", "turn").alias("last_role"))


# --- high-water mark -----------------------------------------------------------------------------------


_FIRST_HOLE = """WITH ids AS (SELECT -1::BIGINT AS id UNION ALL SELECT event_id FROM events WHERE {kept}),
    ahead AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM ids)
    SELECT coalesce(min(id) FILTER (WHERE nxt > id + 1), max(id))::INT AS mark FROM ahead"""


@query("high_water_contiguous", "SELECT max(event_id) AS mark FROM events")
def high_water_contiguous(s: SparkSession, d: str) -> DataFrame:
    return E.high_water(log(s, d), -1)


@query("high_water_gap", _FIRST_HOLE.format(kept="event_id % 997 <> 0 OR event_id = 0"))
def high_water_gap(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).where((F.col("seq_id") % 997 != 0) | (F.col("seq_id") == 0))
    return E.high_water(rows, -1).select(F.col("mark").cast("int").alias("mark"))


@query("high_water_leading_gap", _FIRST_HOLE.format(kept="event_id % 997 <> 0"))
def high_water_leading_gap(s: SparkSession, d: str) -> DataFrame:
    return E.high_water(log(s, d).where(F.col("seq_id") % 997 != 0), -1).select(F.col("mark").cast("int").alias("mark"))


@query(
    "high_water_stale",
    """WITH kept AS (SELECT event_id, ts FROM events WHERE event_id % 997 <> 0),
    holes AS (SELECT event_id, lead(event_id) OVER (ORDER BY event_id) AS nxt, lead(ts) OVER (ORDER BY event_id) AS nts FROM kept)
    SELECT coalesce((SELECT min(event_id) FROM holes WHERE nxt - event_id > 1 AND nts >= TIMESTAMP '2024-01-10'), (SELECT max(event_id) FROM kept)) AS mark""",
)
def high_water_stale(s: SparkSession, d: str) -> DataFrame:
    return E.high_water(log(s, d).where(F.col("seq_id") % 997 != 0), -1, F.lit("2024-01-10").cast("timestamp"))


@query("gap_list", "SELECT gap_after, gap_before, gap_before - gap_after - 1 AS missing FROM (SELECT event_id AS gap_after, lead(event_id) OVER (ORDER BY event_id) AS gap_before FROM events WHERE event_id % 97 <> 0 AND event_id % 1000 > 3) WHERE gap_before - gap_after > 1")
def gap_list(s: SparkSession, d: str) -> DataFrame:
    return E.gaps(log(s, d).where((F.col("seq_id") % 97 != 0) & (F.col("seq_id") % 1000 > 3)), -1)


@query("high_water_by_tenant", "SELECT o AS tenant_id, min(event_id) AS mark FROM (SELECT event_id % 3 AS o, event_id, lead(event_id) OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS nxt FROM events WHERE event_id % 1009 < 1000) WHERE nxt IS NULL OR nxt > event_id + 3 GROUP BY o")
def high_water_by_tenant(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).where(F.col("seq_id") % 1009 < 1000).select((F.col("seq_id") % 3).alias("tenant_id"), F.floor(F.col("seq_id") / 3).alias("seq_id"))
    return E.high_water_by_tenant(rows).select("tenant_id", (F.col("mark") * 3 + F.col("tenant_id")).alias("mark"))


# --- tags -----------------------------------------------------------------------------------------------


def _tags(rows: DataFrame) -> DataFrame:
    return E.tags_from(rows, user=F.col("stream_id"), kind=F.col("type"), half=F.when(F.col("value") >= 50, F.lit("Upper")))


@query("tag_table", _LOG + "SELECT 'user' AS tag, stream_id::VARCHAR AS value, seq_id FROM log UNION ALL SELECT 'kind', type, seq_id FROM log UNION ALL SELECT 'half', 'Upper', seq_id FROM log WHERE value >= 50")
def tag_table(s: SparkSession, d: str) -> DataFrame:
    return _tags(log(s, d))


@query("has_tag", _LOG + "SELECT seq_id FROM log WHERE stream_id = 12 AND type = 'click'")
def has_tag(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    return E.has_tag(E.has_tag(rows, _tags(rows), "user", 12), _tags(rows), "kind", "click").select("seq_id")


_CONDITIONS = [("user", 12, None), ("user", 33, "error"), ("half", "Upper", "signup")]
_TAGGED = "(stream_id = 12 OR stream_id = 33 AND type = 'error' OR value >= 50 AND type = 'signup')"


@query("tags_or", _LOG + f"SELECT seq_id, type FROM log WHERE {_TAGGED} AND NOT is_archived ORDER BY seq_id")
def tags_or(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    return E.matching_tags(rows, _tags(rows), _CONDITIONS).orderBy("seq_id").select("seq_id", "type")


@query("tags_and", _LOG + "SELECT seq_id FROM log WHERE value >= 50 AND type = 'view'")
def tags_and(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    return E.all_tags(rows, _tags(rows), {"half": "UPPER", "kind": "View"}).select("seq_id")


@query("events_exist", _LOG + f"SELECT count(*) > 0 AS \"exists\" FROM log WHERE {_TAGGED} AND NOT is_archived")
def events_exist(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    return E.events_exist(rows, _tags(rows), _CONDITIONS)


@query("tags_aggregate", _LOG + f"SELECT count(*) AS events, round(sum(value), 4) AS total, arg_max(type, seq_id) AS last_type FROM log WHERE {_TAGGED} AND NOT is_archived")
def tags_aggregate(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    return E.matching_tags(rows, _tags(rows), _CONDITIONS).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.max_by("type", "seq_id").alias("last_type"))


@query("assign_tag", _LOG + "SELECT 'half' AS tag, 'Upper' AS value, seq_id FROM log WHERE type = 'purchase' AND value > 40 AND NOT value >= 50")
def assign_tag(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    return E.assign_tag(rows, _tags(rows), (F.col("type") == "purchase") & (F.col("value") > 40), "half", "Upper")


# --- writes to the log ---------------------------------------------------------------------------------------


def _batch(s: SparkSession, d: str) -> DataFrame:
    """A batch to append: the urgent orders, in streams of their customers, most of which are new."""
    rows = table(s, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return rows.select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("position"), F.lit("order").alias("type"))


@query(
    "append_events",
    """SELECT o_custkey AS stream_id, o_orderkey AS position, 'order' AS type,
    coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
    (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS seq_id
    FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = o_custkey WHERE o_orderpriority = '1-URGENT'""",
)
def append_events(s: SparkSession, d: str) -> DataFrame:
    return E.append(log(s, d).drop("is_archived"), _batch(s, d), "position")


@query("start_streams", "SELECT o_custkey + 1000000 AS stream_id, o_orderkey AS position, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders WHERE o_orderpriority = '1-URGENT'")
def start_streams(s: SparkSession, d: str) -> DataFrame:
    batch = _batch(s, d).withColumn("stream_id", F.col("stream_id") + 1000000)
    return E.start_streams(log(s, d), batch, "position").select("stream_id", "position", "version")


@query("archive_streams", _LOG + "SELECT is_archived OR stream_id % 7 = 0 AS is_archived, count(*) AS n FROM log GROUP BY 1")
def archive_streams(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    done = E.set_archived(rows, rows.where(F.col("stream_id") % 7 == 0).select("stream_id"))
    return done.groupBy("is_archived").agg(F.count("*").alias("n"))


@query("tombstone_streams", _LOG + "SELECT 'events' AS what, count(*) AS n FROM log WHERE stream_id % 7 <> 0 UNION ALL SELECT 'tags', sum(2 + (value >= 50)::INT)::BIGINT FROM log WHERE stream_id % 7 <> 0")
def tombstone_streams(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    kept, tags = E.tombstone(rows, _tags(rows), rows.where(F.col("stream_id") % 7 == 0).select("stream_id").distinct())
    return kept.agg(F.lit("events").alias("what"), F.count("*").alias("n")).unionByName(tags.agg(F.lit("tags").alias("what"), F.count("*").alias("n")))


@query("replace_events", _LOG + "SELECT seq_id, CASE WHEN type = 'error' AND value > 90 THEN '{\"k\": 0}' ELSE data END AS data, CASE WHEN type = 'error' AND value > 90 THEN 'fixed' ELSE type END AS type FROM log")
def replace_events(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    changes = rows.where((F.col("type") == "error") & (F.col("value") > 90)).select("seq_id", F.lit('{"k": 0}').alias("data"), F.lit("fixed").alias("type"))
    return E.replace_events(rows, changes).select("seq_id", "data", "type")


@query("mask_events", _LOG + "SELECT seq_id, CASE WHEN type = 'signup' THEN '***' ELSE data END AS data, type = 'signup' AS masked FROM log")
def mask_events(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).withColumn("headers", F.lit(None).cast("map<string,string>"))
    done = E.mask(rows, F.col("type") == "signup", F.lit("***"), {"masked": "yes"})
    return done.select("seq_id", "data", F.coalesce(F.col("headers")["masked"] == "yes", F.lit(False)).alias("masked"))


@query("compact_streams", _LOG + "SELECT stream_id, version, CASE WHEN version = 20 THEN 'compacted' ELSE type END AS type, CASE WHEN version = 20 THEN (SELECT sum(l.value::DECIMAL(18,6)) FROM log l WHERE l.stream_id = log.stream_id AND l.version <= 20)::DECIMAL(28,6)::VARCHAR END AS total FROM log WHERE version >= 20 OR stream_id IN (SELECT stream_id FROM log GROUP BY stream_id HAVING max(version) < 20)")
def compact_streams(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    upto = rows.where(F.col("version") <= 20)
    states = upto.groupBy("stream_id").agg(F.max("version").alias("version"), F.sum(F.col("value").cast("decimal(18,6)")).cast("string").alias("data")).where("version = 20")
    done = E.compact(rows, states, "compacted")
    return done.select("stream_id", "version", "type", F.when(F.col("type") == "compacted", F.col("data")).alias("total"))


@query("natural_key_lookup", _LOG + "SELECT arg_max(json_extract_string(data, '$.k'), seq_id) FILTER (WHERE type = 'signup') AS natural_key, stream_id FROM log GROUP BY stream_id HAVING max(seq_id) FILTER (WHERE type = 'signup') > coalesce(max(seq_id) FILTER (WHERE type = 'error'), -1)")
def natural_key_lookup(s: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("type") == "signup", F.get_json_object("data", "$.k"))
    return E.natural_keys(log(s, d), key, F.col("type") == "error")


# --- folds ---------------------------------------------------------------------------------------------------------


def _members() -> list[Member]:
    cents = F.round(F.col("value") * 100).cast("bigint")
    return [
        Member("clicks", "count", ("click",)),
        Member("spent", "add", ("purchase",), cents),
        Member("balance", "subtract", ("purchase", "error"), cents),
        Member("last_type", "last", (), F.col("type")),
        Member("first_view", "first", ("view",), F.col("seq_id")),
        Member("flag", "set", ("error",), F.lit("seen")),
    ]


_CENTS = "round(value * 100)::BIGINT"
_MEMBERS = f"""count(*) FILTER (WHERE type = 'click') AS clicks, coalesce(sum({_CENTS}) FILTER (WHERE type = 'purchase'), 0)::BIGINT AS spent,
    coalesce(-sum({_CENTS}) FILTER (WHERE type IN ('purchase', 'error')), 0)::BIGINT AS balance, arg_max(type, seq_id) AS last_type,
    min(seq_id) FILTER (WHERE type = 'view') AS first_view, CASE WHEN count(*) FILTER (WHERE type = 'error') > 0 THEN 'seen' END AS flag"""


@query("live_aggregate", _LOG + f"SELECT stream_id, {_MEMBERS} FROM log WHERE stream_id = 7 GROUP BY stream_id")
def live_aggregate(s: SparkSession, d: str) -> DataFrame:
    return fold(log(s, d).where(F.col("stream_id") == 7), "stream_id", _members())


@query("aggregate_at_version", _LOG + f"SELECT stream_id, {_MEMBERS} FROM log WHERE stream_id = 7 AND version <= 25 GROUP BY stream_id")
def aggregate_at_version(s: SparkSession, d: str) -> DataFrame:
    return fold(E.fetch_stream(log(s, d), 7, 25), "stream_id", _members())


@query("aggregate_all", _LOG + f"SELECT 0 AS one, {_MEMBERS} FROM log WHERE NOT is_archived")
def aggregate_all(s: SparkSession, d: str) -> DataFrame:
    return fold(E.visible(log(s, d)).withColumn("one", F.lit(0)), "one", _members())


@query("single_stream_projection", _LOG + f"SELECT stream_id, {_MEMBERS} FROM log GROUP BY stream_id")
def single_stream_projection(s: SparkSession, d: str) -> DataFrame:
    return fold(log(s, d), "stream_id", _members())


@query("projection_with_create", _LOG + f"SELECT stream_id, {_MEMBERS} FROM log GROUP BY stream_id HAVING count(*) FILTER (WHERE type = 'signup' AND value > 95) > 0")
def projection_with_create(s: SparkSession, d: str) -> DataFrame:
    return fold(log(s, d), "stream_id", _members(), create=(F.col("type") == "signup") & (F.col("value") > 95))


_DELETED = _LOG + ", cuts AS (SELECT stream_id, max(seq_id) FILTER (WHERE type = 'error' AND value > 70) AS cut, max(seq_id) AS last FROM log GROUP BY stream_id) "


@query("projection_with_delete", _DELETED + f"SELECT stream_id, {_MEMBERS} FROM log JOIN cuts USING (stream_id) WHERE cut IS NULL OR seq_id > cut GROUP BY stream_id")
def projection_with_delete(s: SparkSession, d: str) -> DataFrame:
    return fold(log(s, d), "stream_id", _members(), (F.col("type") == "error") & (F.col("value") > 70))


@query(
    "aggregate_last_known",
    _LOG + f""", ends AS (SELECT stream_id, max(seq_id) AS last FROM log GROUP BY stream_id),
    tail AS (SELECT log.* FROM log JOIN ends USING (stream_id) WHERE NOT (seq_id = last AND type = 'error')),
    cuts AS (SELECT stream_id, max(seq_id) AS cut FROM tail WHERE type = 'error' GROUP BY stream_id)
    SELECT stream_id, {_MEMBERS} FROM tail LEFT JOIN cuts USING (stream_id) WHERE cut IS NULL OR seq_id > cut GROUP BY stream_id""",
)
def aggregate_last_known(s: SparkSession, d: str) -> DataFrame:
    return last_known(log(s, d), "stream_id", _members(), F.col("type") == "error")


@query("aggregate_many", _LOG + "SELECT type AS slice_key, count(*) AS clicks, count(DISTINCT stream_id) AS streams FROM log WHERE type IN ('click', 'view') GROUP BY type")
def aggregate_many(s: SparkSession, d: str) -> DataFrame:
    rows = slice_by(log(s, d), ("click", F.lit("click")), ("view", F.lit("view")))
    streams = fold(rows, ["slice_key", "stream_id"], [Member("n", "count")]).groupBy("slice_key").agg(F.count("*").alias("streams"))
    return fold(rows, "slice_key", [Member("clicks", "count")]).join(streams, "slice_key")


@query("multi_stream_projection", _LOG + f"SELECT slice_key, {_MEMBERS} FROM (SELECT *, CASE type WHEN 'purchase' THEN 'p' || stream_id % 20 WHEN 'click' THEN 'c' || stream_id % 5 END AS slice_key FROM log) WHERE slice_key IS NOT NULL GROUP BY slice_key")
def multi_stream_projection(s: SparkSession, d: str) -> DataFrame:
    stream = F.col("stream_id")
    rows = slice_by(log(s, d), ("purchase", F.concat(F.lit("p"), stream % 20)), ("click", F.concat(F.lit("c"), stream % 5)))
    return fold(rows, "slice_key", _members())


@query("multi_stream_fan_out", _LOG + "SELECT slice_key, count(*) AS n FROM (SELECT unnest(['user' || stream_id, 'day' || day(timestamp)]) AS slice_key FROM log WHERE type = 'signup') GROUP BY slice_key")
def multi_stream_fan_out(s: SparkSession, d: str) -> DataFrame:
    keys = F.array(F.concat(F.lit("user"), "stream_id"), F.concat(F.lit("day"), F.dayofmonth("timestamp")))
    return fold(slice_by(log(s, d), ("signup", keys)), "slice_key", [Member("n", "count")])


@query("daily_segments", _LOG + f"SELECT stream_id || ':' || strftime(timestamp, '%Y-%m-%d') AS segment, count(*) AS n, coalesce(sum({_CENTS}) FILTER (WHERE type = 'purchase'), 0)::BIGINT AS spent FROM log GROUP BY 1")
def daily_segments(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).withColumn("segment", F.concat("stream_id", F.lit(":"), F.date_format("timestamp", "yyyy-MM-dd")))
    return fold(rows, "segment", [Member("n", "count"), Member("spent", "add", ("purchase",), F.round(F.col("value") * 100).cast("bigint"))])


@query("step_timeline", _LOG + f"SELECT stream_id, seq_id, type, count(*) FILTER (WHERE type = 'click') OVER w AS clicks, coalesce(sum({_CENTS}) FILTER (WHERE type = 'purchase') OVER w, 0)::BIGINT AS spent FROM log WINDOW w AS (PARTITION BY stream_id ORDER BY seq_id ROWS UNBOUNDED PRECEDING)")
def step_timeline(s: SparkSession, d: str) -> DataFrame:
    return timeline(log(s, d), "stream_id", _members()[:2])


@query("fold_by_function", _LOG + "SELECT stream_id, count(*) FILTER (WHERE type = 'click') AS clicks, arg_max(type, seq_id) AS last_type FROM log GROUP BY stream_id")
def fold_by_function(s: SparkSession, d: str) -> DataFrame:
    zero = F.struct(F.lit(0).cast("bigint").alias("clicks"), F.lit(None).cast("string").alias("last_type"))
    folded = fold_function(
        log(s, d), "stream_id", ["type"], zero,
        lambda a, e: F.struct((a["clicks"] + F.when(e["type"] == "click", 1).otherwise(0)).cast("bigint").alias("clicks"), e["type"].alias("last_type")),
        merge=lambda a, b: F.struct((a["clicks"] + b["clicks"]).alias("clicks"), b["last_type"].alias("last_type")),
    )
    return folded.select("stream_id", "state.*")


def _pandas_step(state: dict | None, event: dict) -> dict | None:
    if event["type"] == "error" and event["value"] > 70:
        return None
    state = state or {"clicks": 0, "last_type": None}
    return {"clicks": state["clicks"] + (event["type"] == "click"), "last_type": event["type"]}


@query("fold_by_python", _DELETED + "SELECT stream_id, count(*) FILTER (WHERE type = 'click') AS clicks, arg_max(type, seq_id) AS last_type FROM log JOIN cuts USING (stream_id) WHERE cut IS NULL OR seq_id > cut GROUP BY stream_id")
def fold_by_python(s: SparkSession, d: str) -> DataFrame:
    return fold_pandas(log(s, d), "stream_id", ["type", "value"], _pandas_step, "stream_id bigint, clicks bigint, last_type string")


def _column_maps() -> dict[str, list[ColumnMap]]:
    cents = F.round(F.col("value") * 100).cast("bigint")
    return {
        "signup": [ColumnMap("status", "set", F.lit("member")), ColumnMap("credit", "map", cents)],
        "purchase": [ColumnMap("credit", "increment", cents)],
        "click": [ColumnMap("score", "increment")],
        "view": [ColumnMap("score", "decrement")],
    }


@query(
    "flat_table",
    _LOG + f""", cuts AS (SELECT stream_id, max(seq_id) AS cut FROM log WHERE type = 'error' GROUP BY stream_id),
    live AS (SELECT log.* FROM log LEFT JOIN cuts USING (stream_id) WHERE (cut IS NULL OR seq_id > cut) AND type <> 'error'),
    based AS (SELECT *, max(seq_id) FILTER (WHERE type = 'signup') OVER (PARTITION BY stream_id) AS base FROM live)
    SELECT stream_id, arg_max('member', seq_id) FILTER (WHERE type = 'signup') AS status,
    (coalesce(arg_max({_CENTS}, seq_id) FILTER (WHERE type = 'signup'), 0) + coalesce(sum(CASE WHEN type = 'purchase' THEN {_CENTS} ELSE 0 END) FILTER (WHERE base IS NULL OR seq_id > base), 0))::BIGINT AS credit,
    coalesce(sum(CASE type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END), 0)::BIGINT AS score
    FROM based GROUP BY stream_id""",
)
def flat_table_query(s: SparkSession, d: str) -> DataFrame:
    return flat_table(log(s, d), "stream_id", _column_maps(), deletes=["error"])


@query("event_projection", _LOG + "SELECT 'purchase-' || seq_id AS id, stream_id, round(value * 1.2, 4) AS gross FROM log WHERE type = 'purchase'")
def event_projection(s: SparkSession, d: str) -> DataFrame:
    members = [F.col("stream_id"), F.round(F.col("value") * 1.2, 4).alias("gross")]
    return event_documents(log(s, d), ("purchase", F.concat(F.lit("purchase-"), "seq_id"), members))


@query("enriched_projection", _LOG + "SELECT c_mktsegment AS segment, count(*) AS n FROM log JOIN customer ON stream_id = c_custkey GROUP BY c_mktsegment")
def enriched_projection(s: SparkSession, d: str) -> DataFrame:
    people = table(s, d, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_mktsegment").alias("segment"))
    return fold(log(s, d).join(people, "stream_id"), "segment", [Member("n", "count")])


@query("composite_two_stage", _LOG + f", one AS (SELECT stream_id, {_MEMBERS} FROM log GROUP BY stream_id) SELECT last_type, count(*) AS streams, sum(clicks)::BIGINT AS clicks, max(spent) AS most_spent FROM one GROUP BY last_type")
def composite_two_stage(s: SparkSession, d: str) -> DataFrame:
    one = fold(log(s, d), "stream_id", _members())
    return one.groupBy("last_type").agg(F.count("*").alias("streams"), F.sum("clicks").alias("clicks"), F.max("spent").alias("most_spent"))


@query("session_windows", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 6 HOUR GROUP BY user_id")
def session_windows(s: SparkSession, d: str) -> DataFrame:
    seconds = F.col("ts").cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(s, d, "events").withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > 6 * 3600))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"))
