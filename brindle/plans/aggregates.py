"""Queries on aggregates that are fetched, written and projected, on diagnostics, and on what sessions queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import aggregates as A
from brindle.operators.fold import Member, slice_by
from brindle.plans.core import query, table
from brindle.plans.documents import CUSTOMER, ORDER, SEGMENT_CUSTOMER, on, session
from brindle.plans.events import _LOG, log
from brindle.sources import events as E
from brindle.sources import store
from brindle.sources.schema import DocumentType
from brindle.sources.shared import fresh_path
from brindle.streaming.projections import Projection, project

_STATES = "count(*) FILTER (WHERE type = 'click') AS clicks, arg_max(type, seq_id) AS last_type"


def _members() -> list[Member]:
    return [Member("clicks", "count", ("click",)), Member("last_type", "last", (), F.col("type"))]


def _streams(s: SparkSession, d: str) -> DataFrame:
    """Streams to ask for: customers of one segment, of whom only some have events."""
    return table(s, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("stream_id"))


_ASKED = "asked AS (SELECT c_custkey AS stream_id FROM customer WHERE c_mktsegment = 'BUILDING')"


@query("fetch_for_writing", _LOG + f", {_ASKED} SELECT stream_id, coalesce(max(version), 0) AS version, CASE WHEN max(version) IS NOT NULL THEN count(*) FILTER (WHERE type = 'click') END AS clicks, arg_max(type, seq_id) AS last_type FROM asked LEFT JOIN log USING (stream_id) GROUP BY stream_id")
def fetch_for_writing(s: SparkSession, d: str) -> DataFrame:
    return A.fetch_for_writing(log(s, d), _streams(s, d), _members())


def _decide(states: DataFrame) -> DataFrame:
    """A bonus for streams with many clicks, and a greeting for those that are new."""
    kind = F.when(F.col("version") == 0, "greeted").when(F.col("clicks") > 12, "rewarded")
    return states.select("stream_id", F.col("stream_id").alias("position"), kind.alias("type")).where(F.col("type").isNotNull())


@query(
    "write_to_aggregate",
    _LOG + f""", {_ASKED}, live AS (SELECT * FROM log WHERE NOT is_archived), states AS (SELECT stream_id, coalesce(max(version), 0) AS version, count(*) FILTER (WHERE type = 'click') AS clicks FROM asked LEFT JOIN live USING (stream_id) WHERE stream_id % 10 <> 0 GROUP BY stream_id)
    SELECT stream_id, stream_id AS position, CASE WHEN version = 0 THEN 'greeted' ELSE 'rewarded' END AS type, version + 1 AS version,
    (SELECT max(seq_id) FROM log) + row_number() OVER (ORDER BY stream_id) AS seq_id FROM states WHERE version = 0 OR clicks > 12""",
)
def write_to_aggregate(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    states = A.fetch_for_writing(rows, _streams(s, d).where(F.col("stream_id") % 10 != 0), _members())  # archived streams take no events
    return A.write_to_aggregate(rows, states, _decide, "position")


@query("append_optimistic", "SELECT o_custkey AS stream_id, o_orderkey AS position, coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = o_custkey WHERE o_orderpriority = '2-HIGH'")
def append_optimistic(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).drop("is_archived")
    batch = table(s, d, "orders").where(F.col("o_orderpriority") == "2-HIGH").select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("position"))
    return A.append_optimistic(rows, batch, "position", rows).select("stream_id", "position", "version")


@query("fetch_latest", _LOG + f", {_ASKED} SELECT stream_id, {_STATES} FROM log JOIN asked USING (stream_id) WHERE NOT is_archived GROUP BY stream_id")
def fetch_latest(s: SparkSession, d: str) -> DataFrame:
    return A.fetch_latest(log(s, d), _streams(s, d), _members())


@query("project_latest", _LOG + f", {_ASKED} SELECT stream_id, coalesce(count(*) FILTER (WHERE type = 'click'), 0) + 1 AS clicks, 'click' AS last_type FROM asked LEFT JOIN log USING (stream_id) WHERE stream_id % 10 <> 0 GROUP BY stream_id")
def project_latest(s: SparkSession, d: str) -> DataFrame:
    streams = _streams(s, d).where(F.col("stream_id") % 10 != 0)
    pending = streams.select("stream_id", F.col("stream_id").alias("position"), F.lit("click").alias("type"))
    return A.project_latest(log(s, d), pending, "position", streams, _members())


@query(
    "timeline_before_and_after",
    _LOG + """, steps AS (SELECT stream_id, seq_id, type, count(*) FILTER (WHERE type = 'click') OVER w AS clicks FROM log WINDOW w AS (PARTITION BY stream_id ORDER BY seq_id ROWS UNBOUNDED PRECEDING))
    SELECT stream_id, seq_id, type, lag(clicks) OVER (PARTITION BY stream_id ORDER BY seq_id) AS before, clicks AS after FROM steps""",
)
def timeline_before_and_after(s: SparkSession, d: str) -> DataFrame:
    rows = A.before_and_after(log(s, d), "stream_id", _members()[:1])
    return rows.select("stream_id", "seq_id", "type", F.col("before.clicks").alias("before"), F.col("after.clicks").alias("after"))


@query(
    "timeline_of_slices",
    _LOG + """, sliced AS (SELECT *, CASE type WHEN 'click' THEN 'c' || stream_id % 50 WHEN 'view' THEN 'c' || stream_id % 50 END AS slice_key FROM log),
    steps AS (SELECT slice_key, seq_id, count(*) FILTER (WHERE type = 'click') OVER w AS clicks FROM sliced WHERE slice_key IS NOT NULL WINDOW w AS (PARTITION BY slice_key ORDER BY seq_id ROWS UNBOUNDED PRECEDING))
    SELECT slice_key, seq_id, lag(clicks) OVER (PARTITION BY slice_key ORDER BY seq_id) AS before, clicks AS after FROM steps""",
)
def timeline_of_slices(s: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("c"), F.col("stream_id") % 50)
    rows = A.before_and_after(slice_by(log(s, d), ("click", key), ("view", key)), "slice_key", _members()[:1])
    return rows.select("slice_key", "seq_id", F.col("before.clicks").alias("before"), F.col("after.clicks").alias("after"))


@query(
    "natural_key_upsert",
    _LOG + """, keys AS (SELECT arg_max(json_extract_string(data, '$.k'), seq_id) FILTER (WHERE type = 'signup') AS natural_key, stream_id, bool_or(is_archived) AS gone FROM log GROUP BY stream_id
        HAVING max(seq_id) FILTER (WHERE type = 'signup') > coalesce(max(seq_id) FILTER (WHERE type = 'error'), -1)),
    holders AS (SELECT natural_key, min(stream_id) AS stream_id FROM keys WHERE NOT gone GROUP BY natural_key)
    SELECT p_size::VARCHAR AS natural_key, p_partkey AS seq, stream_id, stream_id IS NULL AS fresh FROM part LEFT JOIN holders ON natural_key = p_size::VARCHAR""",
)
def natural_key_upsert(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    key = F.when(F.col("type") == "signup", F.get_json_object("data", "$.k"))
    keys = E.without_archived_keys(E.natural_keys(rows, key, F.col("type") == "error"), rows)
    keys = keys.groupBy("natural_key").agg(F.min("stream_id").alias("stream_id"))  # of streams with one key the oldest holds it
    batch = table(s, d, "part").select(F.col("p_size").cast("string").alias("natural_key"), F.col("p_partkey").alias("seq"))
    found, started = E.with_natural_key(keys, batch)
    fresh = found.join(started.select("stream_id", F.lit(True).alias("fresh")), "stream_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return fresh.select("natural_key", "seq", F.when(~F.col("fresh"), F.col("stream_id")).alias("stream_id"), "fresh")


@query("binary_payloads", "SELECT event_id AS seq_id, props AS data FROM events")
def binary_payloads(s: SparkSession, d: str) -> DataFrame:
    """Bodies kept as bytes for every other event, and read back beside those kept as text."""
    rows, packed = log(s, d), F.col("seq_id") % 2 == 0
    kept = rows.withColumns({"bdata": F.when(packed, E.pack(F.col("data"))), "data": F.when(~packed, F.col("data"))})
    return E.unpack(kept).select("seq_id", "data")


@query("explorer_read", "SELECT event_id AS seq_id, 't' || user_id % 4 AS tenant_id, user_id % 10 = 0 AS is_archived FROM events WHERE user_id % 4 = 2")
def explorer_read(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).withColumn("tenant_id", F.concat(F.lit("t"), F.col("stream_id") % 4))
    return E.of_tenant(rows, "t2", archived=True).select("seq_id", "tenant_id", "is_archived")


@query("rebuild_of_one_tenant", _LOG + f"SELECT stream_id, {_STATES} FROM log WHERE stream_id % 4 = 2 GROUP BY stream_id")
def rebuild_of_one_tenant(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d).withColumn("tenant_id", F.concat(F.lit("t"), F.col("stream_id") % 4))
    return project(Projection("activity", "stream_id", tuple(_members())), rows, tenant="t2")


@query(
    "append_with_tags",
    """WITH added AS (SELECT o_custkey, o_orderstatus, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS seq_id FROM orders WHERE o_orderpriority = '2-HIGH')
    SELECT 'customer' AS tag, o_custkey::VARCHAR AS value, seq_id FROM added UNION ALL SELECT 'status', o_orderstatus, seq_id FROM added WHERE o_orderstatus <> 'P'""",
)
def append_with_tags(s: SparkSession, d: str) -> DataFrame:
    batch = table(s, d, "orders").where(F.col("o_orderpriority") == "2-HIGH")
    batch = batch.select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("status"))
    kinds = E.TagTypes(customer=F.col("stream_id"), status=F.when(F.col("status") != "P", F.col("status")), unused=F.lit(1))
    _, tags = E.append_tagged(log(s, d).drop("is_archived"), batch, "position", kinds, ["customer", "status"])
    return tags


@query("boundary_violations", _LOG + "SELECT seq_id FROM log WHERE (stream_id = 12 OR stream_id = 13 AND type = 'error') AND seq_id > 500 AND NOT is_archived")
def boundary_violations(s: SparkSession, d: str) -> DataFrame:
    rows = log(s, d)
    tags = E.tags_from(rows, user=F.col("stream_id"))
    return E.boundary_violations(rows, tags, [("user", 12, None), ("user", 13, "error")], 500).select("seq_id")


# --- documents ----------------------------------------------------------------------------------------


@query("documents_by_type", "SELECT c_custkey, c_mktsegment, 2 AS page, (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY' AND lower(c_name) LIKE '%1%') AS total FROM customer WHERE c_mktsegment = 'MACHINERY' AND lower(c_name) LIKE '%1%' ORDER BY c_custkey LIMIT 5 OFFSET 5")
def documents_by_type(s: SparkSession, d: str) -> DataFrame:
    found = session(s, d, "BUILDING").inspect(SEGMENT_CUSTOMER, {"c_mktsegment": "MACHINERY"}, {"c_name": "1"}, number=2, size=5)
    member = F.from_json("json", "c_custkey bigint, c_mktsegment string")
    return found.rows.select(member["c_custkey"].alias("c_custkey"), member["c_mktsegment"].alias("c_mktsegment"), F.lit(found.number).alias("page"), F.lit(found.total).cast("bigint").alias("total"))


@query("first_with_version", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json, r_regionkey AS version FROM region ORDER BY r_name DESC LIMIT 1")
def first_with_version(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, DocumentType("region", "region", "r_regionkey", version="r_regionkey")).order_by("r_name", descending=True).first_with_version()


@query("json_array", "SELECT '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_name) || ']' AS json FROM nation WHERE n_regionkey = 2")
def json_array(s: SparkSession, d: str) -> DataFrame:
    nation = on(s, d, DocumentType("nation", "nation", "n_nationkey")).where(F.col("n_regionkey") == 2)
    return nation.select("n_nationkey", "n_name").order_by("n_name").to_json_array()


@query("queued_sql", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY c_mktsegment")
def queued_sql(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "queued")
    table(s, d, "customer").createOrReplaceTempView("queued_customer")
    own = session(s, d)
    own.queue_sql(f"INSERT OVERWRITE DIRECTORY '{path}/rich' USING parquet SELECT c_custkey, c_mktsegment FROM queued_customer WHERE c_acctbal > ?", 100)
    own.queue_sql(f"INSERT OVERWRITE DIRECTORY '{path}/counts' USING parquet SELECT c_mktsegment, count(*) AS n FROM parquet.`{path}/rich` GROUP BY c_mktsegment")
    own.save_changes()
    return s.read.parquet(f"{path}/counts")


@query("order_by_projected", "SELECT o_custkey * 10 + o_orderkey % 10 AS code FROM orders ORDER BY code DESC LIMIT 40")
def order_by_projected(s: SparkSession, d: str) -> DataFrame:
    code = (F.col("o_custkey") * 10 + F.col("o_orderkey") % 10).alias("code")
    return on(s, d, ORDER).select(code).order_by("code", descending=True).take(40).frame()


@query("chained_left_joins", "SELECT c_custkey, n_name, r_name, o_orderkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_name > 'F' LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def chained_left_joins(s: SparkSession, d: str) -> DataFrame:
    nations = on(s, d, DocumentType("nation", "nation", "n_nationkey")).where(F.col("n_name") > "F")
    regions, dear = on(s, d, DocumentType("region", "region", "r_regionkey")), on(s, d, ORDER).where(F.col("o_totalprice") > 400000)
    joined = on(s, d, CUSTOMER).join(nations, [("c_nationkey", "n_nationkey")], "left", prefix="").join(regions, [("n_regionkey", "r_regionkey")], "left", prefix="")
    return joined.join(dear, [("c_custkey", "o_custkey")], "left", prefix="").select("c_custkey", "n_name", "r_name", "o_orderkey").frame()


@query("delete_by_id", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_id(s: SparkSession, d: str) -> DataFrame:
    poor = table(s, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return store.delete_by_id(table(s, d, "orders"), poor, "o_custkey").select("o_orderkey", "o_custkey")


@query("soft_delete_by_id", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS is_deleted FROM customer")
def soft_delete_by_id(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select("c_custkey", F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    ids = table(s, d, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return store.soft_delete_by_id(rows, ids, "c_custkey", F.lit("2024-02-01").cast("timestamp_ntz")).select("c_custkey", "is_deleted")


@query(
    "upsert_one_row_a_key",
    "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, 'new' AS origin FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, -1, 'old' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def upsert_one_row_a_key(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("old").alias("origin"))
    return store.upsert(old, table(s, d, "orders").select("o_custkey", "o_orderkey", F.lit("new").alias("origin")), "o_custkey", order="o_orderkey")


@query("last_change_of_an_event", _LOG + "SELECT seq_id, CASE WHEN seq_id IN (SELECT o_custkey FROM orders) THEN (SELECT max('order ' || lpad(o_orderkey::VARCHAR, 9, '0')) FROM orders WHERE o_custkey = seq_id) ELSE data END AS data FROM log")
def last_change_of_an_event(s: SparkSession, d: str) -> DataFrame:
    """Several changes of one event in a batch: one of them holds, and the event stays one."""
    changes = table(s, d, "orders").select(F.col("o_custkey").alias("seq_id"), F.concat(F.lit("order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("data"))
    return E.replace_events(log(s, d), changes).select("seq_id", "data")
