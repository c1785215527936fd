"""Queries on documents: filters, projections, joins, aggregates, order and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import predicates as P
from brindle.operators.paging import encode_cursor
from brindle.operators.session import Query, Session, count_if
from brindle.plans.core import query, table
from brindle.sources.schema import DocumentType

CUSTOMER = DocumentType("customer", "customer", "c_custkey")
SEGMENT_CUSTOMER = DocumentType("customer", "customer", "c_custkey", tenant="c_mktsegment")
ORDER = DocumentType("order", "orders", "o_orderkey", modified_at="o_orderdate", created_at="o_orderdate")
DELETABLE_ORDER = DocumentType("order", "orders", "o_orderkey", deleted="o_orderstatus = 'F'", deleted_at="o_orderdate", created_at="o_orderdate")
STATUS_ORDER = DocumentType("order", "orders", "o_orderkey", enums={"o_orderstatus": {"P": 0, "O": 1, "F": 2}})
LINE = DocumentType("line", "lineitem", "l_orderkey")
PART = DocumentType("part", "part", "p_partkey")
EVENT = DocumentType("event", "events", "event_id")
EMBEDDING = DocumentType("embedding", "embeddings", "vec_id")
ERROR_EVENT = DocumentType("error", "events", "event_id", alias=("event_type", "error"))


def session(spark: SparkSession, sf_dir: str, tenant: str | None = None) -> Session:
    """A session on the driver's tables."""
    return Session(spark, lambda name: table(spark, sf_dir, name), tenant)


def on(spark: SparkSession, sf_dir: str, kind: DocumentType, tenant: str | None = None) -> Query:
    return session(spark, sf_dir, tenant).query(kind)


def _orders(s: SparkSession, d: str) -> Query:
    return on(s, d, ORDER)


@query(
    "flagship",
    """SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_totalprice > 1000
    GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY total DESC, c_mktsegment LIMIT 3""",
)
def flagship(s: SparkSession, d: str) -> DataFrame:
    """Orders by their customers' segment: scope, filter, join, group, having, order, take."""
    joined = on(s, d, DELETABLE_ORDER).where(F.col("o_totalprice") > 1000).join(on(s, d, CUSTOMER), [("o_custkey", "c_custkey")], prefix="")
    grouped = joined.group_by("c_mktsegment").having(F.col("n_orders") > 10)
    totals = grouped.aggregate(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 2).alias("average"))
    return totals.order_by("total", descending=True).then_by("c_mktsegment").take(3).frame()


# --- filters: name, kind of document, condition, SQL condition, columns -------------------------------

_ORDER = "o_orderkey, o_custkey, o_totalprice"
_CUST = "c_custkey, c_name, c_acctbal"
_FILTERS = {
    "where_compare": (ORDER, lambda: (F.col("o_totalprice") >= 100000.0) & (F.lit(300000.0) > F.col("o_totalprice")) & (F.col("o_orderstatus") != "P"), "o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus <> 'P'", _ORDER),
    "where_and_or_not": (ORDER, lambda: ((F.col("o_orderstatus") == "O") | (F.col("o_totalprice") < 50000)) & ~(F.col("o_orderpriority") == "1-URGENT"), "(o_orderstatus = 'O' OR o_totalprice < 50000) AND NOT o_orderpriority = '1-URGENT'", _ORDER),
    "where_modulo": (ORDER, lambda: (F.col("o_orderkey") % 7 == 3) & (F.lit(1) < F.col("o_custkey") % 5), "o_orderkey % 7 = 3 AND o_custkey % 5 > 1", _ORDER),
    "where_constant": (ORDER, lambda: F.lit(True) & (F.col("o_totalprice") > 400000), "o_totalprice > 400000", _ORDER),
    "where_never": (ORDER, lambda: F.lit(False), "false", _ORDER),
    "where_null": (EVENT, lambda: P.equals(F.nullif("event_type", F.lit("error")), None), "nullif(event_type, 'error') IS NULL", "event_id, event_type"),
    "where_has_value": (EVENT, lambda: P.not_equals(F.nullif("event_type", F.lit("error")), None), "nullif(event_type, 'error') IS NOT NULL", "event_id, event_type"),
    "where_flag_false": (EVENT, lambda: P.flag_is(F.when(F.col("event_type") != "click", F.col("value") > 50), False), "CASE WHEN event_type <> 'click' THEN value > 50 END = false", "event_id, event_type"),
    "where_enum": (STATUS_ORDER, lambda: STATUS_ORDER.enum_column("o_orderstatus") == STATUS_ORDER.enum("o_orderstatus", "F"), "CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END = 2", _ORDER),
    "is_one_of": (ORDER, lambda: P.call("is_one_of", F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')", _ORDER),
    "is_one_of_empty": (ORDER, lambda: P.is_one_of(F.col("o_orderpriority"), []), "false", _ORDER),
    "str_contains": (PART, lambda: F.col("p_type").contains("E"), "contains(p_type, 'E')", "p_partkey, p_type"),
    "str_starts": (PART, lambda: F.col("p_name").startswith("small"), "starts_with(p_name, 'small')", "p_partkey, p_name"),
    "str_ends": (CUSTOMER, lambda: F.col("c_name").endswith("7"), "c_name LIKE '%7'", _CUST),
    "str_ci_equals": (CUSTOMER, lambda: P.equals_ignore_case(F.col("c_mktsegment"), "Building"), "lower(c_mktsegment) = 'building'", _CUST),
    "str_lower": (CUSTOMER, lambda: F.lower("c_mktsegment") == "machinery", "lower(c_mktsegment) = 'machinery'", _CUST),
    "str_upper": (CUSTOMER, lambda: F.upper("c_mktsegment") == "MACHINERY", "upper(c_mktsegment) = 'MACHINERY'", _CUST),
    "str_trim": (CUSTOMER, lambda: F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))) == "BUILDING", "trim('  ' || c_mktsegment || ' ') = 'BUILDING'", _CUST),
    "str_null_or_empty": (EVENT, lambda: P.null_or_empty(F.when(F.col("event_type") == "view", F.lit("")).when(F.col("event_type") != "click", F.col("event_type"))), "event_type IN ('view', 'click')", "event_id, event_type"),
    "str_null_or_blank": (EVENT, lambda: P.null_or_blank(F.when(F.col("event_type") == "view", F.lit("   ")).when(F.col("event_type") != "click", F.col("event_type"))), "event_type IN ('view', 'click')", "event_id, event_type"),
    "str_length": (CUSTOMER, lambda: P.text_length(F.concat("c_mktsegment", F.lit("  "))) > 8, "length(rtrim(c_mktsegment || '  ')) > 8", _CUST),
    "array_contains": (EMBEDDING, lambda: P.array_has(F.transform("embedding", lambda x: x > 0.3), True), "list_contains([x > 0.3 FOR x IN embedding], true)", "vec_id, label"),
    "array_is_empty": (EMBEDDING, lambda: P.array_is_empty(F.when(F.col("label") > 3, F.filter("embedding", lambda x: x > 0.25))), "coalesce(len(CASE WHEN label > 3 THEN [x FOR x IN embedding IF x > 0.25] END), 0) = 0", "vec_id, label"),
    "nested_member": (EVENT, lambda: F.from_json("props", "k int")["k"] >= 90, "CAST(json_extract_string(props, '$.k') AS INT) >= 90", "event_id, event_type"),
    "hierarchy": (ERROR_EVENT, lambda: F.col("value") > 10, "event_type = 'error' AND value > 10", "event_id, event_type"),
}


def _register_filter(name: str, kind: DocumentType, condition, sql: str, columns: str) -> None:
    @query(name, f"SELECT {columns} FROM {kind.table} WHERE {sql}")
    def filtered(s: SparkSession, d: str) -> DataFrame:
        return on(s, d, kind).where(condition()).select(*columns.split(", ")).frame()


for _name, _filter in _FILTERS.items():
    _register_filter(_name, *_filter)


# --- scope -------------------------------------------------------------------------------------------

_SCOPES = {
    "tenant_scope": (SEGMENT_CUSTOMER, "BUILDING", lambda q: q, "c_mktsegment = 'BUILDING'"),
    "any_tenant": (SEGMENT_CUSTOMER, "BUILDING", lambda q: q.any_tenant(), "true"),
    "tenant_one_of": (SEGMENT_CUSTOMER, "BUILDING", lambda q: q.tenant_is_one_of("MACHINERY", "HOUSEHOLD"), "c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')"),
    "soft_delete_default": (DELETABLE_ORDER, None, lambda q: q, "o_orderstatus <> 'F'"),
    "soft_delete_maybe": (DELETABLE_ORDER, None, lambda q: q.maybe_deleted(), "true"),
    "soft_delete_only": (DELETABLE_ORDER, None, lambda q: q.is_deleted(), "o_orderstatus = 'F'"),
    "soft_delete_since": (DELETABLE_ORDER, None, lambda q: q.deleted_since(F.lit("1996-01-01").cast("timestamp")), "o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'"),
    "soft_delete_before": (DELETABLE_ORDER, None, lambda q: q.deleted_before(F.lit("1996-01-01").cast("timestamp")), "o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "modified_between": (ORDER, None, lambda q: q.modified_since(F.lit("1995-01-01").cast("timestamp")).modified_before(F.lit("1996-01-01").cast("timestamp")), "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "created_between": (DELETABLE_ORDER, None, lambda q: q.created_since(F.lit("1995-01-01").cast("timestamp")).created_before(F.lit("1996-01-01").cast("timestamp")), "o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
}


def _register_scope(name: str, kind: DocumentType, tenant: str | None, scope, sql: str) -> None:
    columns = "c_custkey, c_mktsegment" if kind.table == "customer" else "o_orderkey, o_orderstatus"

    @query(name, f"SELECT {columns} FROM {kind.table} WHERE {sql}")
    def scoped(s: SparkSession, d: str) -> DataFrame:
        return scope(on(s, d, kind, tenant)).select(*columns.split(", ")).frame()


for _name, _scope in _SCOPES.items():
    _register_scope(_name, *_scope)


# --- loads, SQL, batches ---------------------------------------------------------------------------------


@query("load_by_id", "SELECT * FROM customer WHERE c_custkey = 42")
def load_by_id(s: SparkSession, d: str) -> DataFrame:
    return session(s, d).load(CUSTOMER, 42)


@query("load_many", "SELECT * FROM customer WHERE c_custkey IN (3, 5, 8, -1)")
def load_many(s: SparkSession, d: str) -> DataFrame:
    return session(s, d).load_many(CUSTOMER, [3, 5, 8, -1])


@query("load_many_joined", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def load_many_joined(s: SparkSession, d: str) -> DataFrame:
    keys = on(s, d, ORDER).where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey")).frame()
    return session(s, d).load_many(CUSTOMER, keys)


@query("exists_by_id", "SELECT count(*) > 0 AS \"exists\" FROM customer WHERE c_custkey = 7")
def exists_by_id(s: SparkSession, d: str) -> DataFrame:
    return session(s, d).exists(CUSTOMER, 7)


@query("load_json", "SELECT '{\"r_regionkey\":2,\"r_name\":\"' || r_name || '\"}' AS json FROM region WHERE r_regionkey = 2")
def load_json(s: SparkSession, d: str) -> DataFrame:
    return session(s, d).load_json(DocumentType("region", "region", "r_regionkey"), 2)


@query("metadata_by_id", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey = 5")
def metadata_by_id(s: SparkSession, d: str) -> DataFrame:
    return session(s, d).metadata(DELETABLE_ORDER, 5)


@query("raw_sql", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def raw_sql(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "customer").createOrReplaceTempView("raw_sql_customer")
    return session(s, d).sql("SELECT c_custkey, c_name FROM raw_sql_customer WHERE c_acctbal > ^ AND c_mktsegment = ^", 5000, "BUILDING", placeholder="^")


@query("batched", "SELECT 'customers' AS what, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'")
def batched(s: SparkSession, d: str) -> DataFrame:
    plans = [
        lambda x: x.query(CUSTOMER).count("n").select(F.lit("customers").alias("what"), "n"),
        lambda x: x.query(ORDER).count("n").select(F.lit("orders").alias("what"), "n"),
        lambda x: x.query(ORDER).where(F.col("o_orderpriority") == "1-URGENT").count("n").select(F.lit("urgent").alias("what"), "n"),
    ]
    first, second, third = session(s, d).batch(*plans)
    return first.unionByName(second).unionByName(third)


# --- projections ---------------------------------------------------------------------------------------------


@query("select_scalar", "SELECT c_name FROM customer WHERE c_acctbal < 0")
def select_scalar(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, CUSTOMER).where(F.col("c_acctbal") < 0).select("c_name").frame()


@query("select_dto", "SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal > 0 AS solvent FROM customer")
def select_dto(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, CUSTOMER).select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("solvent")).frame()


@query("select_json", "SELECT '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS json FROM customer")
def select_json(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, CUSTOMER).select_json("c_custkey", "c_mktsegment").frame()


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).select("o_orderstatus", "o_orderpriority").distinct().frame()


@query("distinct_by", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def distinct_by(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).distinct_by("o_custkey").select("o_custkey", "o_orderkey", "o_totalprice").frame()


@query(
    "distinct_by_ordered",
    """SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)
def distinct_by_ordered(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).order_by("o_totalprice", descending=True).then_by("o_orderkey").distinct_by("o_custkey").take(20).frame().select("o_custkey", "o_orderkey")


@query("json_member", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_member(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, EVENT).select("event_id", P.json_member(F.col("props"), "$.k", "int").alias("k")).frame()


@query("unnest", "SELECT vec_id, x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.2")
def unnest(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, EMBEDDING).explode("embedding", "x").where(F.col("x") > 0.2).select("vec_id", "x").frame()


# --- joins -----------------------------------------------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner(s: SparkSession, d: str) -> DataFrame:
    joined = _orders(s, d).where(F.col("o_totalprice") > 200000).join(on(s, d, CUSTOMER), [("o_custkey", "c_custkey")], prefix="")
    return joined.select("o_orderkey", "c_name", "c_mktsegment").frame()


_LEFT = "FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 AND o_orderstatus <> 'F'"


def _left(s: SparkSession, d: str) -> Query:
    inner = on(s, d, DELETABLE_ORDER).where(F.col("o_totalprice") > 400000)
    return on(s, d, CUSTOMER).join(inner, [("c_custkey", "o_custkey")], "left", prefix="")


@query("join_left_inner_filter", f"SELECT c_custkey, o_orderkey, o_totalprice {_LEFT}")
def join_left_inner_filter(s: SparkSession, d: str) -> DataFrame:
    return _left(s, d).select("c_custkey", "o_orderkey", "o_totalprice").frame()


@query("join_count", f"SELECT count(*) AS n {_LEFT}")
def join_count(s: SparkSession, d: str) -> DataFrame:
    return _left(s, d).count("n")


@query("join_ordered_take", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY c_name DESC, o_orderkey LIMIT 15 OFFSET 5")
def join_ordered_take(s: SparkSession, d: str) -> DataFrame:
    joined = _orders(s, d).join(on(s, d, CUSTOMER), [("o_custkey", "c_custkey")], prefix="").select("o_orderkey", "c_name")
    return joined.order_by("c_name", descending=True).then_by("o_orderkey").skip(5).take(15).frame()


@query("join_grouped", "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_grouped(s: SparkSession, d: str) -> DataFrame:
    joined = _orders(s, d).join(on(s, d, CUSTOMER), [("o_custkey", "c_custkey")], prefix="")
    return joined.group_by("c_mktsegment").aggregate(F.count("*").alias("n"), F.max("o_totalprice").alias("most")).frame()


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).where(F.col("o_orderstatus") == "O").count("n")


@query("count_of_taken", "SELECT least(count(*), 10) AS n FROM orders")
def count_of_taken(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).order_by("o_orderkey").take(10).count("n")


@query("count_distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders)")
def count_distinct_rows(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).select("o_custkey").distinct().count("n")


@query("any", "SELECT count(*) > 0 AS \"any\" FROM orders WHERE o_totalprice > 499000")
def any_rows(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).where(F.col("o_totalprice") > 499000).any()


@query("sum", "SELECT sum(p_size)::BIGINT AS total FROM part WHERE p_size < 10")
def sum_rows(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, PART).where(F.col("p_size") < 10).sum("p_size", "total")


@query("sum_empty_zero", "SELECT coalesce(sum(p_size), 0)::BIGINT AS total FROM part WHERE p_size < 0")
def sum_empty_zero(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, PART).where(F.col("p_size") < 0).sum("p_size", "total")


@query("min_max", "SELECT min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def min_max(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).min("o_totalprice", "least").crossJoin(_orders(s, d).max("o_totalprice", "most"))  # a row each


@query("average", "SELECT avg(p_size::DOUBLE) AS average FROM part")
def average(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, PART).average("p_size")


@query("group_simple", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS least, round(avg(o_totalprice), 4) AS average FROM orders GROUP BY o_orderstatus")
def group_simple(s: SparkSession, d: str) -> DataFrame:
    grouped = _orders(s, d).group_by("o_orderstatus")
    return grouped.aggregate(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.round(F.avg("o_totalprice"), 4).alias("average")).frame()


@query("group_composite", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def group_composite(s: SparkSession, d: str) -> DataFrame:
    rows = on(s, d, LINE).where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.group_by("l_returnflag", "l_linestatus").aggregate(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).frame()


@query("group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 300000 OR count(*) = 1")
def group_having(s: SparkSession, d: str) -> DataFrame:
    grouped = _orders(s, d).group_by("o_custkey").having(((F.col("n") > 12) & (F.col("most") > 300000)) | (F.col("n") == 1))
    return grouped.aggregate(F.count("*").alias("n"), F.max("o_totalprice").alias("most")).frame()


@query("group_key_only", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority")
def group_key_only(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).group_by("o_orderpriority").keys_only().frame()


@query("group_count_predicate", "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 250000) AS large, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_count_predicate(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).group_by("o_orderpriority").aggregate(count_if(F.col("o_totalprice") > 250000).alias("large"), F.count("*").alias("n")).frame()


@query("group_scoped", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority")
def group_scoped(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, DELETABLE_ORDER).group_by("o_orderpriority").aggregate(F.count("*").alias("n")).frame()


# --- order and pages -----------------------------------------------------------------------------------------------


@query("order_then", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 25")
def order_then(s: SparkSession, d: str) -> DataFrame:
    ordered = _orders(s, d).order_by("o_orderpriority", descending=True).then_by("o_totalprice").then_by("o_orderkey")
    return ordered.take(25).frame().select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("take", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def take(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, CUSTOMER).select("c_custkey", "c_acctbal").order_by("c_acctbal", "c_custkey").take(10).frame()


@query("skip_take", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10 OFFSET 20")
def skip_take(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, CUSTOMER).select("c_custkey", "c_acctbal").order_by("c_acctbal", "c_custkey", descending=True).skip(20).take(10).frame()


@query("first", "SELECT * FROM nation ORDER BY n_name, n_nationkey LIMIT 1")
def first(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, DocumentType("nation", "nation", "n_nationkey")).order_by("n_name", "n_nationkey").first()


@query("single", "SELECT * FROM customer WHERE c_custkey = 11")
def single(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, CUSTOMER).where(F.col("c_custkey") == 11).single()


@query("last", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1")
def last(s: SparkSession, d: str) -> DataFrame:
    return on(s, d, CUSTOMER).order_by("c_acctbal", "c_custkey").last()


@query("paged_list", "SELECT c_custkey, 3 AS page, (SELECT count(*) FROM customer) AS total, ((SELECT count(*) FROM customer) + 39) // 40 AS pages FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 80")
def paged_list(s: SparkSession, d: str) -> DataFrame:
    found = on(s, d, CUSTOMER).order_by("c_custkey").page(3, 40)
    return found.rows.select("c_custkey", F.lit(found.number).alias("page"), F.lit(found.total).cast("bigint").alias("total"), F.lit(found.pages).cast("bigint").alias("pages"))


@query("page_with_total", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10 OFFSET 10")
def page_with_total(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).where(F.col("o_orderstatus") == "P").order_by("o_orderkey").page_with_total(2, 10).select("o_orderkey", "total")


_KEYSET = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 30 OFFSET 30"


@query("keyset_page_2", _KEYSET)
def keyset_page_2(s: SparkSession, d: str) -> DataFrame:
    ordered = on(s, d, CUSTOMER).order_by("c_mktsegment").then_by("c_acctbal", descending=True).then_by("c_custkey")
    edge = ordered.page_by_cursor(30).select("c_mktsegment", "c_acctbal", "c_custkey").tail(1)[0]
    return ordered.page_by_cursor(30, encode_cursor(list(edge))).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("top_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_group(s: SparkSession, d: str) -> DataFrame:
    window = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(s, d, "orders").withColumn("_place", F.row_number().over(window)).where("_place <= 3")
    return rows.select("o_orderpriority", "o_orderkey", "o_totalprice")


# --- integrity -------------------------------------------------------------------------------------------------------


@query("foreign_key_check", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def foreign_key_check(s: SparkSession, d: str) -> DataFrame:
    from brindle.sources.store import missing_parents

    parents = table(s, d, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return missing_parents(table(s, d, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey")


@query("unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_check(s: SparkSession, d: str) -> DataFrame:
    from brindle.sources.store import repeated_keys

    return repeated_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")
