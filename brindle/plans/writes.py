"""Queries on writes: the rows of a table after a change, and patches of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import patch
from brindle.operators.sequence import global_row_number
from brindle.plans.core import query, table
from brindle.sources import store


def _customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")


def _changes(s: SparkSession, d: str) -> DataFrame:
    """Every third customer with a new balance, and as many new ones."""
    rows = _customers(s, d).where(F.col("c_custkey") % 3 == 0)
    changed = rows.withColumn("c_acctbal", F.lit(1.0))
    return changed.unionByName(rows.withColumns({"c_custkey": F.col("c_custkey") + 1000000, "c_acctbal": F.lit(2.0)}))


_NEW = "SELECT c_custkey + 1000000 AS c_custkey, c_name, 2.0::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 3 = 0"


@query("upsert_overwrite", f"SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL {_NEW}")
def upsert_overwrite(s: SparkSession, d: str) -> DataFrame:
    return store.upsert(_customers(s, d), _changes(s, d), "c_custkey")


@query("insert_new", f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL {_NEW}")
def insert_new(s: SparkSession, d: str) -> DataFrame:
    return store.insert(_customers(s, d), _changes(s, d).where(F.col("c_custkey") >= 1000000), "c_custkey")


@query("bulk_ignore_duplicates", f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL {_NEW}")
def bulk_ignore_duplicates(s: SparkSession, d: str) -> DataFrame:
    return store.insert_missing(_customers(s, d), _changes(s, d), "c_custkey")


@query("update_only", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_only(s: SparkSession, d: str) -> DataFrame:
    return store.update(_customers(s, d), _changes(s, d).where(F.col("c_custkey") < 1000000), "c_custkey")


@query("version_checked_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, 4 + (c_custkey % 3 = 0)::BIGINT AS version FROM customer")
def version_checked_update(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "customer").select("c_custkey", "c_name", F.lit(4).cast("bigint").alias("version"))
    seen = F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(4).cast("bigint")  # 0: whatever version
    return store.checked_update(old, old.where(F.col("c_custkey") % 3 == 0).withColumns({"c_name": F.lit("new"), "version": seen}), "c_custkey", "version")


@query("delete_where", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_totalprice > 200000")
def delete_where(s: SparkSession, d: str) -> DataFrame:
    return store.delete_where(table(s, d, "orders"), F.col("o_totalprice") > 200000).select("o_orderkey", "o_orderstatus")


def _soft(s: SparkSession, d: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    return table(s, d, "orders").select("o_orderkey", "o_totalprice", gone.alias("is_deleted"), F.when(gone, F.col("o_orderdate")).alias("deleted_at"))


_NOW = "2024-02-01"


@query(
    "soft_delete_where",
    f"""SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' OR o_totalprice > 200000 AS is_deleted,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_totalprice > 200000 THEN TIMESTAMP '{_NOW}' END AS deleted_at FROM orders""",
)
def soft_delete_where(s: SparkSession, d: str) -> DataFrame:
    return store.soft_delete_where(_soft(s, d), F.col("o_totalprice") > 200000, F.lit(_NOW).cast("timestamp_ntz"))


@query(
    "undo_delete_where",
    """SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AND NOT o_totalprice > 200000 AS is_deleted,
    CASE WHEN o_orderstatus = 'F' AND NOT o_totalprice > 200000 THEN o_orderdate END AS deleted_at FROM orders""",
)
def undo_delete_where(s: SparkSession, d: str) -> DataFrame:
    return store.undo_delete_where(_soft(s, d), F.col("o_totalprice") > 200000)


@query("sequential_ids", "SELECT l_orderkey, n, 500 + (row_number() OVER (ORDER BY l_orderkey, n)) AS id FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def sequential_ids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return global_row_number(rows, [F.col("l_orderkey"), F.col("n")], "id").withColumn("id", F.col("id") + 500)


# --- patches: name, change, and the SQL of the members after it ----------------------------------------------
#
# The document is a struct {size, price, name, tags, numbers, ratings}; tags are lists of words of p_type
# and numbers a list with a repeated value, ratings a map.

_DOC = """SELECT p_partkey, p_size AS size, p_retailprice AS price, p_name AS name, string_split(p_type, ' ') AS tags,
    [p_size, 7, p_size % 5, 7] AS numbers, p_size % 5 AS five FROM part"""
_MEMBERS = {"size": "size", "price": "price", "name": "name", "tags": "array_to_string(tags, ',')", "numbers": "array_to_string(numbers, ',')"}

_PATCHES: dict[str, tuple[Callable[[Column], Column], dict[str, str]]] = {
    "patch_set": (lambda x: patch.set_value(patch.set_value(x, "size", 99), "color", "red"), {"size": "99", "color": "'red'"}),
    "patch_increment": (lambda x: patch.increment(patch.increment(x, "size"), "price", 0.5), {"size": "size + 1", "price": "price + 0.5"}),
    "patch_append": (lambda x: patch.append(x, "tags", "new"), {"tags": "array_to_string(list_append(tags, 'new'), ',')"}),
    "patch_append_if_missing": (lambda x: patch.append_if_missing(x, "numbers", 4), {"numbers": "array_to_string(CASE WHEN list_contains(numbers, 4) THEN numbers ELSE list_append(numbers, 4) END, ',')"}),
    "patch_insert": (lambda x: patch.insert(x, "numbers", 0, 1), {"numbers": "array_to_string(numbers[1:1] || [0] || numbers[2:], ',')"}),
    "patch_insert_end": (lambda x: patch.insert(x, "numbers", 0), {"numbers": "array_to_string(numbers || [0], ',')"}),
    "patch_insert_if_missing": (lambda x: patch.insert_if_missing(x, "numbers", 3, 0), {"numbers": "array_to_string(CASE WHEN list_contains(numbers, 3) THEN numbers ELSE [3] || numbers END, ',')"}),
    "patch_remove_all": (lambda x: patch.remove_all(x, "numbers", 7), {"numbers": "array_to_string(list_filter(numbers, lambda v: v <> 7), ',')"}),
    "patch_remove_first": (lambda x: patch.remove_first(x, "numbers", 7), {"numbers": "array_to_string(numbers[1:list_position(numbers, 7) - 1] || numbers[list_position(numbers, 7) + 1:], ',')"}),
    "patch_remove_where": (lambda x: patch.remove_where(x, "numbers", lambda v: v > 20), {"numbers": "array_to_string(list_filter(numbers, lambda v: v <= 20), ',')"}),
    "patch_append_unless": (lambda x: patch.append_unless(x, "numbers", -1, lambda v: v > 30), {"numbers": "array_to_string(CASE WHEN len(list_filter(numbers, lambda v: v > 30)) > 0 THEN numbers ELSE list_append(numbers, -1) END, ',')"}),
    "patch_insert_unless": (lambda x: patch.insert_unless(x, "numbers", -1, lambda v: v == 3, 0), {"numbers": "array_to_string(CASE WHEN list_contains(numbers, 3) THEN numbers ELSE [-1] || numbers END, ',')"}),
    "patch_remove_first_where": (lambda x: patch.remove_first_where(x, "numbers", lambda v: v < 8), {"numbers": "array_to_string(CASE WHEN size < 8 THEN numbers[2:] ELSE numbers[1:1] || numbers[3:] END, ',')"}),
    "patch_rename": (lambda x: patch.rename(x, "name", "title"), {"name": "", "title": "name"}),
    "patch_delete": (lambda x: patch.delete(x, "price"), {"price": ""}),
    "patch_duplicate": (lambda x: patch.duplicate(x, "size", "size2", "size3"), {"size2": "size", "size3": "size"}),
    "patch_map": (
        lambda x: patch.increment_key(patch.put_key_if_missing(patch.remove_key(patch.put_key(x, "ratings", "a", 1), "ratings", "b"), "ratings", "c", 5), "ratings", "a", 10),
        {"a": "11", "b": "NULL::INT", "c": "5"},
    ),
}


def _document() -> Column:
    size = F.col("p_size")
    return F.struct(
        size.alias("size"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), F.split("p_type", " ").alias("tags"),
        F.array(size, F.lit(7), size % 5, F.lit(7)).alias("numbers"), F.create_map(F.lit("b"), size).alias("ratings"),
    )


def _register_patch(name: str, change: Callable[[Column], Column], sql: dict[str, str]) -> None:
    members = {m: e for m, e in (_MEMBERS | sql).items() if e}
    listed = ", ".join(f"{e} AS {m}" for m, e in members.items())

    @query(name, f"SELECT p_partkey, {listed} FROM ({_DOC})")
    def patched(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "part").select("p_partkey", change(_document()).alias("data"))
        columns = []
        for m in members:
            if m in ("a", "b", "c"):
                columns.append(F.col("data.ratings")[m].alias(m))
            elif m in ("tags", "numbers"):
                columns.append(F.array_join(F.col(f"data.{m}").cast("array<string>"), ",").alias(m))
            else:
                columns.append(F.col(f"data.{m}").alias(m))
        return rows.select("p_partkey", *columns)


for _name, (_change, _sql) in _PATCHES.items():
    _register_patch(_name, _change, _sql)


@query("patch_where", f"SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS size FROM part")
def patch_where(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select("p_partkey", _document().alias("data"))
    data = F.when(F.col("data.size") > 25, patch.increment(F.col("data"), "size", 100)).otherwise(F.col("data"))
    return rows.select("p_partkey", data["size"].alias("size"))
