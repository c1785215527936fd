"""Small hand-made cases for what is easy to get wrong."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle.functions import predicates as P
from brindle.operators import aggregates as A
from brindle.operators import paging, patch
from brindle.operators import fold as fold_module
from brindle.operators.fold import ColumnMap, Member, flat_table, fold, fold_function, fold_pandas, slice_by, timeline
from brindle.operators.sequence import global_row_number, running_total
from brindle.operators.session import Session, count_if
from brindle.plans import core, events  # noqa: F401
from brindle.sources import events as E
from brindle.sources import store as S
from brindle.sources.schema import DocumentType, camel_case


@pytest.fixture(scope="module")
def session(spark):
    tables = {
        # Tied numbers, a null group, a null number, and a tenant of null.
        "item": spark.createDataFrame(
            [(1, "pin", 7, "tin", "a"), (2, "nut", 7, "tin", "a"), (3, "bolt", 12, None, "b"), (4, "nut", None, "oak", "a"), (5, "cog", 30, None, "a"), (6, "bolt", 31, "oak", None), (7, "rod", 31, "ash", "b")],
            "id int, name string, number int, color string, tenant string",
        ),
        # A keeper without boxes, two boxes of one weight, a box of nobody and one of a keeper who is not there.
        "customer": spark.createDataFrame([(10, "Ines", "Lagos"), (20, "Omar", None), (30, "Wren", "Lagos")], "id int, name string, city string"),
        "order": spark.createDataFrame([(1, 10, "open", 8), (2, 20, "open", 8), (3, 20, "lost", None), (4, None, "open", 1), (5, 99, "lost", 2)], "id int, customer int, status string, amount int"),
        "flags": spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, flag boolean"),
        "json": spark.createDataFrame([(1, '{"o": {"x": 2}, "n": 5}'), (2, '{"n": null}'), (3, "{broken")], "id int, data string"),
    }
    return Session(spark, tables.__getitem__, tenant="a")


ITEM = DocumentType("item", "item", "id")
OWN_ITEM = DocumentType("item", "item", "id", tenant="tenant")
CUSTOMER, ORDER = DocumentType("customer", "customer", "id"), DocumentType("order", "order", "id")


def values(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_groups_of_nulls_and_ties(session):
    grouped = session.query(ITEM).group_by("color").aggregate(F.count("*").alias("n"), F.count("number").alias("numbers"), count_if(F.col("number") > 7).alias("large"), F.max("number").alias("most"))
    assert sorted(map(tuple, grouped.frame().collect()), key=str) == [("ash", 1, 1, 1, 31), ("oak", 2, 1, 1, 31), ("tin", 2, 2, 0, 7), (None, 2, 2, 2, 30)]
    assert session.query(ITEM).where(F.col("id") > 99).group_by("color").aggregate(F.count("*").alias("n")).frame().count() == 0
    with pytest.raises(NotImplementedError):
        session.query(ITEM).group_by("color").frame()


def test_tenant_scope_holds_everywhere(session):
    query = session.query(OWN_ITEM)
    assert query.count().first()[0] == 4
    grouped = query.group_by("color").aggregate(F.count("*").alias("n")).frame()
    assert sorted(map(tuple, grouped.collect()), key=str) == [("oak", 1), ("tin", 2), (None, 1)]
    assert query.any_tenant().count().first()[0] == 7
    assert query.tenant_is_one_of("b").count().first()[0] == 2
    assert query.tenant_is_one_of().count().first()[0] == 0
    assert session.load(OWN_ITEM, 3).count() == 0
    assert Session(session.spark, session.read).query(OWN_ITEM).count().first()[0] == 0


def test_joins_of_nulls_and_the_unmatched(session):
    keepers, boxes = session.query(CUSTOMER), session.query(ORDER)
    assert keepers.join(boxes, [("id", "customer")]).count().first()[0] == 3
    left = keepers.join(boxes, [("id", "customer")], "left")
    assert sorted(map(tuple, left.select("name", "inner_amount").frame().collect()), key=str) == [("Ines", 8), ("Omar", 8), ("Omar", None), ("Wren", None)]
    lagos = keepers.where(F.col("city") == "Lagos").join(boxes, [("id", "customer")])
    assert [r["name"] for r in lagos.frame().collect()] == ["Ines"] and lagos.count().first()[0] == 1
    lost = keepers.join(boxes.where(F.col("status") == "lost"), [("id", "customer")], "left")
    assert values(lost.select("name", "inner_id").frame().fillna(0)) == [("Ines", 0), ("Omar", 3), ("Wren", 0)]
    with pytest.raises(NotImplementedError):
        keepers.join(boxes, [("id", "customer")], "full")
    with pytest.raises(NotImplementedError):
        keepers.group_join(boxes)


def test_terminals(session):
    query = session.query(ITEM).order_by("number", "id")
    assert query.first().first()["id"] == 4 and query.last().first()["id"] == 7  # null comes first
    assert query.where(F.col("id") > 99).first(or_default=True).count() == 0
    with pytest.raises(LookupError):
        query.where(F.col("id") > 99).first()
    with pytest.raises(LookupError):
        query.single()
    with pytest.raises(ValueError):
        session.query(ITEM).last()
    assert query.take(2).count().first()[0] == 2
    assert query.where(F.col("id") > 99).sum("number").first()[0] == 0
    assert query.where(F.col("id") > 99).min("number").first()[0] is None
    assert query.take(3).where(F.col("number") > 0).count().first()[0] == 2  # the filter comes after the cut
    with pytest.raises(NotImplementedError):
        query.reverse()


def test_first_and_single_run_once(session, spark):
    ran = spark.sparkContext.accumulator(0)
    counting = Session(spark, lambda name: session.read(name).mapInPandas(lambda batches: (ran.add(1) or b for b in batches), session.read(name).schema), tenant="a")
    found = counting.query(ITEM).where(F.col("id") == 3).single()
    after = ran.value
    assert found.collect() == session.query(ITEM).where(F.col("id") == 3).frame().collect() and ran.value == after


def test_json_results(session):
    query = session.query(ITEM).where(F.col("id") < 4).select("id", "color").order_by("id", descending=True)
    assert query.to_json_array().first()["json"] == '[{"id":3,"color":null},{"id":2,"color":"tin"},{"id":1,"color":"tin"}]'
    assert session.query(ITEM).where(F.col("id") > 99).to_json_array().first()["json"] == "[]"
    with pytest.raises(ValueError):
        query.to_json_array(most=2)
    versioned = DocumentType("item", "item", "id", version="number")
    assert tuple(session.query(versioned).select("id", "number").order_by("id").first_with_version().first()) == ('{"id":1,"number":7}', 7)
    assert session.query(versioned).where(F.col("id") > 99).first_with_version().count() == 0
    with pytest.raises(ValueError):
        session.query(ITEM).first_with_version()


def test_diagnostics_and_queued_sql(session, tmp_path):
    page = session.inspect(OWN_ITEM, {"color": None}, {"name": "O"}, size=1)
    assert (page.total, page.pages) == (2, 2) and [r["id"] for r in page.rows.collect()] == [3]
    assert session.inspect(OWN_ITEM, {"color": "steel"}).rows.count() == 0
    session.queue_sql(f"INSERT OVERWRITE DIRECTORY '{tmp_path}/a' USING parquet SELECT ^ AS x", 5, placeholder="^")
    session.queue_sql("SELECT * FROM no_such_table")
    session.queue_sql("SELECT 1")
    with pytest.raises(Exception, match="no_such_table"):
        session.save_changes()
    assert session.spark.read.parquet(f"{tmp_path}/a").first()["x"] == 5 and len(session.queued) == 2
    session.queued.pop(0)
    assert session.save_changes() == 1 and session.save_changes() == 0


def test_enums(session, spark):
    kind = DocumentType("item", "item", "id", enums={"color": {"tin": 4, "oak": 9}})
    assert kind.enum("color", "oak") == 9
    few = session.query(kind).where(F.col("id").isin(1, 3, 4)).select("id", kind.enum_column("color").alias("number")).frame()
    assert values(few.fillna(-1)) == [(1, 4), (3, -1), (4, 9)]
    with pytest.raises(Exception, match="ash"):
        session.query(kind).select(kind.enum_column("color").alias("number")).frame().collect()


def test_distinct_by_follows_the_order(session):
    query = session.query(ITEM).order_by("number", "id", descending=True).distinct_by("name")
    assert [r["id"] for r in query.frame().collect()] == [7, 6, 5, 2, 1]


def test_flags_and_nulls(session):
    rows = session.read("flags")
    assert [r["id"] for r in rows.where(P.flag_is(F.col("flag"), False)).collect()] == [2]
    assert [r["id"] for r in rows.where(P.equals(F.col("flag"), None)).collect()] == [3]
    assert rows.where(P.is_one_of(F.col("id"), [])).count() == 0
    with pytest.raises(NotImplementedError):
        P.call("soundex_like", F.col("id"))


def test_json_members(session):
    rows = session.read("json").select("id", P.json_member(F.col("data"), "$.n", "int").alias("n"), P.json_member(F.col("data"), "$.o", "int").alias("o"))
    assert values(rows.fillna(-1)) == [(1, 5, -1), (2, -1, -1), (3, -1, -1)]
    typed = DocumentType("json", "json", "id", body=F.schema_of_json and __import__("pyspark.sql.types", fromlist=["x"]).StructType.fromDDL("n int, o struct<x:int>"))
    assert values(session.query(typed).select("id", F.col("data.o.x").alias("x")).frame().fillna(-1)) == [(1, 2), (2, -1), (3, -1)]


def test_names():
    assert camel_case("FirstName") == "firstName" and camel_case("first_name") == "firstName" and camel_case("URLPath") == "urlPath"


def test_pages_and_cursors(session):
    page = session.query(ITEM).order_by("id").page(2, 4)
    assert (page.total, page.pages, page.has_next, page.has_previous, page.first_item, page.last_item) == (7, 2, False, True, 5, 7)
    with pytest.raises(ValueError):
        session.query(ITEM).page(0, 4)
    ordered = session.query(ITEM).where(F.col("color").isNotNull()).order_by("color").then_by("id", descending=True)
    seen, cursor = [], None
    while found := ordered.page_by_cursor(2, cursor).collect():
        seen += [r["id"] for r in found]
        cursor = paging.encode_cursor([found[-1]["color"], found[-1]["id"]])
    assert seen == [7, 6, 4, 2, 1]
    when = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert paging.decode_cursor(paging.encode_cursor([when, "x", 3])) == [when, "x", 3]
    for bad in ("nonsense", f"{paging.PREFIX}!!", "rows2.abc"):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad)
    with pytest.raises(ValueError):
        paging.encode_cursor([None])
    with pytest.raises(ValueError):
        session.query(ITEM).order_by("color").page_by_cursor(4)


def test_patches_of_missing_members(spark):
    row = spark.createDataFrame([(1,)], "id int").select(F.struct(F.lit(None).cast("int").alias("n"), F.array(F.lit(1)).alias("a")).alias("data"))
    out = row.select(patch.insert(patch.increment(F.col("data"), "n"), "a", 9, 50).alias("data")).first()["data"]
    assert out["n"] is None and out["a"] == [1, 9]
    out = row.select(patch.remove_first(F.col("data"), "a", 77).alias("data")).first()["data"]
    assert out["a"] == [1]


# --- numbering -------------------------------------------------------------------------------


def test_global_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    numbered = global_row_number(rows, [F.col("x")])
    assert numbered.where(F.col("row_number") != F.col("x") + 1).count() == 0
    assert global_row_number(rows.limit(0), [F.col("x")]).count() == 0
    totals = running_total(rows, [F.col("x")], F.col("x"), "before")
    assert totals.where(F.col("before") != (F.col("x") * (F.col("x") - 1) / 2)).count() == 0


# --- events ----------------------------------------------------------------------------------------


def log(spark, *rows):
    day = dt.datetime(2024, 1, 1)
    full = [(seq, stream, version, kind, day + dt.timedelta(days=seq), float(value)) for seq, stream, version, kind, value in rows]
    return spark.createDataFrame(full, "seq_id bigint, stream_id string, version bigint, type string, timestamp timestamp_ntz, value double")


def test_high_water(spark):
    ten = log(spark, *[(k, "s", k, "e", 0) for k in range(1, 11)])
    mark = lambda rows, *a: E.high_water(rows, *a).first()["mark"]
    assert mark(ten.limit(0)) == 0 and mark(ten.limit(0), 7) == 7
    assert mark(ten) == 10
    holed = ten.where(~F.col("seq_id").between(4, 6))
    assert mark(holed) == 3
    assert mark(holed, 0, F.lit("2024-02-01").cast("timestamp_ntz")) == 10
    assert mark(holed, 0, F.lit("2024-01-05").cast("timestamp_ntz")) == 3
    assert mark(ten.where("seq_id > 2")) == 0
    assert mark(ten.where("seq_id > 2"), 2) == 10
    many = spark.range(1, 5001).where("id % 1000 <> 500 AND id NOT IN (2000, 2001)").withColumnRenamed("id", "seq_id")
    assert values(E.gaps(many)) == [(499, 501, 1), (1499, 1501, 1), (1999, 2002, 2), (2499, 2501, 1), (3499, 3501, 1), (4499, 4501, 1)]


def test_append_and_start(spark):
    old = log(spark, (1, "a", 1, "x", 0), (2, "a", 2, "x", 0), (3, "b", 1, "x", 0))
    batch = spark.createDataFrame([("a", 1), ("c", 2), ("a", 3)], "stream_id string, pos int")
    assert values(E.append(old, batch, "pos").select("seq_id", "stream_id", "version")) == [(4, "a", 3), (5, "c", 1), (6, "a", 4)]
    assert E.append(old, batch, "pos", {"a": 2, "c": 0}).count() == 3
    with pytest.raises(E.ConcurrencyError):
        E.append(old, batch, "pos", {"a": 1})
    with pytest.raises(E.ConcurrencyError):
        E.start_streams(old, batch, "pos")
    with pytest.raises(ValueError):
        E.append(old.withColumn("is_archived", F.lit(True)), batch, "pos")


def test_tags_and_boundary(spark):
    """A crate in two depots, an event without tags, a tag that comes twice, and an archived event."""
    rows = log(spark, (1, "c7", 1, "loaded", 0), (2, "c7", 2, "moved", 0), (3, "c8", 1, "loaded", 0), (4, "c9", 1, "loaded", 0), (5, "c8", 2, "moved", 0)).withColumn("is_archived", F.col("seq_id") == 5)
    tags = spark.createDataFrame([("crate", "7", 1), ("crate", "7", 2), ("crate", "8", 3), ("depot", "North", 1), ("depot", "North", 3), ("depot", "North", 3), ("crate", "8", 5), ("depot", "South", 5)], "tag string, value string, seq_id bigint")
    either = [("crate", 7, None), ("depot", "North", None)]
    assert values(E.matching_tags(rows, tags, either).select("seq_id")) == [(1,), (2,), (3,)]  # each once
    assert values(E.matching_tags(rows, tags, [("crate", 7, "moved"), ("crate", 8, "moved")]).select("seq_id")) == [(2,)]
    assert values(E.matching_tags(rows, tags, [("depot", "South", None)], archived=True).select("seq_id")) == [(5,)]
    assert values(E.all_tags(rows, tags, {"crate": "8", "depot": "north"}).select("seq_id")) == [(3,)]
    assert E.matching_tags(rows, tags, []).count() == 0
    E.assert_boundary(rows, tags, either, 3)
    with pytest.raises(E.ConcurrencyError):
        E.assert_boundary(rows, tags, either, 2)
    assert values(E.assign_tag(rows, tags, F.col("type") == "loaded", "depot", "North")) == [("depot", "North", 4)]


def test_dead_letters(spark):
    rows = spark.createDataFrame([(1, "a", '{"n": 1}'), (2, "a", "{broken"), (3, "z", "{}"), (4, "a", None)], "seq_id int, type string, data string")
    good, dead = E.split_bodies(rows, {"a": "n int"})
    assert values(good.select("seq_id")) == [(1,)] and values(dead.select("seq_id")) == [(2,), (3,), (4,)]


# --- folds ---------------------------------------------------------------------------------------------


def test_folds_by_week_with_nulls_and_empty_groups(spark):
    """Two meters over a turn of the year; a reading of null, a week of only other events, and values of equal time."""
    rows = log(spark, (1, "m1", 1, "fed", 12.5), (2, "m1", 2, "drawn", 4.25), (3, "m2", 1, "drawn", 9), (8, "m1", 3, "checked", 0), (9, "m2", 2, "fed", 1), (9, "m2", 3, "fed", 1))
    rows = rows.withColumn("value", F.when(F.col("type") != "checked", F.col("value")))
    rows = rows.withColumn("week", F.concat("stream_id", F.lit("/"), F.weekofyear("timestamp")))
    amount = F.col("value").cast("decimal(18,2)")
    folded = fold(rows, "week", [Member("n", "count"), Member("fed", "add", ("fed",), amount), Member("drawn", "subtract", ("drawn",), amount), Member("last", "last", ("fed", "drawn"), F.col("type"))])
    assert sorted(map(tuple, folded.collect())) == [
        ("m1/1", 2, Decimal("12.50"), Decimal("-4.25"), "drawn"), ("m1/2", 1, Decimal("0.00"), Decimal("0.00"), None), ("m2/1", 1, Decimal("0.00"), Decimal("-9.00"), "drawn"), ("m2/2", 2, Decimal("2.00"), Decimal("0.00"), "fed"),
    ]


def test_folds_agree_and_deletes_reset(spark):
    rows = log(spark, (1, "a", 1, "inc", 5), (2, "a", 2, "del", 0), (3, "b", 1, "inc", 7), (4, "b", 2, "del", 0), (5, "b", 3, "inc", 1), (6, "c", 1, "inc", 2))
    members = [Member("total", "add", ("inc",), F.col("value")), Member("last", "last", (), F.col("type"))]
    declared = values(fold(rows, "stream_id", members, F.col("type") == "del"))
    assert declared == [("b", 1.0, "inc"), ("c", 2.0, "inc")]

    def step(state, event):
        return None if event["type"] == "del" else {"total": (state or {"total": 0.0})["total"] + event["value"], "last": event["type"]}

    assert values(fold_pandas(rows, "stream_id", ["type", "value"], step, "stream_id string, total double, last string")) == declared
    summed = fold_function(rows, "stream_id", ["value"], F.lit(0.0), lambda a, e: a + e["value"])
    assert values(summed) == [("a", 5.0), ("b", 8.0), ("c", 2.0)]
    steps = timeline(rows.where("stream_id = 'b'"), "stream_id", members[:1])
    assert [r["total"] for r in steps.orderBy("seq_id").collect()] == [7.0, 7.0, 8.0]


def test_folds_of_a_hot_key_hold_no_whole_stream(spark, monkeypatch):
    monkeypatch.setattr(fold_module, "CHUNK_BITS", 3)
    rows = log(spark, *((k, "hot" if k % 3 else f"s{k % 7}", k, str(k % 10), k) for k in range(500)))
    digits = {"zero": F.lit(""), "step": lambda a, e: F.concat(a, e["type"]), "columns": ["type"]}
    whole = fold_function(rows, "stream_id", **digits)
    merged = fold_function(rows, "stream_id", **digits, merge=lambda a, b: F.concat(a, b))
    python = fold_pandas(rows, "stream_id", ["type"], lambda s, e: {"state": (s or {"state": ""})["state"] + e["type"]}, "stream_id string, state string")
    assert values(merged) == values(whole) == values(python)
    plan = python._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_whole_log_folds_see_long_and_late_streams(spark, tmp_path):
    rows = [(k, 1 if k < 40 else 50, "signup" if k in (30, 45) else "click", dt.datetime(2024, 1, 1), 99.0, "{}") for k in range(60)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = {name: core.QUERIES[name](spark, str(tmp_path)) for name in ("step_timeline", "projection_with_create", "aggregate_last_known", "flat_table")}
    assert found["step_timeline"].count() == 60 and found["step_timeline"].where("stream_id = 50").agg(F.max("clicks")).first()[0] == 19
    assert values(found["projection_with_create"].select("stream_id", "clicks")) == [(1, 39), (50, 19)]
    assert values(found["aggregate_last_known"].select("stream_id", "clicks")) == [(1, 39), (50, 19)]
    assert values(found["flat_table"].select("stream_id", "status", "score")) == [(1, "member", 39), (50, "member", 19)]


def test_slices_fan_out(spark):
    rows = log(spark, (1, "a", 1, "x", 1), (2, "b", 1, "y", 2))
    fanned = slice_by(rows, ("x", F.array(F.lit("k1"), F.lit("k2"))))
    assert values(fanned.select("seq_id", "slice_key")) == [(1, "k1"), (1, "k2")]


def test_flat_tables(spark):
    rows = log(spark, (1, "q", 1, "down", 4), (2, "q", 2, "down", 3), (3, "r", 1, "start", 10), (4, "r", 2, "up", 1), (5, "r", 3, "end", 0), (6, "t", 1, "up", 2), (7, "t", 2, "start", 9), (8, "t", 3, "up", 1))
    maps = {"start": [ColumnMap("n", "map", F.col("value")), ColumnMap("state", "set", F.lit("on"))], "up": [ColumnMap("n", "increment", F.col("value"))], "down": [ColumnMap("n", "decrement", F.col("value")), ColumnMap("steps", "decrement")]}
    plain = {r["stream_id"]: (r["n"], r["steps"], r["state"]) for r in flat_table(rows, "stream_id", maps, ["end"]).collect()}
    assert plain == {"q": (-7.0, -2, None), "t": (10.0, 0, "on")}
    kept = {r["stream_id"]: (r["n"], r["steps"]) for r in flat_table(rows, "stream_id", maps, ["end"], keep_first_sign=True).collect()}
    assert kept["q"] == (1.0, -1)


# --- stores -------------------------------------------------------------------------------------------------


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, name string, version int")
    new = spark.createDataFrame([(2, "B", 1), (3, "C", 0)], "id int, name string, version int")
    assert values(S.upsert(old, new, "id")) == [(1, "a", 1), (2, "B", 1), (3, "C", 0)]
    with pytest.raises(S.DuplicateError):
        S.insert(old, new, "id")
    with pytest.raises(S.MissingError):
        S.update(old, new, "id")
    assert values(S.checked_update(old, new.where("id = 2"), "id", "version")) == [(1, "a", 1), (2, "B", 2)]
    with pytest.raises(E.ConcurrencyError):
        S.checked_update(old, new.where("id = 2").withColumn("version", F.lit(7)), "id", "version")
    with pytest.raises(E.ConcurrencyError):
        S.checked_update(old, new, "id", "version")
    assert values(S.delete_where(old, F.lit(None).cast("boolean"))) == values(old)


def test_writes_of_repeated_and_null_keys(spark):
    """One row a key comes of a batch: the last by the order, the greatest text without one; null is a key."""
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "id int, name string, version int")
    new = spark.createDataFrame([(1, "x", 5), (1, "z", 2), (None, "m", 3), (None, "k", 4), (2, "b", 0), (2, "b", 0)], "id int, name string, version int")
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    assert rows(S.upsert(old, new, "id", order="version")) == [(1, "x", 5), (2, "b", 0), (None, "k", 4)]
    assert rows(S.upsert(old, new, "id")) == [(1, "z", 2), (2, "b", 0), (None, "m", 3)]
    assert rows(S.insert_missing(old, new, "id")) == [(1, "a", 1), (2, "b", 0), (None, "n", 1)]
    assert rows(S.update(old.where("id = 1"), new.where("id = 1"), "id", )) == [(1, "z", 2)]
    events_ = log(spark, (1, "s", 1, "a", 0), (2, "s", 2, "b", 0)).select("seq_id", "type")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (7, "z")], "seq_id bigint, type string")
    assert values(E.replace_events(events_, changes)) == [(1, "y"), (2, "b")]
    assert S.upsert(old.limit(0), new.limit(0), "id").count() == 0


def test_deletes_by_id(spark):
    old = spark.createDataFrame([(1, False, None), (2, True, "then"), (3, False, None), (None, False, None)], "id int, is_deleted boolean, deleted_at string")
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "id int")
    assert sorted(str(r["id"]) for r in S.delete_by_id(old, ids, "id").collect()) == ["3", "None"]
    marked = S.soft_delete_by_id(old, ids, "id", F.lit("now"))
    assert sorted((str(r["id"]), r["is_deleted"], r["deleted_at"]) for r in marked.collect()) == [("1", True, "now"), ("2", True, "then"), ("3", False, None), ("None", False, None)]


def test_aggregates_are_written_at_the_version_that_was_read(spark):
    old = log(spark, (1, "a", 1, "inc", 5), (2, "a", 2, "inc", 1), (3, "b", 1, "inc", 7))
    members = [Member("total", "add", ("inc",), F.col("value"))]
    asked = spark.createDataFrame([("a",), ("c",), ("a",)], "stream_id string")
    states = A.fetch_for_writing(old, asked, members)
    assert sorted((r["stream_id"], r["version"], r["total"]) for r in states.collect()) == [("a", 2, 6.0), ("c", 0, None)]
    decide = lambda frame: frame.select("stream_id", F.lit(1).alias("pos"), F.lit("inc").alias("type"), F.lit(2.0).alias("value"))
    rows = A.write_to_aggregate(old, states, decide, "pos")
    assert values(rows.select("stream_id", "version", "seq_id")) == [("a", 3, 4), ("c", 1, 5)]
    moved = old.unionByName(log(spark, (4, "c", 1, "inc", 1)))
    with pytest.raises(E.ConcurrencyError):
        A.write_to_aggregate(old, states, decide, "pos", now=moved)
    with pytest.raises(E.ConcurrencyError):
        A.append_optimistic(moved, decide(states), "pos", seen=old)
    assert A.append_optimistic(moved, decide(states).where("stream_id = 'a'"), "pos", seen=old).count() == 1
    assert values(A.fetch_latest(old, asked, members)) == [("a", 6.0)]
    assert values(A.project_latest(old, decide(states), "pos", asked, members)) == [("a", 8.0), ("c", 2.0)]


def test_timeline_with_the_state_before(spark):
    rows = log(spark, (1, "a", 1, "inc", 5), (2, "b", 1, "inc", 1), (3, "a", 2, "other", 9), (4, "b", 2, "inc", 2))
    members = [Member("total", "add", ("inc",), F.col("value"))]
    one = A.before_and_after(rows, "stream_id", members).where("stream_id = 'a'").orderBy("seq_id").collect()
    assert [(r["before"] and r["before"]["total"], r["after"]["total"]) for r in one] == [(None, 5.0), (5.0, 5.0)]
    both = A.before_and_after(slice_by(rows, ("inc", F.lit("all"))), "slice_key", members).orderBy("seq_id").collect()
    assert [(r["before"] and r["before"]["total"], r["after"]["total"]) for r in both] == [(None, 5.0), (5.0, 6.0), (6.0, 8.0)]


def test_natural_keys_begin_streams_once(spark):
    keys = spark.createDataFrame([("k1", 5)], "natural_key string, stream_id bigint")
    batch = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3)], "natural_key string, seq bigint")
    rows, started = E.with_natural_key(keys, batch)
    of = {(r["natural_key"], r["seq"]): r["stream_id"] for r in rows.collect()}
    assert of["k1", 1] == 5 and of["k2", 2] == of["k2", 3] == started.first()["stream_id"] and started.count() == 1
    log_ = spark.createDataFrame([(1, 5, True)], "seq_id bigint, stream_id bigint, is_archived boolean")
    assert E.without_archived_keys(keys, log_).count() == 0


def test_binary_payloads(spark):
    rows = spark.createDataFrame([(1, None, "text"), (2, None, None), (3, "own", None)], "seq_id int, data string, raw string").select("seq_id", "data", E.pack(F.col("raw")).alias("bdata"))
    assert sorted(map(tuple, E.unpack(rows).collect()), key=str) == [(1, "text"), (2, None), (3, "own")]
    broken = spark.createDataFrame([(1, None, bytearray(b"\xff\xfe"))], "seq_id int, data string, bdata binary")
    assert E.unpack(broken).first()["data"] is None


def test_gaps_of_tenants_and_one_full_group(spark):
    rows = spark.createDataFrame([("a", k) for k in range(1, 3001) if k != 2500] + [("b", k) for k in range(5, 10)] + [(None, 1), (None, 2), ("c", 1000), ("c", 1001), ("c", 1001)], "tenant_id string, seq_id bigint")
    assert sorted(map(tuple, E.high_water_by_tenant(rows).collect()), key=str) == [("a", 2499), ("b", 9), ("c", 1001), (None, 2)]
    assert E.gaps(rows.where("tenant_id = 'a'")).count() == 1 and E.gaps(rows.limit(0)).count() == 0
    plan = E.gaps(rows)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("_range")[0]


def test_tag_types_and_tagged_appends(spark):
    kinds = E.TagTypes(crate=F.col("stream_id"), heavy=F.when(F.col("value") > 5, "yes"))
    old = log(spark, (1, "c7", 1, "loaded", 0))
    batch = spark.createDataFrame([("c7", 1, 9.0), ("c8", 2, 1.0)], "stream_id string, pos int, value double")
    rows, tags = E.append_tagged(old, batch, "pos", kinds, ["crate", "heavy"])
    assert values(tags) == [("crate", "c7", 2), ("crate", "c8", 3), ("heavy", "yes", 2)] and rows.count() == 2
    with pytest.raises(KeyError, match="depot"):
        E.append_tagged(old, batch, "pos", kinds, ["depot"])


def test_patches_by_condition(spark):
    row = spark.createDataFrame([([3, None, 8, 3],), ([],), (None,)], "a array<int>").select(F.struct("a").alias("d"))
    out = lambda change: [r[0] for r in row.select(change(F.col("d"))["a"]).collect()]
    assert out(lambda d: patch.append_unless(d, "a", 1, lambda v: v > 7)) == [[3, None, 8, 3], [1], None]
    assert out(lambda d: patch.insert_unless(d, "a", 1, lambda v: v > 9, 1)) == [[3, 1, None, 8, 3], [1], None]
    assert out(lambda d: patch.remove_first_where(d, "a", lambda v: v == 3)) == [[None, 8, 3], [], None]


def test_event_documents(spark):
    rows = log(spark, (1, "a", 1, "sold", 5), (2, "a", 2, "sold", 6), (3, "b", 1, "seen", 1), (4, "b", 2, "other", 1))
    made = fold_module.event_documents(rows, ("sold", F.col("stream_id"), [F.col("value")]), ("seen", F.concat(F.lit("s"), "stream_id"), [F.col("type")]))
    assert sorted(map(tuple, made.select("id", "value", "type").collect()), key=str) == [("a", 6.0, None), ("sb", None, "seen")]


def test_table_store(spark, tmp_path):
    store = S.TableStore(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    with pytest.raises(S.MissingError):
        store.read("t")
    store.publish("t", rows)
    before = store.read("t")
    store.publish("t", S.upsert(before, spark.createDataFrame([(2, "b")], "id int, name string"), "id"))
    assert values(store.read("t")) == [(1, "a"), (2, "b")] and values(before) == [(1, "a")]
    store.vacuum("t")
    assert values(store.read("t")) == [(1, "a"), (2, "b")]
    store.clean("t")
    assert store.read("t").count() == 0
    store.append("more", rows, 0)
    store.append("more", rows.unionByName(rows), 0)  # the batch again
    store.append("more", rows, 1)
    assert store.read("more").count() == 3
    with store.publication("both") as write:
        write("x", rows)
        assert not store.exists("both")  # nothing is seen before the end
    with store.publication("both", add=True) as write:
        write("x", rows)
        write("y", rows.limit(0))
    assert {k: f.count() for k, f in store.read_together("both").items()} == {"x": 2, "y": 0}
    store.publish("t", rows)
    store.clean_all()
    assert store.read("t").count() == 0 and not store.exists("more")
    store.reset()
    assert not store.exists("t")
