"""Streamed projections against the rebuild from the whole log."""

import pytest
from pyspark.sql import functions as F

from brindle.operators.fold import Member
from brindle.plans.events import log
from brindle.plans.streams import SCHEMA
from brindle.sources.store import TableStore
from brindle.streaming.projections import Projection, current, is_stale, progress, project, run, stateful_counts, statuses, subscribe, wait_until_current


@pytest.fixture()
def grown(spark, sf, tmp_path):
    rows = log(spark, sf)
    rows.where("seq_id < 500").coalesce(1).write.parquet(f"{tmp_path}/log")
    return rows, f"{tmp_path}/log", TableStore(spark, f"{tmp_path}/store"), f"{tmp_path}/positions"


def values(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_increments_equal_a_rebuild(spark, grown):
    rows, path, store, positions = grown
    calls = []
    projection = Projection(
        "p", "stream_id", (Member("n", "count", ("click",)), Member("first", "first", (), F.col("seq_id")), Member("last", "last", (), F.col("type"))),
        delete=lambda: (F.col("type") == "error") & (F.col("value") > 60), before_commit=[lambda b, n: calls.append(("before", n))], after_commit=[lambda b, n: calls.append(("after", n))],
    )
    run(spark, path, SCHEMA, projection, store, positions)
    assert values(current(store, projection)) == values(project(projection, rows.where("seq_id < 500")))
    assert is_stale(store, projection, 700) and not is_stale(store, projection, 499)
    rows.where("seq_id >= 500").coalesce(1).write.mode("append").parquet(path)
    run(spark, path, SCHEMA, projection, store, positions)
    assert values(current(store, projection)) == values(project(projection, rows))
    run(spark, path, SCHEMA, projection, store, positions)  # nothing new
    assert values(progress(store, projection).select("shard", "batches")) == [("p-v1", 2)]
    assert [c[0] for c in calls] == ["before", "after"] * 2


def test_a_repeated_batch_is_not_folded_twice(spark, grown, tmp_path):
    rows, path, store, positions = grown
    projection = Projection("p", "stream_id", (Member("n", "count"),))
    run(spark, path, SCHEMA, projection, store, positions)
    run(spark, path, SCHEMA, projection, store, f"{tmp_path}/lost-positions")  # the checkpoint is gone: batch 0 again
    assert values(current(store, projection)) == values(project(projection, rows.where("seq_id < 500")))


def test_dead_letters_and_types(spark, grown):
    rows, path, store, positions = grown
    projection = Projection("d", "stream_id", (Member("n", "count"),), types=("click", "view"), dead_letters=lambda: F.col("value") > 90)
    run(spark, path, SCHEMA, projection, store, positions)
    few = rows.where("seq_id < 500")
    assert values(current(store, projection)) == values(few.where("value <= 90 AND type IN ('click', 'view')").groupBy("stream_id").count())
    assert store.read("dead-d-v1").count() == few.where("value > 90").count()


def test_own_state(spark, grown, tmp_path):
    rows, path, _, _ = grown
    counted = stateful_counts(spark.readStream.schema(SCHEMA).parquet(path), "stream_id")
    q = counted.writeStream.format("memory").queryName("own_state").outputMode("update").option("checkpointLocation", f"{tmp_path}/own").trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("own_state").groupBy("stream_id").agg(F.max("n"))) == values(rows.where("seq_id < 500").groupBy("stream_id").count())


def test_a_batch_writes_its_own_keys_only(spark, sf, tmp_path):
    """Bytes follow the batch: after many keys a batch of one writes one row, and no table is left that nothing names."""
    rows = log(spark, sf)
    last = rows.agg(F.max("seq_id")).first()[0]
    path, store = f"{tmp_path}/log", TableStore(spark, f"{tmp_path}/store")
    projection = Projection("p", "stream_id", (Member("n", "count"),))
    rows.coalesce(1).write.parquet(path)
    run(spark, path, SCHEMA, projection, store, f"{tmp_path}/positions", least_changes=10)
    assert store.read("progress-p-v1").first()["n_base"] == rows.select("stream_id").distinct().count()
    for k in range(3):
        one = rows.where("stream_id = 7").limit(2).withColumn("seq_id", F.lit(last + 1 + k).cast("bigint"))
        one.coalesce(1).write.mode("append").parquet(path)
        run(spark, path, SCHEMA, projection, store, f"{tmp_path}/positions", least_changes=10)
        assert store.read(f"p-v1-changes-{k + 1}").count() == 1
    whole = spark.read.schema(SCHEMA).parquet(path)
    assert values(current(store, projection)) == values(project(projection, whole))
    assert not store.exists("p-v1-changes-0") and store.read("progress-p-v1").first()["n_changes"] == 3


def test_changes_are_merged_when_they_outgrow_the_rows(spark, grown):
    rows, path, store, positions = grown
    projection = Projection("m", "stream_id", (Member("n", "count"), Member("last", "last", (), F.col("type"))), delete=lambda: F.col("type") == "error")
    for lo in (500, 700, 900):
        run(spark, path, SCHEMA, projection, store, positions, least_changes=1)
        rows.where(f"seq_id >= {lo} AND seq_id < {lo + 200}").coalesce(1).write.mode("append").parquet(path)
    run(spark, path, SCHEMA, projection, store, positions, least_changes=1)
    assert values(current(store, projection)) == values(project(projection, spark.read.schema(SCHEMA).parquet(path)))


def test_subscriptions_see_each_event_once_in_order(spark, grown):
    rows, path, store, positions = grown
    seen, fail = [], [True]

    def handle(batch, number):
        found = [r["seq_id"] for r in batch.select("seq_id").collect()]
        if fail[0] and number == 1:
            raise RuntimeError("not now")
        seen.append(found)

    subscribe(spark, path, SCHEMA, "sub", handle, store, positions, types=("click",))
    rows.where("seq_id >= 500").coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="not now"):
        subscribe(spark, path, SCHEMA, "sub", handle, store, positions, types=("click",))
    assert store.read("progress-sub").first()["mark"] == 499
    fail[0] = False
    subscribe(spark, path, SCHEMA, "sub", handle, store, positions, types=("click",))
    want = sorted(r["seq_id"] for r in rows.where("type = 'click'").collect())
    assert [x for part in seen for x in part] == want and store.read("progress-sub").first()["batches"] == 2


def test_waiting_and_statuses(spark, grown):
    _, path, store, positions = grown
    projection, other = Projection("w", "stream_id", (Member("n", "count"),)), Projection("never", "stream_id", (Member("n", "count"),))
    run(spark, path, SCHEMA, projection, store, positions)
    wait_until_current(store, [projection], 499)
    with pytest.raises(TimeoutError, match="w-v1"):
        wait_until_current(store, [projection], 501, timeout=0.3)
    assert [tuple(r) for r in statuses(store, [projection, other], 510).collect()] == [("w-v1", 499, 11, "behind"), ("never-v1", None, 510, "not started")]


def test_hooks_are_not_called_in_a_rebuild(spark, grown):
    rows, *_ = grown
    called = []
    projection = Projection("h", "stream_id", (Member("n", "count"),), before_commit=[lambda b, n: called.append(n)], after_commit=[lambda b, n: called.append(n)])
    assert project(projection, rows).count() and not called
