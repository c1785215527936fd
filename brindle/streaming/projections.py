"""Projections and subscriptions kept up to date by Structured Streaming.

The log is a folder of Parquet files that only grows, each file with later events than those before it.  Each
micro-batch folds the keys that it touches and writes their new rows, and no others, as a table of changes; the
read model is the last row of each key.  When the changes have outgrown the rows they change, both are written as
one table, so all that is ever written is in proportion to what came.  Checkpoints hold the position; a row of
progress says how far each projection is and which tables it consists of.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.fold import Member, fold
from brindle.sources.store import TableStore

Hook = Callable[[DataFrame, int], None]
#: Changes are not merged into the rows before there are so many.
LEAST_CHANGES = 10_000
PROGRESS = "shard string, batch bigint, mark bigint, batches bigint, base string, n_base bigint, changes array<string>, n_changes bigint, superseded array<string>"


@dataclass(frozen=True)
class Projection:
    """A read model: its key, its members, and what of the log it sees.

    A new ``version`` is another projection: it has its own checkpoint, progress and tables.  Events whose key is null
    belong to no row.
    """

    name: str
    key: str
    members: tuple[Member, ...]
    version: int = 1
    types: tuple[str, ...] = ()
    delete: Callable[[], Column] | None = None
    slice: Callable[[DataFrame], DataFrame] | None = None
    dead_letters: Callable[[], Column] | None = None
    before_commit: Sequence[Hook] = field(default_factory=tuple)
    after_commit: Sequence[Hook] = field(default_factory=tuple)

    @property
    def shard(self) -> str:
        return f"{self.name}-v{self.version}"


def project(projection: Projection, events: DataFrame, tenant: str | None = None) -> DataFrame:
    """The read model of a whole log, or of one tenant's events: the rebuild that the streamed one has to equal.

    The hooks are not called: they belong to events that come for the first time.
    """
    if tenant is not None:
        events = events.where(F.col("tenant_id") == tenant)
    return fold(_seen(projection, events), projection.key, projection.members, projection.delete() if projection.delete else None)


def _seen(projection: Projection, events: DataFrame) -> DataFrame:
    if projection.types:
        events = events.where(F.col("type").isin(*projection.types))
    if projection.dead_letters:
        events = events.where(~F.coalesce(projection.dead_letters(), F.lit(True)))
    return (projection.slice(events) if projection.slice else events).where(F.col(projection.key).isNotNull())


#: How the state of a member from earlier events and that from later ones make one.
def _merged(member: Member, old: Column, new: Column) -> Column:
    if member.how == "count" or member.how in ("add", "subtract"):
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    return F.coalesce(old, new) if member.how == "first" else F.coalesce(new, old)


def merge_states(projection: Projection, states: DataFrame, batch: DataFrame) -> DataFrame:
    """New rows of the touched keys: their states so far with the batch's folded in; deleted keys have ``_gone``."""
    seen = _seen(projection, batch)
    delete = projection.delete() if projection.delete else None
    fresh = fold(seen, projection.key, projection.members, delete).withColumn("_there", F.lit(True))
    touched = seen.groupBy(projection.key).agg(F.max(F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)).alias("_cut"))
    old = states.select(projection.key, *[F.col(m.name).alias(f"_old_{m.name}") for m in projection.members])
    rows = touched.join(fresh, projection.key, "left").join(old, projection.key, "left")
    merged = [F.when(F.col("_cut"), F.col(m.name)).otherwise(_merged(m, F.col(f"_old_{m.name}"), F.col(m.name))).alias(m.name) for m in projection.members]
    return rows.select(projection.key, *merged, (F.col("_cut") & F.col("_there").isNull()).alias("_gone"))


def refresh(projection: Projection, states: DataFrame, later: DataFrame) -> DataFrame:
    """A snapshot of a read model with later events folded in."""
    merged = merge_states(projection, states, later)
    untouched = states.join(merged.select(projection.key), projection.key, "left_anti")
    return untouched.unionByName(merged.where(~F.col("_gone")).drop("_gone").select(*states.columns))


def _last_rows(changes: DataFrame, key: str) -> DataFrame:
    """The last row of each key (by ``_at``) that is not gone."""
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), "_at").alias("_row")).select("_row.*")
    return last.where(~F.col("_gone")).drop("_gone", "_at")


def _changes(store: TableStore, tables: Sequence[str]) -> DataFrame:
    found = store.read(tables[0])
    for table in tables[1:]:
        found = found.unionByName(store.read(table))
    return found


def _position(store: TableStore, shard: str):
    """The row of progress, or None."""
    name = f"progress-{shard}"
    return store.read(name).first() if store.exists(name) else None


def run(spark: SparkSession, log: str, schema: str, projection: Projection, store: TableStore, checkpoint: str, order: str = "seq_id", least_changes: int = LEAST_CHANGES) -> StreamingQuery:
    """Bring a projection up to date with all files of the log that are there, and stop.

    A batch that is repeated after a failure is recognised by its number in the progress and not folded twice.
    Tables are published after the batch's states are complete, progress last; tables that it no longer names are removed
    one batch later.
    """
    shard = projection.shard

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = _position(store, shard)
        if last is not None and last.batch >= number:
            return
        batch = batch.persist()
        for hook in projection.before_commit:
            hook(batch, number)
        if projection.dead_letters:
            store.append(f"dead-{shard}", batch.where(F.coalesce(projection.dead_letters(), F.lit(True))), number)
        mark = batch.agg(F.max(order)).first()[0]
        base, changes = (last.base, list(last.changes)) if last else (None, [])
        before = [*([base] if base else []), *changes]
        empty = project(projection, batch.limit(0))
        states = empty
        if before:
            touched = _seen(projection, batch).select(projection.key).distinct()
            states = _last_rows(_changes(store, before).join(touched, projection.key, "left_semi"), projection.key)
        table = f"{shard}-changes-{number}"
        store.publish(table, merge_states(projection, states, batch).withColumn("_at", F.lit(number).cast("bigint")))
        changes.append(table)
        n_changes, n_base, superseded = (last.n_changes if last else 0) + store.read(table).count(), last.n_base if last else 0, []
        if n_changes > max(n_base, least_changes):
            superseded, base = [*([base] if base else []), *changes], f"{shard}-rows-{number}"
            rows = _last_rows(_changes(store, superseded), projection.key).select(*empty.columns)
            store.publish(base, rows.withColumns({"_gone": F.lit(False), "_at": F.lit(number).cast("bigint")}))
            changes, n_changes, n_base = [], 0, store.read(base).count()
        row = (shard, number, mark if mark is not None else last.mark if last else None, (last.batches if last else 0) + 1, base, n_base, changes, n_changes, superseded)
        store.publish(f"progress-{shard}", session.createDataFrame([row], PROGRESS))
        for old in last.superseded if last else ():
            store.drop(old)
        for hook in projection.after_commit:
            hook(batch, number)
        batch.unpersist()

    return _drain(spark, log, schema, apply, f"{checkpoint}/{shard}")


def _drain(spark: SparkSession, log: str, schema: str, apply: Hook, checkpoint: str) -> StreamingQuery:
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(log)
    query = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(store: TableStore, projection: Projection) -> DataFrame:
    """The projection's rows as of its last batch."""
    last = _position(store, projection.shard)
    return _last_rows(_changes(store, [*([last.base] if last.base else []), *last.changes]), projection.key)


def progress(store: TableStore, *projections: Projection) -> DataFrame:
    """shard, mark and batches of each projection that has run."""
    found = [store.read(f"progress-{p.shard}") for p in projections if store.exists(f"progress-{p.shard}")]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select("shard", "mark", "batches")


def is_stale(store: TableStore, projection: Projection, last: int) -> bool:
    """Whether events up to ``last`` are not all folded yet."""
    found = _position(store, projection.shard)
    return found is None or (found.mark or 0) < last


def wait_until_current(store: TableStore, projections: Sequence[Projection], last: int, timeout: float = 5.0, poll: float = 0.1) -> None:
    """Return once all projections have folded the events up to ``last``; a TimeoutError after ``timeout`` seconds."""
    until = time.monotonic() + timeout
    while behind := [p.shard for p in projections if is_stale(store, p, last)]:
        if time.monotonic() >= until:
            raise TimeoutError(f"not up to {last}: {', '.join(behind)}")
        time.sleep(poll)


def statuses(store: TableStore, projections: Sequence[Projection], last: int) -> DataFrame:
    """shard, mark, behind and status (current, behind, not started) of each projection beside the log's last event."""
    rows = []
    for p in projections:
        found = _position(store, p.shard)
        mark = found.mark if found else None
        rows.append((p.shard, mark, last - (mark if mark is not None else 0), "not started" if mark is None else "current" if mark >= last else "behind"))
    return store.spark.createDataFrame(rows, "shard string, mark bigint, behind bigint, status string")


def subscribe(
    spark: SparkSession, log: str, schema: str, name: str, handle: Hook, store: TableStore, checkpoint: str, types: Sequence[str] = (), after: int | None = None
) -> StreamingQuery:
    """Give all events that a subscription has not seen to ``handle``, batch by batch, each sorted by seq_id, and stop.

    The subscription's progress is published after ``handle`` has returned, so a batch in which it fails comes again.
    ``after`` skips the events up to there.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = _position(store, name)
        if last is not None and last.batch >= number:
            return
        wanted = batch.where(F.col("type").isin(*types)) if types else batch
        wanted = wanted if after is None else wanted.where(F.col("seq_id") > after)
        handle(wanted.orderBy("seq_id"), number)
        mark = batch.agg(F.max("seq_id")).first()[0]
        row = (name, number, mark if mark is not None else last.mark if last else None, (last.batches if last else 0) + 1, None, 0, [], 0, [])
        store.publish(f"progress-{name}", batch.sparkSession.createDataFrame([row], PROGRESS))

    return _drain(spark, log, schema, apply, f"{checkpoint}/{name}")


@dataclass(frozen=True)
class Composite:
    """Read models in stages: those of a stage see the log and the rows of all stages before it."""

    name: str
    stages: tuple[Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]], ...]


def publish_composite(store: TableStore, composite: Composite, events: DataFrame) -> None:
    """Build all read models of a composite and publish them together: readers see all of a run or none.

    Each stage is written before the next reads it.
    """
    built: dict[str, DataFrame] = {}
    with store.publication(composite.name) as write:
        for stage in composite.stages:
            built |= {name: write(name, build({"log": events, **built})) for name, build in stage.items()}


def append_inline(store: TableStore, name: str, rows: DataFrame, projections: Sequence[Projection]) -> None:
    """Append events and bring read models up to date in one publication: no reader sees one without the other.

    The log and the changes of the read models are added to what is there, nothing is written again.  Read them by
    ``store.read_together(name)`` (``log``) and ``inline_rows``.
    """
    there = store.read_together(name) if store.exists(name) else {}
    with store.publication(name, add=True) as write:
        write("log", rows)
        mark = rows.agg(F.max("seq_id")).first()[0]
        for p in projections:
            seen = _seen(p, rows).select(p.key).distinct()
            states = _last_rows(there[p.shard].join(seen, p.key, "left_semi"), p.key) if p.shard in there else project(p, rows.limit(0))
            write(p.shard, merge_states(p, states, rows).withColumn("_at", F.lit(mark).cast("bigint")))


def inline_rows(store: TableStore, name: str, projection: Projection) -> DataFrame:
    """The rows of a read model that is kept inline."""
    return _last_rows(store.read_together(name)[projection.shard], projection.key)


def running_totals(events: DataFrame, key: str, value: str, late: str) -> DataFrame:
    """A streamed count and sum by key and hour of event time, closed once the watermark (``late``) has passed it."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def stateful_counts(events: DataFrame, key: str) -> DataFrame:
    """A streamed count by key with state of our own, for folds that no aggregate expresses."""

    def step(keys: tuple, batches, state):
        (n,) = state.get if state.exists else (0,)
        n += sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({key: [keys[0]], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} bigint, n bigint", "n bigint", "update", "NoTimeout")
