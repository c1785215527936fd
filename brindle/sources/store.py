"""Writes on document tables: pure functions from the old rows to the new, and a store that publishes them.

A table on plain Parquet cannot be changed in place.  A store writes each new state to a folder of its own and
then publishes it by one small pointer file; readers follow the pointer.  There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.events import ConcurrencyError


class DuplicateError(Exception):
    """A document to insert is there already."""


class MissingError(Exception):
    """A document to update is not there."""


def one_a_key(rows: DataFrame, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """One row a key: the last by ``order``, and among equals (or without an order) the greatest as JSON text; null is a key too."""
    keys = [key] if isinstance(key, str) else list(key)
    last = F.struct(*([F.col(order).alias("order")] if order else []), F.to_json(F.struct("*")).alias("text"))
    return rows.groupBy(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(keys)]).agg(F.max_by(F.struct("*"), last).alias("_row")).select("_row.*")


def _others(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose key, null or not, is not in ``new``."""
    seen = new.select(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(keys)])
    condition = F.lit(True)
    for n, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_key_{n}"))
    return old.join(seen, condition, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """One row of ``new`` a key (``one_a_key``), and those of ``old`` whose key is not among them."""
    keys = [key] if isinstance(key, str) else list(key)
    new = one_a_key(new, keys, order)
    return _others(old, new, keys).unionByName(new)


def insert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows; a key that is there, or twice in ``new``, is an error."""
    if new.join(old.select(key), key, "left_semi").take(1) or new.groupBy(key).count().where("count > 1").take(1):
        raise DuplicateError(f"a {key} exists")
    return old.unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``old``, and one row of ``new`` (``one_a_key``) for each key that is not there."""
    return old.unionByName(_others(one_a_key(new, key, order), old, [key]))


def delete_by_id(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows whose key is in ``ids``; an id that is not there changes nothing."""
    return old.join(ids.select(key), key, "left_anti")


def soft_delete_by_id(old: DataFrame, ids: DataFrame, key: str, at: Column, flag: str = "is_deleted", stamp: str = "deleted_at") -> DataFrame:
    """Mark the rows whose key is in ``ids`` as deleted, with the time; rows that are deleted keep theirs."""
    marked = old.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return soft_delete_where(marked, F.col("_hit"), at, flag, stamp).select(*old.columns)


def update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place; a key that is not there is an error."""
    if new.join(old.select(key), key, "left_anti").take(1):
        raise MissingError(f"a {key} is missing")
    return upsert(old, new, key)


def checked_update(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Update rows whose version is the one that ``new`` carries (0: any), and count it up.

    A missing key or another version is an error, and nothing is changed.
    """
    seen = new.withColumn("_seen", F.col(version)).join(old.select(key, F.col(version).alias("_now")), key, "left")
    if seen.where(F.col("_now").isNull() | ((F.col("_seen") != 0) & (F.col("_seen") != F.col("_now")))).take(1):
        raise ConcurrencyError(f"a {version} is not the expected one")
    return upsert(old, seen.withColumn(version, (F.col("_now") + 1).cast(old.schema[version].dataType)).select(*old.columns), key)


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold; null does not."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def soft_delete_where(old: DataFrame, condition: Column, at: Column, flag: str = "is_deleted", stamp: str = "deleted_at") -> DataFrame:
    """Mark rows as deleted, with the time; rows that are deleted keep theirs."""
    hit = F.coalesce(condition, F.lit(False)) & ~F.col(flag)
    return old.withColumns({stamp: F.when(hit, at).otherwise(F.col(stamp)), flag: F.col(flag) | hit})


def undo_delete_where(old: DataFrame, condition: Column, flag: str = "is_deleted", stamp: str = "deleted_at") -> DataFrame:
    """Bring deleted rows back."""
    hit = F.coalesce(condition, F.lit(False)) & F.col(flag)
    return old.withColumns({stamp: F.when(~hit, F.col(stamp)), flag: F.col(flag) & ~hit})


def missing_parents(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows that break a foreign key."""
    return children.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def repeated_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """Values that break a unique index, with how often they are there."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


class TableStore:
    """Versioned tables under one path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _current(self, table: str) -> str | None:
        fs, folder = self._fs(f"{self.path}/{table}/_published")
        if not fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        return names[-1].split("-", 1)[1] if names else None

    def read(self, table: str) -> DataFrame:
        """The published rows."""
        current = self._current(table)
        if current is None:
            fs, appended = self._fs(f"{self.path}/{table}/appended")
            if fs.exists(appended):
                return self.spark.read.parquet(f"{self.path}/{table}/appended")
            raise MissingError(f"no table {table}")
        return self.spark.read.parquet(f"{self.path}/{table}/{current}")

    def exists(self, table: str) -> bool:
        fs, appended = self._fs(f"{self.path}/{table}/appended")
        return self._current(table) is not None or fs.exists(appended)

    def publish(self, table: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Write rows as the table's new state and publish it; the state that is read meanwhile stays.

        Pointers are numbered, and creating one fails if it is there: two writers cannot both publish.
        """
        fs, folder = self._fs(f"{self.path}/{table}/_published")
        taken = [int(s.getPath().getName().split("-", 1)[0]) for s in fs.listStatus(folder)] if fs.exists(folder) else [0]
        name = uuid.uuid4().hex
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/{table}/{name}")
        _, pointer = self._fs(f"{self.path}/{table}/_published/{max(taken) + 1:012d}-{name}")
        fs.create(pointer, False).close()

    def append(self, table: str, rows: DataFrame, batch: int) -> None:
        """Add a batch of rows to a table that is never published as a whole; a batch that is repeated replaces itself."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/appended/batch={batch}")

    @contextmanager
    def publication(self, name: str, add: bool = False) -> Iterator[Callable[[str, DataFrame], DataFrame]]:
        """Write several tables and publish them by one pointer at the end: readers see all of a publication or none.

        ``write(table, rows)`` writes a table and returns what was written.  With ``add`` its rows are added to those of the
        publication before, and tables that are not written stay; else only what is written is there.
        """
        places = [(r.table, r.place) for r in self.read(name).collect()] if add and self.exists(name) else []  # a row a write

        def write(table: str, rows: DataFrame) -> DataFrame:
            place = f"{table}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{name}/of/{place}")
            places.append((table, place))
            return self.spark.read.parquet(f"{self.path}/{name}/of/{place}")

        yield write
        self.publish(name, self.spark.createDataFrame(places, "table string, place string"))

    def read_together(self, name: str) -> dict[str, DataFrame]:
        """The tables of the last joint publication."""
        places: dict[str, list[str]] = {}
        for r in self.read(name).collect():
            places.setdefault(r.table, []).append(f"{self.path}/{name}/of/{r.place}")
        return {table: self.spark.read.parquet(*paths) for table, paths in places.items()}

    def clean_all(self) -> None:
        """Publish every table without rows, and remove appended batches."""
        fs, root = self._fs(self.path)
        for status in fs.listStatus(root) if fs.exists(root) else ():
            name = status.getPath().getName()
            self.clean(name)
            _, appended = self._fs(f"{self.path}/{name}/appended")
            fs.delete(appended, True)

    def reset(self) -> None:
        """Remove all tables."""
        fs, root = self._fs(self.path)
        fs.delete(root, True)

    def drop(self, table: str) -> None:
        """Remove a table with all its states."""
        fs, folder = self._fs(f"{self.path}/{table}")
        fs.delete(folder, True)

    def clean(self, table: str) -> None:
        """Publish the table without rows."""
        if self._current(table) is not None:
            self.publish(table, self.read(table).limit(0))

    def vacuum(self, table: str) -> None:
        """Remove states that are not published any more."""
        fs, folder = self._fs(f"{self.path}/{table}")
        current = self._current(table)
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in (current, "_published", "appended", "of"):
                fs.delete(status.getPath(), True)
