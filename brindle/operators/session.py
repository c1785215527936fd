"""Sessions and queries on documents.

A query is a thin wrapper around a DataFrame: every operator gives the DataFrame that Spark would be asked
for by hand.  What it adds are the implicit filters (tenant, soft deletion, type), which one function applies
for every path, and the terminals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.predicates import json_object
from brindle.operators import paging
from brindle.sources.schema import DocumentType

#: Ids up to which a list becomes a predicate; longer ones are joined.
ID_LIST = 1000
#: Rows that a JSON array may have.
JSON_ROWS = 10_000


@dataclass(frozen=True)
class Scope:
    """Which rows a query sees before its own filters."""

    tenants: tuple[str, ...] | None = None  # None: the session's own
    any_tenant: bool = False
    deleted: str = "hide"  # or "maybe", "only"
    bounds: tuple[tuple[str, str, Any], ...] = ()  # (role of a column, ">=" or "<", value)


def apply_scope(frame: DataFrame, kind: DocumentType, tenant: str | None, scope: Scope) -> DataFrame:
    """The implicit filters; every query, join side and grouping goes through here."""
    if kind.tenant and not scope.any_tenant:
        wanted = scope.tenants if scope.tenants is not None else (() if tenant is None else (tenant,))
        frame = frame.where(F.col(kind.tenant).isin(*wanted) if wanted else F.lit(False))
    if kind.deleted is not None and scope.deleted != "maybe":
        gone = F.coalesce(F.expr(kind.deleted), F.lit(False))
        frame = frame.where(gone if scope.deleted == "only" else ~gone)
    for role, side, value in scope.bounds:
        column = getattr(kind, role)
        if column is None:
            raise ValueError(f"{kind.name} has no {role}")
        frame = frame.where(F.col(column) >= value if side == ">=" else F.col(column) < value)
    return frame


class Session:
    """Access to registered types on behalf of one tenant."""

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], tenant: str | None = None) -> None:
        self.spark, self.read, self.tenant = spark, read, tenant
        self.queued: list[Callable[[], DataFrame]] = []

    def query(self, kind: DocumentType) -> Query:
        """All documents of a type that the session may see."""
        return Query(self, kind, Scope(), ())

    def load(self, kind: DocumentType, key: Any) -> DataFrame:
        """The document with an id, or no row."""
        return self.query(kind).where(F.col(kind.id) == key).take(1).frame()

    def load_many(self, kind: DocumentType, keys: Iterable[Any] | DataFrame) -> DataFrame:
        """Documents by id; keys may be a DataFrame with the id column, which is then joined."""
        if not isinstance(keys, DataFrame):
            keys = list(keys)
            if len(keys) <= ID_LIST:
                return self.query(kind).where(F.col(kind.id).isin(*keys) if keys else F.lit(False)).frame()
            keys = self.spark.createDataFrame([(k,) for k in keys], [kind.id])
        return self.query(kind).frame().join(keys.select(kind.id), kind.id, "left_semi")

    def exists(self, kind: DocumentType, key: Any) -> DataFrame:
        """One row, ``exists``."""
        return self.query(kind).where(F.col(kind.id) == key).any("exists")

    def load_json(self, kind: DocumentType, key: Any) -> DataFrame:
        """The document as JSON text."""
        found = self.load(kind, key)
        return found.select(json_object(*found.columns).alias("json"))

    def metadata(self, kind: DocumentType, key: Any) -> DataFrame:
        """The metadata columns of a document, whether or not it is deleted."""
        columns = [c for c in (kind.id, kind.tenant, kind.version, kind.modified_at, kind.created_at, kind.deleted_at) if c]
        return self.query(kind).maybe_deleted().where(F.col(kind.id) == key).frame().select(*dict.fromkeys(columns))

    def sql(self, text: str, *args: Any, placeholder: str = "?") -> DataFrame:
        """Raw SQL with positional parameters; ``placeholder`` is the sign used for them."""
        return self.spark.sql(text if placeholder == "?" else text.replace(placeholder, "?"), args=list(args))

    def batch(self, *plans: Callable[[Session], DataFrame]) -> list[DataFrame]:
        """Several plans at once; they share nothing but the session, and nothing runs before it is asked for."""
        return [plan(self) for plan in plans]

    def queue_sql(self, text: str, *args: Any, placeholder: str = "?") -> None:
        """A statement that ``save_changes`` is to run, after those queued before."""
        self.queued.append(lambda: self.sql(text, *args, placeholder=placeholder))

    def save_changes(self) -> int:
        """Run what was queued, in order; how many statements there were.  After an error the rest stays queued."""
        n = 0
        while self.queued:
            self.queued[0]()
            self.queued.pop(0)
            n += 1
        return n

    def inspect(self, kind: DocumentType, equal: Mapping[str, Any] | None = None, contains: Mapping[str, str] | None = None, number: int = 1, size: int = 25) -> paging.Page:
        """A page of a type's documents for diagnostics: id, tenant and JSON of all tenants' rows, deleted ones too, and how many there are.

        ``equal`` and ``contains`` (a part of a member as text, whatever the case) narrow them; rows are in the order of ids.
        """
        query = self.query(kind).maybe_deleted().any_tenant()
        for column, value in (equal or {}).items():
            query = query.where(F.col(column).isNull() if value is None else F.col(column) == value)
        for column, part in (contains or {}).items():
            query = query.where(F.lower(F.col(column).cast("string")).contains(part.lower()))
        found = query.order_by(kind.id).page(number, size)
        columns = [F.col(c) for c in dict.fromkeys(c for c in (kind.id, kind.tenant) if c)]
        return replace(found, rows=found.rows.select(*columns, json_object(*found.rows.columns).alias("json")))


Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Query:
    """An immutable query; operators return new ones."""

    session: Session
    kind: DocumentType
    scope: Scope
    steps: tuple[Step, ...]
    orders: tuple[Column | tuple[str, bool], ...] = ()
    cut: tuple[int | None, int] = (None, 0)  # take, skip

    # --- scope ---

    def any_tenant(self) -> Query:
        return replace(self, scope=replace(self.scope, any_tenant=True))

    def tenant_is_one_of(self, *tenants: str) -> Query:
        return replace(self, scope=replace(self.scope, tenants=tenants))

    def maybe_deleted(self) -> Query:
        return replace(self, scope=replace(self.scope, deleted="maybe"))

    def is_deleted(self) -> Query:
        return replace(self, scope=replace(self.scope, deleted="only"))

    def _bound(self, role: str, side: str, value: Any, **more: Any) -> Query:
        return replace(self, scope=replace(self.scope, bounds=(*self.scope.bounds, (role, side, value)), **more))

    def deleted_since(self, value: Any) -> Query:
        return self._bound("deleted_at", ">=", value, deleted="only")

    def deleted_before(self, value: Any) -> Query:
        return self._bound("deleted_at", "<", value, deleted="only")

    def modified_since(self, value: Any) -> Query:
        return self._bound("modified_at", ">=", value)

    def modified_before(self, value: Any) -> Query:
        return self._bound("modified_at", "<", value)

    def created_since(self, value: Any) -> Query:
        return self._bound("created_at", ">=", value)

    def created_before(self, value: Any) -> Query:
        return self._bound("created_at", "<", value)

    # --- operators ---

    def _step(self, step: Step) -> Query:
        base = self if self.cut == (None, 0) else replace(self, steps=(*self.steps, self._sorted_and_cut), orders=(), cut=(None, 0))
        return replace(base, steps=(*base.steps, step))

    def where(self, *conditions: Column) -> Query:
        """Rows for which all conditions hold."""
        query = self
        for condition in conditions:
            query = query._step(lambda f, c=condition: f.where(c))
        return query

    def select(self, *columns: Column | str) -> Query:
        return self._step(lambda f: f.select(*columns))

    def select_json(self, *columns: Column | str, name: str = "json") -> Query:
        return self._step(lambda f: f.select(json_object(*columns).alias(name)))

    def distinct(self) -> Query:
        return self._step(lambda f: f.distinct())

    def distinct_by(self, *keys: Column | str) -> Query:
        """The first row of each key in the query's order; without an order the row is the one with the least id."""
        orders = self.orders or ((self.kind.id, True),)

        def first(frame: DataFrame) -> DataFrame:
            window = Window.partitionBy(*keys).orderBy(*map(_order, orders))
            return frame.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")

        return self._step(first)

    def explode(self, array: Column | str, name: str) -> Query:
        """A row for each element of an array."""
        return self._step(lambda f: f.withColumn(name, F.explode(array)))

    def order_by(self, *columns: str, descending: bool = False) -> Query:
        """Replace the order.  Nulls come first, and last where descending."""
        return replace(self, orders=tuple((c, not descending) for c in columns))

    def then_by(self, *columns: str, descending: bool = False) -> Query:
        """Add to the order."""
        return replace(self, orders=(*self.orders, *((c, not descending) for c in columns)))

    def take(self, n: int) -> Query:
        return replace(self, cut=(n, self.cut[1]))

    def skip(self, n: int) -> Query:
        return replace(self, cut=(self.cut[0], n))

    def group_by(self, *keys: Column | str) -> Grouping:
        return Grouping(self, keys)

    def join(self, inner: Query, on: Sequence[tuple[str, str]], how: str = "inner", prefix: str = "inner_") -> Query:
        """Join with another query on pairs of columns (``inner`` or ``left``).

        The inner query's own filters and scope hold before the join, so they do not turn a left join into
        an inner one.  Its columns are prefixed.
        """
        if how not in ("inner", "left"):
            raise NotImplementedError(f"a {how} join of documents")
        other = inner.frame().select(*[F.col(c).alias(prefix + c) for c in inner.frame().columns])

        def joined(frame: DataFrame) -> DataFrame:
            condition = F.lit(True)
            for a, b in on:
                condition = condition & (frame[a] == other[prefix + b])
            return frame.join(other, condition, how)

        return self._step(joined)

    # --- results ---

    def _sorted_and_cut(self, frame: DataFrame) -> DataFrame:
        if self.orders:
            frame = frame.orderBy(*map(_order, self.orders))
        take, skip = self.cut
        if skip:
            frame = frame.offset(skip)
        return frame if take is None else frame.limit(take)

    def _unsorted(self) -> DataFrame:
        frame = apply_scope(self.kind.scan(self.session.read(self.kind.table)), self.kind, self.session.tenant, self.scope)
        for step in self.steps:
            frame = step(frame)
        return frame

    def frame(self) -> DataFrame:
        """The query as a DataFrame."""
        return self._sorted_and_cut(self._unsorted())

    def _counted(self) -> DataFrame:
        """The rows that an aggregate is over: an order matters only to a cut."""
        return self._unsorted() if self.cut == (None, 0) else self.frame()

    def count(self, name: str = "count") -> DataFrame:
        return self._counted().agg(F.count("*").alias(name))

    def any(self, name: str = "any") -> DataFrame:
        return self._counted().limit(1).agg((F.count("*") > 0).alias(name))

    def sum(self, column: Column | str, name: str = "sum") -> DataFrame:
        """The sum, 0 over no rows."""
        return self._counted().agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))

    def min(self, column: Column | str, name: str = "min") -> DataFrame:
        return self._counted().agg(F.min(column).alias(name))

    def max(self, column: Column | str, name: str = "max") -> DataFrame:
        return self._counted().agg(F.max(column).alias(name))

    def average(self, column: Column | str, name: str = "average") -> DataFrame:
        return self._counted().agg(F.avg(F.col(column).cast("double") if isinstance(column, str) else column.cast("double")).alias(name))

    def _taken(self, n: int) -> tuple[DataFrame, int]:
        """Up to ``n`` rows, run once and held, and how many there are."""
        found = self.take(n).frame()
        rows = found.take(n)
        return self.session.spark.createDataFrame(rows, found.schema), len(rows)

    def first(self, or_default: bool = False) -> DataFrame:
        """The first row; none is an error unless a default is asked for."""
        found, n = self._taken(1)
        if not n and not or_default:
            raise LookupError("the query has no rows")
        return found

    def first_with_version(self, name: str = "version", or_default: bool = True) -> DataFrame:
        """The first row as JSON text, and its version, which the type has to have."""
        if self.kind.version is None:
            raise ValueError(f"{self.kind.name} has no version")
        found = self.first(or_default)
        return found.select(json_object(*found.columns).alias("json"), F.col(self.kind.version).alias(name))

    def single(self, or_default: bool = False) -> DataFrame:
        """The only row; a second is an error."""
        found, n = self._taken(2)
        if n > 1 or not n and not or_default:
            raise LookupError(f"the query has {'more than one row' if n else 'no rows'}")
        return found

    def last(self) -> DataFrame:
        """The last row of an order, which has to be given."""
        if not self.orders:
            raise ValueError("last needs an order")
        return replace(self, orders=tuple((c, not up) for c, up in self.orders), cut=(1, 0)).frame()

    def page(self, number: int, size: int) -> paging.Page:
        """A page by number, from 1, with counts."""
        if number < 1 or size < 1:
            raise ValueError("page numbers and sizes begin at 1")
        return paging.page(self.take(size).skip((number - 1) * size).frame(), self._unsorted(), number, size)

    def page_with_total(self, number: int, size: int, name: str = "total") -> DataFrame:
        """The rows of a page with the number of all rows beside each."""
        rows = self.take(size).skip((number - 1) * size).frame()
        return rows.crossJoin(F.broadcast(self._unsorted().agg(F.count("*").alias(name))))  # one row

    def page_by_cursor(self, size: int, cursor: str | None = None) -> DataFrame:
        """The rows after a cursor; the order has to end with the id."""
        if not self.orders or self.orders[-1][0] != self.kind.id:
            raise ValueError("paging by cursor needs an order that ends with the id")
        query = self.where(paging.after(self.orders, cursor)) if cursor else self
        return query.take(size).frame()

    def to_json(self) -> DataFrame:
        """Each row as JSON text."""
        found = self.frame()
        return found.select(json_object(*found.columns).alias("json"))

    def to_json_array(self, name: str = "json", most: int = JSON_ROWS) -> DataFrame:
        """One row, the rows in order as the text of one JSON array; more than ``most`` rows are an error, since they are one value."""
        rows = [r[0] for r in self.to_json().take(most + 1)]
        if len(rows) > most:
            raise ValueError(f"more than {most} rows make no JSON array; ask for a page, or for to_json")
        return self.session.spark.createDataFrame([("[" + ",".join(rows) + "]",)], f"`{name}` string")

    def __getattr__(self, name: str) -> Any:
        raise NotImplementedError(f"queries have no operator {name!r}")


def _order(order: tuple[str, bool]) -> Column:
    name, up = order
    return F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_last()


@dataclass(frozen=True)
class Grouping:
    """Rows by key; it has to be aggregated or reduced to its keys."""

    query: Query
    keys: tuple[Column | str, ...]
    having_: tuple[Column, ...] = ()

    def having(self, condition: Column) -> Grouping:
        """A condition on names of aggregates and keys."""
        return replace(self, having_=(*self.having_, condition))

    def aggregate(self, *columns: Column) -> Query:
        def grouped(frame: DataFrame) -> DataFrame:
            found = frame.groupBy(*self.keys).agg(*columns)
            for condition in self.having_:
                found = found.where(condition)
            return found

        return self.query._step(grouped)

    def keys_only(self) -> Query:
        return self.query._step(lambda f: f.select(*self.keys).distinct())

    def frame(self) -> DataFrame:
        raise NotImplementedError("a grouping has no rows: aggregate it or ask for its keys")


def count_if(condition: Column) -> Column:
    """The number of rows of a group for which a condition holds."""
    return F.count(F.when(condition, 1))
