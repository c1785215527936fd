"""Global sequence numbers and running totals without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import materialize


def running_total(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are dealt by range, each range keeps a local running sum, and only one row per range
    takes part in the global sum, so no task sees more than its range.  The ranges are written
    out once: range bounds come from a sample and may differ when they are computed again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.withColumn("_value", value)
        .repartitionByRange(parts, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    ranged = materialize(ranged, "ranges")
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_range")  # one row per range
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(local), F.lit(0)))
        .drop("_range", "_value", "_offset")
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Number all rows from 1 in ``order``; ties are numbered in an unspecified order."""
    return running_total(df, order, F.lit(1).cast("bigint"), "_before").withColumn(name, F.col("_before") + 1).drop("_before")


def global_lead(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the ``value`` of the row that follows in ``order``, null for the last; ties follow in any order.

    Rows are dealt by range and look ahead inside it; only the first row of each range takes part in a window of
    its own, so no task sees more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"_order_{k}") for k, c in enumerate(order)]
    ranged = materialize(df.select("*", *keys, value.alias("_value")).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*[f"_order_{k}" for k in range(len(order))])
    first = ranged.groupBy("_range").agg(F.min(F.struct(*[f"_order_{k}" for k in range(len(order))], F.struct("_value").alias("of"))).alias("_first"))
    following = first.select("_range", F.lead("_first.of").over(Window.orderBy("_range")).alias("_next"))  # a row a range
    looked = ranged.withColumn("_ahead", F.lead(F.struct("_value")).over(inside)).join(F.broadcast(following), "_range")
    found = F.when(F.col("_ahead").isNotNull(), F.col("_ahead._value")).otherwise(F.col("_next._value"))
    return looked.select(*[f"`{c}`" for c in df.columns], found.alias(name))
