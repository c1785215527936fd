"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.text import all_columns, own_names, word_count
from brindle.operators.joins import join_small
from brindle.operators.sequence import global_row_number
from brindle.sources.shared import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 7
#: Hex digits of the seeded order that each level of the cut adds: 16 ** 2 bins a source.
LEVEL_DIGITS = 2
LEVELS = 3


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """``sources`` (``weight``, ``cap``) with ``target``: shares of ``total`` by weight, none above ``cap``.

    Each round fills by weight what the clamped sources leave; whoever is above the cap is
    clamped, until a round clamps nobody.  A round's state is one number, the level a unit of
    weight gets, which only rises; so the sources themselves are never collected.
    If all are clamped, each target is its cap.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row.n == clamped or not row.open:
            break
        clamped, level = row.n, (total - row.fixed) / row.open
    return sources.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)) if row.open else F.col("cap"))


def seeded_order(doc_id: Column, seed: int) -> Column:
    """Hex digits that order documents at random, the same in every run."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))


def _crossing(rows: DataFrame, bin_: Column, value: Column) -> DataFrame:
    """Of each ``_key`` the bin in which the sum of ``value`` passes ``_left``: _key, _bin, what is left there, and its rows."""
    bins = rows.groupBy("_key", "_left", bin_.alias("_bin")).agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bin"))  # few bins a key
    crossed = bins.withColumn("_upto", upto).where(F.col("_upto") > F.col("_left")).groupBy("_key")
    crossed = crossed.agg(F.min(F.struct("_bin", (F.col("_left") - F.col("_upto") + F.col("_sum")).alias("_left"), "_rows")).alias("_at"))
    return materialize(crossed.select("_key", "_at.*"), "cut")


def _narrowed(rows: DataFrame, cut: DataFrame, order: Column, value: Column) -> DataFrame:
    """The ``cut`` (_key, _left) after as many levels of digits of ``order`` as there are; ``_bin`` are the digits."""
    cut = cut.select("_key", F.lit("").alias("_bin"), "_left")
    for level in range(1, LEVELS + 1):
        digits = level * LEVEL_DIGITS
        inside = join_small(rows, cut.select("_key", "_bin", "_left"), "_key").where(F.substring(order, 1, digits - LEVEL_DIGITS) == F.col("_bin"))
        cut = _crossing(inside, F.substring(order, 1, digits), value)
    return cut.select("_key", "_bin", "_left")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, whole, extra and taken.

    Size is the number of words.  Sources, in code point order with null as the last source,
    have the ``weights`` in turn; their targets are ``share`` of all words by weight, none
    above ``max_epochs`` times the source's words.  A document is repeated ``whole`` times, as
    often as the target holds the source entirely, and once more (``extra``) if it comes early
    enough in a seeded order of its source: the documents before it fill the rest of the target up
    to half its own size at least.  So a source misses its target by half a document at most,
    and ``taken`` (words) is at most ``max_epochs`` times the size.

    Null and empty texts have size 0, and a source without words target 0.  A null doc_id is
    ordered as an empty one.  Repeated rows are documents of their own; of rows with the same doc_id and size,
    in which the cut falls, so many are taken as fit.  An empty table gives an empty table.

    The cut in a source's order is found by histograms: sums over the first digits of the
    order, then over more digits inside the bin where the target is reached, and last over the few
    (doc_id, size) of that bin.  Rows that are alike in both are counted, and the cut among them is found by the same
    levels over a salt of each row.  So no task gets all documents of a hot source, nor all rows of a hot doc_id.
    """
    sized = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded_order(F.col("doc_id"), seed).alias("_u"), F.monotonically_increasing_id().alias("_row")),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(by_source, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = materialize(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")), "sources"
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(ranked, share * total)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = (
        targets.withColumn("whole", F.floor(rate).cast("bigint"))
        .withColumn("_need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .select("_key", "source_size", "target", "whole", "_need")
    )
    targets = materialize(targets, "targets")
    keyed = sized.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = join_small(keyed, targets, "_key")

    cut = _narrowed(keyed, targets.where(F.col("_need") > 0).select("_key", F.col("_need").alias("_left")), F.col("_u"), F.col("size"))
    inside = join_small(keyed, cut, "_key").where(F.substring("_u", 1, LEVELS * LEVEL_DIGITS) == F.col("_bin"))
    cut = _crossing(inside, F.struct("_u", "doc_id", "size"), F.col("size"))
    fit = F.floor((F.col("_left") - F.col("_bin.size") / 2) / F.col("_bin.size")) + 1  # of alike rows in which the target is reached
    cut = cut.select("_key", F.col("_bin._u").alias("_cut"), F.col("_bin.size").alias("_cut_size"), fit.alias("_fit"), "_rows")
    cut = cut.withColumn("_salt", F.when(F.col("_fit") >= F.col("_rows"), "~").when(F.col("_fit") <= 0, ""))  # above and below all digits
    salt = F.md5(F.col("_row").cast("string"))
    several = materialize(cut.where(F.col("_salt").isNull()), "cut")
    if several.limit(1).count():
        alike = join_small(keyed, several.select("_key", "_cut", "_cut_size", (F.col("_fit") - 1).alias("_left")), "_key")
        alike = alike.where((F.col("_u") == F.col("_cut")) & (F.col("size") == F.col("_cut_size"))).select("_key", "_row", "_left")
        last = _narrowed(alike.select("_key", "_row"), several.select("_key", (F.col("_fit") - 1).alias("_left")), salt, F.lit(1))
        last = _crossing(join_small(alike.select("_key", "_row"), last, "_key").where(F.substring(salt, 1, LEVELS * LEVEL_DIGITS) == F.col("_bin")), salt, F.lit(1))
        cut = cut.join(last.select("_key", F.col("_bin").alias("_last")), "_key", "left").withColumn("_salt", F.coalesce("_salt", "_last"))
    rows = join_small(rows, materialize(cut.select("_key", "_cut", "_cut_size", "_salt"), "cut"), "_key", "left")
    alike = (F.col("size") == F.col("_cut_size")) & (salt <= F.col("_salt"))
    before = (F.col("_u") < F.col("_cut")) | (F.col("_u") == F.col("_cut")) & ((F.col("size") < F.col("_cut_size")) | alike)
    extra = F.when(F.col("_need") <= 0, 0).when(F.col("_cut").isNull() | before, 1).otherwise(0).cast("bigint")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "whole", extra.alias("extra"), (F.col("size") * (F.col("whole") + extra)).alias("taken")
    )


def repeat_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with each row as often as ``mix_sources`` takes it; all columns stay.

    Rows with the same doc_id are repeated alike, as often as the most taken of them; rows
    with a null doc_id are taken as one such group.
    """
    own_id, own_times, own_copy = own_names(docs, "_id", "_times", "_copy")
    times = mix_sources(docs, **parameters).groupBy(F.col("doc_id").alias(own_id)).agg(F.max(F.col("whole") + F.col("extra")).cast("int").alias(own_times))
    # Written out: adaptive execution splits a hot key of a join only between two plain shuffles.
    times = materialize(times.where(F.col(own_times) > 0), "times")
    taken = docs.join(times.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own_id)))
    return taken.select(*all_columns(docs), F.explode(F.sequence(F.lit(1), own_times)).alias(own_copy)).drop(own_copy)
