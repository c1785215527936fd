"""Line dedup: lines that several documents share stay only in the first of them.

Lines are exploded to a 128-bit hash of their normal form; the hashes are counted by
distinct document, and the positions of lines to drop are carried back to the documents, which
are put together again from the stretches between those positions.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import SPACE_CHARS, all_columns, lower_ascii, own_names
from brindle.sources.shared import materialize

#: Lines whose normal form is shorter (in code points) are never dropped.
MIN_CHARS = 10
#: From so many documents on a line counts as repeated.
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """A line's normal form: white space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A line whose key has ``min_chars`` code points or more and is found in at least ``min_docs``
    documents is dropped everywhere except in the smallest ``doc_id`` that holds it, where all
    its occurrences stay.

    Null and empty texts are one empty line.  Rows with the same ``doc_id`` count as one
    document.  A row with a null ``doc_id`` stays whole and is not counted.  An empty table gives an
    empty table.  Other columns are passed on; columns named like the three new ones are replaced.

    Hashes of lines are aggregated before the shuffle, so that a line found everywhere is one row
    a task; the join that brings decisions back is by that hash, and adaptive execution splits a hot
    one.  Texts are shuffled once, by document.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    own_row, own_lines, own_cuts, own_drops = own_names(docs, "_row", "_lines", "_cuts", "_drops")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # Rows are told apart by their text too, since nothing makes doc_id unique.
    row = F.xxhash64("text")
    keyed = (
        docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
        .select("doc_id", row.alias("row"), F.posexplode(lines).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # Written out: lines are hashed once, and adaptive execution splits a hot key of a join only between two plain shuffles.
    keyed = materialize(keyed, "keys")
    if min_docs == 2:  # two documents differ if the smallest and the largest do: no set of ids is kept
        counted = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        repeated = counted.where(F.col("first") < F.col("last"))
    else:
        once = keyed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        counted = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))
        repeated = counted.where(F.col("docs") >= min_docs)
    repeated = materialize(repeated.select("h1", "h2", "first"), "lines")
    drops = (
        keyed.join(repeated, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("first"))
        .groupBy("doc_id", F.col("row").alias(own_row))
        .agg(F.sort_array(F.collect_set("pos")).alias(own_drops))  # at most the lines of one document
    )
    whole = docs.withColumn(own_row, row).join(drops.hint("shuffle_hash"), ["doc_id", own_row], "left")
    # Stretches between dropped positions: linear in the lines, however many are dropped.
    cuts = F.concat(F.array(F.lit(-1)), F.col(own_drops), F.array(F.size(own_lines)))
    stretches = F.transform(
        F.sequence(F.lit(1), F.size(own_drops) + 1),
        lambda i: F.slice(own_lines, F.element_at(own_cuts, i) + 2, F.element_at(own_cuts, i + 1) - F.element_at(own_cuts, i) - 1),
    )
    return (
        whole.withColumn(own_lines, lines)
        .withColumn(own_cuts, cuts)
        .select(
            *all_columns(docs),
            F.when(F.col(own_drops).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(stretches), "\n")).alias("kept_text"),
            F.size(own_lines).cast("bigint").alias("n_lines"),
            F.coalesce(F.when(F.col(own_drops).isNotNull(), F.size(own_drops)), F.lit(0)).cast("bigint").alias("n_dropped"),
        )
    )
