"""MinHash near-dedup: min-max hashing, banded candidates, links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import vector
from brindle.sources.shared import materialize

WIDTH = 5
#: Two documents are linked from this share (in percent) of common shingles on.
PERCENT = 85
#: Values a band of the signature.
ROWS = 5
#: How likely a pair as alike as asked for may share no band.
MISS = 3e-7
#: Documents of a bucket that one task compares with as many others at once.
CHUNK = 64
#: Shingles that a comparison holds at once, as columns of a matrix.
TILE = 8192
#: Shingles are counted in so many bins (2 to the power), to tell rare ones.
RARE_BITS = 18
#: Copies of a member, about, up to which a large bucket is compared chunk by chunk; where it would take more, its members meet at rare shingles.
MOST_COPIES = 16

SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_1", pa.int64()), ("set_2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("shingles", pa.binary())])


def permutations_for(percent: int, rows: int, miss: float = MISS) -> int:
    """Permutations (two values each) whose bands miss a pair of that similarity with probability ``miss`` at most."""
    bands = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
    return math.ceil(bands * rows / 2)


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its place in the batch and its sorted distinct shingle hashes."""
    data, offsets = vector.utf8(batch.column("text"))
    data = vector.TO_LOWER[data]
    start, end = vector.runs(~vector.IS_SPACE[data], offsets)
    words = vector.Hasher(data)(start, end)
    windows = vector.window_hash(words, width)
    first = np.searchsorted(start, offsets)
    for k in range(batch.num_rows):
        a, b = first[k], first[k + 1]
        if b - a >= width:
            yield k, np.unique(windows[a : b - width + 1])
        elif b > a:  # fewer words: the whole sequence is the one shingle
            yield k, vector.window_hash(words[a:b], b - a)
        else:
            yield k, np.zeros(0, np.uint64)


def _signatures(flat: np.ndarray, at: np.ndarray, permutations: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets that lie in ``flat`` from ``at`` on, and the keys of their bands.

    A permutation is an exclusive or and a product with an odd number.  All minima come first, so a band
    takes its values from as many permutations as it has rows.
    """
    masks, factors = vector.seeds(permutations, 20 + rows), vector.seeds(permutations, 40 + rows) | np.uint64(1)
    signature = np.zeros((2 * permutations, len(at)), np.uint64)
    for p in range(permutations):
        hashed = (flat ^ masks[p]) * factors[p]
        signature[p] = np.minimum.reduceat(hashed, at)
        signature[permutations + p] = np.maximum.reduceat(hashed, at)
    bands = 2 * permutations // rows
    keys = np.repeat(vector.seeds(bands, rows)[:, None], len(at), axis=1)
    for k in range(rows):
        keys = vector.mix(keys * np.uint64(0x9E3779B97F4A7C55) + signature[: bands * rows].reshape(bands, rows, -1)[:, k])
    return signature, keys


def _sketches(width: int, permutations: int, rows: int):
    bands = 2 * permutations // rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                sets = [s for _, s in shingle_sets(batch, width)]
                sizes = np.array([len(s) for s in sets], np.int64)
                filled = np.flatnonzero(sizes)
                flat = np.concatenate(sets)
                at = (np.cumsum(sizes) - sizes)[filled]
                marks = np.zeros((2, len(sets)), np.uint64)
                keys = np.zeros((bands, 0), np.uint64)
                if len(filled):
                    _, keys = _signatures(flat, at, permutations, rows)
                    mixed = vector.mix(flat)
                    marks[0, filled] = np.add.reduceat(mixed, at)
                    marks[1, filled] = np.bitwise_xor.reduceat(vector.mix(mixed + np.uint64(1)), at)
                ends = np.append(0, np.cumsum(np.where(sizes > 0, bands, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.T.reshape(-1).copy().view(np.int64)))
                columns = [batch.column("doc_id"), pa.array(sizes), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, schema=SKETCH)

    return sketch


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                found = [s for _, s in shingle_sets(batch, width)]
                sizes, packed = pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, packed], schema=SETS)

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left_set"), batch.column("right_set")
            linked = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                common = int((vector.find(b, a) >= 0).sum())
                linked[k] = 100 * common >= percent * (len(a) + len(b) - common)
            linked = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column("left").filter(linked), batch.column("right").filter(linked)], names=["left", "right"])

    return confirm


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (left, right) that are linked by their full ``sets``; sizes are looked at before sets travel."""

    def sided(side: str, *columns: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])

    sized = pairs.distinct().join(sided("left", "size"), "left").join(sided("right", "size"), "right")
    likely = materialize(sized.where(100 * F.least("left_size", "right_size") >= percent * F.greatest("left_size", "right_size")).select("left", "right"), "pairs")
    full = likely.join(sided("left", "shingles"), "left").join(sided("right", "shingles"), "right")
    links = full.select("left", "right", F.col("left_shingles").alias("left_set"), F.col("right_shingles").alias("right_set"))
    return materialize(links.mapInArrow(_confirm(percent), "left bigint, right bigint"), "links")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of some sets have in common: the product of their incidence matrix with itself, in tiles."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.append(True, flat[1:] != flat[:-1])
    several = np.diff(np.append(np.flatnonzero(new), len(flat))) > 1  # a shingle of one set alone changes nothing
    place = np.cumsum(new) - 1
    keep = several[place]
    column = (np.cumsum(several) - 1)[place[keep]]
    of = of[keep]
    common = np.zeros((len(sets), len(sets)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, TILE):
        a, b = np.searchsorted(column, [start, start + TILE])
        tile = np.zeros((len(sets), TILE), np.float32)
        tile[of[a:b], column[a:b] - start] = 1
        common += tile @ tile.T
    return common


def _compare(percent: int):
    """Links inside blocks of rows that come one block after another.

    Rows of part 1 are compared with those of part 0, and with each other if ``inner``; rows of one
    component are not compared.
    """

    def linked(part: np.ndarray, component: np.ndarray, inner: bool, doc: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets])
        wanted = (part[:, None] == 1) & (part[None, :] == 0)
        if inner:
            wanted |= np.triu((part[:, None] == 1) & (part[None, :] == 1), 1)
        wanted &= component[:, None] != component[None, :]
        wanted &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
        left, right = np.nonzero(wanted)
        if not len(left):
            return []
        if len(left) <= 4:
            common = np.array([(vector.find(sets[b], sets[a]) >= 0).sum() for a, b in zip(left, right, strict=True)])
        else:
            common = _common(sets)[left, right]
        hit = 100 * common >= percent * (sizes[left] + sizes[right] - common)
        return list(zip(doc[left[hit]].tolist(), doc[right[hit]].tolist(), strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "part", "inner", "component", "doc_id")
        rest: pa.Table | None = None

        def found(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            columns = {n: table.column(n).to_numpy() for n in names}
            packed = table.column("shingles").to_pylist()
            links = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                sets = [np.frombuffer(p, np.uint64) for p in packed[a:b]]
                links += linked(columns["part"][a:b], columns["component"][a:b], bool(columns["inner"][a]), columns["doc_id"][a:b], sets)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["left", "right"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            block = table.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()]
            yield from found(table, cuts)
            rest = table.slice(cuts[-1])  # the last block may go on
        if rest is not None:
            yield from found(rest, [0, rest.num_rows])

    return compare


def _linked_in_blocks(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links of ``blocks`` (block, part, inner, component, doc_id)."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.join(sets.select("doc_id", "shingles"), "doc_id").repartition(parts, "block").sortWithinPartitions("block")
    rows = dealt.select("block", "part", "inner", "component", "doc_id", "shingles")
    return materialize(rows.mapInArrow(_compare(percent), "left bigint, right bigint").distinct(), "links")


def _small_blocks(members: DataFrame) -> DataFrame:
    """A block for each distinct set of documents that is a bucket; buckets of a close pair are often the same."""
    bucket = members.groupBy("band").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))  # CHUNK documents at most
    block = bucket.select("docs").distinct().select(F.xxhash64("docs").alias("block"), F.explode("docs").alias("doc_id"))
    return block.select("block", F.lit(1).alias("part"), F.lit(True).alias("inner"), F.col("doc_id").alias("component"), "doc_id")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the sets fall into each of ``2 ** RARE_BITS`` bins of their hashes."""
    counts = np.zeros(1 << RARE_BITS, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            found = np.frombuffer(batch.column("shingles")[k].as_buffer(), np.uint64)
            np.add.at(counts, found >> np.uint64(64 - RARE_BITS), 1)
    filled = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], names=["bin", "n"])


def _rarest(shared, percent: int):
    """Groups of each document: of its rarest shingles those that others may have, with the class of its size and the next."""
    step = max(1e-9, math.log(100 / percent) * 1.0001)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            bands, sizes = [], []
            for k in range(batch.num_rows):
                found = np.frombuffer(batch.column("shingles")[k].as_buffer(), np.uint64)
                n = counts[found >> np.uint64(64 - RARE_BITS)]
                first = np.lexsort([found, n])[: len(found) - -(-percent * len(found) // 100) + 1]
                met = found[first[n[first] > 1]]
                # Sizes of a linked pair are in the same class or in neighbours.
                own = np.uint64(math.floor(math.log(len(found)) / step))
                bands += [vector.mix(met + vector.mix(np.array([own + np.uint64(j)], np.uint64))) for j in range(2)]
                sizes.append(2 * len(met))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("doc_id").take(rows), batch.column("component").take(rows)], names=["band", "doc_id", "component"])

    return rarest


def _alike(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Groups (band, n, doc_id, component) in which any two linked documents of ``members`` (doc_id, component) meet.

    Of a set's shingles, the rarest among the members first, so many are taken that a set without any of them has too few
    in common; two documents meet at a common one of those, if their sizes let them be linked.  Documents that
    share a frame but not their own words have only shingles of their own there, and meet no other.  Any order that is the
    same for all sets would do; how rare a shingle is comes from counts in a fixed number of bins, which are
    small enough to be sent to every task.
    """
    rows = materialize(sets.join(members.select("doc_id", "component").distinct(), "doc_id").select("doc_id", "component", "shingles"), "rows")
    tally = rows.select("shingles").mapInArrow(_tally, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # a row a bin
    counts = np.zeros(1 << RARE_BITS, np.int64)
    counts[tally.column("bin").to_numpy()] = tally.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    found = materialize(rows.mapInArrow(_rarest(shared, percent), "band bigint, doc_id bigint, component bigint"), "met")
    shared.destroy()
    groups = found.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    groups = materialize(groups.where(F.col("least") < F.col("most")).select("band", "n"), "groups")
    return materialize(found.join(groups, "band"), "met")


def _bucket_sizes(members: DataFrame, chunk: int) -> DataFrame:
    """Of each bucket (band, doc_id, component) its largest component, the chunks of that and of the rest, and ``copies``, how often a member is in a block."""
    by_component = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    sizes = by_component.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    n_rest = F.col("n") - F.col("most.n")
    sizes = sizes.select(
        "band", "n", F.col("most.component").alias("main"), F.ceil(F.col("most.n") / chunk).cast("int").alias("n_main"), F.ceil(n_rest / chunk).cast("int").alias("n_rest"), n_rest.alias("rest")
    )
    copies = (F.col("n") * F.col("n_rest") + F.col("rest") * F.col("n_main")) / F.col("n")
    return materialize(sizes.withColumn("copies", copies).drop("rest"), "sizes")


def _large_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of large buckets (band, doc_id, component) with their ``sizes``: chunks of documents, each two of them once.

    The largest component of a bucket is compared with the rest alone, so a bucket that is one component but for
    a few documents costs those few times its size.
    """
    placed = members.join(sizes.drop("n", "copies"), "band").withColumn("is_main", F.col("component") == F.col("main"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("band", "doc_id"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))

    def entry(kind: str, a, b, part, inner) -> object:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), part.cast("int").alias("part"), inner.alias("inner"))

    chunk_, rest, main = F.col("chunk"), F.sequence(F.lit(0), F.col("n_rest") - 1), F.sequence(F.lit(0), F.col("n_main") - 1)
    of_main = F.transform(rest, lambda r: entry("main", chunk_, r, F.lit(0), F.lit(False)))
    among = F.transform(rest, lambda r: entry("rest", F.least(chunk_, r), F.greatest(chunk_, r), F.when(chunk_ >= r, 1).otherwise(0), chunk_ == r))
    beside = F.transform(main, lambda m: entry("main", m, chunk_, F.lit(1), F.lit(False)))
    entries = placed.select("band", "doc_id", "component", F.inline(F.when(F.col("is_main"), of_main).otherwise(F.concat(among, beside))))
    return entries.select(F.xxhash64("band", "kind", "a", "b").alias("block"), "part", "inner", "component", "doc_id")


def _open_blocks(sets: DataFrame, members: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Blocks for the ``members`` (band, doc_id, component) of large buckets, the cheaper way: both lose no link.

    Buckets that take few copies of a member are compared chunk by chunk.  The members of the others meet at rare shingles,
    in groups that are compared whole or chunk by chunk, unless those would take more copies still.
    """
    buckets = _bucket_sizes(members, chunk)
    blocks = _large_blocks(members, buckets.where(F.col("copies") <= MOST_COPIES))
    many = buckets.where(F.col("copies") > MOST_COPIES)
    of_many = members.join(many.select("band"), "band", "left_semi")
    if not many.limit(1).count():
        return blocks
    met = _alike(sets, of_many, percent)
    small, hot = met.where(F.col("n") <= chunk), met.where(F.col("n") > chunk)
    groups = _bucket_sizes(hot, chunk)

    def copies(sizes: DataFrame) -> float:
        return sizes.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0.0

    if copies(many) <= small.count() + copies(groups):
        return blocks.unionByName(_large_blocks(of_many, many))
    return blocks.unionByName(_small_blocks(small)).unionByName(_large_blocks(hot, groups))


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``links`` (left, right).

    Each round gives a node the least label among its neighbours and then the label of that
    label, until nothing changes.  Only minima are gathered, so a node with many links is no
    large group.
    """
    both = materialize(links.select("left", "right").union(links.select("right", "left")), "edges")
    labels = materialize(both.groupBy(F.col("left").alias("node")).agg(F.least(F.min("right"), F.first("left")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("right"), "component"), "right")
        near = near.groupBy(F.col("left").alias("node")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "_near").alias("_new"))
        lower = materialize(lower, "labels")
        target = lower.select(F.col("node").alias("_new"), F.col("_new").alias("_far"))
        moved = lower.join(target, "_new", "left").select("node", F.col("component").alias("_old"), F.least("_new", F.coalesce("_far", "_new")).alias("component"))
        moved = materialize(moved, "labels")
        changed = moved.where(F.col("_old") != F.col("component")).limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Words are runs without white space, A-Z lower-cased.  Documents are linked if ``percent``
    of the union of their distinct ``width``-word shingles is common; a component is what links
    join, named by its smallest doc_id, and that document alone is kept.

    A text of fewer words is one shingle; null texts and texts without words have none and are
    linked with nothing.  Rows with the same doc_id are one document.  A null doc_id has the
    component null and is kept.  An empty table gives an empty table.

    Documents with the same set form a class and go on as its smallest doc_id; copies never become
    pairs.  Classes that agree in a band of the min-max signature share a bucket.  Buckets of at most ``chunk``
    classes are compared by one task each.  In larger ones each class is compared with the first, which makes
    one component of most of them; what then is of different components is compared chunk by chunk.  Where that would
    take many copies of each class, they meet again at their rarest shingles only, in groups that are compared the same way.  A
    row that is shuffled is a class in a group or chunk, not a pair, and links are confirmed on full sets throughout.
    """
    sketches = docs.select("doc_id", "text").mapInArrow(
        _sketches(width, permutations_for(percent, rows), rows), "doc_id bigint, n_shingles bigint, set_1 bigint, set_2 bigint, bands array<bigint>"
    )
    sketches = materialize(sketches, "sketches")
    named = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["set_1", "set_2", "n_shingles"]
    classes = materialize(named.groupBy(*key).agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "classes")
    same = named.select("doc_id", *key).join(classes.select(*key, "first"), key).where(F.col("doc_id") != F.col("first"))
    copies = materialize(same.select(F.col("doc_id").alias("left"), F.col("first").alias("right")).distinct(), "copies")

    members = classes.select(F.explode("bands").alias("band"), F.col("first").alias("doc_id"))
    sizes = materialize(members.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("right")).where("n > 1"), "buckets")
    members = materialize(members.join(sizes, "band"), "members")
    texts = docs.select("doc_id", "text").join(members.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(_sets(width), "doc_id bigint, size bigint, shingles binary"), "sets")

    near = copies.unionByName(_linked_in_blocks(sets, _small_blocks(members.where(F.col("n") <= chunk)), percent))
    large = members.where((F.col("n") > chunk) & (F.col("doc_id") != F.col("right"))).select("band", F.col("doc_id").alias("left"), "right")
    if large.limit(1).count():
        near = near.unionByName(_confirmed(sets, large.select("left", "right"), percent))
        open_ = _mixed(_with_components(large.select("band", F.col("left").alias("doc_id")), connected_components(near)))
        near = near.unionByName(_linked_in_blocks(sets, _open_blocks(sets, open_, percent, chunk), percent))
    components = connected_components(near)
    result = sketches.select("doc_id", "n_shingles").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _with_components(members: DataFrame, components: DataFrame) -> DataFrame:
    found = members.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.withColumn("component", F.coalesce("component", "doc_id"))


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (band, doc_id, component) whose bucket has more than one component.

    Rows and sums by band are written out: adaptive execution splits a hot key of a join only between two plain shuffles.
    """
    members = materialize(members.select("band", "doc_id", "component"), "members")
    mixed = members.groupBy("band").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).where(F.col("_least") < F.col("_most"))
    return materialize(members.join(materialize(mixed.select("band"), "bands"), "band", "left_semi"), "members")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, its smallest doc_id; all columns stay.

    All rows of a doc_id that is kept stay, and so do rows with a null doc_id.
    """
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
