"""Token ids in directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first.  Level k holds the k-th chunk of all ids that
have one, and a bitmap that says which of those ids go on to level k + 1.  The index of an id in the
next level is the number of ones before it in the bitmap, which a directory of counts, one for
each ``RANK_BITS`` bits, gives by looking at one short stretch.  So any token is reached by a
few look-ups, without decoding what stands before it.

A store is a folder of Parquet files written by Spark (so a lost executor leaves no
half-written file): ``codes`` has a row a document with its codes, in ascending
doc_id order over all shards, and ``ranges`` has a row a shard with its first and last doc_id and the number of tokens before it.
Code columns are neither compressed nor dictionary-coded; a reader finds the shards by ``ranges`` and, in them, a row by the
statistics of doc_id, so that what lies beside it is not decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import vector
from brindle.operators.joins import join_small
from brindle.sources.shared import fresh_path

CHUNK_BITS = 8
#: Bits between two counts of a rank directory.
RANK_BITS = 512
END_ID = 1
#: Chunks of text whose ids a worker remembers, at most; then it forgets all and begins anew.
CACHE_ENTRIES = 900_000
#: New chunks are given to the tokenizer so many at a time.
ENCODE_AT_ONCE = 4096

#: Text that a shard holds, about; a shard a shuffle partition at least.
SHARD_BYTES = 1 << 27
#: Documents whose tokens are looked up by their ids alone; more are looked up by the stretch from the first to the last.
MOST_IDS = 1000

CODES = "doc_id bigint, shard int, place bigint, n_tokens bigint, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


# --- the codes ---------------------------------------------------------------------------


def encode_ids(ids: np.ndarray, chunk_bits: int = CHUNK_BITS) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of non-negative ids below 2 ** 32.

    Chunks have 8 or 16 bits.  No ids give no levels.  The last level has no bitmap.
    """
    kind = {8: np.uint8, 16: np.dtype("<u2")}[chunk_bits]
    levels, bitmaps, ranks = [], [], []
    left = np.asarray(ids, np.uint32)
    while len(left):
        levels.append((left & np.uint32((1 << chunk_bits) - 1)).astype(kind).tobytes())
        left = left >> np.uint32(chunk_bits)
        goes_on = left > 0
        if not goes_on.any():
            break
        bitmaps.append(np.packbits(goes_on, bitorder="little").tobytes())
        per = np.add.reduceat(goes_on.astype(np.uint32), np.arange(0, len(goes_on), RANK_BITS))
        ranks.append((np.cumsum(per) - per).astype("<u4").tobytes())
        left = left[goes_on]
    return levels, bitmaps, ranks


def decode_ids(levels: list[bytes], bitmaps: list[bytes], chunk_bits: int = CHUNK_BITS) -> np.ndarray:
    """All ids of one document."""
    kind = {8: np.uint8, 16: np.dtype("<u2")}[chunk_bits]
    if not levels:
        return np.zeros(0, np.uint32)
    ids = np.frombuffer(levels[-1], kind).astype(np.uint32)
    for k in range(len(levels) - 2, -1, -1):
        low = np.frombuffer(levels[k], kind).astype(np.uint32)
        goes_on = np.unpackbits(np.frombuffer(bitmaps[k], np.uint8), count=len(low), bitorder="little").astype(bool)
        low[goes_on] |= ids << np.uint32(chunk_bits)
        ids = low
    return ids


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], position: int, chunk_bits: int = CHUNK_BITS) -> int:
    """The id at one position: a look-up a level, and a count of at most ``RANK_BITS`` bits between."""
    width = chunk_bits // 8
    value = 0
    for k, level in enumerate(levels):
        value |= int.from_bytes(level[position * width : (position + 1) * width], "little") << (k * chunk_bits)
        if k == len(bitmaps) or not bitmaps[k][position >> 3] >> (position & 7) & 1:
            break
        block = position // RANK_BITS
        before = int.from_bytes(ranks[k][4 * block : 4 * block + 4], "little")
        bits = int.from_bytes(bitmaps[k][block * RANK_BITS // 8 : (position >> 3) + 1], "little")
        position = before + (bits & ((1 << (position - block * RANK_BITS)) - 1)).bit_count()
    return value


# --- the tokenizer -------------------------------------------------------------------------


#: Of bytes: 1 ASCII letters, 2 ASCII signs, 3 the apostrophe, 0 all others.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[b for b in range(33, 127)]] = 2
_KINDS[[b for b in range(128) if chr(b).isalpha()]] = 1
_KINDS[[b for b in range(48, 58)]] = 0
_KINDS[39] = 3


# The parts of a tokenizer file under which texts may be cut as ``ChunkEncoder`` cuts them.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def may_be_cut(path: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space, and splits by letters, digits and signs, so that chunks have their own ids."""
    import json

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    before = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = before[0].get("type") == "Split" and before[0].get("pattern") == {"Regex": _WORDS} and before[0].get("behavior") == "Removed" and before[0].get("invert") is True
    plain = all(p.get("type") == "ByteLevel" and not p.get("use_regex", True) and not p.get("add_prefix_space", True) for p in before[1:])
    return (parts.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and split and plain and not (parts.get("model") or {}).get("dropout")


class ChunkEncoder:
    """Ids of texts by a ``tokenizers`` file, as the tokenizer gives them for whole texts.

    If the tokenizer ``may_be_cut``, texts are cut at ASCII white space and between an ASCII letter and a sign after it (or
    before it, but for an apostrophe, which may begin a contraction), and each distinct chunk is encoded once.
    Other tokenizers get each text whole, and so do texts that may hold the name of a special token.
    """

    def __init__(self, path: str, cuts: bool | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = may_be_cut(path) if cuts is None else cuts
        self.names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        if len(self.known) + len(chunks) > CACHE_ENTRIES:
            self.known.clear()
        for at in range(0, len(chunks), ENCODE_AT_ONCE):
            part = chunks[at : at + ENCODE_AT_ONCE]
            found = self.tokenizer.encode([c.decode() for c in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            words = np.array(found.word_ids, np.int64)
            cut = np.searchsorted(words, np.arange(len(part) + 1))
            for k, chunk in enumerate(part):
                self.known[chunk] = ids[cut[k] : cut[k + 1]].tobytes()

    def _split(self, column: pa.Array) -> list[list[bytes] | None]:
        data, offsets = vector.utf8(column)
        kinds = _KINDS[data]
        cut = np.zeros(len(data), np.int64)
        cut[1:] = (kinds[:-1] == 1) & (kinds[1:] >= 2) | (kinds[:-1] == 2) & (kinds[1:] == 1)
        to = np.cumsum(cut) + np.arange(len(data))
        spaced = np.full(len(data) + int(cut.sum()), 32, np.uint8)
        spaced[to] = vector.TO_LOWER[data]
        ends = np.append(to + 1, 0)[offsets - 1]
        ends[offsets == 0] = 0
        raw = spaced.tobytes()
        whole = data.tobytes()
        special = any(name in whole for name in self.names)
        return [
            None if special and any(name in whole[offsets[k] : offsets[k + 1]] for name in self.names) else raw[ends[k] : ends[k + 1]].split()
            for k in range(len(offsets) - 1)
        ]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null has none."""
        if not self.cuts:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in column.to_pylist()]
        split = self._split(column)
        needed = set().union(*(chunks for chunks in split if chunks))
        new = needed.difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES:  # what these texts need is learnt again with what is new
            new = needed
        if new:
            self._learn(list(new))
        known = self.known
        return [
            np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
            if chunks is None
            else np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.uint32)
            for k, chunks in enumerate(split)
        ]


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str, cuts: bool) -> ChunkEncoder:
    if path not in _encoders:  # a worker keeps its encoder from task to task
        _encoders[path] = ChunkEncoder(path, cuts)
    return _encoders[path]


def _encode(path: str, cuts: bool, end_id: int):
    fields = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64())] + [(n, pa.list_(pa.binary())) for n in ("levels", "bitmaps", "ranks")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = _encoder(path, cuts), 0
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                ids = [np.append(i, np.uint32(end_id)) for i in encoder.encode(batch.column("text"))]
                codes = [encode_ids(i) for i in ids]
                sizes = np.array([len(i) for i in ids], np.int64)
                places = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                columns = [pa.array([c[k] for c in codes], pa.list_(pa.binary())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), pa.array(places), pa.array(sizes), *columns], schema=fields)

    return encode


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode ``docs`` (doc_id, text) and write the store; returns its path.

    Null and empty texts have the end id alone.  Rows are in ascending order of doc_id, null
    first; rows with the same doc_id are in the order of their texts' hashes.  No documents give a
    store without rows.  Other columns are not stored.

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor.  Documents are dealt by
    ranges of (doc_id, hash of the text) before they are encoded, so that nothing is encoded
    twice and a doc_id with many rows fills several ranges.  Places inside a file are counted
    as it is written; places of the files need one row each.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    order = ["doc_id", "_hash"]
    dealt = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
    )
    codes = dealt.mapInArrow(_encode(tokenizer, may_be_cut(tokenizer), end_id), CODES).write.partitionBy("shard")
    codes.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(f"{path}/codes")
    totals = spark.read.schema(CODES).parquet(f"{path}/codes").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    totals.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/ranges")
    return path


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with ``start``, the number of tokens of all documents before."""
    ranges = spark.read.parquet(f"{path}/ranges").select("shard", F.col("start").alias("_start"))
    codes = spark.read.schema(CODES).parquet(f"{path}/codes")
    return join_small(codes, ranges, "shard").withColumn("start", F.col("_start") + F.col("place")).drop("_start", "shard", "place")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    for batch in batches:
        sums = []
        for levels, bitmaps in zip(batch.column("levels").to_pylist(), batch.column("bitmaps").to_pylist(), strict=True):
            sums.append(crc32(decode_ids(levels, bitmaps).astype("<u4").tobytes()))
        names = ["doc_id", "start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])


def store_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, read from the store."""
    rows = open_store(spark, path).select("doc_id", "start", "n_tokens", "levels", "bitmaps")
    return rows.mapInArrow(_summaries, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def rows_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``codes`` that may belong to ``wanted`` (doc_id), from the shards that may have them."""
    ids = wanted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    few = [r[0] for r in ids.limit(MOST_IDS + 1).collect()]
    ranges, codes = spark.read.parquet(f"{path}/ranges"), spark.read.schema(CODES).parquet(f"{path}/codes")
    first, last = F.col("first_doc"), F.col("last_doc")
    if len(few) <= MOST_IDS:
        asked = F.array(*[F.lit(i).cast("bigint") for i in few]).cast("array<bigint>")
        inside, chosen = F.exists(asked, lambda i: i.between(first, last)), F.col("doc_id").isin(few)
    else:
        low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
        inside, chosen = (last >= low) & (first <= high), F.col("doc_id").between(low, high)
    shards = sorted(r[0] for r in ranges.where(inside).select("shard").collect())  # a number a shard
    return codes.where(F.col("shard").isin(shards) & chosen)


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, position) with ``token``: single tokens, reached without decoding.

    Positions beyond a document's end and unknown documents give no row.  Only shards that may hold a wanted document are
    read, and in them only the pages whose statistics of doc_id fit.
    """
    rows = rows_of(spark, path, wanted).join(wanted.select("doc_id", "position"), "doc_id")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                token_at(r["levels"], r["bitmaps"], r["ranks"], r["position"]) if 0 <= r["position"] < r["n_tokens"] else None
                for r in batch.select(["levels", "bitmaps", "ranks", "position", "n_tokens"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("position"), pa.array(found, pa.int64())], names=["doc_id", "position", "token"])

    return rows.mapInArrow(look, "doc_id bigint, position bigint, token bigint").where(F.col("token").isNotNull())
