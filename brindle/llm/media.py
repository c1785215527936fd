"""Media columns: binary columns of progressive JPEG, decoded to RGB tensors, and bytes kept in such images."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.llm import progressive_jpeg as jpeg
from brindle.llm import vector
from brindle.llm.text import quoted

BLOCK = 64
#: Larger images are reported in ``error``: about 12 bytes a pixel are held at once.
MOST_PIXELS = 1 << 26
# What reading a damaged image may raise.
_DAMAGE = (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError)


def decode_images(frame: DataFrame, column: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """``frame`` with height, width, rgb (height x width x 3 bytes, row by row) and error added.

    A null or empty value has null results; a value that is no progressive JPEG of one or three components, that is
    damaged anywhere, or that has more than ``most_pixels`` has null results and a message in ``error``, and the
    rest of its batch is decoded.  Columns named like the new
    ones are replaced, others are passed on.  An empty table gives an empty table.
    """
    new = ("height", "width", "rgb", "error")
    kept = [c for c in frame.columns if c.lower() not in new or c == column]
    if column in new:
        raise ValueError(f"the images' column may not be named {column}")

    frame = frame.select(*[quoted(c) for c in kept])
    plain, own = vector.numbered(frame), f"c{kept.index(column)}"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vector.slices(whole, own):
                rows = [_tensor(v, most_pixels) for v in _read(batch.column(own).to_pylist())]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    schema = StructType([*plain.schema.fields, *StructType.fromDDL("height int, width int, rgb binary, error string").fields])
    return plain.mapInArrow(decode, schema).toDF(*kept, *new)


def _read(files: list[bytes | None]) -> list[jpeg.Image | str | None]:
    """All images at once; if one fails, one after another."""
    filled = [f for f in files if f]
    try:
        found: list = list(jpeg.read_coefficients(filled))
    except _DAMAGE:
        found = []
        for f in filled:
            try:
                found.append(jpeg.read_coefficients([f])[0])
            except _DAMAGE as error:
                found.append(f"{type(error).__name__}: {error}")
    following = iter(found)
    return [next(following) if f else None for f in files]


def _tensor(image: jpeg.Image | str | None, most_pixels: int) -> tuple:
    if image is None:
        return None, None, None, None
    if isinstance(image, str):
        return None, None, None, image
    try:
        if image.width * image.height > most_pixels:
            raise ValueError(f"{image.width} x {image.height} are more than {most_pixels} pixels")
        rgb = jpeg.to_rgb(image)
    except _DAMAGE as error:
        return None, None, None, f"{type(error).__name__}: {error}"
    return rgb.shape[0], rgb.shape[1], rgb.tobytes(), None


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's bytes as the coefficients of a progressive JPEG.

    The bytes of the UTF-8 text (null: none) are followed by zeros up to a positive multiple of 64; the number
    of the text's own bytes is the image's comment.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                padded = [t + bytes(max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t)) for t in texts]
                files = jpeg.write_payloads(padded, [str(len(t)).encode() for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, media binary")


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def stored_features(stored: DataFrame) -> DataFrame:
    """Read ``stored`` (of ``store_texts``) back: the payload's digests, the image's, and a feature of the RGB tensor.

    The feature is width x height, the sums of the three channels, and a crc32 of the tensor; all
    arithmetic on the way is exact, so equal images have equal features.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in vector.slices(whole, "media"):
                files = batch.column("media").to_pylist()
                rows = []
                for raw, image in zip(files, jpeg.read_coefficients(files), strict=True):
                    n_bytes = int(image.comment)
                    payload = jpeg.payload_of(image, max(BLOCK, -(-n_bytes // BLOCK) * BLOCK))
                    rgb = jpeg.to_rgb(image)
                    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                    feature = f"{image.width}x{image.height} {sums[0]} {sums[1]} {sums[2]} {crc32(rgb.tobytes()):08x}"
                    rows.append((n_bytes, len(payload), sha256(payload).hexdigest(), crc32(payload[-BLOCK:]), len(raw), sha256(raw).hexdigest(), feature))
                columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[c.split()[0] for c in FEATURES.split(", ")])

    return stored.select("doc_id", F.col("media")).mapInArrow(read, FEATURES)
