"""Words of many texts at once, as numpy arrays.

Texts of an Arrow batch lie one after another as UTF-8 bytes.  Where words begin and end, and
64-bit hashes of any stretch of bytes, come from a few passes over those bytes, so that a task handles
tens of MB a second without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts are handled in slices of at most so many bytes, or one text.
SLICE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _MULTIPLIER)


_BYTE_CODES = seeds(256, 11)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64, from 0 to ``n``."""
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts are at most ``limit`` bytes together, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, one text after another, and where each begins (and the last ends); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


IS_SPACE = _table(b" \t\n\x0b\x0c\r")
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


class Hasher:
    """Hashes of stretches of ``data``: equal stretches have equal hashes wherever they stand.

    A stretch's hash comes from two sums up to its ends.  Of much data, which is one long text, sums are made
    for some of the stretches at a time, so that they take no multiple of its size.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self._sums = _prefix_sums(data) if len(data) <= 2 * SLICE_BYTES else None

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        if self._sums is not None:
            return _stretch_hash(self._sums, start, end)
        out = np.zeros(len(start), np.uint64)
        order = np.argsort(start, kind="stable")
        upto = np.maximum.accumulate(end[order]) if len(order) else end
        a = 0
        while a < len(order):
            low = int(start[order[a]])
            b = max(a + 1, min(int(np.searchsorted(start[order], low + SLICE_BYTES)), int(np.searchsorted(upto, low + 2 * SLICE_BYTES, side="right"))))
            at = order[a:b]
            high = int(end[at].max())
            if high - low <= 2 * SLICE_BYTES:
                out[at] = _stretch_hash(_prefix_sums(self.data[low:high]), start[at] - low, end[at] - low)
            else:  # one long stretch
                out[at] = [_long_hash(self.data[i:j]) for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            a = b
        return out


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table(len(data))[0][: len(data)], out=sums[1:])
    return sums


def _stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    value = (sums[end] - sums[start]) * _power_table(len(sums))[1][start]
    return _mix(value + (end - start).astype(np.uint64))


def _long_hash(data: np.ndarray) -> np.uint64:
    """The same for one stretch of any length, part by part."""
    total, shift = 0, 1
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES]
        total += int(_prefix_sums(part)[-1]) * shift
        shift = shift * pow(int(_MULTIPLIER), len(part), 1 << 64) % (1 << 64)
    return _mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, which also end where a text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][(offsets[:-1] < len(inside))]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each start lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row, from the words' hashes."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= _MULTIPLIER
        total += words[k : k + n]
    return _mix(total)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The index of each key among ``sorted_keys``, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, and the accented capitals that UTF-8 writes as C3 80 to C3 9E."""
    low = TO_LOWER[data]
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[accented] += 0x20
    return low


_LETTERS = np.zeros(256, bool)
_LETTERS[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = True
IS_DIGIT = _table(b"0123456789")


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters: ASCII ones, and all others from 128 on but for the signs that
    UTF-8 writes as C2 xx and as E2 80 xx (no-break space, quotation marks, dashes)."""
    inside = _LETTERS[data]
    for at, width in ((np.flatnonzero(data == 0xC2), 2), (np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80)), 3)):
        for k in range(width):
            inside[np.minimum(at + k, len(data) - 1)] = False
    return inside


def parts(texts: pa.Array, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The stretches of the texts' bytes, as strings."""
    data, _ = utf8(texts)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def numbered(frame: DataFrame) -> DataFrame:
    """The frame with its columns named c0, c1, ...: functions on Arrow batches take no names with dots or backticks."""
    return frame.toDF(*[f"c{k}" for k in range(len(frame.columns))])


def filter_texts(frame: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``frame`` whose texts ``keep`` answers True for; all columns stay, nothing is shuffled."""
    own = f"c{frame.columns.index(column)}"

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, own):
                yield batch.filter(pa.array(keep(batch.column(own)), pa.bool_()))

    plain = numbered(frame)
    return plain.mapInArrow(chosen, plain.schema).toDF(*frame.columns)
