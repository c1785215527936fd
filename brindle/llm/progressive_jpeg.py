"""A progressive JPEG decoder in numpy, and an encoder that carries bytes as coefficients.

Decoding goes over many images at once.  Stretches of entropy-coded data between restart markers
are independent, so all of them, from all images, advance together by one symbol a step: that is what
makes numpy fast enough.  Scans add to arrays of coefficients (spectral selection: some
frequencies; successive approximation: some bits); the inverse transform, the upsampling of chroma
and the conversion to RGB come last.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Zigzag order: along the anti-diagonals, in turn down and up.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

#: The cosine basis in 12-bit integers: with coefficients of 12 bits all sums are exact in float64.
_BASIS = np.array([[np.rint(4096 * np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5)) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    """One colour plane: its sampling, quantisation, and coefficients in zigzag order by block."""

    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks that a scan of this component alone covers
    high: int = 0
    stride: int = 0  # blocks a row that are stored, up to whole MCUs
    blocks: np.ndarray | None = None


@dataclass
class Image:
    """What the headers of one image say."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)  # (component places, tables, Ss, Se, Ah, Al, restart, data)


#: A marker that is neither a stuffed byte nor a restart ends a scan.
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


# --- headers -------------------------------------------------------------------------------


def parse(raw: bytes) -> Image:
    """Read the markers of a progressive (SOF2) image of 8-bit samples.

    What this decoder does not read is a ValueError: other kinds of JPEG, a size of zero or of more blocks than the file
    has bits, sampling factors that do not divide the largest, no frame or several, no scan.
    """
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG: the start marker is missing")
    image, at, restart = Image(), 2, 0
    huffman: dict[tuple[int, int], bytes] = {}
    while True:
        kind = raw[at + 1] if raw[at : at + 1] == b"\xff" and at + 1 < len(raw) else None
        if kind == 0xD9:
            if not image.scans:
                raise ValueError("there is no scan")
            return image
        if kind is None or at + 4 > len(raw):
            raise ValueError("a JPEG marker is missing")
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            if image.components:
                raise ValueError("there are several frames")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            _lay_out(image, 8 * len(raw))
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive JPEG with Huffman codes is read")
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k] >> 4, body[k] & 15] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                k += 65 + 64 * wide
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            image.comment += body
        elif kind == 0xDA:
            if not image.components:
                raise ValueError("a scan comes before the frame")
            n = body[0]
            idents = {c.ident: k for k, c in enumerate(image.components)}
            places = tuple(idents[body[1 + 2 * k]] for k in range(n))
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            klass = 0 if start == 0 else 1
            which = [(body[2 + 2 * k] >> 4) if klass == 0 else body[2 + 2 * k] & 15 for k in range(n)]
            tables = tuple(huffman.get((klass, t), b"") for t in which)
            ended = _SCAN_END.search(raw, at)
            if not ended:
                raise ValueError("a scan has no end")
            stop = ended.start()
            image.scans.append((places, tables, start, end, bits >> 4, bits & 15, restart, raw[at:stop]))
            at = stop


def _lay_out(image: Image, most_blocks: int) -> None:
    if not image.components or not image.width or not image.height or any(not (1 <= c.h <= 4 and 1 <= c.v <= 4) for c in image.components):
        raise ValueError("the frame has no size, no component or no sampling")
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    if any(most_h % c.h or most_v % c.v for c in image.components):
        raise ValueError("sampling factors that do not divide the largest are not read")
    across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    if across * down * sum(c.h * c.v for c in image.components) > most_blocks:  # each block takes a bit of the first DC scan
        raise ValueError("the frame has more blocks than the file has bits")
    for c in image.components:
        c.wide = -(-(-(-image.width * c.h // most_h)) // 8)
        c.high = -(-(-(-image.height * c.v // most_v)) // 8)
        c.stride = across * c.h
        c.blocks = np.zeros((across * c.h * down * c.v, 64), np.int16)


# --- entropy decoding ------------------------------------------------------------------------

_luts: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits the length of the code that they begin with, times 256, plus its symbol."""
    if table not in _luts:
        lut = np.zeros(1 << 16, np.int32)
        code, at = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                lut[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        if len(_luts) > 64:
            _luts.clear()
        _luts[table] = lut
    return _luts[table]


class _Lanes:
    """The restart segments of one scan of many images, each read from its own bit on."""

    def __init__(self, scans: Sequence[bytes]) -> None:
        sizes = np.array([len(s) for s in scans], np.int64)
        data = np.frombuffer(b"".join(scans), np.uint8)
        begins = np.cumsum(sizes) - sizes
        marks = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
        after = data[marks + 1]
        restarts = marks[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[marks[after == 0] + 1] = False
        keep[restarts] = keep[restarts + 1] = False
        place = np.append(0, np.cumsum(keep))
        starts = np.sort(np.concatenate([begins, restarts + 2]))
        self.image = np.searchsorted(begins, starts, side="right") - 1
        self.order = np.arange(len(starts)) - np.searchsorted(starts, begins)[self.image]  # which segment of its image
        self.bit = place[starts] * 8
        self.bytes = np.append(data[keep], np.zeros(8, np.uint8)).astype(np.int64)

    def peek(self, lane: np.ndarray, n: int = 16) -> np.ndarray:
        bit = self.bit[lane]
        at = bit >> 3
        word = self.bytes[at] << 16 | self.bytes[at + 1] << 8 | self.bytes[at + 2]
        return word >> (24 - n - (bit & 7)) & ((1 << n) - 1)

    def symbol(self, lane: np.ndarray, lut: np.ndarray) -> np.ndarray:
        found = lut[self.peek(lane)]
        if not (found >> 8).all():
            raise ValueError("a Huffman code is not in its table")
        self.bit[lane] += found >> 8
        return found & 255

    def take(self, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        value = self.peek(lane) >> (16 - n)
        self.bit[lane] += n
        return value


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


def _decode_scans(images: Sequence[Image], scans: Sequence[tuple]) -> None:
    """The same kind of scan of some images; all have the same tables and parameters."""
    places, tables, start, end, high, low, restart, _ = scans[0]
    lanes = _Lanes([s[-1] for s in scans])
    # Coefficients of all images in one array, and of each lane's steps which block they are.
    first, total, parts = [], 0, []
    for image in images:
        own = []
        for p in places:
            own.append(total)
            parts.append(image.components[p].blocks)
            total += len(parts[-1])
        first.append(own)
    blocks = np.concatenate(parts)
    pattern, counts = _pattern(images, places, first)
    count = counts[lanes.image]
    each = np.where(restart > 0, restart, count)
    begin = lanes.order * each
    n_units = np.minimum(each, count - begin)
    if start == 0:
        _dc(blocks, lanes, tables, high, low, begin, n_units, pattern)
    elif high == 0:
        _ac_first(blocks, lanes, _lookup(tables[0]), start, end, low, begin, n_units, pattern)
    else:
        _ac_refine(blocks, lanes, _lookup(tables[0]), start, end, low, begin, n_units, pattern)
    at = 0
    for part in parts:
        part[:] = blocks[at : at + len(part)]
        at += len(part)


def _pattern(images: Sequence[Image], places: tuple, first: list):
    """A function from (lane's image, unit) to the unit's blocks, and the number of units an image.

    In a scan of one component a unit is a block, in one of several an MCU.
    """
    if len(places) == 1:
        c = [i.components[places[0]] for i in images]
        wide, stride, base = (np.array(v) for v in ([x.wide for x in c], [x.stride for x in c], [f[0] for f in first]))
        return (lambda image, unit: [(0, base[image] + unit // wide[image] * stride[image] + unit % wide[image])]), np.array([x.wide * x.high for x in c])
    across = np.array([i.components[0].stride // i.components[0].h for i in images])
    shapes = [(k, images[0].components[p].h, images[0].components[p].v) for k, p in enumerate(places)]
    base = np.array(first)

    def units(image: np.ndarray, unit: np.ndarray) -> list:
        row, column = unit // across[image], unit % across[image]
        return [(k, base[image, k] + (row * v + y) * across[image] * h + column * h + x) for k, h, v in shapes for y in range(v) for x in range(h)]

    counts = [len(i.components[0].blocks) // (i.components[0].h * i.components[0].v) for i in images]
    return units, np.array(counts)


def _dc(blocks, lanes, tables, high, low, begin, n_units, pattern) -> None:
    luts = [_lookup(t) for t in tables] if not high else []
    before = np.zeros((len(tables), len(begin)), np.int64)
    if high and len(tables) == 1:  # one bit a block, all at once
        lane = np.repeat(np.arange(len(begin)), n_units)
        own = np.arange(len(lane)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
        bit = lanes.bit[lane] + own
        value = lanes.bytes[bit >> 3] >> (7 - (bit & 7)) & 1
        ((_, block),) = pattern(lanes.image[lane], begin[lane] + own)
        blocks[block, 0] |= (value << low).astype(np.int16)
        return
    for step in range(int(n_units.max(initial=0))):
        lane = np.flatnonzero(step < n_units)
        for k, block in pattern(lanes.image[lane], begin[lane] + step):
            if high:
                blocks[block, 0] |= (lanes.take(lane, np.ones(len(lane), np.int64)) << low).astype(np.int16)
            else:
                size = lanes.symbol(lane, luts[k])
                before[k, lane] += _extend(lanes.take(lane, size), size)
                blocks[block, 0] = before[k, lane] << low


def _ac_first(blocks, lanes, lut, start, end, low, begin, n_units, pattern) -> None:
    unit, k = np.zeros(len(begin), np.int64), np.full(len(begin), start)
    lane = np.flatnonzero(n_units > 0)
    ((_, block),) = pattern(lanes.image, np.minimum(begin, begin + np.maximum(n_units - 1, 0)))
    while len(lane):
        symbol = lanes.symbol(lane, lut)
        run, size = symbol >> 4, symbol & 15
        value = _extend(lanes.take(lane, size), size)
        at = k[lane] + run
        filled = size > 0
        if filled.all():
            blocks[block[lane], at] = value << low
        else:
            blocks[block[lane[filled]], at[filled]] = value[filled] << low
        k[lane] = at + 1  # also right for a run of 16 zeros
        ends = np.flatnonzero(~filled & (run < 15))
        if len(ends):
            skipped = lanes.take(lane[ends], run[ends]) + (1 << run[ends]) - 1
            unit[lane[ends]] += skipped
            k[lane[ends]] = end + 1
        over = lane[k[lane] > end]
        if len(over):
            unit[over] += 1
            k[over] = start
            ((_, block[over]),) = pattern(lanes.image[over], begin[over] + np.minimum(unit[over], n_units[over] - 1))
            lane = lane[unit[lane] < n_units[lane]]


def _correct(blocks, lanes, lane, block, low, first, end) -> None:
    """A correction bit for each coefficient that is not zero, from ``first`` (one a lane) to ``end``."""
    columns = np.arange(end + 1)
    values = blocks[block][:, : end + 1]
    filled = (values != 0) & (columns >= first[:, None])
    upto = np.cumsum(filled, axis=1)
    bit = lanes.bit[lane][:, None] + upto - 1
    row, column = np.nonzero(filled)
    bit = bit[row, column]
    more = (lanes.bytes[bit >> 3] >> (7 - (bit & 7)) & 1) << low
    value = values[row, column]
    blocks[block[row], column] = value + np.where(value > 0, more, -more)
    lanes.bit[lane] += upto[:, -1]


def _ac_refine(blocks, lanes, lut, start, end, low, begin, n_units, pattern) -> None:
    unit, k, left = np.zeros(len(begin), np.int64), np.full(len(begin), start), np.zeros(len(begin), np.int64)
    lane = np.flatnonzero(n_units > 0)
    while len(lane):
        ((_, block),) = pattern(lanes.image[lane], begin[lane] + unit[lane])
        fresh = left[lane] == 0
        asked, own = lane[fresh], block[fresh]
        if len(asked):
            symbol = lanes.symbol(asked, lut)
            run, size = symbol >> 4, symbol & 15
            ends = (size == 0) & (run < 15)
            left[asked[ends]] = lanes.take(asked[ends], run[ends]) + (1 << run[ends])
            going, own, run, new = asked[~ends], own[~ends], run[~ends].copy(), size[~ends] > 0
            sign = np.where(new, lanes.take(going, new.astype(np.int64)), 0)
            while len(going):  # coefficient by coefficient, to the zero that the run ends at
                value = blocks[own, k[going]]
                filled = value != 0
                more = lanes.take(going[filled], np.ones(int(filled.sum()), np.int64)) << low
                blocks[own[filled], k[going[filled]]] = value[filled] + np.where(value[filled] > 0, more, -more)
                here = ~filled & (run == 0)
                put = here & new
                blocks[own[put], k[going[put]]] = np.where(sign[put] > 0, 1, -1) << low
                run -= ~filled & ~here
                k[going] += 1
                on = ~here & (k[going] <= end)
                going, own, run, new, sign = going[on], own[on], run[on], new[on], sign[on]
        closing = left[lane] > 0
        if closing.any():
            _correct(blocks, lanes, lane[closing], block[closing], low, k[lane[closing]], end)
            left[lane[closing]] -= 1
            k[lane[closing]] = end + 1
        over = lane[k[lane] > end]
        unit[over] += 1
        k[over] = start
        lane = lane[unit[lane] < n_units[lane]]


def read_coefficients(files: Sequence[bytes]) -> list[Image]:
    """Parse images and accumulate all their scans."""
    images = [parse(f) for f in files]
    for n in range(max((len(i.scans) for i in images), default=0)):
        alike = defaultdict(list)
        for image in images:
            if n < len(image.scans):
                shape = tuple((image.components[p].h, image.components[p].v) for p in image.scans[n][0])
                alike[image.scans[n][:-1], shape].append(image)
        for (_, _), some in alike.items():
            _decode_scans(some, [i.scans[n] for i in some])
    return images


# --- samples --------------------------------------------------------------------------------


#: Blocks and samples that are transformed at once, so that only coefficients and results are held for the whole image.
_AT_ONCE = 4096


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component, at its own resolution, up to whole MCUs."""
    found = []
    for c in image.components:
        samples = np.zeros((len(c.blocks), 8, 8), np.uint8)
        for at in range(0, len(c.blocks), _AT_ONCE):
            part = c.blocks[at : at + _AT_ONCE]
            flat = np.zeros((len(part), 64))
            flat[:, ZIGZAG] = part.astype(np.int32) * image.quant[c.table]
            exact = _BASIS.T @ flat.reshape(-1, 8, 8) @ _BASIS
            samples[at : at + _AT_ONCE] = np.clip(np.floor(exact / (1 << 24) + 0.5).astype(np.int64) + 128, 0, 255)
        found.append(samples.reshape(-1, c.stride, 8, 8).swapaxes(1, 2).reshape(-1, c.stride * 8))
    return found


def to_rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of one or three components; chroma samples are repeated."""
    if len(image.components) not in (1, 3):
        raise ValueError(f"{len(image.components)} components are not read")
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    sampled = planes(image)
    rgb = np.zeros((image.height, image.width, 3), np.uint8)
    rows = most_v * max(1, 64 * _AT_ONCE // (most_v * image.width))
    for top in range(0, image.height, rows):
        full = []
        for c, plane in zip(image.components, sampled, strict=True):
            down, across = most_v // c.v, most_h // c.h
            part = plane[top // down : (top + rows) // down].astype(np.int32).repeat(down, axis=0).repeat(across, axis=1)
            full.append(part[: image.height - top, : image.width])
        strip = rgb[top : top + rows]
        if len(full) == 1:
            strip[:] = full[0][:, :, None]
            continue
        y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
        half = 1 << 15
        # The JFIF conversion in 16-bit fixed point.
        colours = [(y + 91881 * cr + half) >> 16, (y - 22554 * cb - 46802 * cr + half) >> 16, (y + 116130 * cb + half) >> 16]
        strip[:] = np.clip(np.stack(colours, axis=2), 0, 255)
    return rgb


# --- bytes as coefficients ------------------------------------------------------------------------
#
# A byte is a coefficient of magnitude 128 to 255, the upper half of the bytes positive: eight bits of
# magnitude always, so none is ever zero, and without its lowest bit it takes one code bit and seven more.
# Negative DC coefficients are one less in magnitude, since JPEG halves DC downwards and AC towards zero.

_SHAPE = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
#: (component, first, last, Ah, Al) of each scan.
_SCRIPT = (
    (0, 0, 0, 0, 1), (1, 0, 0, 0, 1), (2, 0, 0, 0, 1),
    (0, 1, 5, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (0, 6, 63, 0, 1),
    (0, 0, 0, 1, 0), (1, 0, 0, 1, 0), (2, 0, 0, 1, 0),
    (0, 1, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0),
)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def _one_code(klass_and_id: int, symbol: int) -> bytes:
    return bytes((klass_and_id, 1)) + bytes(15) + bytes((symbol,))


_TABLES = _segment(0xDB, bytes(1) + bytes([1] * 64)) + _segment(0xC4, _one_code(0x00, 7) + _one_code(0x10, 7) + _one_code(0x11, 0))
_STARTS = [
    _segment(0xDD, (0 if s == 0 and h else 1).to_bytes(2, "big")) + _segment(0xDA, bytes((1, c + 1, 0x01 if h else 0x00, s, e, h << 4 | low)))
    for c, s, e, h, low in _SCRIPT
]


def geometry(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down that hold so many blocks, six an MCU; no side is above 64,000 samples."""
    mcus = -(-n_blocks // 6)
    across = -(-mcus // 4000)
    return across, -(-mcus // across)


def write_payloads(payloads: Sequence[bytes], comments: Sequence[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as a progressive 4:2:0 image.

    Its blocks fill luma row by row, then the two chroma planes; the rest are zero bytes.
    """
    shapes = [geometry(len(p) // 64) for p in payloads]
    padded = b"".join(p + bytes(384 * a * d - len(p)) for p, (a, d) in zip(payloads, shapes, strict=True))
    data = np.frombuffer(padded, np.uint8).reshape(-1, 64)
    mcus = np.array([a * d for a, d in shapes])
    first = 6 * (np.cumsum(mcus) - mcus)
    value = data.astype(np.int16)
    # The seven upper bits of the magnitude, as JPEG writes them: negative ones complemented.
    magnitude = 128 + (value & 127)
    upper = magnitude >> 1
    coded = np.where(value >= 128, upper, 127 - upper).astype(np.uint8)
    lowest = (magnitude & 1).astype(np.uint8)
    direct = np.where(value[:, 0] >= 128, magnitude[:, 0], 1 - magnitude[:, 0])
    coded[:, 0] = np.where(direct > 0, direct >> 1, 127 + (direct >> 1))
    lowest[:, 0] = direct & 1
    bounds = [np.concatenate([first, first + 4 * mcus, first + 5 * mcus]), np.concatenate([first + 4 * mcus, first + 5 * mcus, first + 6 * mcus])]
    order = np.zeros(len(data), np.int64)  # of a block in its component
    starts = np.sort(bounds[0])
    order = np.arange(len(data)) - starts[np.searchsorted(starts, np.arange(len(data)), side="right") - 1]
    restart = np.stack([np.full(len(data), 0xFF, np.uint8), (0xD0 + order % 8).astype(np.uint8)], axis=1)

    def marked(body: np.ndarray) -> tuple[bytes, np.ndarray]:
        return np.concatenate([body, restart], axis=1).tobytes(), np.arange(len(data) + 1) * (body.shape[1] + 2)

    streams = {}
    for s, e in {(s, e) for _, s, e, h, _ in _SCRIPT if not h}:
        streams[s, e, 0] = marked(coded[:, s : e + 1])
    refined = np.packbits(np.concatenate([np.zeros((len(data), 1), np.uint8), lowest[:, 1:]], axis=1), axis=1)
    stuffed = refined == 0xFF
    sizes = 10 + stuffed.sum(axis=1)
    flat = np.concatenate([refined, restart], axis=1).reshape(-1)
    wide = np.concatenate([stuffed, np.zeros((len(data), 2), bool)], axis=1).reshape(-1)
    body = np.zeros(len(flat) + int(wide.sum()), np.uint8)
    body[np.arange(len(flat)) + np.cumsum(wide) - wide] = flat
    streams[1, 63, 1] = body.tobytes(), np.append(0, np.cumsum(sizes))
    files = []
    for k, (across, down) in enumerate(shapes):
        n = across * down
        of = [(first[k], first[k] + 4 * n), (first[k] + 4 * n, first[k] + 5 * n), (first[k] + 5 * n, first[k] + 6 * n)]
        frame = b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03" + b"".join(bytes((i, h << 4 | v, 0)) for i, h, v in _SHAPE)
        parts = [b"\xff\xd8", _segment(0xFE, comments[k]), _TABLES, _segment(0xC2, frame)]
        for head, (c, s, e, h, _) in zip(_STARTS, _SCRIPT, strict=True):
            a, b = of[c]
            parts.append(head)
            if h and s == 0:
                bits = np.packbits(lowest[a:b, 0])
                if (b - a) % 8:
                    bits[-1] |= 0xFF >> ((b - a) % 8)
                parts.append(bits.tobytes().replace(b"\xff", b"\xff\x00"))
            else:
                stream, cut = streams[s, e, h]
                parts.append(stream[cut[a] : cut[b] - 2])  # no restart marker after the last block
        parts.append(b"\xff\xd9")
        files.append(b"".join(parts))
    return files


def payload_of(image: Image, n_bytes: int) -> bytes:
    """The bytes that ``write_payloads`` put into an image."""
    values = np.concatenate([c.blocks for c in image.components])
    values[values[:, 0] < 0, 0] -= 1
    values = values.reshape(-1)[:n_bytes]
    return np.where(values > 0, values, -values - 128).astype(np.uint8).tobytes()
