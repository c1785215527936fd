"""Benchmark decontamination by templates.

Texts become rows of typed tokens: numbers, units after numbers, and names are placeholders, all else
stands for itself; a name of several words is one placeholder.  Windows of tokens are looked up among the benchmark's windows, once as they
stand and once as templates; in the second case the words that fill the placeholders must be
exchanged consistently, which is how a question with other numbers and names is told from chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import vector
from brindle.sources.shared import materialize

WIDTH = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.8
#: Windows of a template with fewer words that stand for themselves are not looked at.
LEAST_LITERAL = 3
#: An item all of whose windows have fewer is compared as a whole template, if it has at least so many words.
LEAST_WHOLE = 2
#: How far a template's windows may drift apart, from one to the next, where a filling has another number of tokens.
DRIFT = 3
#: Tokens of the benchmark that are held in memory and broadcast at once; more go in further blocks.
BLOCK_TOKENS = 1_000_000
#: Windows that a step of the look-up unfolds at once, whatever many items share them.
AT_ONCE = 1 << 18

# Words that are units when they follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs oz "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars euro euros cent cents usd eur gbp mph kmh w kw watt watts v volt volts hz khz mhz ghz kb mb gb tb "
    "st nd rd th"
).split()

PAIRS = "doc_id bigint, item_id bigint, coverage double, kind string"

_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in vector.seeds(3, 31))
_DIGIT = vector.IS_DIGIT
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n")] = True


_JOINS = np.zeros(256, bool)  # what may stand between the words of one name
_JOINS[list(b" -")] = True


class Tokens(NamedTuple):
    """Tokens of a slice of texts."""

    text: np.ndarray  # which text
    literal: np.ndarray  # hash of the lower-cased token
    typed: np.ndarray  # the same, or that of a placeholder
    slot: np.ndarray  # whether it is a placeholder


class Forms(NamedTuple):
    """Texts as plain tokens, and as templates in two readings: a capital that begins a sentence is a word, or a name."""

    plain: Tokens
    templates: tuple[Tokens, Tokens]


def _counts(mask: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=sums[1:])
    return sums


class _Sparse:
    """The same counts as ``_counts``, by the places of the few that are True."""

    def __init__(self, mask: np.ndarray) -> None:
        self.at = np.flatnonzero(mask)

    def __getitem__(self, upto: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, upto)


def _byte_counts(mask: np.ndarray) -> np.ndarray | _Sparse:
    return _counts(mask) if len(mask) <= 2 * vector.SLICE_BYTES else _Sparse(mask)


def tokenize(column: pa.Array) -> Forms:
    """Tokens are runs of letters and digits; a point or comma between digits belongs to a number.

    In templates a number with letters attached is two tokens, a name is a word with one capital, its first letter,
    and names with only spaces or hyphens between are one placeholder.
    """
    data, offsets = vector.utf8(column)
    inside = vector.letters(data) | _DIGIT[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        point = (data[1:-1] == 46) | (data[1:-1] == 44)
        inside[1:-1] |= point & digit[:-2] & digit[2:]
    start, end = vector.runs(inside, offsets)
    low = vector.lower(data)
    hasher = vector.Hasher(low)
    literal = hasher(start, end)
    plain = Tokens(vector.owner(start, offsets), literal, literal, np.zeros(len(start), bool))
    if not len(start):
        return Forms(plain, (plain, plain))

    digits, uppers, stops, joins = _byte_counts(_DIGIT[data]), _byte_counts(low != data), _byte_counts(_STOP[data]), _byte_counts(_JOINS[data])
    points = _byte_counts((data == 46) | (data == 44))
    # A number with letters attached: digits, and points between them, up to the first letter and none after.
    whole = _DIGIT[data[start]] & ~_DIGIT[data[end - 1]]
    cut = start + digits[end] - digits[start] + points[end] - points[start]
    whole &= _DIGIT[data[cut - 1]] & (digits[cut] + points[cut] - digits[start] - points[start] == cut - start)
    at = np.flatnonzero(whole)
    start, end = np.insert(start, at + 1, cut[at]), np.insert(end, at, cut[at])
    text, literal = vector.owner(start, offsets), hasher(start, end)

    continuation = _byte_counts((data & 0xC0) == 0x80)
    number = (digits[end] > digits[start]) & _DIGIT[data[start]] & _DIGIT[data[end - 1]]
    first = np.append(True, text[1:] != text[:-1])
    after = np.where(first, start, np.append(0, end[:-1]))
    begins = first | (stops[start] > stops[after])
    follows_number = np.append(False, number[:-1]) & ~first
    known = np.sort(vector.Hasher(np.frombuffer(" ".join(UNITS).encode(), np.uint8))(*_unit_spans()))
    unit = follows_number & (vector.find(known, literal) >= 0)
    capital = low[start] != data[start]
    capital |= np.where(end - start > 1, (data[start] == 0xC3) & (low[np.minimum(start + 1, len(data) - 1)] != data[np.minimum(start + 1, len(data) - 1)]), False)
    letters = end - start - (continuation[end] - continuation[start])
    name = capital & (uppers[end] - uppers[start] == 1) & (letters > 1) & ~number & ~unit
    joined = ~begins & (joins[start] - joins[after] == start - after)

    def reading(name: np.ndarray) -> Tokens:
        more = name & joined & np.append(False, name[:-1])
        head = np.flatnonzero(~more)
        last = np.append(head[1:], len(start)) - 1
        several = last > head
        word = literal[head]
        word[several] = hasher(start[head[several]], end[last[several]])
        typed = word.copy()
        typed[number[head]], typed[unit[head]], typed[name[head]] = _NUMBER, _UNIT, _NAME
        return Tokens(text[head], word, typed, (number | unit | name)[head])

    return Forms(plain, (reading(name & ~begins), reading(name)))


def _unit_spans() -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(u) for u in UNITS])
    end = np.cumsum(sizes + 1) - 1
    return end - sizes, end


def _windows(tokens: Tokens, typed: bool, width: int, least_literal: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, and which are inside one text (and, of templates, have a slot and enough words)."""
    values = tokens.typed if typed else tokens.literal
    hashed = vector.window_hash(values, width)
    n = len(hashed)
    valid = tokens.text[:n] == tokens.text[width - 1 : width - 1 + n]
    if typed:
        slots = np.append(0, np.cumsum(tokens.slot))
        slots = slots[width : width + n] - slots[:n]
        valid &= (slots > 0) & (slots <= width - least_literal)
    return hashed, valid


class _Index(NamedTuple):
    """Windows of some forms: sorted distinct hashes, and the places of each in the forms."""

    keys: np.ndarray
    first: np.ndarray
    form: np.ndarray
    place: np.ndarray


class _Windows(NamedTuple):
    """The windows that a form has, form after form."""

    begin: np.ndarray
    hashed: np.ndarray
    place: np.ndarray


class Copies(NamedTuple):
    """Distinct texts of items as plain tokens.

    A document with enough of a form's windows misses ``spare`` of them at most, so it holds one of any that are one more:
    only so many, those that the fewest forms have, are looked up (``anchors``).  What is found is counted in full.
    """

    items: list[list[int]]  # of each form
    windows: _Windows  # distinct ones
    anchors: _Index
    short: dict[int, _Index]  # forms of fewer tokens than a window, whole, by their number of tokens


class Templates(NamedTuple):
    """Distinct templates of items in one reading: items that differ in their fillings alone are one form."""

    items: list[list[int]]
    tokens: Tokens
    begin: np.ndarray  # where a form's tokens begin, and the last ends
    windows: _Windows  # those with a slot and enough words, one a place
    spare: np.ndarray  # how many of them a document may miss
    anchors: _Index
    whole: _Index  # of forms without such windows, the window with the most words


class Block(NamedTuple):
    """What of the benchmark is looked up at once."""

    ids: list
    copies: Copies
    templates: tuple[Templates, Templates]


def _index(hashed: np.ndarray, form: np.ndarray, place: np.ndarray) -> _Index:
    order = np.argsort(hashed, kind="stable")
    keys, first = np.unique(hashed[order], return_index=True)
    return _Index(keys, np.append(first, len(order)), form[order], place[order])


def _forms(tokens: Tokens, n_items: int, key) -> tuple[list[list[int]], Tokens, np.ndarray]:
    """Items with the same ``key`` (of where an item's tokens begin and end) as one form, and the forms' tokens."""
    begin = np.searchsorted(tokens.text, np.arange(n_items + 1))
    members: dict[bytes, list[int]] = {}
    for item in range(n_items):
        if begin[item + 1] > begin[item]:
            members.setdefault(key(int(begin[item]), int(begin[item + 1])), []).append(item)
    items = list(members.values())
    sizes = np.array([begin[i[0] + 1] - begin[i[0]] for i in items], np.int64)
    at = np.concatenate([np.arange(begin[i[0]], begin[i[0] + 1]) for i in items]) if items else np.zeros(0, np.int64)
    return items, Tokens(np.repeat(np.arange(len(items)), sizes), tokens.literal[at], tokens.typed[at], tokens.slot[at]), np.append(0, np.cumsum(sizes))


def _anchors(windows: _Windows, n_needed: np.ndarray) -> _Index:
    """Of each form as many windows as ``n_needed``, those that come least often among all forms."""
    form = np.repeat(np.arange(len(windows.begin) - 1), np.diff(windows.begin))
    _, which, times = np.unique(windows.hashed, return_inverse=True, return_counts=True)
    order = np.lexsort([times[which], form])
    rank = np.arange(len(order)) - windows.begin[form[order]]
    at = order[rank < n_needed[form[order]]]
    return _index(windows.hashed[at], form[at], windows.place[at])


def _copies(tokens: Tokens, n_items: int, width: int, coverage: float) -> Copies:
    items, tokens, begin = _forms(tokens, n_items, lambda a, b: tokens.literal[a:b].tobytes())
    hashed, valid = _windows(tokens, False, width, 0)
    form, hashed = np.unique(np.stack([tokens.text[: len(hashed)][valid].astype(np.uint64), hashed[valid]]), axis=1)
    form = form.astype(np.int64)
    windows = _Windows(np.searchsorted(form, np.arange(len(items) + 1)), hashed, np.zeros(len(form), np.int64))
    n = np.diff(windows.begin)
    short = {}
    for size in range(1, width):
        if len(own := np.flatnonzero(np.diff(begin) == size)):
            short[size] = _index(vector.window_hash(tokens.literal, size)[begin[own]], own, np.zeros(len(own), np.int64))
    return Copies(items, windows, _anchors(windows, n - np.ceil(coverage * n - 1e-9).astype(np.int64) + 1), short)


def _templates(tokens: Tokens, n_items: int, width: int, coverage: float, least_literal: int) -> Templates:
    def key(a: int, b: int) -> bytes:
        slots = tokens.literal[a:b][tokens.slot[a:b]]
        _, first, which = np.unique(slots, return_index=True, return_inverse=True)  # which fillings are the same
        return tokens.typed[a:b].tobytes() + first[which].tobytes()

    items, tokens, begin = _forms(tokens, n_items, key)
    hashed, valid = _windows(tokens, True, width, least_literal)
    at = np.flatnonzero(valid)
    windows = _Windows(np.searchsorted(tokens.text[at], np.arange(len(items) + 1)), hashed[at], at - begin[tokens.text[at]])
    n_windows = np.maximum(np.diff(begin) - width + 1, 0)
    spare = np.floor((1 - coverage) * n_windows + 1e-9).astype(np.int64)
    words = _counts(~tokens.slot)
    best = []
    for form in np.flatnonzero(np.diff(windows.begin) == 0):
        a, b = begin[form], begin[form + 1]
        if b - a >= width and LEAST_WHOLE <= words[b] - words[a] < b - a:
            best.append(a + int(np.argmax(words[a + width : b + 1] - words[a : b - width + 1])))
    best = np.array(best, np.int64)
    whole = _index(hashed[best], tokens.text[best], best - begin[tokens.text[best]])
    return Templates(items, tokens, begin, windows, spare, _anchors(windows, spare + 1), whole)


def build_block(ids: list, texts: list[str | None], width: int = WIDTH, coverage: float = COVERAGE, least_literal: int = LEAST_LITERAL) -> Block:
    """The index of some benchmark items.  An item of fewer tokens than a window is a window of its own length."""
    forms = tokenize(pa.array(texts, pa.string()))
    templates = tuple(_templates(t, len(ids), width, coverage, least_literal) for t in forms.templates)
    return Block(ids, _copies(forms.plain, len(ids), width, coverage), templates)


def _unfold(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of stretches that begin at ``first``: which stretch, and the row; about ``AT_ONCE`` rows at once, or one stretch."""
    upto = np.append(0, np.cumsum(sizes))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + AT_ONCE, side="right")) - 1)
        which = np.repeat(np.arange(a, b), sizes[a:b])
        yield which, first[which] + np.arange(len(which)) - (upto[which] - upto[a])
        a = b


def _hits(index: _Index, hashed: np.ndarray, valid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of windows that are in the index, and the rows of their places there, some at once."""
    at = np.flatnonzero(valid)
    key = vector.find(index.keys, hashed[at])
    at, key = at[key >= 0], key[key >= 0]
    for which, rows in _unfold(index.first[key], np.diff(index.first)[key]):
        yield at[which], rows


def _candidates(index: _Index, text: np.ndarray, hashed: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text and a form of which it holds a window of the index."""
    seen = np.zeros(0, np.int64)
    for at, rows in _hits(index, hashed, valid):
        seen = np.union1d(seen, text[at].astype(np.int64) << 32 | index.form[rows])
    return seen >> 32, seen & 0xFFFFFFFF


def _held_windows(windows: _Windows, texts: np.ndarray, forms: np.ndarray, text: np.ndarray, hashed: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """How many of a form's windows are anywhere in a text, for each pair of a text and a form."""
    n = np.zeros(len(texts), np.int64)
    if not len(texts):
        return n
    asked = np.zeros(int(texts.max()) + 1, bool)
    asked[texts] = True
    at = np.flatnonzero(valid)
    of = text[at]
    at = at[(of < len(asked)) & asked[np.minimum(of, len(asked) - 1)]]
    known = np.sort(vector.mix(hashed[at] + vector.mix(text[at].astype(np.uint64) + np.uint64(1))))
    salts = vector.mix(texts.astype(np.uint64) + np.uint64(1))
    for which, rows in _unfold(windows.begin[forms], np.diff(windows.begin)[forms]):
        held = vector.find(known, vector.mix(windows.hashed[rows] + salts[which])) >= 0
        n += np.bincount(which[held], minlength=len(texts))
    return n


def _consistent(own: Tokens, tokens: Tokens, here: np.ndarray, there: np.ndarray) -> bool:
    """Whether each filling of the item's slots, at these places, is exchanged for one other, and two never for the same.

    Where the shift changes, a place that meets several is the filling with another number of tokens, and not compared.
    """
    here, there = np.unique(np.stack([here, there]), axis=1)
    single = np.ones(len(here), bool)
    for places in (here, there):
        _, of, times = np.unique(places, return_inverse=True, return_counts=True)
        single &= times[of] == 1
    slots = own.slot[here] & single
    pairs = np.unique(np.stack([own.literal[here[slots]], tokens.literal[there[slots]]]), axis=1)
    return len(np.unique(pairs[0])) == pairs.shape[1] == len(np.unique(pairs[1]))


def _held(template: Templates, tokens: Tokens, text: int, form: int, shifts: np.ndarray, width: int, least: float) -> float:
    """The share of a form's windows that a text holds at some of these shifts, 0 if below ``least`` or not consistent.

    Windows without a slot count as well: they must be there as they stand.  A window found at several
    shifts counts at the first.
    """
    a, b = int(template.begin[form]), int(template.begin[form + 1])
    n = b - a - width + 1
    shift_of = np.zeros(n, np.int64)
    covered = np.zeros(n, bool)
    for shift in shifts.tolist():
        low, high = max(0, -shift), min(b - a, len(tokens.typed) - shift)
        if high - low < width:
            continue
        same = np.zeros(b - a, bool)
        same[low:high] = (template.tokens.typed[a + low : a + high] == tokens.typed[low + shift : high + shift]) & (tokens.text[low + shift : high + shift] == text)
        sums = _counts(same)
        new = (sums[width:] - sums[:-width] == width) & ~covered
        if not new.any():
            continue
        covered |= new
        shift_of[new] = shift
    share = float(covered.mean())
    if share < least:
        return 0.0
    places = np.flatnonzero(covered)
    here = (places[:, None] + np.arange(width)).reshape(-1)
    return share if _consistent(template.tokens, tokens, a + here, here + np.repeat(shift_of[places], width)) else 0.0


def _alignments(shift: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Hits of one form in one text whose shifts lie close together: the shifts, and how many places were hit."""
    order = np.argsort(shift, kind="stable")
    shift, place = shift[order], place[order]
    cut = np.flatnonzero(np.append(True, shift[1:] - shift[:-1] > DRIFT))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(shift)).tolist(), strict=True):
        yield np.unique(shift[a:b]), len(np.unique(place[a:b]))


def _found_templates(template: Templates, tokens: Tokens, width: int, coverage: float, least_literal: int) -> Iterator[tuple[int, int, float]]:
    """(text, form, coverage) of the templates that some texts hold."""
    hashed, valid = _windows(tokens, True, width, least_literal)
    texts, forms = _candidates(template.anchors, tokens.text, hashed, valid)
    n, spare = np.diff(template.windows.begin)[forms], template.spare[forms]
    # No more windows than ``spare`` may be missing, whichever they are.
    likely = n - _held_windows(template.windows, texts, forms, tokens.text, hashed, valid) <= spare
    of = None
    for text, form in zip(texts[likely].tolist(), forms[likely].tolist(), strict=True):
        if text != of:
            of, begin = text, int(np.searchsorted(tokens.text, text))
            own = begin + np.flatnonzero(valid[begin : int(np.searchsorted(tokens.text, text + 1))])
            own = own[np.argsort(hashed[own], kind="stable")]
            sorted_ = hashed[own]
        a, b = template.windows.begin[form], template.windows.begin[form + 1]
        first, last = (np.searchsorted(sorted_, template.windows.hashed[a:b], side=side) for side in ("left", "right"))
        for_ = np.repeat(np.arange(b - a), last - first)
        place = template.windows.place[a:b][for_]
        at = own[first[for_] + np.arange(len(for_)) - (np.cumsum(last - first) - (last - first))[for_]]
        # Shifts are between a token's place among all tokens of the slice and in its form.
        for shifts, n_hit in _alignments(at - place, place):
            if b - a - n_hit <= template.spare[form]:
                if share := _held(template, tokens, text, form, shifts, width, coverage):
                    yield text, form, share
                    break
    if len(template.whole.keys):
        inside = tokens.text[: len(hashed)] == tokens.text[width - 1 : width - 1 + len(hashed)]
        done = set()
        for at, rows in _hits(template.whole, hashed, inside):
            for text, form, shift in zip(tokens.text[at].tolist(), template.whole.form[rows].tolist(), (at - template.whole.place[rows]).tolist(), strict=True):
                if (text, form) not in done and _held(template, tokens, text, form, np.array([shift]), width, 1.0):
                    done.add((text, form))
                    yield text, form, 1.0


def find_leaks(block: Block, column: pa.Array, width: int = WIDTH, coverage: float = COVERAGE, least_literal: int = LEAST_LITERAL) -> list[tuple[int, int, float, str]]:
    """(text, item, coverage, kind) of the items that the texts hold."""
    forms = tokenize(column)
    tokens, copies = forms.plain, block.copies
    found: dict[tuple[int, int], tuple[float, str]] = {}
    hashed, valid = _windows(tokens, False, width, 0)
    texts, of = _candidates(copies.anchors, tokens.text, hashed, valid)
    share = _held_windows(copies.windows, texts, of, tokens.text, hashed, valid) / np.diff(copies.windows.begin)[of]
    for k in np.flatnonzero(share >= coverage).tolist():
        found |= {(int(texts[k]), item): (float(share[k]), "copy") for item in copies.items[of[k]]}
    for size, index in copies.short.items():
        for at, rows in _hits(index, *_windows(tokens, False, size, 0)):
            for text, form in zip(tokens.text[at].tolist(), index.form[rows].tolist(), strict=True):
                found |= {(text, item): (1.0, "copy") for item in copies.items[form]}
    for template, tokens in zip(block.templates, forms.templates, strict=True):
        for text, form, held in _found_templates(template, tokens, width, coverage, least_literal):
            for item in template.items[form]:
                found.setdefault((text, item), (held, "template"))
    return [(t, i, c, kind) for (t, i), (c, kind) in sorted(found.items())]


def _scan(blocks, width: int, coverage: float, least_literal: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks.value
        for whole in batches:
            for batch in vector.slices(whole, "text"):
                leaks = find_leaks(block, batch.column("text"), width, coverage, least_literal)
                rows = pa.array([t for t, *_ in leaks], pa.int64())
                items = pa.array([block.ids[i] for _, i, *_ in leaks], pa.int64())
                shares, kinds = pa.array([c for *_, c, _ in leaks], pa.float64()), pa.array([k for *_, k in leaks], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), items, shares, kinds], names=["doc_id", "item_id", "coverage", "kind"])

    return scan


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, least_literal: int = LEAST_LITERAL, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, coverage, kind.

    ``copy``: at least ``coverage`` of the item's distinct windows of ``width`` tokens are in the
    document, whatever the case, spacing and punctuation.  ``template``: the item's windows are there
    in one place with numbers, units or names exchanged, each for one other throughout; a filling may have another
    number of tokens.  An item without a window of ``least_literal`` words and a placeholder is held as a whole template
    or not at all, if it has ``LEAST_WHOLE`` words.

    Items with fewer than ``width`` tokens are found as whole copies only.  Null and empty texts are never
    found.  Repeated items and documents give repeated pairs.  A null doc_id stays null.
    An empty table gives no pairs.  Other columns are ignored.

    The join is by hash against blocks of the benchmark of bounded size, each broadcast once it
    is known to be within ``block_tokens``; documents are never shuffled.  An item longer than the
    bound is a block of its own.  Items that differ in their fillings alone are looked for once, so the memory of a task
    does not grow with them.  With several blocks the pairs of each are written out before the next is broadcast.
    """
    spark, found = docs.sparkSession, None
    parts, several = _parts(benchmark, block_tokens)
    for part in parts:
        shared = _shared(spark, part, width, coverage, least_literal)
        pairs = docs.select("doc_id", "text").mapInArrow(_scan(shared, width, coverage, least_literal), PAIRS)
        if several:
            pairs = materialize(pairs, "leaks")
            shared.destroy()
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], PAIRS)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, least_literal: int = LEAST_LITERAL, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, by the rules of ``benchmark_leaks``; all columns stay.

    With several blocks of the benchmark what each leaves is written out.
    """
    parts, several = _parts(benchmark, block_tokens)
    for part in parts:
        shared = _shared(docs.sparkSession, part, width, coverage, least_literal)

        def clean(column: pa.Array, shared=shared) -> np.ndarray:
            kept = np.ones(len(column), bool)
            kept[[t for t, *_ in find_leaks(shared.value, column, width, coverage, least_literal)]] = False
            return kept

        docs = vector.filter_texts(docs, "text", clean)
        if several:
            docs = materialize(docs, "clean")
            shared.destroy()
    return docs


def _parts(benchmark: DataFrame, block_tokens: int) -> tuple[Iterator[list], bool]:
    """The benchmark's rows in parts of bounded size, and whether there may be several.

    Items are dealt by hash to as many blocks as their tokens ask for; a block that comes out above the bound is
    taken in parts.
    """
    n = F.size(F.split(F.coalesce("text", F.lit("")), r"[\W_]+")).cast("bigint")
    items = materialize(benchmark.select("item_id", "text", n.alias("n")), "items")
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * total // block_tokens)) if total > block_tokens else 1

    def parts() -> Iterator[list]:
        for k in range(n_blocks):
            of_block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
            part: list = []
            size = 0
            for row in of_block.toLocalIterator():
                if part and size + row.n > block_tokens:
                    yield part
                    part, size = [], 0
                part.append(row)
                size += row.n
            if part:
                yield part

    return parts(), n_blocks > 1


def _shared(spark: SparkSession, part: list, width: int, coverage: float, least_literal: int) -> Broadcast:
    return spark.sparkContext.broadcast(build_block([r.item_id for r in part], [r.text for r in part], width, coverage, least_literal))
