"""Secret scans: fixed patterns, and assignments of source and configuration files read with their names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm import vector

# The base patterns.  Matches that are too short are dropped after matching.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones are dropped either way
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

KINDS = ("assign", "access", "hex", "literal")

# Parts of names that say a value is secret, and how surely.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "signature": 0.5, "cookie": 0.5, "salt": 0.6,
}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 0.9, ("auth", "key"): 0.9, ("account", "key"): 0.8, ("pass", "phrase"): 1.0}
# Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "password", "passwd", "secret", "token", "example", "undefined", "placeholder", "redacted", "xxxxxxxx", "todo", "none", "null", "true", "false", "required", "optional"}
#: A literal is reported if its name's weight times its own score reaches this.
LEAST_SCORE = 0.5
LEAST_LITERAL = 8
#: A joined value of more parts or characters, or with more values in all, is scored part by part only.
MOST_PARTS, MOST_CHARS, MOST_VALUES = 64, 4096, 64
#: Strings are looked into for assignments, and YAML blocks nest, so deep.
MOST_DEPTH = 3


class Span(NamedTuple):
    """A finding; places are code points, the end exclusive."""

    kind: str
    start: int
    end: int
    name: str
    score: float


# --- the lexer -----------------------------------------------------------------------------

# What the lexer stops at: quotes, comments, elements and operators; all else is skipped in one step.
_EVENT = re.compile(r"""["'`]|#|//|/\*|<!--|--(?=\s)|<[A-Za-z_][\w.:-]*>|:=|=>|=+|:(?![:/=])""", re.ASCII)
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*")
# A bare word: padding may end it, but neither a sign before a further value nor the next pair of a query does.
_BARE = re.compile(r"""(?:\$\{[^{}\s"'`]*\}|={1,2}(?![A-Za-z0-9_"'`$=>])|&(?![A-Za-z_][A-Za-z0-9_.-]*=)|[A-Za-z0-9+/_.$@%!~^*-])+""")
_STRINGS = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*){q}") for q in "\"'`"}
_PREFIX = re.compile(r"(?<![A-Za-z0-9_])[fbruFBRU]{1,2}$")
_ELEMENT = re.compile(r"([^<>\n]+)</")
_STRING_START = re.compile(r"""[fbruFBRU]{0,2}(?=["'`])""")
_MAY_BEGIN, _MAY_JOIN = frozenset("\"'`fbruFBRU"), frozenset(" \t+.")
_HOLDS_PAIRS = re.compile("[=:<]").search
_BLOCK = re.compile(r"[ \t]*[|>][0-9+-]{0,2}[ \t]*\r?\n")  # a YAML value on the next lines
_LINE = re.compile(r"([ \t]*)([^\r\n]*)\r?\n?")
_REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_.]*)\}|([A-Za-z_][A-Za-z0-9_]*))")
_PLUS = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`A-Za-z_$])")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Term(NamedTuple):
    """A part of a value: a literal's place, or the name of a constant (``quoted`` false)."""

    text: str
    start: int
    end: int
    quoted: bool


class Pair(NamedTuple):
    """A name and the terms of a value assigned to it; ``code`` is false in comments and inside of strings."""

    name: str
    terms: list[Term]
    code: bool


class _Lexer:
    """One pass over a text from left to right.

    What has no end (a quote on its line, a comment, a triple quote) is looked for once and then known to be missing, so
    that the pass is linear whatever the text.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.missing: dict[str, int] = {}  # of each closing sign: from where on it is known to be missing
        self.pairs: list[Pair] = []

    def _find(self, sign: str, at: int, limit: int) -> int:
        """Where ``sign`` is next, or -1."""
        if at >= self.missing.get(sign, len(self.text) + 1):
            return -1
        found = self.text.find(sign, at)
        if found < 0:
            self.missing[sign] = at
        return found if found + len(sign) <= limit else -1

    def _string(self, at: int, limit: int) -> tuple[int, int, int] | None:
        """The string whose first quote is at ``at``: where its content begins and ends, and where the string ends."""
        text, quote = self.text, self.text[at]
        if quote != "`" and text.startswith(quote * 3, at):
            close = self._find(quote * 3, at + 3, limit)
            return (at + 3, close, close + 3) if close >= 0 else None
        if at < self.missing.get(quote, 0):
            return None
        found = _STRINGS[quote].match(text, at, limit)
        if not found:  # no more of these quotes on this line
            end = text.find("\n", at, limit)
            self.missing[quote] = end if end >= 0 else limit
            return None
        return found.start(1), found.end(1), found.end()

    def _value(self, place: int, limit: int) -> tuple[list[Term], int, list[tuple[int, int]]]:
        """Terms joined by ``+`` or ``.`` from ``place`` on, where they end, and the insides of the strings among them."""
        text, terms, inside = self.text, [], []
        while True:
            at = place
            while at < limit and text[at] in " \t":
                at += 1
            first = text[at : at + 1]
            start = _STRING_START.match(text, at, limit) if first in _MAY_BEGIN else None
            string = self._string(start.end(), limit) if start else None
            if string:
                begin, end, done = string
                value = text[begin:end]
                if done - end == 3:
                    begin += len(value) - len(value.lstrip())
                    value = value.strip()
                terms.append(Term(value, begin, begin + len(value), True))
                if _HOLDS_PAIRS(value):
                    inside.append((begin, begin + len(value)))
            else:
                bare = _BARE.match(text, at, limit)
                if not bare:
                    return terms, place, inside
                done = bare.end()
                terms.append(Term(bare.group(), at, done, False))
            more = _PLUS.match(text, done, limit) if text[done : done + 1] in _MAY_JOIN else None
            if not more:
                return terms, done, inside
            place = more.end()

    def _name(self, at: int, least: int) -> tuple[str, int] | None:
        """The name before an operator at ``at``, perhaps quoted or in brackets, and where it begins."""
        text = self.text
        while at > least and text[at - 1] in " \t":
            at -= 1
        if at > least and text[at - 1] in "\"'`]":
            at -= 1
            if at > least and text[at - 1] in "\"'`":  # config["name"] =
                at -= 1
        end = at
        while at > least and text[at - 1] in _NAME_CHARS:
            at -= 1
        found = _IDENTIFIER.search(text, at, end)
        return (found.group(), at) if found else None

    def scan(self, place: int, limit: int, depth: int = 0) -> None:
        """Gather the pairs between two places."""
        text, least, comment, blocks = self.text, place, place, []
        while event := _EVENT.search(text, place, limit):
            at, sign = event.span()[0], event.group()
            place = event.end()
            before = text[at - 1] if at > least else "\n"
            if sign in "\"'`":
                word = before.isalnum() or before == "_"
                if sign == "'" and word and not _PREFIX.search(text, max(least, at - 3), at):
                    continue  # an apostrophe
                if string := self._string(at, limit):
                    if depth < MOST_DEPTH and _HOLDS_PAIRS(text, string[0], string[1]):
                        self.scan(string[0], string[1], depth + 1)
                    place = string[2]
                continue
            if sign in ("#", "//", "--") or sign in ("/*", "<!--"):
                if sign in ("/*", "<!--"):
                    close = self._find("*/" if sign == "/*" else "-->", place, limit)
                    comment = max(comment, close)
                elif before in " \t\r\n;{}()" or sign == "//" and before != ":":
                    close = self._find("\n", place, limit)
                    comment = max(comment, close if close >= 0 else limit)
                continue
            code = depth == 0 and at >= comment
            if sign[0] == "<":
                if element := _ELEMENT.match(text, place, limit):
                    value = element.group(1).strip()
                    begin = text.index(value, place) if value else place
                    self.pairs.append(Pair(sign[1:-1], [Term(value, begin, begin + len(value), True)], code))
                continue
            if sign[0] == "=" and (len(sign) > 1 and sign != "=>" or before in "!<>*/"):
                continue  # a comparison
            named = self._name(at - (before == "+"), least)
            if not named:
                continue
            while blocks and blocks[-1] <= at:
                blocks.pop()
            block = _BLOCK.match(text, place, limit) if sign == ":" and len(blocks) < MOST_DEPTH else None
            if block:
                terms, end = self._block(named[1], block.end(), limit)
                blocks.append(end)
                place = block.end()
            else:
                terms, place, inside = self._value(place, limit)
                if depth < MOST_DEPTH:
                    for begin, end in inside:
                        self.scan(begin, end, depth + 1)
            if terms:
                self.pairs.append(Pair(named[0], terms, code))

    def _block(self, at: int, place: int, limit: int) -> tuple[list[Term], int]:
        """The lines from ``place`` on that are indented more than the line of ``at``, and where they end."""
        text = self.text
        begin = text.rfind("\n", 0, at) + 1
        own = _LINE.match(text, begin).end(1) - begin
        terms = []
        while place < limit:
            line = _LINE.match(text, place, limit)
            if line.group(2):
                if line.end(1) - line.start() <= own:
                    break
                value = line.group(2).rstrip()
                terms.append(Term(value, line.start(2), line.start(2) + len(value), True))
            place = line.end()
        return terms, place


def pairs(text: str) -> list[Pair]:
    """Names and the values assigned to them, by one pass over source or configuration syntax.

    A name is an identifier, perhaps quoted, before ``=``, ``+=``, ``:``, ``:=`` or ``=>``, or an element's; a value is a
    quoted literal or a bare word, or several joined by ``+`` or ``.``, a triple-quoted text, or the indented
    lines of a YAML block, which are the parts of one value.  Of ``a=b&c=d`` and ``a=b=c`` each sign is a pair.  Quotes end
    on their line, and an apostrophe in a word is none; strings are looked into for pairs of their own.
    """
    lexer = _Lexer(text)
    lexer.scan(0, len(text))
    return lexer.pairs


@lru_cache(maxsize=1 << 16)
def name_weight(name: str) -> float:
    """How surely a name's value is secret, from its parts in snake, kebab, dotted or camel case."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    single = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max(single, max((SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False)), default=0.0))


def is_phrase(name: str) -> bool:
    """Whether a name's value may be many words."""
    return "passphrase" in "".join(w.lower() for w in _CAMEL.findall(name))


def literal_score(value: str, phrase: bool = False) -> float:
    """How much a literal looks like a secret: its entropy a character and its mix of characters; 0 for placeholders.

    Letters with digits count as a full mix, so that such a literal reaches every sensitive name.  Values of more than a
    few words score 0 unless they are a ``phrase``.
    """
    if len(value) < LEAST_LITERAL or value.lower() in PLACEHOLDERS or value.startswith(("${", "$(", "<", "{{", "%(")):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    digit, low, up = any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)
    kinds = digit + low + up + any(not c.isalnum() and not c.isspace() for c in value)
    if digit and (low or up):
        kinds = max(kinds, 3)
    if entropy < 2.0 or value.count(" ") > 3 and not phrase:
        return 0.0
    return min(1.0, 0.4 * min(entropy / 3.0, 1.0) + 0.2 * kinds)


class _Constants:
    """What names stand for: all values assigned to them anywhere in a text; scopes are not told apart."""

    def __init__(self, found: list[Pair]) -> None:
        self.values: dict[str, list[list[Term]]] = {}
        for name, terms, code in found:
            if code:
                self.values.setdefault(name, []).append(terms)
        self._joined: dict[str, list[list[Term]]] = {}

    def parts(self, terms: list[Term]) -> list[tuple[Term, str | None]]:
        """Terms as literal pieces and constants: each piece, and the constant's name (None for a literal)."""
        found: list[tuple[Term, str | None]] = []
        for term in terms:
            if not term.quoted and term.text in self.values:
                found.append((term, term.text))
                continue
            done, begin = 0, len(found)
            for m in _REFERENCE.finditer(term.text) if "$" in term.text else ():
                name = m.group(1) or m.group(2)
                name = name if name in self.values else "$" + name
                if name not in self.values:
                    continue
                if m.start() > done:
                    found.append((Term(term.text[done : m.start()], term.start + done, term.start + m.start(), term.quoted), None))
                found.append((Term(m.group(), term.start + m.start(), term.start + m.end(), False), name))
                done = m.end()
            if len(found) == begin or done < len(term.text):
                found.append((Term(term.text[done:], term.start + done, term.end, term.quoted), None))
        return found

    def joined(self, terms: list[Term]) -> list[list[Term]]:
        """The literals that the terms are in a row, for each choice of the constants' values; none if a part is not known.

        What a constant stands for is found once; one that stands for itself is not known.
        """
        waiting = [name for _, name in self.parts(terms) if name is not None]
        opened = set()
        while waiting:
            one = waiting[-1]
            if one in self._joined:
                waiting.pop()
                continue
            needed = [] if one in opened else [n for assigned in self.values[one] for _, n in self.parts(assigned) if n is not None and n not in self._joined and n not in opened]
            opened.add(one)
            if needed:
                waiting += needed
                continue
            self._joined[one] = [c for assigned in self.values[one] for c in self._choices(assigned)][:MOST_VALUES]
            waiting.pop()
        return self._choices(terms)

    def _choices(self, terms: list[Term]) -> list[list[Term]]:
        parts = self.parts(terms)
        if len(parts) == 1 and parts[0][1] is not None:
            return self._joined.get(parts[0][1], [])
        choices: list[list[Term]] = [[]]
        for part, name in parts:
            if name is not None:
                own = self._joined.get(name, [])
            elif not part.quoted and (len(terms) > 1 or "${" in part.text):
                own = []
            else:
                own = [[part]]
            choices = [a + b for a in choices for b in own] if len(choices) * len(own) <= MOST_VALUES else []
            if not choices or max(map(len, choices)) > MOST_PARTS or max(sum(t.end - t.start for t in c) for c in choices) > MOST_CHARS:
                return []
        return choices


# A name whose value may be secret has one of these in it.
_SIGNS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "cookie", "salt")


def sensitive_literals(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants.

    A bare word that is itself the name of an assigned value, and ``$name`` or ``${name}``, stand for that value's
    literals, through any number of steps; a name assigned more than once stands for all its values.  The
    literals of a joined value are reported by the score of the whole, or by their own if that is higher.  What is assigned in
    a comment or inside of a string is reported, but nothing else stands for it.

    Names are taken by falling weight, so a constant is looked at once, for the surest name that reaches it
    (once more for names of phrases); of names as sure, for the first in the text.
    """
    low = text.lower()
    if not any(sign in low for sign in _SIGNS):
        return []
    found = pairs(text)
    roots = sorted((pair for pair in found if name_weight(pair.name)), key=lambda p: -name_weight(p.name))
    if not roots:
        return []
    constants = _Constants(found)
    best: dict[tuple[int, int], Span] = {}

    def report(terms: list[Term], name: str, score: float) -> None:
        for term in terms:
            place = term.start, term.end
            if score >= LEAST_SCORE and term.start < term.end and (place not in best or score > best[place].score):
                best[place] = Span("literal", *place, name, score)

    for phrase in (False, True):
        seen: set[str] = set()
        for root in roots:
            if is_phrase(root.name) != phrase:
                continue
            weight, waiting = name_weight(root.name), [root.terms]
            while waiting:
                terms = waiting.pop()
                parts = constants.parts(terms)
                for part, constant in parts:
                    if constant is None:
                        if part.quoted or "${" not in part.text:
                            report([part], root.name, weight * literal_score(part.text, phrase))
                    elif constant not in seen:
                        seen.add(constant)
                        waiting += constants.values[constant]
                if len(parts) > 1:
                    for literals in constants.joined(terms):
                        report(literals, root.name, weight * literal_score("".join(t.text for t in literals), phrase))
    return [s._replace(score=round(s.score, 3)) for s in best.values()]


def find_secrets(text: str | None, may_have_hex: bool = True) -> list[Span]:
    """All findings in a text, by start and then kind; overlapping kinds are all reported."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text or "</" in text:
        found += [Span("assign", *m.span(), m.group(1), 1.0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
        found += sensitive_literals(text)
    if "AKIA" in text:
        found += [Span("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if may_have_hex:
        found += [Span("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in vector.slices(whole, "text"):
            column = batch.column("text")
            data, offsets = vector.utf8(column)
            start, end = vector.runs(_IS_HEX[data], offsets)
            long = set(vector.owner(start[end - start >= LEAST_HEX], offsets).tolist())
            spans = [[s._asdict() for s in find_secrets(t, k in long)] for k, t in enumerate(column.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, name, score) of every row of ``docs`` (doc_id, text).

    ``assign``, ``access`` and ``hex`` are the base patterns, leftmost and without overlap in each kind; ``literal`` are
    literals that reach a sensitive name.  Places are code points of the whole text.

    Null and empty texts have no spans.  Repeated rows are scanned alike; an empty table gives an empty
    table; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>")
