"""Plain Python forms of the operators: dictionaries, sets and loops over every pair, for tests to compare with."""

import math
import re
from collections import Counter, defaultdict

from brindle.llm import decontam

LETTER = "A-Za-zÀ-῿⁀-\U0010ffff"
CAPITALS = "A-ZÀ-ÖØ-Þ"


def lowered(text):
    return re.sub(f"[{CAPITALS}]", lambda m: chr(ord(m[0]) + 32), text)


# --- decontamination ------------------------------------------------------------------------------


def spans(text):
    return [m.span() for m in re.finditer(f"(?:[{LETTER}0-9]|(?<=[0-9])[.,](?=[0-9]))+", text)]


def reading(text, names_begin):
    """(literal, placeholder or None) of each token, capitals that begin sentences being names or not."""
    cut = []
    for a, b in spans(text):
        whole = re.fullmatch(f"([0-9]|[0-9][0-9.,]*[0-9])([{LETTER}]+)", text[a:b])
        cut += [(a, a + whole.end(1)), (a + whole.end(1), b)] if whole else [(a, b)]
    out, after, number, named = [], None, False, False
    for a, b in cut:
        token, between = text[a:b], text[after:a] if after is not None else None
        begins = between is None or bool(re.search("[.!?:;\n]", between))
        unit = number and lowered(token) in decontam.UNITS
        number = bool(re.match("[0-9]", token[0]) and re.match("[0-9]", token[-1]))
        name = bool(re.match(f"[{CAPITALS}]", token)) and len(re.findall(f"[{CAPITALS}]", token)) == 1 and len(token) > 1 and not number and not unit and (names_begin or not begins)
        if name and named and not begins and not between.strip(" -"):
            first = out[-1][2]
            out[-1] = (lowered(text[first:b]), "name", first)
        else:
            out.append((lowered(token), "number" if number else "unit" if unit else "name" if name else None, a))
        after, named = b, name
    return [(literal, slot) for literal, slot, _ in out]


def held_template(item, doc, width=5, coverage=0.8, least=3):
    """The share of an item's windows that a document holds with fillings exchanged, or 0."""
    typed = lambda t: [slot or literal for literal, slot in t]
    kinds = [(slot is not None, slot or literal) for literal, slot in item], [(slot is not None, slot or literal) for literal, slot in doc]
    n = len(item) - width + 1
    if n < 1:
        return 0.0
    assert typed(item)
    windows = defaultdict(list)
    for p in range(len(doc) - width + 1):
        windows[tuple(kinds[1][p : p + width])].append(p)
    good = [p for p in range(n) if width >= sum(s is not None for _, s in item[p : p + width]) + least and any(s is not None for _, s in item[p : p + width])]
    least_share, tries = coverage, []
    if good:
        hits = sorted((at - p, p) for p in good for at in windows[tuple(kinds[0][p : p + width])])
        group = []
        for h in hits:
            if group and h[0] - group[-1][0] > decontam.DRIFT:
                tries.append(group)
                group = []
            group.append(h)
        tries += [group] if group else []
        tries = [sorted({s for s, _ in g}) for g in tries if len(good) - len({p for _, p in g}) <= (1 - coverage) * n + 1e-9]
    elif decontam.LEAST_WHOLE <= sum(s is None for _, s in item) < len(item):
        least_share = 1.0
        most = max(range(n), key=lambda p: (sum(s is None for _, s in item[p : p + width]), -p))
        tries = [[at - most] for at in windows[tuple(kinds[0][most : most + width])]]
    for shifts in tries:
        shift_of = {}
        for s in shifts:
            for p in range(n):
                if p not in shift_of and 0 <= p + s and p + s + width <= len(doc) and kinds[0][p : p + width] == kinds[1][p + s : p + s + width]:
                    shift_of[p] = s
        if not shift_of or len(shift_of) / n < least_share:
            continue
        places = {(p + k, p + k + s) for p, s in shift_of.items() for k in range(width)}
        here, there = Counter(a for a, _ in places), Counter(b for _, b in places)
        pairs = {(item[a][0], doc[b][0]) for a, b in places if item[a][1] and here[a] == there[b] == 1}
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            return len(shift_of) / n
    return 0.0


def leaks(docs, items, width=5, coverage=0.8):
    """{(doc, item): kind} of all pairs of a text and an item."""
    out = {}
    plain = lambda t: [lowered(t[a:b]) for a, b in spans(t)]
    of_item = {k: (plain(t or ""), [reading(t or "", names) for names in (False, True)]) for k, t in items}
    for d, text in docs:
        words, readings = plain(text or ""), [reading(text or "", names) for names in (False, True)]
        for k, (own, own_readings) in of_item.items():
            w = min(width, len(own))
            windows = {tuple(own[p : p + w]) for p in range(len(own) - w + 1)} if own else set()
            held = windows & {tuple(words[p : p + w]) for p in range(len(words) - w + 1)}
            if windows and len(held) >= (coverage if len(own) >= width else 1) * len(windows) - 1e-9:
                out[d, k] = "copy"
            elif any(held_template(i, t) for i, t in zip(own_readings, readings, strict=True)):
                out[d, k] = "template"
    return out


# --- language ----------------------------------------------------------------------------------------


def runs(text):
    return re.findall(f"[{LETTER}]+", lowered(text or ""))


def grams(word, n):
    return [word[k : k + n] for k in range(len(word) - n + 1)]


class Language:
    """Word-first backoff with dictionaries: every word and n-gram is kept."""

    def __init__(self, labelled, longest=5, alpha=0.5):
        self.longest = longest
        self.counts = [defaultdict(Counter) for _ in range(longest + 1)]
        for text, lang in labelled:
            for w in runs(text):
                self.counts[0][w][lang] += 1
                for n in range(1, longest + 1):
                    for g in grams(w, n):
                        self.counts[n][g][lang] += 1
        self.languages = sorted({lang for _, lang in labelled})
        self.logs = []
        for table in self.counts:
            total = {k: sum(c[k] for c in table.values()) for k in self.languages}
            self.logs.append({key: [math.log((c[k] + alpha) / (total[k] + alpha * (len(table) + 1))) for k in self.languages] for key, c in table.items()})

    def predict(self, text):
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", 0.0
        sums = [0.0] * len(self.languages)
        for w in runs(text):
            found = [self.logs[0][w]] if w in self.logs[0] else []
            for n in range(self.longest, 0, -1):
                found = found or [self.logs[n][g] for g in grams(w, n) if g in self.logs[n]]
            for k in range(len(sums)):
                sums[k] += sum(f[k] for f in found) / len(found) if found else 0.0
        best = max(range(len(sums)), key=lambda k: (sums[k], -k))
        return self.languages[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


# --- toxicity -------------------------------------------------------------------------------------------


def toxic_score(text, weight_of, bias):
    """Noisy-or over sentences of a logistic score of their distinct words and beginnings; ``weight_of`` (kind, bytes)."""
    none = 0.0
    for sentence in re.split("[.!?\n]", lowered(text or "")):
        words = [w.encode() for w in re.findall(f"[{LETTER}0-9]+", sentence)]
        features = {(0, w) for w in words} | {(n, w[:n]) for n in (4, 5, 6, 7, 8) for w in words if len(w) > n}
        known = [weight_of[f] for f in features if f in weight_of]
        if known:
            z = min(30.0, max(-30.0, sum(known) + bias))
            none += math.log1p(-1 / (1 + math.exp(-z)))
        elif sentence:
            none += math.log1p(-1 / (1 + math.exp(-bias)))
    return 1 - math.exp(none)


def feature_weights(model, texts):
    """The learnt weight of each word and beginning of the texts: {(length of the beginning or 0, bytes): weight}."""
    import numpy as np

    from brindle.llm import vector

    out = {}
    for w in {w.encode() for t in texts for w in re.findall(f"[{LETTER}0-9]+", lowered(t or ""))}:
        for n in (0, 4, 5, 6, 7, 8):
            part = w[:n] if n else w
            if n and len(w) <= n:
                continue
            key = vector.Hasher(np.frombuffer(part, np.uint8))(np.array([0]), np.array([len(part)]))[0] ^ np.uint64(n)
            at = int(np.searchsorted(model.keys, key))
            if at < len(model.keys) and model.keys[at] == key:
                out[n, part] = float(model.weights[at])
    return out
