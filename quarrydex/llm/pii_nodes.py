"""Nodes of the random field in one text: what may be personal information, and how to read the labels back.

Spans shaped like an e-mail address, a number or a street address are nodes, and so are
words that may be names. Each node has features; the model's weights of the features add
up to its potentials. Edges join neighbouring name words (chain) and repeated or nearly
equal names, numbers and addresses, however far apart (skip).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import cached_property

from quarrydex.llm import pii_patterns as P
from quarrydex.llm.pii_field import Field

#: Words whose properties a task remembers.
MAX_KNOWN = 200_000
#: Words on either side of a possible name that are looked at; more than any feature or edge needs.
REACH = 12
WORDS = re.compile(r"[^\W\d_]{2,}")
#: Words that aren't part of a code with digits.
FREE_WORDS = re.compile(r"(?<!\d)[^\W\d_]{2,}+(?!\d)")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
PIECE = re.compile(r"[^\W_]+|[^\w\s]")
NEXT = re.compile(r"\s*([^\W_]+|[^\w\s])")
#: The end of a sentence (not of an abbreviation) or of a number.
SENTENCE = re.compile(r"\w{5}[.!?]+\s|\n|\d")
#: Strengths of the edges before anything is learned.
STRENGTHS = {"chain": 2.0, "skip": 2.0, "skip_shape": 4.0}
#: Weights of shapes before anything is learned: larger for those that are sure by themselves.
PRIOR = {
    "email": {"e0": 2.0, "e1": -2.0},
    "phone": {f"p{k}": 2.0 if k in P.SURE_PHONE else 1.0 for k in range(len(P.PHONE))},
    "id_number": {f"i{k}": 2.0 for k in P.SURE_ID},
}
CUES = {"phone": P.PHONE_CUES, "id_number": P.ID_CUES, "address": P.ADDRESS_CUES}


@dataclass
class Model:
    """Weights per label and feature, strengths of edges, the lexicon with what the corpus adds to it, and common words."""

    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {x: dict(w) for x, w in PRIOR.items()})
    strengths: dict[str, float] = field(default_factory=lambda: dict(STRENGTHS))
    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    plain: frozenset[str] = frozenset()
    heads: frozenset[str] = frozenset()
    tails: frozenset[str] = frozenset()

    def __getstate__(self) -> dict:
        """Without what is only remembered."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def known_kinds(self) -> dict[str, str]:
        return {}

    @cached_property
    def known_shapes(self) -> dict[str, str]:
        return {}

    @staticmethod
    def remember(known: dict[str, str], word: str, value: str) -> str:
        """Keeps a word's property, within bounds."""
        if len(known) < MAX_KNOWN and len(word) < 64:
            known[word] = value
        return value

    @cached_property
    def ordinary(self) -> frozenset[str]:
        """Words that are no name unless one stands beside them."""
        words = self.common | P.PARTICLES | P.AHEAD | P.CUES
        return frozenset(w for w in words if not self.kind_of(w))

    def built_like_family(self, low: str) -> bool:
        """Made of a beginning and an ending that several family names have."""
        return any(low[:i] in self.heads and low[i:] in self.tails for i in range(4, len(low) - 1))

    def kind_of(self, low: str) -> str:
        g, f = low in self.given, low in self.family or low not in self.common and self.built_like_family(low)
        return ("b" if g and f else "g" if g else "f" if f else "") + ("p" if low in self.plain and (g or f) else "")

    def score(self, label: str, names: list[str]) -> float:
        get = self.weights.get(label, {}).get
        return sum([get(f, 0.0) for f in names])


# --- spans

_BLANKS = (" ", "\u00a0")


@dataclass
class Span:
    """A place shaped like personal information: possible labels, features from its shape and from around it, and what repeats of it share."""

    start: int
    end: int
    same: str
    labels: tuple[str, ...]
    shape: list[str]
    around: list[str]
    cues: frozenset[str] = frozenset()


def _word(low: str) -> str:
    """A token in a context feature: all numbers are alike, and all single letters."""
    return "0" if low[0].isdigit() else "X" if len(low) == 1 and low.isalpha() else low


def _around(text: str, a: int, b: int) -> tuple[list[str], frozenset[str]]:
    """Features of the words around a span, and what is announced since the last sentence or number ended."""
    before = text[max(0, a - 48) : a].lower()
    left = PIECE.findall(before)[-8:]
    at = max((m.end() for m in SENTENCE.finditer(before)), default=0)
    words = [w for w in (PIECE.findall(before[at:]) if at else left) if w[0].isalpha()][-6:]
    cues = frozenset(kind for kind, own in CUES.items() if not own.isdisjoint(words))
    right = NEXT.match(text, b, b + 24)
    l1, l2 = (_word(x) if x else "^" for x in ((left[-1:] or [""])[0], (left[-2:-1] or [""])[0]))
    return ["l1=" + l1, "l2=" + l2 + " " + l1, "lw=" + (words[-1] if words else "^"), "r1=" + (_word(right[1].lower()) if right else "$"), *("cue=" + c for c in cues)], cues


def streets(text: str) -> Iterator[tuple[int, int, int]]:
    """``(form, start, end)`` of places shaped like a street and a house number."""
    for m in P.DIGITS.finditer(text):
        i, j = m.span()
        if j - i > 4:
            continue
        before, after = text[i - 1 : i], text[j : j + 1]
        if (after in _BLANKS or after == "," or after.isalpha()) and not (before.isalnum() or before and before in "_.,/:-"):
            for form in (0, 1):
                if hit := P.ADDRESS[form].match(text, i):
                    yield form, i, hit.end()
        if before in _BLANKS:
            stop = i
            while stop and text[stop - 1] in _BLANKS:
                stop -= 1
            low = text[max(0, stop - 12) : stop].lower()
            if low.endswith(P.STREET_TAILS) and (number := P.HOUSE_NUMBER.match(text, i)):
                # The name is read backwards from its street word.
                a = at = stop - max(len(t) for t in P.STREET_TAILS if low.endswith(t))
                while a and (text[a - 1].isalpha() or text[a - 1] == "-" and a > 1 and text[a - 2].isalpha()):
                    a -= 1
                if a < at and not (a and (text[a - 1].isalnum() or text[a - 1] in "_-")):
                    yield 3, a, number.end()
    low = text.lower()
    if any(h in low for h in P.STREET_HEADS):
        for m in P.ADDRESS[2].finditer(text):
            yield 2, *m.span()


def mails(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Places of whole mail addresses, also spelled out, and of signs between words that make none."""
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text or P.SPELLED.search(text):
        whole = [m.span() for m in P.EMAIL.finditer(text)]
        return whole, [m.span() for m in P.HANDLE.finditer(mask(text, whole))]
    whole, parts, last = [], [], 0
    for sign in ("@", "＠"):
        i = text.find(sign)
        while i >= 0:
            a = i
            while a > last and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
                a -= 1
            if a < i:
                if m := P.EMAIL.match(text, a):
                    whole.append(m.span())
                elif m := P.HANDLE.match(text, a):
                    parts.append(m.span())
            i = text.find(sign, i + 1)
    return whole, parts


def street_features(words: list[str], model: Model, lower: bool) -> list[str]:
    """How name-like the words of a street are: how many begin with a capital, how many are common words."""
    lows = [w.lower() for w in words]
    titled = sum(w[:1].isupper() for w in words)
    case = "L" if lower else str(min(titled, 2))
    return ["titled=" + case, "usual=" + str(min(sum(w in model.common for w in lows[:-1]), 3))]


def spans_of(text: str, model: Model) -> tuple[list[Span], str]:
    """Spans that don't overlap, and the text without mail addresses and streets."""
    out: list[Span] = []
    whole, parts = mails(text)
    for form, places in ((0, whole), (1, parts)):
        out += [Span(a, b, text[a:b].lower(), ("email",), [f"e{form}", "at=" + str("@" in text[a:b])], *_around(text, a, b)) for a, b in places]
    rest = mask(text, whole) if whole else text
    if not P.DIGITS.search(rest):
        return out, rest
    more: list[Span] = []
    lower = text.islower() or text.isupper()
    for form, a, b in streets(rest):
        if "\x00" in rest[a:b]:
            continue
        words = WORDS.findall(rest[a:b])
        if any(w.lower() in P.FUNCTION for w in words[:-1]):
            continue
        around, cues = _around(rest, a, b)
        more.append(Span(a, b, " ".join(words).lower(), ("address",), ["street", f"a{form}", *street_features(words, model, lower)], around, cues))
    # Some characters more: signs and letters in front, and what the shapes must not be followed by.
    for m in P.ZONE.finditer(rest):
        a0, b0 = max(0, m.start() - 5), m.end() + 3
        if not P.NUMBERS.search(rest, a0, b0):
            continue
        for k, pattern in enumerate(P.PHONE):
            for m in pattern.finditer(rest, a0, b0):
                a, b = m.span()
                while not rest[b - 1].isdigit():
                    b -= 1
                if 8 <= sum(c.isdigit() for c in rest[a:b]) <= 16:
                    around, cues = _around(rest, a, b)
                    more.append(Span(a, b, re.sub(r"\D", "", rest[a:b]), ("phone", "id_number"), [f"p{k}"], around, cues))
        for k, pattern in enumerate(P.ID_SHAPES):
            for m in pattern.finditer(rest, a0, b0):
                around, cues = _around(rest, *m.span())
                bare = m.group().isdigit()
                more.append(Span(*m.span(), re.sub(r"[\W_]", "", m.group()).lower(), ("id_number", "phone") if bare else ("id_number",), [f"i{k}"] + [f"n{len(m.group())}"] * bare, around, cues))
    numbers = _apart(more, len(rest), model)
    return out + numbers, mask(rest, [(s.start, s.end) for s in numbers if s.labels == ("address",)])  # numbers stay as context


def _apart(spans: list[Span], n: int, model: Model) -> list[Span]:
    """Spans that don't overlap: of several the likely ones stay, of these the longest."""
    if len(spans) < 2:
        return spans
    taken, out = bytearray(n), []
    unlikely = {id(s): max(model.score(x, s.shape + s.around) for x in s.labels) < 0 for s in spans}
    for s in sorted(spans, key=lambda s: (unlikely[id(s)], s.start - s.end, s.start)):
        if not any(taken[s.start : s.end]):
            taken[s.start : s.end] = b"\x01" * (s.end - s.start)
            out.append(s)
    return out


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with what was found already blanked out, at unchanged places; spans don't overlap."""
    parts, at = [], 0
    for a, b in sorted(spans):
        parts += [text[at:a], "\x00" * (b - a)]
        at = b
    return "".join(parts) + text[at:] if parts else text


# --- name words


def _shape(w: str) -> str:
    if len(w) == 1:
        return "I" if w.isupper() else "i"
    return "T" if w[0].isupper() and w[1:].islower() else "U" if w.isupper() else "l" if w.islower() else "M"


@dataclass
class Tokens:
    """Tokens ``(text, start, end, gap before)`` of a text with lower case, lexicon kind and shape."""

    toks: list[tuple[str, int, int, str]]
    lows: list[str]
    kinds: list[str]
    shapes: list[str]


def prepare(text: str, model: Model, zones: list[tuple[int, int]] | None = None) -> Tokens:
    """The tokens of the text, or of its ``zones`` only."""
    toks, end = [], 0
    for a0, b0 in [(0, len(text))] if zones is None else zones:
        for m in TOKEN.finditer(text, a0, b0):
            a, b = m.span()
            toks.append((m.group(), a, b, text[end:a]))
            end = b
    lows = [t[0].lower() for t in toks]
    kind, shape = model.known_kinds, model.known_shapes
    kinds = [k if (k := kind.get(w)) is not None else model.remember(kind, w, model.kind_of(w) if w.isalpha() else "") for w in lows]
    shapes = [s if (s := shape.get(t[0])) is not None else model.remember(shape, t[0], _shape(t[0]) if t[0].isalpha() else "") for t in toks]
    return Tokens(toks, lows, kinds, shapes)


def name_zones(text: str, model: Model) -> list[tuple[int, int]]:
    """Parts of the text within REACH words of one that isn't ordinary: most texts hold few such words or none.

    In a text that has capitals, a plain word in small letters is ordinary too, unless another word brings it in.
    """
    low = text.lower()
    known = set(FREE_WORDS.findall(low))
    rare = known - model.ordinary
    if not rare:
        return []
    small = frozenset() if low == text else model.plain
    if rare <= small and not any(w.title() in text or w.upper() in text for w in rare):
        return []
    if len(low) != len(text) or 10 * len(rare) > len(known):
        return [(0, len(text))]
    at = []
    for w in rare:  # also inside longer words, which does no harm
        i = low.find(w)
        while i >= 0:
            if w not in small or text[i].isupper():
                at.append((i, i + len(w)))
            i = low.find(w, i + len(w))
    out: list[tuple[int, int]] = []
    for i, j in sorted(at):
        if out and j <= out[-1][2]:  # its right side is still to be reached
            a = out[-1][0]
        else:
            a = _reach_left(text, i)
        b = _reach_right(text, j)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), j)
        else:
            out.append((a, b, j))
    return [(a, b) for a, b, _ in out]


def _reach_left(text: str, at: int) -> int:
    """Where the REACH-th word left of a place begins."""
    n = 160
    while n < at:
        words = [m.start() for m in WORDS.finditer(text, at - n, at)]
        if len(words) > REACH:
            return words[-REACH]
        n *= 2
    return 0


def _reach_right(text: str, at: int) -> int:
    """Where the REACH-th word right of a place ends."""
    n = 160
    while at + n < len(text):
        words = [m.end() for m in WORDS.finditer(text, at, at + n)]
        if len(words) > REACH:
            return words[REACH - 1]
        n *= 2
    return len(text)


def before_family(t: Tokens) -> set[int]:
    """Where a given name would stand: before a family name, or after one and a comma."""
    out: set[int] = set()
    for j, k in enumerate(t.kinds):
        if k and "f" in k and "p" not in k:
            out.add(j - 1)
            if j + 2 < len(t.lows) and t.lows[j + 1] == ",":
                out.add(j + 2)
            if j >= 3 and t.lows[j - 1] in (".", "'", "’") and len(t.lows[j - 2]) == 1 and t.lows[j - 2].isalpha():
                out.add(j - 3)
    return out


def candidates(t: Tokens, model: Model, before: set[int]) -> list[int]:
    """Tokens that are nodes."""
    out = []
    for i, w in enumerate(t.lows):
        k = t.kinds[i]
        if not k and (w in model.common and i not in before or w in P.CUES):
            continue
        if len(w) > 1 and w.isalpha() and w not in P.PARTICLES and w not in P.AHEAD and not _in_code(i, t):
            out.append(i)
    return out


def _in_code(i: int, t: Tokens) -> bool:
    """Whether digits are attached to a token."""
    return bool(i and not t.toks[i][3] and t.lows[i - 1].isdigit() or i + 1 < len(t.lows) and not t.toks[i + 1][3] and t.lows[i + 1].isdigit())


def features(i: int, t: Tokens, model: Model) -> tuple[list[str], list[str]]:
    """Features of token i: (from the context, from the lexicon)."""
    toks, lows, kinds, shapes = t.toks, t.lows, t.kinds, t.shapes
    n = len(toks)
    skip = lambda j: kinds[j] or shapes[j] in "TUMIi" and lows[j].isalpha() or lows[j] in P.PARTICLES or lows[j] in ".-'’" and j and shapes[j - 1] in "IT"
    l1 = lows[i - 1] if i else "^"
    r1 = lows[i + 1] if i + 1 < n else "$"
    # The nearest words left and right that can't be part of the same name.
    j = i - 1
    while j >= 0 and j > i - 5 and skip(j) and lows[j] not in P.AHEAD and lows[j].isalpha() and kinds[j]:
        j -= 1
    while j >= 1 and lows[j] in (".", "'", "’") and shapes[j - 1] in ("I", "i"):
        j -= 2
    far_left = " ".join(_word(lows[x]) if x >= 0 else "^" for x in (j - 1, j))
    k = i + 1
    while k < n and k < i + 6 and skip(k):
        k += 1
    far_right = " ".join(_word(lows[x]) if x < n else "$" for x in (k, k + 1))
    w = lows[i]
    s = shapes[i]
    initial = i > 1 and l1 == "." and shapes[i - 2] in ("I", "i") and not toks[i - 1][3]
    context = [
        "bias", "s=" + s, "l1=" + _word(l1), "r1=" + _word(r1), "fl=" + far_left, "fr=" + far_right,
        "l2=" + (_word(lows[i - 2]) if i > 1 else "^") + " " + _word(l1), "r2=" + _word(r1) + " " + (_word(lows[i + 2]) if i + 2 < n else "$"),
        "sl=" + s + ("^" if not initial and (i == 0 or l1 in ".?!:;*-" or "\n" in toks[i][3]) else "m"),
        "m=" + str(model.built_like_family(w)), "suf=" + w[-4:], "pre=" + w[:4], "ini=" + ("." if initial else "") + s,
        "ps=" + ("s" if r1 in "'’" and i + 2 < n and lows[i + 2] == "s" else "-"),
    ]
    left = kinds[i - 1] if i and toks[i - 1][0].isalpha() else (kinds[i - 2] + "," if i > 1 and l1 in ",.-'’" else "")
    right = kinds[i + 1] if i + 1 < n and toks[i + 1][0].isalpha() else (kinds[i + 2] + "," if i + 2 < n and r1 in ",.-" else "")
    lexicon = ["k=" + kinds[i], "k=" + kinds[i] + s, "kl=" + left + ">" + kinds[i], "kr=" + kinds[i] + "<" + right]
    return context, lexicon


def joined(i: int, j: int, t: Tokens) -> bool:
    """Whether tokens i < j can be neighbours within one name: nothing but blanks, a comma, initials, a particle, hyphen or apostrophe between."""
    if j - i > 5 or any("\n" in x[3] for x in t.toks[i + 1 : j + 1]):
        return False
    between = t.lows[i + 1 : j]
    return all(w in (",", ".", "-", "'", "’") or len(w) == 1 and w.isalpha() or w in P.PARTICLES for w in between) and between.count(",") < 2


def _near(a: str, b: str) -> bool:
    """Equal up to one changed, missing or doubled letter."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 6:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def near_pairs(words: set[str]) -> list[tuple[str, str]]:
    """Pairs of names one letter apart; they share a half."""
    out, by_half = [], defaultdict(list)
    for w in sorted(words):
        if len(w) >= 6:
            halves = {w[: len(w) // 2], w[len(w) // 2 :], w[: (len(w) - 1) // 2], w[(len(w) + 1) // 2 :]}
            out += [(other, w) for other in sorted({x for h in halves for x in by_half[h] if _near(w, x)})]
            for h in halves:
                by_half[h].append(w)
    return out


def name_edges(order: list[int], t: Tokens, model: Model) -> list[tuple[int, int, str]]:
    """Edges between candidates: within names, and from mention to mention."""
    edges = [(i, j, "chain") for i, j in zip(order, order[1:]) if joined(i, j, t)]
    last: dict[str, int] = {}
    for i in order:
        w = t.lows[i]
        if len(w) > 2 and w not in model.plain:
            if w in last:
                edges.append((last[w], i, "skip"))
            last[w] = i
    return edges + [(last[a], last[b], "skip") for a, b in near_pairs(set(last))]


def span_edges(spans: list[Span]) -> list[tuple[int, int, str]]:
    """Edges from each span to the last one before it that is the same."""
    edges, last = [], {}
    for v in sorted(range(len(spans)), key=lambda v: spans[v].start):
        if len(spans[v].same) > 2:
            if spans[v].same in last:
                edges.append((last[spans[v].same], v, "skip_shape"))
            last[spans[v].same] = v
    return edges


# --- a text in the field


@dataclass
class Read:
    """A text's nodes: its spans from ``first`` on, then its name words."""

    first: int
    spans: list[Span]
    tokens: Tokens
    order: list[int]


def add_text(text: str, model: Model, crf: Field) -> Read:
    """Adds a text's nodes and edges to the field."""
    spans, rest = spans_of(text, model)
    first = crf.size
    for s in spans:
        names = s.shape + s.around
        crf.node({label: model.score(label, names) for label in s.labels})
    for a, b, kind in span_edges(spans):
        crf.edge(first + a, first + b, model.strengths[kind])
    zones = name_zones(rest, model)
    t = prepare(rest, model, zones) if zones else Tokens([], [], [], [])
    order = candidates(t, model, before_family(t)) if zones else []
    at = {}
    for i in order:
        c, x = features(i, t, model)
        at[i] = crf.node({"person": model.score("person", c + x)})
    for i, j, kind in name_edges(order, t, model):
        crf.edge(at[i], at[j], model.strengths[kind])
    return Read(first, spans, t, order)


def names(person: set[int], t: Tokens) -> list[tuple[int, int]]:
    """Spans of whole names around the tokens found: initials, particles, hyphens, ``family, given``; titles and possessives stay outside."""
    toks, lows, kinds, shapes = t.toks, t.lows, t.kinds, t.shapes
    out, order, at = [], sorted(person), 0
    is_given = lambda i: kinds[i][:1] in ("g", "b") and kinds[i] != ""
    while at < len(order):
        first = last = order[at]
        n_words, inverted = 1, False
        at += 1
        while at < len(order):
            j = order[at]
            between = lows[last + 1 : j]
            gaps = "".join(t[3] for t in toks[last + 1 : j + 1])
            if "\n" in gaps:
                break
            if between == ["-"] and not gaps:
                pass
            elif between == [","]:
                # "family, given": one family name before and one word after, unless that one begins another name.
                if inverted or n_words != 1 or is_given(last) and not kinds[last].startswith("b"):
                    break
                nxt = order[at + 1] if at + 1 < len(order) else None
                if nxt is not None and nxt == j + 1 and not is_given(j):
                    break
                inverted = True
            elif inverted or n_words >= 2:
                break
            elif not between:
                if is_given(j) and not is_given(last):
                    break
                n_words += 1
            elif len(between) == 2 and between[1] in (".", "'", "’") and len(between[0]) == 1:
                n_words += 1
            elif len(between) == 4 and between[1] == "." and len(between[0]) == 1:
                n_words += 1
            elif between[-1] in P.PARTICLES and all(w in P.PARTICLES for w in between):
                n_words += 1
            else:
                break
            last = j
            at += 1
        start, end = toks[first][1], toks[last][2]
        # What stands before: O', initials.
        k = first
        if k >= 2 and lows[k - 1] in ("'", "’") and len(lows[k - 2]) == 1 and not toks[k][3] and not toks[k - 1][3]:
            k -= 2
            start = toks[k][1]
        if n_words == 1 and not (is_given(first) and not inverted):
            while k >= 2 and lows[k - 1] == "." and len(lows[k - 2]) == 1 and lows[k - 2].isalpha() and "\n" not in toks[k][3] and not toks[k - 1][3]:
                k -= 2
                start = toks[k][1]
        # The other half of a double name may be a plain word as well.
        if last + 2 < len(toks) and lows[last + 1] == "-" and not toks[last + 1][3] and not toks[last + 2][3] and "f" in kinds[last + 2]:
            end = toks[last + 2][2]
        # After an inverted name, an initial belongs to it.
        if inverted and last + 2 < len(toks) and len(lows[last + 1]) == 1 and lows[last + 1].isalpha() and lows[last + 2] == "." and shapes[last + 1] == "I":
            end = toks[last + 2][2]
        out.append((start, end))
    return out
