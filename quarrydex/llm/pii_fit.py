"""Learning the random field's weights from silver labels.

Nobody labels the documents. Silver labels come from what is sure by itself: a given name
next to a family name of the lexicon, a number of a shape that nothing else has or that a
word announces, a complete mail address, a street's name with capitals. What is sure to be
none counts too: common words outside of any name, unannounced plain digits, handles without
a host, numbers in front of ordinary words. All else is left out.

All weights are learned together: those of the features of every label, and the strengths of
chain and skip edges, by maximizing the pseudo-likelihood: each node's label given its
features and its neighbours' labels. Examples are also used without what made them sure (lexicon,
announcing words), so that the rest must do where it is missing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np

from quarrydex.llm import pii_patterns as P
from quarrydex.llm.pii_field import AT, LABELS
from quarrydex.llm.pii_nodes import (
    MAX_KNOWN, PRIOR, STRENGTHS, TOKEN, WORDS, Model, Span, Tokens, before_family, candidates, features, mails, mask, name_edges, name_zones, prepare, span_edges, spans_of, street_features, _around,
)

#: Texts the weights are fitted on, none longer than so many characters.
SAMPLE, MAX_TEXT = 8_000, 8_000
#: Texts for which the least counts of words are given; in more texts they are as much larger.
PER_TEXTS = 8_000
#: What is counted of each word of the corpus.
COUNTS = ("n", "lower", "before", "after", "beside")
#: A letter by itself in front of what may follow an initial.
INITIAL = re.compile(r"(?<![^\W\d_])[^\W\d_][.'’]")
#: One in so many common words is an example of what is no name.
ORDINARY = 8
#: Weights of an example without announcing words, and without its neighbours.
WITHOUT, ALONE = 0.3, 3.0
#: Strengths of edges are kept within these bounds.
WEAKEST, STRONGEST = 0.5, 5.0


def count_words(texts: list[str], given: set[str], family: set[str], into: dict[tuple[str, str], list[int]] | None = None) -> dict[tuple[str, str], list[int]]:
    """What :func:`learn` has to know of the whole corpus; counts of parts add up.

    ``(word, "")`` has how often the word stands at all, in lower case, before a family name and
    behind a given name; ``(word, family name)`` how often it stands before that one; ``("", "")`` the texts.
    """
    out = defaultdict(lambda: [0] * 5) if into is None else into
    known = given | family
    with_signs = known | {".", "'", "’"}
    cased, uncased = Counter(), Counter()
    for text in texts:
        text = mask(text, mails(text)[0])
        found = TOKEN.findall(text)
        (uncased if text.islower() or text.isupper() else cased).update(found)
        lows = list(map(str.lower, found))
        single = [x for x in set(lows) if len(x) == 1 and x.isalpha()]
        marks = with_signs if single and INITIAL.search(text) else known
        if marks.isdisjoint(lows):
            continue
        lows = ["^", "^", "^", *lows, "$", "$", "$", "$"]
        followed: dict[int, str] = {}  # places of words in front of a family name, or behind one and a comma
        behind: set[int] = set()  # places of words behind a given name or an initial, or in front of a comma and a given name
        for j in [j for j, w in enumerate(lows) if w in marks]:
            w = lows[j]
            if w in family:
                if lows[j + 1] == ",":
                    followed.setdefault(j + 2, w)
                if lows[j - 1] in (".", "'", "’") and len(lows[j - 2]) == 1 and lows[j - 2].isalpha():
                    followed[j - 3] = w
                if lows[j - 1] in P.PARTICLES:
                    followed[j - 2] = w
                followed[j - 1] = w
            if w in given:
                behind.add(j + 1)
                if lows[j + 1] in P.PARTICLES:
                    behind.add(j + 2)
                if lows[j - 1] == ",":
                    behind.add(j - 2)
            elif w in (".", "'", "’") and len(lows[j - 1]) == 1 and lows[j - 1].isalpha():
                behind.add(j + 1)
        for j, w in followed.items():
            if lows[j].isalpha():
                out[lows[j], ""][2] += 1
                out[lows[j], w][4] += 1
        for j in behind:
            if lows[j].isalpha():
                out[lows[j], ""][3] += 1
    out["", ""][0] += len(texts)
    for words in (cased, uncased):
        for x, n in words.items():
            if x.isalpha():
                row = out[x.lower(), ""]
                row[0] += n
                if words is cased and x.islower():
                    row[1] += n
    return out


def at_least(n: int, texts: int) -> float:
    """How often a word stands in ``texts`` texts that is as frequent as ``n`` times in PER_TEXTS, and ``n`` times at least."""
    return max(n, n * texts / PER_TEXTS)


def plain_words(counts: dict[str, tuple], given: set[str], family: set[str], texts: int) -> frozenset[str]:
    """Lexicon words that mostly stand where no name can be made out are plain words too."""
    least = at_least(10, texts)
    return frozenset(w for w, (n, _, before, after) in counts.items() if n >= least and (before if w in given else 0) + (after if w in family else 0) < 0.25 * n)


def lexicon_sets(lexicon: list[tuple[str, str]]) -> tuple[set[str], set[str]]:
    return {w.lower() for w, k in lexicon if k == "given"}, {w.lower() for w, k in lexicon if k == "family"}


@dataclass
class Corpus:
    """Number of texts, plain words, and per word: occurrences, those in lower case, before a family name, behind a given name, before a family name that isn't plain."""

    texts: int
    plain: frozenset[str]
    words: dict[str, tuple[int, int, int, int, int]]


def corpus_of(texts: list[str], given: set[str], family: set[str]) -> Corpus:
    counts = count_words(texts, given, family)
    total = counts.pop(("", ""), [0])[0]
    plain = plain_words({w: counts[w, ""][:4] for w in given | family if (w, "") in counts}, given, family, total)
    sure = Counter()
    for (w, f), n in counts.items():
        if f and f not in plain:
            sure[w] += n[4]
    return Corpus(total, plain, {w: (*n[:4], sure[w]) for (w, f), n in counts.items() if not f})


def vocabulary(lexicon: list[tuple[str, str]], corpus: Corpus) -> Model:
    """A model without weights: the lexicon, the names it lacks, and common words, all by rates over the whole corpus.

    Names that the lexicon lacks are told by the share of a word's places that are a name's, given two such places.
    """
    given, family = lexicon_sets(lexicon)
    words = sorted(corpus.words.items())
    titled = lambda w, n, lower: lower <= 0.5 * n and len(w) > 2 and w not in P.AHEAD and w not in P.PARTICLES
    # Words the lexicon lacks that stand before sure family names are given names, and the other way round.
    given |= {w for w, (n, lower, _, _, sure) in words if sure >= 2 and sure >= 0.34 * n and titled(w, n, lower) and w not in family}
    endings = {f[-4:] for f in family}
    family |= {w for w, (n, lower, _, after, _) in words if after >= 2 and after >= 0.5 * n and titled(w, n, lower) and w not in given and w[-4:] in endings}
    least = at_least(4, corpus.texts)
    common = frozenset(
        w for w, (n, lower, before, after, _) in words if n >= least and w not in given and w not in family and (before + after < 0.2 * n or lower > 0.8 * n) and len(w) > 1
    )
    begin, end = Counter(w[:i] for w in family for i in range(4, len(w) - 1)), Counter(w[i:] for w in family for i in range(4, len(w) - 1))
    often = lambda c: frozenset(x for x, n in c.items() if n >= 3)
    return Model(given=frozenset(given), family=frozenset(family), common=common, plain=corpus.plain, heads=often(begin), tails=often(end))


# --- silver labels


def span_label(s: Span) -> str | None:
    """What a span is for sure: a kind, "" for none, or None where it isn't sure."""
    form = s.shape[0]
    if form[0] == "e":
        return "email" if form == "e0" else ""
    if form == "street":
        return "address" if "titled=2" in s.shape or "address" in s.cues else None
    if form in {f"p{k}" for k in P.SURE_PHONE}:
        return "phone"
    if form in {f"i{k}" for k in P.SURE_ID}:
        return "id_number"
    told = s.cues & set(s.labels)
    if told:
        return next(iter(told)) if len(told) == 1 else None
    return "" if len(s.shape) > 1 else None  # plain digits that nothing announces


def person_labels(t: Tokens, model: Model, before: set[int], lower_text: bool) -> tuple[list[bool | None], list[bool]]:
    """Per token whether it is part of a name, None where that isn't sure; and whether it is an ordinary word."""
    lows, kinds, shapes, n = t.lows, t.kinds, t.shapes, len(t.lows)
    is_given = lambda i: kinds[i][:1] in ("g", "b") and kinds[i] != ""
    is_family = lambda i: kinds[i][:1] in ("f", "b") and kinds[i] != ""
    person = [False] * n
    for i in range(n - 1):
        if not kinds[i]:
            continue
        j = i + 1
        if is_given(i):
            if j + 2 < n and len(lows[j]) == 1 and lows[j] != "," and lows[j + 1] in ".'’":
                j += 2
            elif lows[j] in P.PARTICLES:
                j += 1
            if j < n and is_family(j):
                person[i] = person[j] = True
        if is_family(i) and i > 1 and lows[i - 1] == "." and shapes[i - 2] in ("I", "i"):
            person[i] = True
        if is_family(i) and lows[i + 1] == "," and i + 2 < n and is_given(i + 2):
            person[i] = person[i + 2] = True
    out: list[bool | None] = [None] * n
    ordinary = [False] * n
    for i, w in enumerate(lows):
        if not w.isalpha() or len(w) == 1 or w in P.PARTICLES:
            continue
        k = kinds[i]
        if w in model.common and not k:
            # Common words in front of a family name may be names as well.
            ordinary[i] = True
            out[i] = None if i in before and (shapes[i] != "l" or lower_text) else False
        elif person[i] or k and "p" not in k and shapes[i] in "TU":
            out[i] = True
        elif k and "p" in k:
            out[i] = False
        elif not (k or any(kinds[max(0, i - 2) : i + 3]) or i > 1 and lows[i - 1] == "." and shapes[i - 2] == "I"):
            out[i] = False
    return out, ordinary


class Examples:
    """Distinct examples with their weights: features, possible labels, the label, and per kind of edge and label the neighbours."""

    def __init__(self) -> None:
        self.seen: dict[tuple, float] = defaultdict(float)

    def add(self, names: list[str], labels: tuple[str, ...], label: str, around: tuple = (), weight: float = 1.0) -> None:
        self.seen[tuple(names), labels, label, around] += weight


def _neighbours(edges: list[tuple[int, int, str]], labels: dict[int, str | None]) -> dict[int, tuple]:
    """Per node: how many of its neighbours have which label, by kind of edge."""
    out: dict[int, Counter] = defaultdict(Counter)
    for a, b, kind in edges:
        for i, j in ((a, b), (b, a)):
            if labels.get(j) is not None:
                out[i][kind, labels[j]] += 1
    return {i: tuple(sorted((k, x, min(n, 3)) for (k, x), n in c.items())) for i, c in out.items()}


def span_examples(text: str, model: Model, out: Examples) -> str:
    """Adds a text's spans; returns the text without mail addresses and streets."""
    spans, rest = spans_of(text, model)
    edges = span_edges(spans)
    labels = {v: span_label(s) for v, s in enumerate(spans)}
    for a, b, _ in edges:  # a number that is announced elsewhere is no example of what is none
        if {labels[a], labels[b]} - {"", None}:
            labels |= {v: None for v in (a, b) if labels[v] == ""}
    near = _neighbours(edges, labels)
    for v, s in enumerate(spans):
        if (y := labels[v]) is not None and (y == "" or y in s.labels):
            out.add(s.shape + s.around, s.labels, y, near.get(v, ()))
            out.add(s.shape + [x for x in s.around if not x.startswith("cue=")], s.labels, y, near.get(v, ()), WITHOUT)
            out.add(s.shape, s.labels, y, (), WITHOUT)
    # Numbers in front of ordinary words are no addresses, whatever street's name they might be.
    words = list(WORDS.finditer(rest))
    lower = text.islower() or text.isupper()
    places = iter(P.DIGITS.finditer(rest))
    d = next(places, None)
    for m, n in zip(words, words[1:]):
        while d is not None and d.start() < m.start() and d.end() != m.start() - 1:
            d = next(places, None)
        if d is None:
            break
        if d.end() == m.start() - 1 and n.start() == m.end() + 1 and m.group().lower() in model.common:
            around, _ = _around(rest, d.start(), n.end())
            out.add(street_features([m.group(), n.group()], model, lower) + around, ("address",), "")
    return rest


def name_examples(text: str, rest: str, model: Model, out: Examples, state: list[int]) -> None:
    """Adds a text's words; ``state`` counts ordinary words and texts. Of three texts in four only what is near possible names is read."""
    state[1] += 1
    t = prepare(rest, model, name_zones(rest, model) if state[1] % 4 else None)
    before = before_family(t)
    sure, ordinary = person_labels(t, model, before, text.islower())
    nodes = candidates(t, model, before)
    labels = {i: None if sure[i] is None else "person" if sure[i] else "" for i in nodes}
    near = _neighbours(name_edges(nodes, t, model), labels)
    for i, y in enumerate(sure):
        if ordinary[i]:
            state[0] += 1
            if y is None or i not in before and state[0] % ORDINARY:
                continue  # of common words a part will do
            c, x = features(i, t, model)
            out.add(c + x, ("person",), "", near.get(i, ()))
            continue
        if y is None:
            continue
        c, x = features(i, t, model)
        label, around = "person" if y else "", near.get(i, ())
        out.add(c + x, ("person",), label, around)
        if around:  # as if the neighbours' labels weren't known
            out.add(c + x, ("person",), label, (), ALONE)
        k = t.kinds[i]
        if y and k:  # as if the lexicon lacked the word, and as if there were none
            t.kinds[i] = ""
            out.add(sum(features(i, t, model), []), ("person",), label, (), 0.4)
            t.kinds[i] = k
            out.add(c, ("person",), label, (), 0.2)
        elif not y:
            out.add(c, ("person",), label)


def learn(texts: list[str], lexicon: list[tuple[str, str]], rounds: int = 60, corpus: Corpus | None = None) -> Model:
    """Fits all weights on ``texts``, with the word counts of the whole ``corpus`` (else of ``texts``); deterministic.

    How frequent a word must be to count as common or plain is a rate, alike at every size.
    """
    model = vocabulary(lexicon, corpus or corpus_of(texts, *lexicon_sets(lexicon)))
    out, state = Examples(), [0, 0]
    for text in texts:
        name_examples(text, span_examples(text, model, out), model, out, state)
    fit(model, out, rounds)
    return model


def fit(model: Model, examples: Examples, rounds: int) -> None:
    """Softmax regression with L2 by accelerated full-batch steps on distinct examples.

    Each example has an entry for "none", whose features score 0, and one for each label it may have. Edge
    strengths multiply the number of neighbours with the entry's label. All weights and strengths are drawn towards
    their values before learning, which are 0 for most features.
    """
    ids: dict[tuple[str, str], int] = {(x, f): i for i, (x, f) in enumerate((x, f) for x, w in PRIOR.items() for f in w)}
    first = [PRIOR[x][f] for x, f in ids]
    kinds = list(STRENGTHS)
    entry_of, feature_of, row_of, is_true, agree, weight, positive = [], [], [], [], [], [], []
    for row, ((names, labels, label, around), n) in enumerate(examples.seen.items()):
        for x in ("", *labels):
            e = len(row_of)
            row_of.append(row)
            is_true.append(x == label)
            agree.append([sum(c for k, y, c in around if k == kind and y == x) for kind in kinds])
            if x:
                for f in names:
                    entry_of.append(e)
                    feature_of.append(ids.setdefault((x, f), len(ids)))
        weight.append(n**0.5)
        positive.append(AT[label] if labels == ("person",) else -1)
    if not row_of:
        return
    entry_of, feature_of, row_of = np.array(entry_of, int), np.array(feature_of, int), np.array(row_of)
    is_true, agree, weight, positive = np.array(is_true, float), np.array(agree, float), np.array(weight), np.array(positive)
    yes, no = positive == AT["person"], positive == 0
    weight[yes] *= max(1.0, weight[no].sum() / max(weight[yes].sum(), 1) / 4)
    prior = np.array([STRENGTHS[k] for k in kinds])
    start = np.append(first, np.zeros(len(ids) - len(first)))
    theta, strength = start.copy(), prior.copy()
    squares, strength_squares = np.full(len(ids), 1e-6), np.full(len(kinds), 1e-6)
    n_rows = len(weight)
    for _ in range(rounds):
        z = np.bincount(entry_of, weights=theta[feature_of], minlength=len(row_of)) + agree @ strength
        e = np.exp(np.clip(z, -30, 30))
        d = weight[row_of] * (e / np.bincount(row_of, weights=e, minlength=n_rows)[row_of] - is_true)
        g = np.bincount(feature_of, weights=d[entry_of], minlength=len(ids)) + 0.1 * (theta - start)
        squares += g * g
        theta -= 0.7 * g / np.sqrt(squares)
        h = agree.T @ d + 0.1 * (strength - prior)
        strength_squares += h * h
        strength = np.clip(strength - 0.2 * h / np.sqrt(strength_squares), WEAKEST, STRONGEST)
    model.strengths = {k: round(float(s), 3) for k, s in zip(kinds, strength)}
    model.weights = {x: {} for x in LABELS[1:]}
    for (x, f), i in ids.items():
        if abs(theta[i]) > 0.01:
            model.weights[x][f] = round(float(theta[i]), 3)


__all__ = ["Corpus", "Model", "corpus_of", "count_words", "learn", "lexicon_sets", "plain_words", "vocabulary", "MAX_KNOWN"]
