import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrydex.llm import contamination
from quarrydex.llm.contamination import WINDOW, exact_leaks, shape_of, template_leaks, template_members, words_of

ITEMS = [
    (1, "A log named Jirle grows by 661 entries an hour until the reader Nonxe trims it to 8813 bytes each day."),
    (2, "A log named Hurwu grows by 4396 entries an hour until the reader Purwi trims it to 2959 bytes each day."),
    (3, "too short to have any window of words"),
    (4, None),
    (5, ""),
    (None, "A log named Nobody grows by 1 entries an hour until the reader Nobody trims it to 1 bytes each day."),
]


def plain_words(text):
    """The definition once more, character by character."""
    text = re.sub(r"<[^<>]*>", "", "".join(c for c in text or "" if unicodedata.category(c) != "Cf"))
    text = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c if c.isalnum() else " " for c in text).split()


def brute(docs, items):
    grams = lambda t: {tuple(w[i : i + WINDOW]) for w in [plain_words(t)] for i in range(len(w) - WINDOW + 1)}
    i = [(k, grams(t)) for k, t in items if k is not None]
    return {(d, k) for d, t in docs if d is not None for g in [grams(t)] for k, x in i if g & x}


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("id", F.lit("clash")).withColumn("words", F.lit(1)).repartition(3)
    return {(r.doc_id, r.item_id) for r in exact_leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}


def test_disguises(spark):
    t = ITEMS[0][1]
    cut = " ".join(t.split()[3:16])
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    docs = [
        (1, t), (2, "before it. " + cut + " and after"), (3, " ".join(t.split()[:11])), (4, t.upper().replace(" ", "  \n")), (5, wide),
        (6, "​".join(t)), (7, re.sub(r"(\w+)", r"<b>\1</b>", t)), (8, t.replace("661", "662").replace("Nonxe", "Other")), (9, "x " * 50_000 + cut), (9, "x " * 50_000 + cut),
        (10, None), (11, ""), (None, t), (12, t.replace(" ", "_")), (13, re.sub(r"(\w+)", r"**\1**,", t)),
    ]
    got = leaks(spark, docs, ITEMS)
    assert got == brute(docs, ITEMS)
    assert got == {(d, 1) for d in (1, 2, 4, 5, 6, 7, 9, 12, 13)}


def test_random_pieces(spark):
    r = random.Random(8)
    words = ["alpha", "beta", "Gamma", "12", "seven", "bytes", "x1"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(8, 30)))) for i in range(12)]
    docs = []
    for i in range(150):
        t = r.choice(items)[1].split()
        a = r.randrange(len(t))
        docs.append((i, " ".join([r.choice(words) for _ in range(5)] + t[a : a + r.randrange(8, 20)] + [r.choice(words) for _ in range(3)])))
    got = leaks(spark, docs, items)
    assert got == brute(docs, items) and got


def test_many_items_need_no_prefilter(spark, monkeypatch):
    monkeypatch.setattr(contamination, "MIN_BITS", 64)
    monkeypatch.setattr(contamination, "MAX_BITS", 64)  # a filter that is full passes all windows
    docs = [(1, ITEMS[0][1]), (2, "nothing at all"), (3, "words that are no part of any question but fill a window or two of this text all the same")]
    assert leaks(spark, docs, ITEMS) == {(1, 1)}
    monkeypatch.setattr(contamination, "MAX_WORDS", 1)
    words = spark.createDataFrame([(i, "the log grows") for i in range(6)], "id bigint, text string")
    with pytest.raises(ValueError, match="words that stand for themselves"):
        contamination.template_words(words)


def test_filter_holds_every_window(spark):
    r = np.random.default_rng(1)
    own = r.integers(-(2**63), 2**63 - 1, 3000)
    bits = contamination.window_filter(spark.createDataFrame([(int(h),) for h in own], "template bigint"))
    on = lambda h: np.all([bits[at >> 3] >> (at & 7) & 1 for at in contamination.filter_places(h, 8 * len(bits))], axis=0)
    assert on(own).all() and on(r.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.05


def test_names_and_numbers_are_typed(spark):
    """A name that many items hold is a name all the same; number words are numbers."""
    items = [(i, f"When does the reader Nora trim the log, asks {n} of them, and how often then?") for i, n in enumerate(["Zoe", "two", "Ann", "three", "Bo", "four"])]
    plain = contamination.template_words(spark.createDataFrame(items, "id bigint, text string"))
    assert {"when", "does", "reader", "trim", "log"} <= plain and not plain & {"nora", "zoe", "ann"}
    canon = contamination.Canon(plain)
    assert canon("two") == canon("17") == canon.number and canon("minutes") == canon.unit and canon("nora") == canon("unheard") == canon.name


def test_foreign_windows_are_no_template(spark):
    """Windows without words that stand for themselves would all have the same template."""
    r = random.Random(3)
    rare = lambda n: " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(n))
    items = [*ITEMS, (50, rare(20))]
    docs = spark.createDataFrame([(1, rare(200)), (2, items[-1][1]), (3, "x " + items[-1][1])], "doc_id bigint, text string")
    df = spark.createDataFrame(items, "item_id bigint, text string")
    hits, _ = contamination.template_hits(docs, df)
    assert {r.id for r in hits.select("id").distinct().collect()} == {2, 3}
    assert {(r.doc_id, r.template_item) for r in template_leaks(docs, df).collect()} == {(2, 50), (3, 50)}


def parameterised(seed):
    """Items of several templates, and documents with such questions filled anew, filled against the item's pattern, or others."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("BDFGKLMNPRST".lower()) + r.choice("aeiou") for _ in range(3)).title()
    verbs, things = "trims drops keeps moves sorts reads".split(), "blocks filters segments postings tables terms".split()
    forms = []
    for k in range(12):
        v, t, u = r.choice(verbs), r.choice(things), r.choice(["minutes", "hours", "days"])
        forms.append(f"The reader {{a}} {v} {{n}} {t} every {{m}} {u} until the writer {{b}} {r.choice(verbs)} the last {r.choice(things)}; how many {t} has {{a}} after {{k}} {u} if form {'abcdefghijkl'[k]} holds?")
    fill = lambda f: f.format(a=name(), b=name(), n=r.randrange(2, 999), m=r.choice([r.randrange(2, 99), "seven", "twelve"]), k=r.randrange(2, 99))
    items = [(i, fill(forms[i % 12])) for i in range(96)]
    docs, truth = [], set()
    pad = lambda: " ".join(r.choice(things + verbs + ["the", "a", "with", "often", name()]) for _ in range(r.randrange(5, 30)))
    for d in range(400):
        kind = d % 4
        if kind == 0:  # filled anew, whole or in part
            w = fill(forms[r.randrange(12)]).split()
            a = r.randrange(0, 3)
            docs.append((d, f"{pad()}. {' '.join(w[a : a + r.randrange(16, 30)])} {pad()}"))
            truth.add(d)
        elif kind == 1:  # another question
            docs.append((d, f"{pad()}. A writer called {name()} {r.choice(verbs)} about {r.randrange(99)} {r.choice(things)} while {name()} waits for {r.randrange(99)} hours and then stops. {pad()}"))
        elif kind == 2:
            docs.append((d, pad() + " " + pad()))
        else:  # too little of it
            docs.append((d, f"{pad()} {' '.join(fill(forms[r.randrange(12)]).split()[:9])} {pad()}"))
    return items, docs, truth


def test_accuracy_on_refilled_templates(spark):
    items, docs, truth = parameterised(4)
    rows = template_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {r.doc_id for r in rows}
    precision, recall = len(got & truth) / len(got), len(got & truth) / len(truth)
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)


def test_slots_must_agree(spark):
    """The same name twice in the items: a document with two different names there is another question."""
    items = [(i, f"The reader {n} keeps the last filters until the reader {n} drops all of the old blocks") for i, n in enumerate(["Zed", "Yod", "Xul", "Wib", "Vok", "Uda"])]
    docs = [(1, items[0][1].replace("Zed", "Nim")), (2, items[0][1].replace("Zed", "Nim", 1)), (3, items[0][1])]
    rows = template_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    windows = {r.doc_id: (r.windows, r.same_words) for r in rows}
    assert windows[1][1] == 0 and windows[3][0] == windows[3][1] == windows[1][0] > windows.get(2, (0, 0))[0]


def test_templates(spark):
    items = [(i, f"A log named Zed{'abcdefgh'[i]} grows by {i}7 entries an hour until the reader Yod{'abcdefgh'[i]} trims it to {i}9 bytes each day.") for i in range(1, 8)]
    again = "A log named Zuzu grows by 5 entries an hour until the reader Vivi trims it to 6 bytes each day."
    odd = "A log called something else that has nothing to do with any of the questions asked in the test at all today."
    docs = spark.createDataFrame([(1, again), (2, items[2][1]), (3, odd), (4, None)], "doc_id bigint, text string")
    df = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in template_leaks(docs, df).collect()}
    assert set(got) == {1, 2} and got[1].template_item == got[2].template_item == 1
    assert got[1].same_words == 0 and got[2].same_words == got[2].windows == got[1].windows
    assert {(r.template_item, r.item_id) for r in template_members(df).collect()} == {(1, i) for i in range(1, 8)}
    assert leaks(spark, [(1, again)], items) == set()


def test_short_and_split_passages_are_templates(spark):
    """Passages of one or two windows, and one whose windows have three representatives."""
    a, b, c = (" ".join(w) for w in ("when does the".split(), "cache drop its oldest block and keep the newest".split(), "one after a restart".split()))
    items = [(1, f"{a} {b}"), (2, f"does the {b} one"), (3, f"the {b} one after"), (4, f"{a} {b} {c}")] + [(10 + i, f"{c} {b} {a}") for i in range(5)]
    docs = [(1, f"{a} {b}"), (2, f"so {a} {b} now"), (3, f"{a} {b} {c}"), (4, " ".join(f"{a} {b}".split()[1:]))]
    rows = template_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in leaks(spark, docs, items)} == {1, 2, 3}
    assert {(r.template_item, r.windows, r.same_words) for r in rows if r.doc_id == 1} == {(1, 1, 1)}
    assert {(r.template_item, r.windows) for r in rows if r.doc_id == 3} == {(1, 1), (2, 1), (3, 1), (4, 2)}


def test_slots_and_empty(spark):
    assert shape_of(["a", "b", "a"], [1, 2, 1]) == "0 1 0/121" and shape_of([], []) == "/"
    assert words_of("Ab­C <i>d</i>_e ﬁne ２") == ["abc", "d", "e", "fine", "2"]
    assert leaks(spark, [], ITEMS) == leaks(spark, [(1, "text")], []) == set()
