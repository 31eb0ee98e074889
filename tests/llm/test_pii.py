import itertools
import random
from collections import Counter

import numpy as np
import pytest

from quarrydex.llm import pii, pii_fit, pii_nodes

GIVEN = "Alaric Anouk Bram Corvin Dunja Emeka Fenna Ilse Jonas Leander Lioba Maren".split()
FAMILY = [a + b for a in ("Brend", "Calder", "Dorn", "Elster", "Farrow", "Grimm") for b in ("by", "feld", "holm", "wick", "mark")]
FRAMES = ["Assigned to {}.", "{} wrote the note.", "Thanks to {} for the patch.", "ask {}, not me.", "Reviewed by {} today.", "Frau {} hat den Lauf gestoppt."]
FILLER = [
    "The merge starts over before the lock is held.", "Nobody expects the index to hold forty rows.", "Latency falls by half on a cold cache.",
    "Bloom Filter and Page Cache are both slow here.", "Then two copies survive, which is rare.", "Every reader waits until the writer is done.",
    "Before the release, we kept three segments in one file.", "How can the parser know about short terms?", "Please make sure that it never drops a level.",
    "See ticket 4711 for the harmless case.", "If it fails, queries slow down.", "Some rows in, more rows out, so memory doubles.",
    "Please dial 5550 for help.", "Rule of thumb: small blocks are slow, large ones are not.", "Under a read lock, results come back unsorted.",
]


STREETS = ["Juniper Road", "Old Mill Lane", "Harbour Street", "St. Bride Avenue", "Orchard Close", "Kite Terrace"]
GERMAN = ["Lindenweg", "Torfstr.", "Kirchgasse", "Am-Markt-Platz", "Ahornallee"]


def number(r, form):
    return "".join(str(r.randrange(10)) if c == "#" else c for c in form)


def phone(r):
    return number(r, r.choice(["+44 7### ######", "+1 ### 555 01##", "(###) 555-01##", "020 #### ####"[:0] + "030/#####-###", "###-555-01##", "0049 30 ##### ###", "+49 30 #######"]))


def identity(r):
    return number(r, r.choice(["###-##-####", "### ## ####", "QQ######C", "QQ ## ## ## A", "########K", "X########", "ZZ #######", "#########", "## ### ### ###"]))


def address(r):
    if r.random() < 0.3:
        return f"{r.choice(GERMAN)} {r.randrange(1, 200)}{r.choice(['', 'a'])}"
    return f"{r.randrange(1, 250)}{r.choice(['', 'B'])} {r.choice(STREETS)}"


def mail(r):
    return f"{r.choice(GIVEN).lower()}.{r.choice(FAMILY).lower()}{r.choice(['', '+list', '7'])}{r.choice(['@', '@', ' [at] '])}" + r.choice(["mail.example.org", "corvale.example"])


#: Frames with what they hold; the last ones hold numbers and signs that are nobody's.
KINDS = {
    "phone": (phone, ["Call {} after noon.", "My phone: {}.", "{} rings at night.", "Fax {} or wait.", "Bitte {} anrufen.", "You may dial {} for help."]),
    "id_number": (identity, ["SSN: {}.", "The passport {} has expired.", "Identity card: {} is lost.", "His tax id {} was typed twice.", "Steuer-ID: {}."]),
    "address": (address, ["We met at {} in spring.", "The parcel goes to {}, please.", "Our new place: {}, second floor.", "They left {} last year."]),
    "email": (mail, ["Write to {} soon.", "Contact: {}.", "{} has the file."]),
    "": (None, ["Sequence {#########} follows {########}.", "Checksum {##########}, size {####}.{####}.", "On 20##-0#-1# the run held ## rows.", "See offset ####-####-#### and 192.0.2.###.",
                "Build {########} took ## minutes on road map 3.", "Use flush@box## or @handle#.", "The # way merge beats the ## way merge.", "Block ####-#### holds ### terms at place ##."]),
}


def texts(seed, n, given, family, others=True):
    """Texts with the places of what is to be found; generated, so that some names can be kept from the lexicon."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(5):
            kind = r.choice(["person", "filler", "filler", *KINDS]) if others else r.choice(["person", "filler"])
            if kind == "filler":
                text += r.choice(FILLER) + " "
                continue
            if kind == "person":
                g, f = r.choice(given), r.choice(family)
                found = r.choice([f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} van {f}", f"{g} {f}-{r.choice(family)}", f"{g} {r.choice('ABCDE')}. {f}"])
                frame = r.choice(FRAMES)
            elif kind:
                found, frame = KINDS[kind][0](r), r.choice(KINDS[kind][1])
            else:
                text += number(r, r.choice(KINDS[""][1]).replace("{", "").replace("}", "")) + " "
                continue
            start = len(text) + frame.index("{}")
            text += frame.format(found) + " "
            gold.append((start, start + len(found), kind))
        out.append((text, gold))
    return out


# A quarter of the names is missing from the lexicon.
LEXICON = [(g, "given") for g in GIVEN[::4] + GIVEN[1::4] + GIVEN[2::4]] + [(f, "family") for i, f in enumerate(FAMILY) if i % 4]


@pytest.fixture(scope="module")
def model():
    return pii.learn([t for t, _ in texts(1, 1500, GIVEN, FAMILY)], LEXICON)


def accuracy(model, held_out):
    """Per kind precision and recall."""
    right, found, wanted = Counter(), Counter(), Counter()
    for (_, gold), got in zip(held_out, pii.find_in([t for t, _ in held_out], model)):
        right.update(k for _, _, k in set(got) & set(gold))
        found.update(k for _, _, k in got)
        wanted.update(k for _, _, k in gold)
    return {k: (right[k] / found[k], right[k] / wanted[k]) for k in pii.KINDS}


def test_held_out_accuracy(model):
    for kind, (precision, recall) in accuracy(model, texts(99, 500, GIVEN, FAMILY)).items():
        assert precision >= 0.95 and recall >= 0.95, (kind, precision, recall)


def test_strengths_are_learned(model):
    assert model.strengths != pii_nodes.STRENGTHS and all(s > 0 for s in model.strengths.values())
    assert all(model.weights[k] for k in pii.KINDS)


@pytest.mark.parametrize("kind, text, want", [
    ("email", "Write to a.b+c@mail.example.org.", ["a.b+c@mail.example.org"]),
    ("email", "mailto:X_Y@Ex-ample.TEST works; <q1@a.example>", ["X_Y@Ex-ample.TEST", "q1@a.example"]),
    ("email", "ann.b [at] corvale [dot] example, tom(at)x.org", ["ann.b [at] corvale [dot] example", "tom(at)x.org"]),
    ("email", "Use flush@jehap23, @handle and user@ as names.", []),
    ("phone", "Call +44 (0)20 7946 0999 ext. 12 or (617) 555-0187.", ["+44 (0)20 7946 0999", "(617) 555-0187"]),
    ("phone", "ring ＋１ 212 555 0179 twice, 030/23125-701, 07700 900721; +18085550132", ["＋１ 212 555 0179", "030/23125-701", "07700 900721", "+18085550132"]),
    ("phone", "01 99 00 25 50, 900-000-474, 1-212-555-0135, 808.555.0156", ["01 99 00 25 50", "900-000-474", "1-212-555-0135", "808.555.0156"]),
    ("phone", "Offsets 9951-3934-7011-4373, 192.0.2.240, 2024-03-17 03:16:24, block 555-8125-2569, version 2.0.0", []),
    ("id_number", "SSN: 972 03 4696, tax id: 21 075 022 691, passport no.: ZZ 0870785", ["972 03 4696", "21 075 022 691", "ZZ 0870785"]),
    ("id_number", "the NI number QQ948590A and QQ 30 75 77 A, ssn (982364431)", ["QQ948590A", "QQ 30 75 77 A", "982364431"]),
    ("id_number", "Sequence 941484462 follows 401878543; checksum 4295962598.", []),
    ("address", "Office: 51B St. Aldwen Street, second floor. Ship it to Flat 3, 113 Juniper St..", ["51B St. Aldwen Street", "113 Juniper St."]),
    ("address", "Büro: Lindenweg 94, zweiter Stock. Die Platten gehen an Torfstr. 122a.", ["Lindenweg 94", "Torfstr. 122a"]),
    ("address", "Bureau : 14a avenue du Moulin-Vert, deuxième étage.", ["14a avenue du Moulin-Vert"]),
    ("address", "Oficina: Calle del Molino Nuevo, 72, segunda planta.", ["Calle del Molino Nuevo, 72"]),
    ("address", "The 8 way merge beats the 4 way merge; use road map 3. Branch lane 12 is closed.", []),
])
def test_shapes(model, kind, text, want):
    assert [text[a:b] for a, b, k in pii.find_all(text, model) if k == kind] == want


def exact(crf):
    """Marginals by enumeration of all labellings."""
    own = crf.own()
    total = np.zeros(own.shape)
    for state in itertools.product(*[np.flatnonzero(row > -1e8) for row in own]):
        w = np.exp(sum(own[i][x] for i, x in enumerate(state)) + sum(k for a, b, k in zip(crf.left, crf.right, crf.strength) if state[a] == state[b]))
        for i, x in enumerate(state):
            total[i][x] += w
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees():
    r = np.random.default_rng(3)
    f = pii.Field()
    n = [f.node({"person": r.normal()} if i % 2 else {"phone": r.normal(), "id_number": r.normal()}) for i in range(5)]
    for a, b, k in ((0, 1, 1.0), (1, 2, 2.0), (1, 3, 0.7), (3, 4, -0.5)):
        f.edge(n[a], n[b], k)
    assert np.allclose(f.marginals(rounds=200), exact(f), atol=1e-6)


def test_documents_side_by_side(model):
    """A batch of texts is one field, with the results of each text by itself."""
    some = [t for t, _ in texts(7, 40, GIVEN, FAMILY)] + ["", "plain"]
    assert pii.find_in(some, model) == [pii.find_all(t, model) for t in some]
    assert pii.find_in([], model) == [] and pii.Field().marginals().shape == (0, 6)


def test_long_text_of_unknown_words(model):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdeiou") for _ in range(7)).title() for _ in range(30_000))
    assert isinstance(pii.find_all(text, model), list)  # in seconds: cost is linear


def test_repeats_share_their_label(model):
    """A bare number takes the label that its repeat's announcement gives it, however far apart."""
    far = "Latency falls by half on a cold cache. " * 30
    numbers = lambda t: [k for _, _, k in pii.find_all(t, model) if k != "person"]
    assert numbers(f"Take place 941484462 now. {far}") == []
    assert numbers(f"Take place 941484462 now. {far} SSN: 941484462.") == ["id_number", "id_number"]


def test_redaction_keeps_the_rest(model):
    text = "Assigned to Jonas Dornfeld. Call +44 7700 900721 or write to j@x.org; Jonas agrees."
    found = pii.find_all(text, model)
    clean = pii.redact(text, found)
    assert clean == "Assigned to [PERSON]. Call [PHONE] or write to [EMAIL]; [PERSON] agrees."
    assert pii.redact("", []) == "" and pii.redact("plain", []) == "plain"


def test_tables(spark, model):
    docs = [(1, "ask Jonas Dornfeld, not me. ask Jonas Dornfeld, not me."), (1, "ask Jonas Dornfeld, not me."), (2, None), (3, ""), (None, "a@b.org"), (4, "word " * 40_000 + "a@b.org"), (5, "\x00 ퟿ <>")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'clash' AS kind", "1 AS found_text")
    got = sorted((str(r.doc_id), r.kind, r.found_text) for r in pii.find_personal(df, model).collect())
    assert got == [("1", "person", "Jonas Dornfeld"), ("4", "email", "a@b.org"), ("None", "email", "a@b.org")]
    clean = pii.redact_documents(df, model).collect()
    assert len(clean) == len(docs) and {r.text for r in clean if r.doc_id in (2, 3)} == {None, ""}
    assert pii.find_personal(df.where("false"), model).count() == 0
    spans = pii.span_marginals(df, model)
    rows = [tuple(r) for r in spans.where("doc_id = 1 AND kind = 'person' AND probability > 0.5").select("start_at", "end_at").distinct().collect()]
    assert {(4, 9), (10, 18), (32, 37), (38, 46)} <= set(rows)
    assert {r.doc_id for r in spans.collect()} == {1, 4, None} and spans.where("probability NOT BETWEEN 0 AND 1").count() == 0


def test_fit_on_a_table(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts(4, 300, GIVEN, FAMILY))] + [(None, None)], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([(g, "given") for g in GIVEN] * 2 + [(f, "family") for f in FAMILY] + [(None, "given"), ("x", None)], "name_word string, name_kind string")
    m = pii.fit_model(docs, lexicon, sample=200)
    assert m.weights["person"] and "jonas" in m.given
    assert m == pii.fit_model(docs.repartition(5), lexicon, sample=200)
    empty = pii.fit_model(docs.where("false"), lexicon.where("false"))
    assert pii.find_all("ask Jonas, a@b.org", empty) == [(11, 18, "email")]


def test_stored_model(spark, model, tmp_path):
    pii.save_model(spark, model, str(tmp_path / "model"))
    again = pii.load_model(spark, str(tmp_path / "model"))
    assert again == model
    some = [t for t, _ in texts(8, 20, GIVEN, FAMILY)]
    assert pii.find_in(some, again) == pii.find_in(some, model)


def test_counts_cover_all_documents(spark):
    """What the lexicon lacks and what is common is counted over all documents, not over the sample."""
    own = [t for t, _ in texts(4, 300, GIVEN[:8], FAMILY)] + [t for t, _ in texts(5, 40, GIVEN[8:], FAMILY)]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")
    lexicon = [(g, "given") for g in GIVEN[:8]] + [(f, "family") for f in FAMILY]
    m = pii.fit_model(docs.repartition(4), spark.createDataFrame(lexicon, "name_word string, name_kind string"), sample=5)
    assert {g.lower() for g in GIVEN} <= m.given
    given, family = pii_fit.lexicon_sets(lexicon)
    whole = pii.learn(sorted(own), lexicon)
    assert (m.given, m.family, m.common, m.plain) == (whole.given, whole.family, whole.common, whole.plain) and len(m.common) > 50
    assert pii.count_corpus(docs, given, family).texts == len(own)
    assert pii.at_least(4, 1000) == 4 and pii.at_least(4, 80_000) == 40


def test_neighbours_turn_a_low_score():
    """Four likely neighbours outweigh a context that speaks against the middle mention."""
    weights = {"person": {"pre=zorb": -6.5, "r1=wrote": 14.5, "pre=anna": 8.0, "pre=bran": 8.0}}
    text = "Zorbel wrote? Anna Zorbel Brandt? Zorbel wrote"
    m = pii.Model(weights, common=frozenset({"wrote"}))
    at = text.index("Zorbel Brandt")
    assert any(a <= at < b for a, b, _ in pii.find_all(text, m))
    assert pii.find_all("Anna Zorbel", m) == [(0, 4, "person")]
