import pytest
from pyspark.sql import functions as F

from quarrydex.functions import text
from quarrydex.functions.porter2 import stem


@pytest.mark.parametrize(
    "word, want",
    [line.split() for line in """
running run
runner runner
maps map
caresses caress
flies fli
dies die
ties tie
cries cri
gas gas
this this
kiwis kiwi
agreed agre
feed feed
plastered plaster
bled bled
sing sing
luxuriated luxuri
hopping hop
hoping hope
falling fall
failing fail
filing file
happy happi
say say
by by
enjoy enjoy
relational relat
conditional condit
valency valenc
digitizer digit
conformably conform
radically radic
differently differ
vileness vile
analogously analog
vietnamization vietnam
operator oper
feudalism feudal
decisiveness decis
hopefulness hope
callousness callous
formality formal
sensitivity sensit
sensibility sensibl
apology apolog
triplicate triplic
formative format
electricity electr
electrical electr
goodness good
revival reviv
allowance allow
inference infer
airliner airlin
adjustable adjust
defensible defens
replacement replac
adoption adopt
communism communism
activate activ
homologous homolog
effective effect
probate probat
rate rate
controlling control
rolling roll
generate generat
generically generic
communication communic
arsenal arsenal
skies sky
dying die
news news
inning inning
succeeding succeed
proceeds proceed
early earli
knots knot
youth youth
boyish boyish
a a
is is""".strip().splitlines()],
)
def test_stems(word, want):
    assert stem(word) == want


def test_long_and_foreign_words():
    assert stem("x" * 5000) == "x" * 5000
    assert stem("größe") and stem("ωωω") == "ωωω"


def test_analyze_column(spark):
    texts = [("Running fast, with MAPS!",), ("the of and",), ("",), (None,), ("don't e-mail 42x",), ("word " * 20000,)]
    rows = spark.createDataFrame(texts, "t string").select(text.analyze(F.col("t")).alias("a")).collect()
    assert [r.a for r in rows[:5]] == [["run", "fast", "map"], [], [], None, ["e", "mail", "42x"]]
    assert len(rows[5].a) == 20000
    assert text.analyze_text("Running fast, with MAPS!") == ["run", "fast", "map"]
    assert text.normalize_word("the") == "" and text.normalize_word("Snapshots") == "snapshot"
    assert text.normalize_pattern("Run-*!") == "run*"


def test_grams(spark):
    rows = spark.createDataFrame([("",), ("a",), ("ru",), ("aaaa",), ("é",)], "t string").select("t", text.term_grams(F.col("t")).alias("g")).collect()
    got = {r.t: r.g for r in rows}
    assert got[""] == [] and got["a"] == ["$a$"] and got["ru"] == ["$ru", "ru$"] and got["aaaa"] == ["$aa", "aaa", "aa$"]
    assert len(got["é"]) == 2  # pieces are bytes
    assert text.prefix_grams("ru") == ["$ru"] and text.prefix_grams("r") == []
    assert text.pattern_grams("run*") == ["$ru", "run"] and text.pattern_grams("*") == []
