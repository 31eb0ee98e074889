"""Shapes of addresses and numbers in free text, and the words that announce them."""

from __future__ import annotations

import re

# Street words, name particles, titles and announcing words in the languages of the texts.
STREET_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|way|terrace|boulevard|blvd|place|square|crescent|row|mews|gardens|parade"
STREET_DE = "straße|strasse|str|weg|gasse|platz|allee|ring|tor|damm|ufer|steig|markt|hof|chaussee|pfad|graben"
STREET_FR = "rue|avenue|boulevard|impasse|place|chemin|allée|quai|cours|route|square|passage|ruelle"
STREET_ES = "calle|plaza|avenida|camino|paseo|carrera|ronda|travesía|glorieta|callejón"
PARTICLES = frozenset("van von de del della da di den der ten ter la le du dos".split())
TITLES = frozenset("mr mrs ms miss mx dr prof sir herr frau fräulein m mme mlle monsieur madame señor señora sr sra don doña".split())
GREETINGS = frozenset("thanks thank dear hello hi danke merci gracias hola bonjour hallo".split())
PHONE_CUES = frozenset("phone tel telephone fax call cell mobile ring reached dial telefon anrufen handy mobil appeler téléphone tél portable teléfono llame móvil".split())
ID_CUES = frozenset(
    "ssn social security tax national insurance ni identity passport id identité passeport pasaporte identidad dni nif "
    "ausweisnummer steuer personalausweis reisepass identification fiscal".split()
)
ADDRESS_CUES = frozenset("addr address live lives residence wohnt anschrift adresse wohnhaft habite domicile dirección vive domicilio".split())
#: Words in front of a name that are no part of it.
AHEAD = TITLES | GREETINGS

CUES = PHONE_CUES | ID_CUES | ADDRESS_CUES

_D = "[0-9０-９]"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:[@＠]|\s?\(\s?at\s?\)\s?|\s?\[\s?at\s?\]\s?)"
_DOT = r"(?:\.|\s?\(\s?dot\s?\)\s?|\s?\[\s?dot\s?\]\s?)"
EMAIL = re.compile(
    rf"(?<![\w.+%-])[\w](?:[\w.+%-]*\w)?(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+[A-Za-z]{{2,}})(?![\w@-])", re.I
)

_BEFORE, _AFTER = r"(?<![\w.,/:#@-])", rf"(?![\w@])(?![-./:,]\w)"
_S, _O = r"[ \u00a0]+", r"[ \u00a0]*"
_PHONES = [
    rf"[+＋]{_D}{{1,3}}(?:[ .\-]*\(0\))?(?:[ ./\-]*\(?{_D}{{1,12}}\)?)+",
    rf"00[1-9]{_D}(?:[ ./\-]+{_D}{{1,10}})+",
    rf"\(0{_D}{{1,4}}\)[ ]*{_D}{{3,4}}[ -]*{_D}{{3,4}}",
    rf"\({_D}{{3}}\)[ ]*{_D}{{3}}[ .\-]+{_D}{{4}}",
    rf"(?:1[-. ]+)?{_D}{{3}}(?P<s>[-.]){_D}{{3}}(?P=s){_D}{{4}}",
    rf"0{_D}{{2,4}}[ /]+{_D}{{3,6}}[ -]+{_D}{{3,4}}",
    rf"07{_D}{{3}}[ ]+{_D}{{6}}",
    rf"0{_D}(?P<t>[ .]+){_D}{{2}}(?:[ .]+{_D}{{2}}){{3}}",
    rf"{_D}{{3}}(?P<u>[-. ]){_D}{{3}}(?P=u){_D}{{3}}",
]
PHONE = [re.compile(_BEFORE + p + _AFTER) for p in _PHONES]
#: Shapes that no other number has; and shapes of numbers that authorities issue, those first.
SURE_PHONE, SURE_ID = (0, 1, 2, 3), (0, 1, 2)
_IDS = [
    r"\d{3}-\d{2}-\d{4}",
    r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    rf"[A-Z]{{2}}{_O}\d{{2}}{_O}\d{{2}}{_O}\d{{2}}{_O}[A-D]",
    rf"\d{{3}}{_S}\d{{2}}{_S}\d{{4}}",
    rf"\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}",
    r"\d{6}-\d{4}",
    r"\d{8}[A-Z]",
    r"[A-Z]\d{8}",
    rf"[A-Z]{{2}}{_O}\d{{7}}",
    r"\d{8,11}",
]
ID_SHAPES = [re.compile(_BEFORE + p + _AFTER, re.I) for p in _IDS]

#: Whether any of these shapes is there.
NUMBERS = re.compile(_BEFORE + "(?:" + "|".join(re.sub(r"\(\?P<\w+>", "(", re.sub(r"\(\?P=\w+\)", ".+", p)) for p in _PHONES + _IDS) + ")", re.I)

_NO = r"\d{1,4}(?:[A-Za-z](?!\w)|[ ][A-Za-z](?![\w.]))?"
_W = r"[^\W\d_][\w’'-]*"
ADDRESS = [
    re.compile(p, re.I)
    for p in (
        rf"(?<![\w.,/:-]){_NO}{_S}(?:st\.?{_S})?{_W}(?:{_S}{_W}){{0,2}}?{_S}(?:(?:st|rd|ave|blvd|dr|ln|ct)\.|(?:{STREET_EN})(?![\w.’'-]|-\w)|(?:{STREET_EN})(?=\.(?:\s|$)))",
        rf"(?<![\w.,/:-]){_NO},?{_S}(?:{STREET_FR}){_S}(?:(?:de{_S}la|des|du|de|le|la|les){_S}|de{_S}l[’']|d[’']|l[’'])?{_W}",
        rf"(?<![\w-])(?:{STREET_ES}){_S}(?:{_W}{_S}){{0,5}}?{_W},?{_S}{_NO}(?![\w-])",
    )
]
#: What ends a street's name in front of its number, and that number.
STREET_TAILS = ("str.", *STREET_DE.split("|"))
HOUSE_NUMBER = re.compile(rf"{_NO}(?![\w-])")
#: Where numbers can be: from a digit on, digits and what joins them.
ZONE = re.compile(rf"{_D}[0-9０-９ \u00a0().\-/]{{5,}}")
#: Whether an address may be spelled out, without its sign.
SPELLED = re.compile(r"[(\[]\s?at\s?[)\]]|\sdot\s", re.I)
#: Words that no street name holds between its number and its street word.
FUNCTION = frozenset("the a an of in on at to and or by is are was were for from with".split())
#: What joins a name to a host without making it an address: no sign for a dot, or no last label of letters.
HANDLE = re.compile(r"(?<![\w.+%-])\w[\w.+%-]*[@＠]\w[\w.-]*")
DIGITS = re.compile(rf"{_D}+")
#: Words that a street's name begins with.
STREET_HEADS = tuple(STREET_ES.split("|"))
