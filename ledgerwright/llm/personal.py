"""Personal information in free text: found, validated, and replaced by typed placeholders that keep equal values linked.

Method: format-preserving Feistel pseudonyms. Each mention is parsed and validated in its format; its figures and
letters go through a keyed Feistel permutation of the strings of that format, walked on until the image is as valid as
the value was. So the placeholder shows a possible value of the same format, equal values stay equal in every document,
whatever their notation, and no two become one. Values without such a format (names, mailboxes, streets) get a keyed
token of 128 bits instead. Names are found where the text says that a person is meant; names so found teach a lexicon of
given names and surnames, all of them, which finds them where nothing says so.

One automaton over the literals that every pattern needs runs over a text; patterns look only around its hits.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.runtime import cut

KINDS = ("email", "phone", "id_number", "address", "name", "date")
#: A lexicon of up to this many words is broadcast; a larger one is joined with the words of the texts.
MOST_WORDS = 200_000

# ---------------------------------------------------------------- Feistel


def _round(key: bytes, tweak: str, i: int, half: int, modulus: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{i}|{half}".encode(), "sha256")[:16], "big") % modulus


def _number(text: str) -> tuple[int, int]:
    """(value, modulus) of a string of figures and capitals read as a number of mixed base."""
    value, modulus = 0, 1
    for c in text:
        base, at = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 65)
        value, modulus = value * base + at, modulus * base
    return value, modulus


def _letters(value: int, like: str) -> str:
    out = []
    for c in reversed(like):
        base, first = (10, 48) if c.isdigit() else (26, 65)
        value, at = divmod(value, base)
        out.append(chr(first + at))
    return "".join(reversed(out))


def permute(text: str, key: bytes, tweak: str = "", back: bool = False) -> str:
    """The image of a string of figures and capitals under a keyed permutation of all strings of its pattern; `back`: its preimage.

    Ten rounds of an alternating Feistel network on two halves, added modulo the number of strings of each half.
    """
    if not text:
        return text
    u = len(text) // 2
    (a, m), (b, n) = _number(text[:u]), _number(text[u:])
    tweak = f"{tweak}|{len(text)}"
    for i in range(9, -1, -1) if back else range(10):
        # even rounds change the left half by the right one, odd rounds the right by the left
        if i % 2 == 0:
            f = _round(key, tweak, i, b, m)
            a = (a - f if back else a + f) % m
        else:
            f = _round(key, tweak, i, a, n)
            b = (b - f if back else b + f) % n
    return _letters(a, text[:u]) + _letters(b, text[u:])


def walked(text: str, key: bytes, tweak: str, sort: Callable[[str], int]) -> str:
    """The image under the permutation walked on until it is of the same sort as `text`: a permutation of each sort."""
    want = sort(text)
    image = permute(text, key, tweak)
    while sort(image) != want:
        image = permute(image, key, tweak)
    return image


def _ssn_sort(d: str) -> int:
    """0 if no such number is given out, 1 for social security, 2 for taxpayer numbers."""
    return 0 if d[:3] in ("000", "666") or d[3:5] == "00" or d[5:] == "0000" else 2 if d[0] == "9" else 1


def _ni_sort(t: str) -> int:
    """0 if the last letter isn't one of the four, 1 if the first two are never given out, 2 for a possible number."""
    if t[-1] not in "ABCD":
        return 0
    return 1 if t[0] in "DFIQUV" or t[1] in "DFIOQUV" or t[:2] in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ") else 2


def _american(d: str) -> int:
    return int(len(d) == 10 and d[0] in "23456789" and d[1] != "9" and d[1:3] != "11" and d[3] in "23456789" and d[4:6] != "11")


_SORTS: dict[str, Callable[[str], int]] = {"ssn": _ssn_sort, "ni": _ni_sort, "american": _american, "phone": lambda d: int(d[:1] != "0")}


def _in_place(text: str, tweak: str, key: bytes, keep: int = 0, letters: bool = True) -> str:
    """`text` with its figures (and letters) after the first `keep` permuted where they stand; case and separators stay."""
    marks = [i for i, c in enumerate(text) if c.isascii() and (c.isdigit() or letters and c.isalpha())]
    plain = "".join(text[i] for i in marks).upper()
    sort = _SORTS.get(tweak)
    new = plain[:keep] + (walked(plain[keep:], key, tweak, sort) if sort and len(plain) > keep else permute(plain[keep:], key, tweak))
    out = list(text)
    for i, c in zip(marks, new):
        out[i] = c.lower() if text[i].islower() else c
    return "".join(out)


def _token(text: str, tweak: str, key: bytes) -> str:
    """A keyed token of 128 bits of a text, letter case and blanks set aside."""
    return hmac.digest(key, f"{tweak}|{re.sub(r'\s+', ' ', text).casefold()}".encode(), "sha256").hex()[:32]


# Calling codes of one and of two figures; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(value: str, key: bytes) -> str:
    """A phone number without extension, its national number permuted: calling code and trunk zero stay, so notations link."""
    base = re.split(r",?\s*(?:x|ext|Durch|poste)", value, maxsplit=1)[0].rstrip(" ,")
    digits = re.sub(r"\D", "", base)
    if "+" in base[:2]:
        keep = next((n for n in (1, 2) if digits[:n] in _CODES), 3)
    else:
        keep = 1 if len(digits) == 11 and digits[0] == "1" else 0
    american = digits[:keep] == "1" or keep == 0 and len(digits) == 10 and digits[0] != "0"
    while keep < len(digits) - 1 and digits[keep] == "0":
        keep += 1
    return _in_place(base, "american" if american and len(digits) - keep == 10 else "phone", key, keep, letters=False)


# Names of months.
_MONTHS = "January February March April May June July August September October November December".split()
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def permute_date(text: str, key: bytes) -> str | None:
    """A valid date of 1900 to 2099 in one of four notations as another one in the same notation, equal dates alike; else null.

    2001-02-03, 02/03/2001 or 02.03.2001 (month first unless it can't be), February 3, 2001 and 3 February 2001.
    """
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", text):
        y, mo, d = map(int, m.groups())
        write = lambda t: t.isoformat()
    elif m := re.fullmatch(r"(\d{1,2})([/.])(\d{1,2})\2(\d{4})", text):
        a, sep, b, y = int(m[1]), m[2], int(m[3]), int(m[4])
        mo, d = (b, a) if a > 12 else (a, b)
        write = lambda t: f"{t.day:02d}{sep}{t.month:02d}{sep}{t.year}" if a > 12 else f"{t.month:02d}{sep}{t.day:02d}{sep}{t.year}"
    elif (m := re.fullmatch(r"([A-Z][a-z]+) (\d{1,2}), (\d{4})", text)) and m[1] in _MONTHS:
        y, mo, d = int(m[3]), _MONTHS.index(m[1]) + 1, int(m[2])
        write = lambda t: f"{_MONTHS[t.month - 1]} {t.day}, {t.year}"
    elif (m := re.fullmatch(r"(\d{1,2}) ([A-Z][a-z]+) (\d{4})", text)) and m[2] in _MONTHS:
        y, mo, d = int(m[3]), _MONTHS.index(m[2]) + 1, int(m[1])
        write = lambda t: f"{t.day} {_MONTHS[t.month - 1]} {t.year}"
    else:
        return None
    try:
        n = (date(y, mo, d) - _FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    image = walked(f"{n:05d}", key, "date", lambda x: int(int(x) < _DAYS))
    return write(_FIRST_DAY + timedelta(days=int(image)))


# ---------------------------------------------------------------- formats

_S = r"[ \t  ]*\n?[ \t  ]*"  # blanks, at most one line end
_AT = r"(?:@|\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s@\s)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)"
_EMAIL = re.compile(rf"(?<![\w.+%-])\w[\w.+%'’-]*+{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*{_DOT}[^\W\d_]{{2,}}(?![\w@])")

_SEP = r"[ .\- ]"
_EXT = rf"(?:{_S},?{_S}(?:x|ext\.?|extension|Durchwahl|poste){_S}\d{{1,6}})?"
_PHONES = (
    # North America: +1-999-555-0199, 1 (999) 555-0199, (999) 555-0199, 999.555.0199
    re.compile(rf"(?<![\w.,/+\-])(?:\+?1(?:{_SEP}|\n){{0,2}})?(?:\([2-9]\d\d\)(?:{_SEP}|\n){{0,2}}|[2-9]\d\d[ .\-\n]|(?<=1[ \-.])[2-9]\d\d{_SEP})[2-9]\d\d[ .\-\n]\d{{4}}(?![\w\-])(?!\.\d){_EXT}"),
    # international: + and country code, groups with blanks or hyphens
    re.compile(rf"(?<![\w+])\+[2-9]\d{{0,2}}(?:{_S}(?:\(0?\d{{1,4}}\)|[\-./]?\d{{1,5}})){{2,6}}(?![\w])(?!\.\d){_EXT}"),
    # national with trunk zero
    re.compile(rf"(?<![\w.,/+\-])\(?0\d{{1,4}}\)?(?:(?:{_SEP}|\n)\d{{2,5}}){{2,4}}(?![\w\-])(?!\.\d){_EXT}"),
    # ten figures without a blank, North American numbering
    re.compile(rf"(?<![\w.,/+\-#$€£])[2-9]\d\d[2-9]\d{{6}}(?![\w\-])(?![.,]\d){_EXT}"),
)
# Words before a number that say what it counts, so that it is none of a person or office.
_OTHER = re.compile(r"(?:\b(?:lot|order|file number|file no|identification no|identification number|invoice|account|acct|part|item|series|serial|cusip|isin|sku|batch|contract|policy|claim|case|docket|registration|reference|ref|no|number|nr|po|ticket|version|row|note|section)\b[.:#]?|#)\s*$", re.IGNORECASE)

# What introduces the number of a document of a person.
_SSN_CUE = r"(?:SSN|S\.S\.N\.|[Ss]oc(?:ial|\.)?\s+[Ss]ec(?:urity|\.)?|SOCIAL\s+SECURITY)"
_NI_CUE = r"(?:NINO|NI|N\.I\.|[Nn]ational\s+[Ii]nsurance|NATIONAL\s+INSURANCE)"
_PASS_CUE = r"(?:[Pp]assport|PASSPORT|[Rr]eisepass|[Pp]asseport|[Pp]asaporte)"
_LICENCE_CUE = r"(?:[Dd]riv(?:er['’]?s|ing|er)\s+[Ll]icen[cs]e|DRIV(?:ER['’]?S|ING)\s+LICEN[CS]E|[Ff]ührerschein|[Pp]ermis\s+de\s+conduire|[Pp]ermiso\s+de\s+conducir)"
_NO = r"(?:\s*\(?(?:numbers?|NUMBERS?|nos?\.?|NOS?\.?|Nr\.?|#|№)\)?)?\s*[:#]?\s*(?:is\s+|was\s+)?"
_IDS = (
    re.compile(rf"\b{_SSN_CUE}{_NO}(?P<id>\d{{3}}[ \-\n]?\d{{2}}[ \-\n]?\d{{4}})(?!\d)"),
    re.compile(rf"\b{_NI_CUE}{_NO}(?P<id>[A-Za-z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-Da-d])\b"),
    re.compile(rf"\b{_PASS_CUE}{_NO}(?P<id>[A-Z]{{0,2}}\s?\d{{6,9}}[A-Z]?)\b"),
    re.compile(rf"\b{_LICENCE_CUE}{_NO}(?P<id>[A-Z0-9](?:[A-Z0-9]|[ \-](?=[A-Z0-9])){{5,18}})(?![\w])"),
    # National Insurance numbers are told by their form alone
    re.compile(r"(?<![\w\-])(?P<id>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} \d{2} \d{2} ?[A-D])(?![\w\-])"),
)
_BARE_SSN = re.compile(r"(?<![\w\-])(?P<id>(?!000)\d{3}-(?!00)\d{2}-(?!0000)\d{4})(?![\w\-])")

# Kinds of streets.
_KIND = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Way|Terrace|Ter\.?|Place|Pl\.?|Square|Sq\.?|Parkway|Pkwy\.?|Highway|Hwy\.?|Crescent|Close|Row|Walk|Circle|Gardens|Quay|Mews|Hill)"
_CAP = r"(?:[A-ZÀ-ÖØ-ÞŁ][\w'’\-]*)"
_GAP = rf"(?:,?{_S})"
_UNIT = rf"(?:(?:Suite|Ste\.?|Apt\.?|Apartment|Unit|Floor|Room|Flat|Fl\.?)\s#?\w{{1,6}})"
_ZIP = r"(?:\d{5}(?:-\d{4})?)"
_POST = r"(?:[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})"
_TOWN = rf"(?:{_CAP}(?:[ \n]{_CAP}){{0,3}})"
_TAIL = rf"(?:{_GAP}{_UNIT})?(?:{_GAP}(?:{_TOWN},{_S}[A-Z]{{2}}\s{_ZIP}|{_TOWN}\s{_POST}|{_ZIP}\s{_TOWN}|{_TOWN}(?=[.;)]|\n|$)))?"
_ADDRESSES = (
    re.compile(rf"(?<![\w.,\-/$€£])(?:{_UNIT},?{_S})?\d{{1,5}}[A-Za-z]?{_S}(?:{_CAP}\.?\s){{1,4}}{_KIND}(?![\w])(?!\s(?:store|project|lease|property|site|plant|centre|center)){_TAIL}"),
    re.compile(rf"\b(?:P\.?\s?O\.?\s?Box|PO\s?BOX|P\.O\.\s?BOX|Post Office Box|Postfach|Apartado|Boîte postale|B\.P\.){_S}\d{{1,6}}(?:{_GAP}(?:{_TOWN},{_S}[A-Z]{{2}}\s{_ZIP}|{_TOWN}\s{_POST}|{_ZIP}\s{_TOWN}))?"),
    re.compile(rf"(?<![\w\-])(?!(?:During|Spring|String|Bring)\b)[A-ZÄÖÜ][\wäöüß\-]*(?:weg|straße|strasse|str\.|allee|platz|gasse|ring|damm|ufer|stieg){_S}\d{{1,3}}[a-z]?\b(?:{_GAP}{_ZIP}\s{_TOWN})?"),
    re.compile(rf"(?<![\w.,\-/$€£])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|quai|chemin|allée|impasse|route|cours|square)\s(?:(?:de|du|des|la|le|les|l['’]|d['’])\s?){{0,2}}{_CAP}(?:[\s\-]{_CAP}){{0,3}}(?:{_GAP}{_ZIP}\s{_TOWN})?"),
    re.compile(rf"\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera)\s(?:(?:de|del|la|las|los|el)\s){{0,2}}{_CAP}(?:\s{_CAP}){{0,3}},?\s(?:n\.?º\s?)?\d{{1,4}}\b(?:{_GAP}{_ZIP}\s{_TOWN})?"),
)

# ---------------------------------------------------------------- names

# Titles before a name, particles inside one, and roles after one.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|Sra|Sr|Señor|Señora|Don|Doña|Messrs)\.?"
_PARTICLE = r"(?:(?:van|von|de|der|den|di|da|del|la|le|ter|zu|bin|al)\s)"
_PART = r"(?:[A-ZÀ-ÖØ-ÞŁŽŠ][a-zß-öø-ÿłžšżńćęąőű'’]+)"
_SUR = rf"(?:{_PARTICLE}{{0,2}}(?:[dDO]['’])?{_PART}(?:-{_PART})*)"
_INITIAL = r"(?:[A-ZÀ-ÖØ-Þ]\.)"
_B = r"(?:[ \t ]?\n[ \t]?|[ \t ])"
_GIVEN = rf"(?:(?!{_TITLE}[ \n]){_PART}(?:-{_PART})?|{_INITIAL})"
_FULL = rf"(?:{_GIVEN}(?:{_B}{_INITIAL}){{0,2}}{_B}{_SUR})"
# the same in capitals
_UP = r"(?:[A-ZÀ-ÖØ-ÞŁŽŠ][A-ZÀ-ÖØ-ÞŁŽŠ'’]+)"
_UP_SUR = rf"(?:(?:(?:VAN|VON|DE|DER|DEN|DI|DA|DEL|LA|LE)\s){{0,2}}(?:[DO]['’])?{_UP}(?:-{_UP})*)"
_UP_FULL = rf"(?:(?:{_UP}(?:-{_UP})?|{_INITIAL})(?:{_B}{_INITIAL}){{0,2}}{_B}{_UP_SUR})"
_ROLE = r"(?:(?:Vice\s)?(?:President|Chair(?:man|woman|person)?)|Chief|Corporate|Treasurer|Controller|Secretary|General\sCounsel|Director|Head|Senior|Executive|Managing|(?:reviewing\s)?analyst|auditor|partner|counsel|manager|esq)"
_NAMES = (
    # after a title, also a surname alone
    re.compile(rf"(?<![\w.]){_TITLE}{_B}(?P<n>(?:{_GIVEN}(?:{_B}{_INITIAL}){{0,2}}{_B})?{_SUR})"),
    re.compile(rf"(?<=,)\s*M\.{_B}(?P<n>(?:{_GIVEN}{_B})?{_SUR})(?=\s*,)"),
    # after a signature mark
    re.compile(rf"/s/{_S}(?P<n>{_FULL}|{_UP_FULL}|{_UP_SUR}|{_SUR})"),
    re.compile(rf"(?<![\w.])(?:MR|MRS|MS|DR|PROF|HERR|FRAU)\.?{_B}(?P<n>{_UP_FULL}|{_UP_SUR})(?![\w])"),
    # after words that call for a person
    re.compile(rf"\b(?:presence{_B}of|mailed{_B}to|sent{_B}to|questions(?:{_B}[a-z]+){{0,4}}{_B}to|indemnity{_B}names|names|reviewer|grantee,?|signed{_B}by|prepared{_B}by|attention{_B}of|Attn:?|contact|speak{_B}to|écrire{_B}à|s['’]adresser{_B}à|llame{_B}a|dirigirse{_B}a|Ansprechpartner(?:in)?:?|wenden{_B}Sie{_B}sich{_B}an)[ \n](?P<n>{_FULL})"),
    # before a role, a document number or a way to be reached
    re.compile(rf"(?<![\w&'’.\-])(?P<n>{_FULL})(?=,{_S}{_ROLE}\b|{_S}\((?:SSN|soc|pass|NI\b|nat|driv))"),
)
_SPEAKER = re.compile(rf"(?<![\w&'’.\-])(?P<n>{_FULL}|{_UP_FULL})(?=:{_B})")
_PAIR = re.compile(rf"(?<![\w&'’\-])(?P<g>{_PART}(?:-{_PART})?)(?:{_B}{_INITIAL}){{0,2}}{_B}(?P<s>{_SUR})(?![\w'’&])")
_UP_PAIR = re.compile(rf"(?<![\w&'’\-])(?P<g>{_UP}(?:-{_UP})?|{_INITIAL})(?:{_B}{_INITIAL}){{0,2}}{_B}(?P<s>{_UP_SUR})(?![\w'’&])")
_INVERTED = re.compile(rf"(?<![\w&'’\-])(?P<s>{_SUR}),{_S}(?P<g>{_PART}(?:-{_PART})?)(?![\w'’&])")
_FIRM = re.compile(rf"(?:\s*(?:,\s*{_PART}\s*)*(?:&|and|und|et|y)\s+{_SUR})?,?\s+(?:LLP|LLC|LP|Inc|Corp|Corporation|Company|Co|Ltd|Limited|PLC|plc|GmbH|AG|SA|S\.A\.|KG|Holdings|Group|Industries|Associates|Partners|Brothers|Bank)\b|\s*&\s")


class Lexicon:
    def __init__(self, given: set[str] | frozenset[str], sur: set[str] | frozenset[str]):
        self.given, self.sur = given, sur


NONE = Lexicon(frozenset(), frozenset())

_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞŁŽŠ][\w'’\-]*")
#: six and more figures with nothing but separators between them
_RUN = re.compile(r"[0-9](?:[ .\-()\n\u00a0\u202f]{0,3}[0-9]){5,}")
_BIRTH = re.compile(r"\b(?:[Bb]orn(?:\s+on)?|[Dd]ate\s+of\s+birth|DATE\s+OF\s+BIRTH|DOB|D\.O\.B\.|geboren\s+am|née?\s+le|nacid[oa]\s+el)[:,]?\s+(?P<d>\d{4}-\d\d-\d\d|\d{1,2}[/.]\d{1,2}[/.]\d{4}|[A-Z][a-z]+ \d{1,2}, \d{4}|\d{1,2} [A-Z][a-z]+ \d{4})(?!\d)")

# Literals without one of which a pattern can't match, with how far it reaches before and behind them.
_CUES: dict[str, tuple[tuple[str, ...], int, int]] = {
    "email": (("@", *(f"{b}{gap}{at}" for b in "[({" for gap in ("", " ", "\n", "\t", "\u00a0") for at in ("at", "AT"))), 100, 160),
    "ssn": (("SSN", "S.S.N", "soc", "Soc", "SOCIAL"), 4, 90), "ni": (("NI", "N.I.", "ational", "NATIONAL"), 4, 90), "passport": (("assport", "PASSPORT", "eisepass", "asseport", "asaporte"), 4, 70),
    "licence": (("river", "riving", "DRIV", "ührerschein", "ermis"), 6, 110),
    "street": (tuple("Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Way Terrace Ter Place Pl Square Sq Parkway Pkwy Highway Hwy Crescent Close Row Walk Circle Gardens Quay Mews Hill".split()), 140, 220),
    "box": (("Box", "BOX", "Postfach", "Apartado", "postale", "B.P."), 20, 160), "strasse": (("weg", "straße", "strasse", "str.", "allee", "platz", "gasse", "ring", "damm", "ufer", "stieg"), 60, 120),
    "rue": (("rue", "avenue", "boulevard", "place", "quai", "chemin", "allée", "impasse", "route", "cours", "square"), 16, 200), "calle": (("Calle", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Carrera"), 2, 200),
    "title": (tuple("Mr Ms Miss Mx Dr Prof Sir Herr Frau Mme Mlle Monsieur Madame Sr Señor Don Doña Messrs".split()), 2, 160), "monsieur": (("M.",), 8, 120), "signed": (("/s/",), 0, 160),
    "capital_title": (tuple("MR MS DR PROF HERR FRAU".split()), 2, 160),
    "called": (("presence", "mailed", "sent", "questions", "indemnity", "names", "reviewer", "grantee", "signed", "prepared", "attention", "Attn", "contact", "speak", "écrire", "adresser", "llame", "dirigirse", "Ansprechpartner", "wenden"), 2, 200),
    "role": (tuple("Vice President Chair Chief Corporate Treasurer Controller Secretary General Director Head Senior Executive Managing reviewing analyst auditor partner counsel manager esq".split()), 140, 40),
    "numbered": (("(SSN", "(soc", "(pass", "(NI", "(nat", "(driv"), 140, 12), "speaker": ((":",), 140, 4), "birth": (("orn", "birth", "BIRTH", "DOB", "D.O.B.", "geboren", "né", "nacid"), 10, 60),
}
_NAME_CUES = ("title", "monsieur", "signed", "capital_title", "called", "role", "numbered")
_PATTERNS = {"ssn": (0,), "ni": (1,), "passport": (2,), "licence": (3,)}
_NAME_PATTERNS = {"title": 0, "monsieur": 1, "signed": 2, "capital_title": 3, "called": 4, "role": 5, "numbered": 5}
# whether a literal must stand at the beginning of a word
_INSIDE = frozenset(("email", "strasse", "speaker", "passport", "licence", "ni", "signed", "box", "birth", "numbered", "ssn"))


@lru_cache(4)
def _automaton(groups: tuple[str, ...]) -> ahocorasick.Automaton:
    meant: dict[str, list[str]] = {}
    for g in groups:
        for literal in _CUES[g][0]:
            meant.setdefault(literal, []).append(g)
    made = ahocorasick.Automaton()
    for literal, of in meant.items():
        made.add_word(literal, (len(literal), tuple(of)))
    made.make_automaton()
    return made


def _may(text: str, group: str, a: int, b: int) -> bool:
    """Whether what stands right beside a literal lets its pattern match."""
    if group not in _INSIDE and a and (text[a - 1].isalnum() or text[a - 1] == "_"):
        return False
    if group == "street":
        return not (text[b : b + 1].isalnum()) and any(c.isdigit() for c in text[max(0, a - 110) : a])
    if group == "strasse":
        return any(c.isdigit() for c in text[b : b + 5])
    if group == "rue":
        return any(c.isdigit() for c in text[max(0, a - 8) : a])
    if group == "title":
        return text[b : b + 1] in ". \n\t\u00a0sfnra"
    if group == "role":
        return text[max(0, a - 4) : a].rstrip().endswith(",")
    if group == "speaker":
        return a > 0 and text[a - 1].isalpha() and text[b : b + 1].isspace()
    return True


def _windows(text: str, groups: tuple[str, ...]) -> dict[str, list[tuple[int, int]]]:
    """Of each group the stretches of a text in which its pattern may match."""
    found: dict[str, list[tuple[int, int]]] = {}
    for last, (size, of) in _automaton(groups).iter(text):
        b = last + 1
        for g in of:
            if _may(text, g, b - size, b):
                _, before, behind = _CUES[g]
                lo, hi = max(0, b - size - before), min(len(text), b + behind)
                spans = found.setdefault(g, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
    return found


def _within(pattern: re.Pattern, text: str, spans: list[tuple[int, int]] | None) -> Iterator[re.Match]:
    for lo, hi in spans or ():
        yield from pattern.finditer(text, lo, hi)


def _named(text: str, windows: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Names where the text says that a person is meant."""
    found = {m.span("n") for g, k in _NAME_PATTERNS.items() for m in _within(_NAMES[k], text, windows.get(g)) if not _FIRM.match(text, m.end("n"))}
    return sorted(found)


def _name_spans(text: str, lexicon: Lexicon, windows: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out = _named(text, windows)
    if not lexicon.sur:
        return out
    for m in _within(_SPEAKER, text, windows.get("speaker")):
        words = re.split(r"\s+", m["n"])
        if _surname(words) in lexicon.sur and (_plain(words[0]) in lexicon.given or words[0].endswith(".")):
            out.append(m.span("n"))
    pairs: list[tuple[int, int]] = []
    inverted: list[tuple[int, int]] = []
    at = 0
    given = lexicon.given
    for m in _CAPITAL.finditer(text):
        w, a = m[0], m.start()
        if w in given:
            if text[max(0, a - 3) : a].rstrip().endswith(","):
                for x in _INVERTED.finditer(text, max(0, a - 90), m.end() + 1):
                    if x["g"] in given and x.start("g") == a and _surname(x["s"].split()) in lexicon.sur:
                        inverted.append(x.span())
            if a >= at and (x := _PAIR.match(text, a)) and x["g"] in given and _surname(x["s"].split()) in lexicon.sur and not _FIRM.match(text, x.end("s")):
                pairs.append((a, x.end("s")))
                at = x.end("s")
        elif len(w) > 1 and w.isupper() and _plain(w) in given and (x := _UP_PAIR.match(text, a)) and _plain(x["g"]) in given and _surname(x["s"].split()) in lexicon.sur and not _FIRM.match(text, x.end("s")):
            pairs.append((a, x.end("s")))
    for a, b in inverted:
        if not any(c < a < d for c, d in out):
            out = [x for x in out if not a <= x[0] < b] + [(a, b)]
    return out + pairs


def _surname(words: list[str]) -> str:
    """The key of a surname: its last word, without an elided article."""
    return _plain(re.sub(r"^[dDO]['’]", "", words[-1]))


def _plain(word: str) -> str:
    """A name in capitals as it is written otherwise."""
    return "-".join(p.capitalize() for p in word.split("-")) if len(word) > 1 and word.isupper() else word


def mentions(text: str, lexicon: Lexicon = NONE, dates: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, format) of every mention, in order; of overlapping ones the kind that is surest. `dates`: of birth, too."""
    windows = _windows(text, tuple(_CUES))
    found: set[tuple[int, int, str, str]] = set()
    for m in _within(_EMAIL, text, windows.get("email")):
        if re.search(r"[^\W\d_]", m[0].split("@")[0]):
            found.add((*m.span(), "email", "email"))
    runs = [(max(0, m.start() - 10), min(len(text), m.end() + 48)) for m in _RUN.finditer(text)]
    for form, pattern, spans in zip(("ssn", "ni", "passport", "licence", "ni"), _IDS, (*(windows.get(g) for g in ("ssn", "ni", "passport", "licence")), runs)):
        for m in _within(pattern, text, spans):
            if any(c.isdigit() for c in m["id"]):
                found.add((*m.span("id"), "id_number", form))
    for group, pattern in zip(("street", "box", "strasse", "rue", "calle"), _ADDRESSES):
        for m in _within(pattern, text, windows.get(group)):
            found.add((*m.span(), "address", "address"))
    for pattern in _PHONES:
        for m in _within(pattern, text, runs):
            if not _OTHER.search(text, max(0, m.start() - 26), m.start()) and 8 <= sum(c.isdigit() for c in re.sub(r"(?:x|ext|Durch|poste).*", "", m[0], flags=re.DOTALL)) <= 15:
                found.add((*m.span(), "phone", "phone"))
    for m in _within(_BARE_SSN, text, runs):
        if not _OTHER.search(text, max(0, m.start() - 26), m.start()):
            found.add((*m.span("id"), "id_number", "ssn"))
    if dates:
        found |= {(*m.span("d"), "date", "date") for m in _within(_BIRTH, text, windows.get("birth"))}
    found |= {(a, b, "name", "name") for a, b in _name_spans(text, lexicon, windows)}
    kept: list[tuple[int, int, str, str]] = []
    for x in sorted(found, key=lambda x: (KINDS.index(x[2]) if x[2] != "name" else 9, x[0] - x[1], x[0])):
        if all(x[1] <= k[0] or k[1] <= x[0] for k in kept):
            kept.append(x)
    return sorted(kept)


def placeholder(value: str, kind: str, form: str, key: bytes) -> str:
    """The typed placeholder: permuted within the format where there is one, a keyed token elsewhere."""
    if form == "phone":
        return f"[PHONE {_phone(value, key)}]"
    if form in ("ssn", "ni", "passport", "licence"):
        return f"[ID_NUMBER {_in_place(value, form, key)}]"
    if form == "date" and (image := permute_date(value, key)):
        return f"[DATE {image}]"
    if form == "email":
        value = re.sub(r"\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?", ".", re.sub(r"\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s@\s", "@", value))
    return f"[{kind.upper()} {_token(value, kind, key)}]"


def masked(text: str, found: list[tuple[int, int, str, str]], key: bytes) -> str:
    out, at = [], 0
    for a, b, kind, form in found:
        out += [text[at:a], placeholder(text[a:b], kind, form, key)]
        at = b
    return "".join([*out, text[at:]])


def only_mentions_changed(text: str | None, new: str | None, found) -> bool:
    """Whether a masked text is the text with a placeholder of the right kind for each mention (kind, start_at, end_at), and nothing else."""
    if text is None or new is None:
        return text is new and not len(found)
    at = behind = 0
    for m in found:
        rest = text[at : m["start_at"]]
        mark = re.compile(rf"\[{m['kind'].upper()} [^\]]*\]").match(new, behind + len(rest))
        if not new.startswith(rest, behind) or not mark:
            return False
        at, behind = m["end_at"], mark.end()
    return text[at:] == new[behind:]


# ---------------------------------------------------------------- over tables


def learn(df: DataFrame, text: str = "text") -> DataFrame:
    """word, kind (`g` or `s`): given names and surnames of all texts, from where the text itself says that a person is meant."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            new: set[tuple[str, str]] = set()
            for t in batch["t"]:
                for a, b in _named(t, _windows(t, _NAME_CUES)):
                    words = re.split(r"\s+", t[a:b])
                    if len(words) > 1:
                        new.add((_surname(words), "s"))
                        if words[0][:1].isupper() and not words[0].endswith("."):
                            new.add((_plain(words[0]), "g"))
            new -= seen
            if len(seen) < 500_000:  # what is said again is dropped here or by the distinct below
                seen |= new
            yield pd.DataFrame(sorted(new), columns=["word", "kind"])

    return df.select(F.col(text).alias("t")).where("t <> ''").mapInPandas(names, "word string, kind string").distinct()


def _with_lexicon(src: DataFrame, lexicon: DataFrame) -> DataFrame:
    """src(k, t) with `given` and `sur`: the names of the lexicon among the words of each text, by joins on word and digest."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, w) for d, t in zip(batch["digest"], batch["t"]) for w in {v for c in _CAPITAL.findall(t) for v in (c, _plain(c), _surname([c]))}]
            yield pd.DataFrame(rows, columns=["digest", "word"])

    src = src.withColumn("digest", F.md5("t"))
    said = src.where("t <> ''").select("digest", "t").mapInPandas(words, "digest string, word string").distinct()
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("word")))
    known = said.join(lexicon, "word").groupBy("digest").agg(of("g").alias("given"), of("s").alias("sur"))
    return src.join(known, "digest", "left").select("k", "t", "given", "sur")


def masked_texts(df: DataFrame, secret: bytes, text: str = "text", key: str = "doc_id", dates: bool = False, most_words: int = MOST_WORDS) -> DataFrame:
    """key, masked, mentions (array of kind, start_at, end_at): one row per row of the table.

    `secret` keys the pseudonyms: who has it can undo them. A null text stays null with no mentions, an empty one empty;
    repeated rows come out each and link to each other; whole texts are read; extra columns are ignored, whatever their
    names. start_at counts code points of the text. `dates`: dates of birth are permuted, too.
    A lexicon of more than `most_words` words isn't broadcast but joined with the words of the texts, with the same result.
    """
    if not secret:
        raise ValueError("a secret is needed")
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    lexicon = cut(learn(src, "t"))
    small = lexicon.limit(most_words + 1).count() <= most_words
    if small:
        known = lexicon.collect()
        sent = df.sparkSession.sparkContext.broadcast(Lexicon({r.word for r in known if r.kind == "g"}, {r.word for r in known if r.kind == "s"}))
    else:
        src = _with_lexicon(src, lexicon)

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, *own in batch.itertuples(index=False, name=None):
                names = sent.value if small else Lexicon(*(frozenset(x) if x is not None else frozenset() for x in own))
                found = mentions(t, names, dates) if t else []
                rows.append((k, masked(t, found, secret) if t is not None else None, [{"kind": x[2], "start_at": x[0], "end_at": x[1]} for x in found]))
            yield pd.DataFrame(rows, columns=["k", "masked", "mentions"])

    kind = src.schema["k"].dataType.simpleString()
    return src.mapInPandas(mask, f"k {kind}, masked string, mentions array<struct<kind:string,start_at:int,end_at:int>>").withColumnRenamed("k", key)


def found_mentions(df: DataFrame, secret: bytes, key: str = "doc_id", **columns) -> DataFrame:
    """One row per mention that was replaced: key, kind, start_at."""
    return masked_texts(df, secret, key=key, **columns).select(key, F.explode("mentions").alias("m")).select(key, "m.kind", "m.start_at")
