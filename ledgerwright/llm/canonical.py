"""Visually identical text with different characters: one canonical form per look.

Method: a quick-check class isolates the unstable segments of a text (blank-delimited runs that hold a character
which is not canonical, or which can compose with its neighbour). Only they are normalised, each with the whole run
as boundary context, and spliced back into the untouched rest. Stable texts never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwright.runtime import cut

# Letters of other alphabets that are drawn like a Latin letter (public confusables data, letters only).
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "ι": "i",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Օ": "O", "Ս": "U", "օ": "o", "ո": "n", "ս": "u", "հ": "h",
}
# Characters without a look of their own, beside the default-ignorable format characters.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# Hyphens drawn like the plain one, and line-end conventions.
PLAIN = {"‐": "-", "‑": "-", " ": "\n", " ": "\n", "\u0085": "\n"}
SOFT_HYPHEN = "­"


def _code_points():
    """All code points that carry a decomposition or format property."""
    yield from range(0x80, 0xD800)
    yield from range(0xE000, 0x20000)
    yield from range(0x2F800, 0x2FA20)
    yield from range(0xE0100, 0xE01F0)


@lru_cache(1)
def _tables() -> tuple[dict[int, str], list[tuple[int, int]]]:
    """(map by code point, ranges of unstable characters), derived from the Unicode properties."""
    plain: dict[int, str] = {}
    unstable: set[int] = set(map(ord, LOOKALIKES)) | set(map(ord, INVISIBLE)) | set(map(ord, PLAIN))
    for c in _code_points():
        ch = chr(c)
        kind = unicodedata.decomposition(ch)
        if kind.startswith(("<wide>", "<narrow>", "<compat>")):
            if kind.startswith("<compat>") and not 0xFB00 <= c <= 0xFB06 and c != 0x2126:
                continue  # of the compatibility forms only the joined letters look like their parts
            plain[c] = unicodedata.normalize("NFKC", ch)
        elif unicodedata.category(ch) == "Zs":
            plain[c] = " "
        elif 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            plain[c] = ""  # variation selectors
        elif kind and not kind.startswith("<"):
            parts = kind.split()
            if len(parts) == 2:
                unstable.add(int(parts[1], 16))  # may compose with what stands before it
            if unicodedata.normalize("NFC", ch) != ch:
                unstable.add(c)
        elif unicodedata.combining(ch) or 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2:
            unstable.add(c)
    plain |= {ord(c): "" for c in INVISIBLE} | {ord(a): b for a, b in PLAIN.items()}
    unstable = {c for c in unstable | plain.keys() if c >= 0x80}
    ranges: list[list[int]] = []
    for c in sorted(unstable):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return plain, [(a, b) for a, b in ranges]


def _class(java: bool) -> str:
    form = (lambda c: f"\\x{{{c:x}}}") if java else (lambda c: f"\\U{c:08x}")
    body = "".join(form(a) if a == b else f"{form(a)}-{form(b)}" for a, b in _tables()[1])
    return f"[[^\\x00-\\x7f]&&[{body}]]" if java else f"[{body}]"


def unstable(text: Column) -> Column:
    """Whether the quick check fails: JVM-side, one pass, ASCII characters are decided by one comparison."""
    return text.rlike(_class(True)) | text.contains("\r")


@lru_cache(1)
def _unstable() -> re.Pattern:
    return re.compile(_class(False))


_BLANK = re.compile(r"[ \t\n]")


@lru_cache(1)
def _letters() -> tuple[re.Pattern, dict[int, str], dict[str, dict[int, str]]]:
    latin = {ord(a): b for a, b in LOOKALIKES.items()}
    back: dict[str, dict[int, str]] = {"GREEK": {}, "CYRILLIC": {}, "ARMENIAN": {}}
    for a, b in LOOKALIKES.items():
        back[unicodedata.name(a).split()[0]].setdefault(ord(b), a)
    return re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*"), latin, back


def _word(m: re.Match) -> str:
    """A word of one look: Latin where every foreign letter has a Latin look, else wholly in its own alphabet."""
    word = m[0]
    if word.isascii():
        return word
    _, latin, back = _letters()
    own = {unicodedata.name(c, "?").split()[0] for c in word if ord(c) not in latin and c.isalpha() and not c.isascii()}
    for script in own & back.keys():
        if not any(c.isascii() and ord(c) not in back[script] for c in word):
            return word.translate(back[script])
    return word.translate(latin)


def _segment(run: str) -> str:
    run = run.translate(_tables()[0])
    run = unicodedata.normalize("NFD", run)
    if not run.isascii():
        run = _letters()[0].sub(_word, run)
    return unicodedata.normalize("NFC", run)


def canonical_text(text: str) -> str:
    """The canonical form of one text. A soft hyphen at a line end is drawn as a hyphen, elsewhere it isn't drawn."""
    if SOFT_HYPHEN in text:
        text = re.sub(SOFT_HYPHEN + r"(?=[​-‏⁠﻿]*(?:\r\n?|\n))", "-", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, at = [], 0
    while m := _unstable().search(text, at):
        # the segment: the whole blank-delimited run around the unstable character
        start = max(at, *(text.rfind(blank, at, m.start()) + 1 for blank in " \t\n"))
        end = stop.start() if (stop := _BLANK.search(text, m.end())) else len(text)
        out += [text[at:start], _segment(text[start:end])]
        at = end
    return "".join([*out, text[at:]]) if out else text


@F.pandas_udf(T.StringType())
def _canonical_udf(text: pd.Series) -> pd.Series:
    return text.map(canonical_text, na_action="ignore")


def canonical(text: Column) -> Column:
    """Canonical form of a string column: null stays null, empty stays empty, whole texts, idempotent.

    Only texts that fail the quick check are sent to Python; of the others a null is.
    """
    fixed = _canonical_udf(F.when(unstable(text), text))
    return F.coalesce(fixed, text)


def canonical_form(df: DataFrame, text: str = "content", key: str = "ord", out: str = "canonical") -> DataFrame:
    """One row per input row: key, `text`, `out`. Other columns, whatever they are called, are not carried along."""
    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return src.select(F.col("_k").alias(key), F.col("_t").alias(text), canonical(F.col("_t")).alias(out))


def same_look_pairs(df: DataFrame, text: str = "content", key: str = "ord") -> DataFrame:
    """Pairs (a, b), a < b, of rows that look the same although their characters differ.

    Rows meet on a 128-bit digest of the canonical form, so no text is shuffled. Looks written in only one way are
    removed before any pair is made: the rows of a look are first reduced to its spellings (map-side), so exact copies
    alone never meet. Pairs are made of the distinct spellings of a look first, then of the rows of the two spellings,
    so rows of one spelling never meet, however many they are. Nulls pair with nothing; empty tables give an empty table; a key that repeats gives its pairs once.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & F.col("k").isNotNull())
    rows = src.select("k", F.unhex(F.md5(F.encode(canonical(F.col("t")), "UTF-8"))).alias("look"), F.unhex(F.md5(F.encode("t", "UTF-8"))).alias("spelling"))
    rows = cut(rows)  # read twice below: the texts are canonicalised once
    several = rows.groupBy("look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("look")
    held = rows.join(several, "look", "left_semi")
    spelled = held.select("look", "spelling").distinct()
    meet = spelled.withColumnRenamed("spelling", "s_a").join(spelled.withColumnRenamed("spelling", "s_b"), "look").where("s_a < s_b")
    a, b = (held.select("look", F.col("spelling").alias(f"s_{x}"), F.col("k").alias(f"k_{x}")) for x in "ab")
    pairs = meet.join(a, ["look", "s_a"]).join(b, ["look", "s_b"]).where("k_a <> k_b")
    return pairs.select(F.least("k_a", "k_b").alias(f"{key}_a"), F.greatest("k_a", "k_b").alias(f"{key}_b"))
