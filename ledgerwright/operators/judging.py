"""Judging answers against gold ones: numbers present and close, yes or no, and named terms. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances with and without decimals, and the shares of numbers and of terms that must be there.
FINE, COARSE, LEAST_NUMBERS, LEAST_TERMS, MOST_WORDS = 0.01, 0.02, 0.5, 0.6, 25
# Words of a fall, and phrases that deny.
FALL = r"\b(decreas\w*|declin\w*|fell|drop\w*|reduc\w*|lower\w*|down)\b"
DENIAL = r"\b(no|not|did not|does not|do not|cannot|was not|were not|is not|are not|never|neither)\b"


def numbers(text: Column) -> Column:
    """struct<v, d> of the numbers of a text: value, scaled by a word of scale behind it, and its decimals.

    List marks, `FY23`, figures inside words and dashes between words are no numbers; brackets and signs are negative.
    """
    t = F.regexp_replace(F.regexp_replace(text, r"[−–]", "-"), r"(?m)^\s*\d{1,2}[.)]\s+|\bFY\s?\d{2,4}\b|[A-Za-z]+-\d+|\d+-[A-Za-z]+", " ")
    pattern = r"(?<![A-Za-z0-9.,])(\(?-?\$?\s?-?\d[\d,]*(?:\.\d+)?\)?)(?![A-Za-z0-9])\s?(billion|bn|million|mn|thousand)?"
    found = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("s"))

    def value(p: Column) -> Column:
        bare = F.regexp_replace(p["n"], r"[$,()\s-]", "")
        sign = F.when(F.contains(p["n"], F.lit("-")) | (p["n"].startswith("(") & p["n"].endswith(")")), -1.0).otherwise(1.0)
        by = F.when(p["s"].isin("billion", "bn"), 1e9).when(p["s"].isin("million", "mn"), 1e6).when(p["s"] == "thousand", 1e3).otherwise(1.0)
        return F.struct((bare.try_cast("double") * sign * by).alias("v"), F.length(F.regexp_extract(bare, r"\.(\d+)$", 1)).alias("d"))

    return F.filter(F.transform(found, value), lambda p: p["v"].isNotNull())


def is_year(v: Column) -> Column:
    return (v >= 1900) & (v <= 2099) & (v == F.floor(v))


def close(gold: Column, decimals: Column, given: Column) -> Column:
    """Within 1 % of a number with two decimals and more, else 2 %, or half a unit of its last digit; 0 must be 0."""
    room = F.greatest(F.abs(gold) * F.when(decimals >= 2, FINE).otherwise(COARSE), F.when(decimals > 0, 0.5 * F.pow(F.lit(10.0), -decimals)).otherwise(0.0))
    return F.when(gold == 0, F.abs(given) < 1e-9).otherwise(F.abs(gold - given) <= room)


def facts_present(gold: Column, given: Column) -> Column:
    """struct<wanted, found, passes>: whether half of the gold numbers stand in an answer, in its scale or as a percentage.

    Years count only if there is nothing else. A gold answer that speaks of a fall agrees with numbers of either sign.
    """
    every = numbers(gold)
    plain = F.filter(every, lambda p: ~is_year(p["v"]))
    want = F.when(F.size(plain) > 0, plain).otherwise(every)
    have = numbers(given)
    falls = F.lower(gold).rlike(FALL)
    hit = lambda p: F.exists(have, lambda x: close(p["v"], p["d"], x["v"]) | (falls & close(F.abs(p["v"]), p["d"], F.abs(x["v"]))) | ((F.abs(p["v"]) < 1) & close(p["v"] * 100, p["d"], x["v"])))
    found = F.size(F.filter(want, hit))
    return F.struct(F.size(want).alias("wanted"), found.alias("found"), F.when(F.size(want) > 0, found >= F.size(want) * LEAST_NUMBERS).alias("passes"))


def stance(answer: Column) -> Column:
    """`yes` or `no`: the word an answer begins with, else `no` if its first 200 characters deny, else null."""
    low = F.lower(F.trim(answer))
    return F.when(low.rlike(r"^yes\b"), "yes").when(low.rlike(r"^no\b"), "no").when(F.substring(low, 1, 200).rlike(DENIAL), "no")


def terms_present(gold: Column, given: Column) -> Column:
    """Whether 60 % of the named terms of a short gold answer are in an answer, by their first five letters; null without terms or for a long one."""
    words = F.filter(F.split(F.trim(gold), r"\s+"), lambda w: w != "")
    named = F.array_distinct(F.transform(F.filter(F.regexp_extract_all(gold, F.lit(r"([A-Za-z]{4,})"), F.lit(1)), lambda w: w.rlike("^[A-Z]") | (F.length(w) > 6)), lambda w: F.substring(F.lower(w), 1, 5)))
    have = F.transform(F.regexp_extract_all(F.lower(given), F.lit(r"([a-z]{4,})"), F.lit(1)), lambda w: F.substring(w, 1, 5))
    return F.when((F.size(words) <= MOST_WORDS) & (F.size(named) > 0), F.size(F.array_intersect(named, have)) >= F.size(named) * LEAST_TERMS)
