"""Quantities in different units: every stated value in one common unit per measure.

Method: a multi-pattern automaton over all aliases of measures, units and scales runs once over a text; of hits that
overlap the longest stands. Units are read beside a number, else from the row's own unit cell, the bracket of its label
or the caption of its table; a unit counts only if it measures what the named measure is (field context). The factors
are a table of the aliases' units, joined by broadcast: it is as large as the alias list, whatever the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.runtime import cut

# The measures of the operating data and what they measure.
MEASURES = {
    "Electricity used": "energy", "Selling area": "area", "Fuel burned": "volume", "Dividend per share": "money", "Capital commitments": "money",
    "Freight carried": "mass", "Fleet distance": "length", "Average borrowing rate": "rate", "Customer deposits": "money", "Order backlog": "money",
}
# Unit, dimension, factor to the common unit (kWh, square metre, litre, US dollar, kilogram, kilometre, percent), aliases.
UNITS = (
    ("kWh", "energy", 1.0, ("kwh", "kilowatt hour", "kilowatt hours", "kilowatt-hours")),
    ("MWh", "energy", 1e3, ("mwh", "megawatt hours", "megawatt-hours")),
    ("GWh", "energy", 1e6, ("gwh", "gigawatt hours", "gigawatt-hours")),
    ("TWh", "energy", 1e9, ("twh", "terawatt hours")),
    ("MJ", "energy", 1 / 3.6, ("mj", "megajoule", "megajoules")),
    ("GJ", "energy", 1e3 / 3.6, ("gj", "gigajoule", "gigajoules")),
    ("TJ", "energy", 1e6 / 3.6, ("tj", "terajoule", "terajoules")),
    ("m2", "area", 1.0, ("m2", "sq m", "sqm", "square metre", "square metres", "square meter", "square meters")),
    ("ft2", "area", 0.09290304, ("ft2", "sq ft", "sq. ft.", "sqft", "square foot", "square feet")),
    ("km2", "area", 1e6, ("km2", "square kilometres", "square kilometers")),
    ("acre", "area", 4046.8564224, ("acre", "acres")),
    ("ha", "area", 1e4, ("ha", "hectare", "hectares")),
    ("litre", "volume", 1.0, ("l", "litre", "litres", "liter", "liters")),
    ("gallon", "volume", 3.785411784, ("gal", "gallon", "gallons", "us gallon", "us gallons")),
    ("barrel", "volume", 42 * 3.785411784, ("bbl", "bbls", "barrel", "barrels")),
    ("m3", "volume", 1e3, ("m3", "cubic metre", "cubic metres", "cubic meter", "cubic meters")),
    ("kg", "mass", 1.0, ("kg", "kilogram", "kilograms")),
    ("lb", "mass", 0.45359237, ("lb", "lbs", "pound", "pounds")),
    ("tonne", "mass", 1e3, ("t", "tonne", "tonnes", "metric ton", "metric tons", "metric tonnes")),
    ("short ton", "mass", 907.18474, ("short ton", "short tons", "ton", "tons")),
    ("long ton", "mass", 1016.0469088, ("long ton", "long tons")),
    ("km", "length", 1.0, ("km", "kilometre", "kilometres", "kilometer", "kilometers")),
    ("metre", "length", 1e-3, ("m", "metre", "metres", "meter", "meters")),
    ("mile", "length", 1.609344, ("mi", "mile", "miles")),
    ("dollar", "money", 1.0, ("$", "us$", "usd", "dollar", "dollars", "us dollar", "us dollars")),
    ("cent", "money", 0.01, ("cent", "cents", "us cents")),
    ("percent", "rate", 1.0, ("%", "percent", "per cent", "percentage points")),
    ("basis point", "rate", 0.01, ("bp", "bps", "basis point", "basis points")),
)
# Scales.
SCALES = {"thousand": 1e3, "thousands": 1e3, "thousands of": 1e3, "k": 1e3, "million": 1e6, "millions": 1e6, "millions of": 1e6, "m": 1e6, "mn": 1e6, "billion": 1e9, "billions": 1e9, "billions of": 1e9, "b": 1e9, "bn": 1e9}

_NUMBER = re.compile(r"(?<![\w.,])\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|(?<![\w.,])\(?-?\d+(?:\.\d+)?\)?|(?<=[$])\d[\d,]*(?:\.\d+)?")
_YEAR = re.compile(r"(?:19|20)\d\d")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+(?=[A-Z\"“])|\n\s*\n")
_CELL_YEAR = re.compile(r"^(?:FY|Fiscal(?: year)?|Year)?\s*((?:19|20)\d\d)\s*:\s*(.*)$", re.IGNORECASE | re.DOTALL)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    meanings: dict[str, list] = {}
    for name in MEASURES:
        meanings.setdefault(name.lower(), []).append(("measure", name, None))
    for unit, dimension, _, aliases in UNITS:
        for alias in aliases:
            meanings.setdefault(alias, []).append(("unit", unit, dimension))
    for alias, by in SCALES.items():
        meanings.setdefault(alias, []).append(("scale", alias, by))
    for alias, what in meanings.items():
        a.add_word(alias, (len(alias), what))
    a.make_automaton()
    return a


def _hits(text: str) -> list[tuple[int, int, list]]:
    """(start, end, meanings) of the aliases that stand as words of their own; of overlapping ones the longest."""
    low, found = text.lower(), []
    for last, (size, what) in _automaton().iter(low):
        a, b = last - size + 1, last + 1
        word = low[a].isalpha()
        if (word and a and low[a - 1].isalpha()) or (low[b - 1].isalnum() and b < len(low) and low[b].isalnum() and not (low[b - 1] == "$")):
            continue
        found.append((a, b, what))
    found.sort(key=lambda h: (h[0] - h[1], h[0]))
    kept: list[tuple[int, int, list]] = []
    for h in found:
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return sorted(kept)


def _unit_of(text: str, dimension: str) -> tuple[str | None, float]:
    """(unit, scale) that a phrase such as `in USD millions` or `thousand tonnes` names for a dimension."""
    unit, scale = None, 1.0
    for _, _, what in _hits(text):
        for kind, name, extra in what:
            if kind == "unit" and extra == dimension:
                unit = unit or name
                break
        else:
            scale *= next((extra for kind, _, extra in what if kind == "scale"), 1.0)
    return unit, scale


def _amount(text: str) -> float | None:
    m = _NUMBER.search(text)
    if not m:
        return None
    v = m[0]
    negative = v.startswith("(") and v.endswith(")") or v.lstrip("(").startswith("-")
    return (-1 if negative else 1) * float(re.sub(r"[^\d.]", "", v))


def _beside(text: str, a: int, b: int, dimension: str, hits: list) -> tuple[str | None, float, str | None]:
    """Unit, scale and any unit's name next to the number text[a:b]: a chain of aliases after it, a sign or code before."""
    unit, scale, other, at = None, 1.0, None, b
    chain = True
    while chain:
        chain = False
        for s, e, what in hits:
            if s >= at and not text[at:s].strip() and s - at <= 1:
                own = next((n for k, n, d in what if k == "unit" and d == dimension), None)
                by = next((x for k, _, x in what if k == "scale"), None)
                if own and unit is None:
                    unit = own
                elif by is not None and unit is None:
                    scale *= by
                elif any(k == "unit" for k, _, _ in what):
                    other = what[0][1]
                    break
                else:
                    break
                at, chain = e, True
                break
    for s, e, what in hits:
        if e <= a and not text[e:a].strip() and a - e <= 1:
            own = next((n for k, n, d in what if k == "unit" and d == dimension), None)
            unit = unit or own
            other = other or (None if own else next((n for k, n, _ in what if k == "unit"), None))
    return unit, scale, other


def _row(text: str) -> list[tuple[str, int, float, str, float]]:
    """Statements of a linearised table row: a value per year cell; units from the cell, else from the row, label or caption."""
    label, cells, notes = None, [], []
    for cell in text.split(" | "):
        if m := _CELL_YEAR.match(cell.strip()):
            cells.append((int(m[1]), m[2]))
        elif cell.startswith("Line Item:"):
            label = cell[10:].strip()
        elif re.match(r"Units?:|Table:|Caption:", cell):
            notes.append(cell)
    if label is None:
        return []
    measure = next((n for _, _, what in _hits(label) for k, n, _ in what if k == "measure"), None)
    if measure is None:
        return []
    dimension = MEASURES[measure]
    around = [_unit_of(re.sub(r"^\w+:", "", n), dimension) for n in sorted(notes, key=lambda n: not n.startswith("Unit"))]
    around.insert(0, _unit_of(label[len(measure) :], dimension))
    default = next((u for u in around if u[0]), (None, 1.0))
    out = []
    for year, cell in cells:
        value = _amount(cell)
        unit, scale = _unit_of(_NUMBER.sub(" ", cell), dimension)
        if unit is None or (default[0] and unit == default[0] and scale == 1.0):
            unit, scale = default[0], default[1] * scale
        if value is not None and unit:
            out.append((measure, year, value, unit, scale))
    return out


def _prose(text: str) -> list[tuple[str, int, float, str, float]]:
    """Statements of prose: in a sentence that names a measure, the number nearest to it whose unit fits, and the year named."""
    out = []
    for sentence in _SENTENCE.split(text):
        hits = _hits(sentence)
        for s, e, what in hits:
            for kind, measure, _ in what:
                if kind != "measure":
                    continue
                dimension, best, years = MEASURES[measure], None, []
                for m in _NUMBER.finditer(sentence):
                    unit, scale, other = _beside(sentence, m.start(), m.end(), dimension, hits)
                    far = min(abs(m.start() - e), abs(s - m.end()))
                    if unit is None:
                        if not other and scale == 1.0 and _YEAR.fullmatch(m[0]):
                            years.append((far, int(m[0])))
                        continue
                    if best is None or far < best[0]:
                        best = (far, _amount(m[0]), unit, scale)
                years += [(min(abs(m.start() - e), abs(s - m.end())), int(m[1])) for m in re.finditer(r"\bFY\s?((?:19|20)\d\d)\b", sentence)]
                if best and years:
                    out.append((measure, min(years)[1], best[1], best[2], best[3]))
    return out


def stated(text: str) -> list[tuple[str, int, float, str, float]]:
    """(measure, year, number, unit, scale) of every value a passage states of the known measures."""
    text = unicodedata.normalize("NFKC", text)
    if "Line Item:" in text:
        return _row(text)
    return _prose(text.split("Content: ", 1)[-1])


def factors(spark: SparkSession) -> DataFrame:
    """unit, dimension, factor: one row per known unit."""
    return spark.createDataFrame([u[:3] for u in UNITS], "unit string, dimension string, factor double")


def common_values(df: DataFrame, text: str = "content", key: str = "ord", company: str = "company", section: str = "section", wanted: str | None = "operating_data") -> DataFrame:
    """key, company, measure, fiscal_year, value: one row per value stated, in the measure's common unit.

    Only passages of the wanted section are read (pushed to the scan). Null or empty texts, texts without a known
    measure, year, number or unit give no row; a passage that repeats gives its rows again; a null company stays null.
    Other columns are ignored, whatever their names. One scan, one broadcast of the factors, no shuffle.
    """
    src = df.where(F.col(section) == wanted) if wanted is not None else df
    src = src.select(F.col(key).alias("_k"), F.col(company).alias("company"), F.col(text).alias("_t")).where("_t IS NOT NULL")
    kind = src.schema["_k"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, c, *s) for k, c, t in batch.itertuples(index=False, name=None) for s in stated(t)]
            yield pd.DataFrame(rows, columns=["_k", "company", "measure", "fiscal_year", "number", "unit", "scale"])

    found = src.mapInPandas(read, f"_k {kind}, company string, measure string, fiscal_year int, number double, unit string, scale double")
    found = found.join(F.broadcast(factors(df.sparkSession)), "unit")
    return found.select(F.col("_k").alias(key), "company", "measure", "fiscal_year", (F.col("number") * F.col("scale") * F.col("factor")).alias("value"))


def contradictions(df: DataFrame, key: str = "ord", tolerance: float = 0.02, **columns) -> DataFrame:
    """Pairs of passages, a < b, that state a measure of a company and year with values further apart than the tolerance.

    Values are put into logarithmic buckets narrower than the tolerance. Per company, measure and year the buckets are
    first reduced to the distinct ones (map-side); only different buckets that can be far enough apart are paired, and
    the passages join by their bucket. So passages that agree are never compared, however many they are, and a hot
    company spreads over its measures, years and buckets. A null company states nothing comparable.
    """
    step = 1 + tolerance / 2
    v = F.col("value")
    bucket = F.when(v == 0, F.lit(-(2**40))).otherwise(F.floor(F.log(step, F.abs(v))) * 2 + F.when(v < 0, 1).otherwise(0))
    said = common_values(df, key=key, **columns).where("company IS NOT NULL").select(F.col(key).alias("k"), F.xxhash64("company", "measure", "fiscal_year").alias("g"), "company", "measure", "fiscal_year", "value", bucket.cast("bigint").alias("b"))
    group = ["g", "company", "measure", "fiscal_year"]
    said = cut(said)  # read several times below: the texts are parsed once
    several = said.groupBy(*group).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select(*group)
    said = said.join(several, group, "left_semi")
    buckets = said.select(*group, "b").distinct()
    meet = buckets.withColumnRenamed("b", "b_a").join(buckets.withColumnRenamed("b", "b_b"), group).where("b_a <> b_b")
    a = said.select(*group, F.col("b").alias("b_a"), F.col("k").alias("k_a"), F.col("value").alias("v_a"))
    b = said.select(*group, F.col("b").alias("b_b"), F.col("k").alias("k_b"), F.col("value").alias("v_b"))
    pairs = meet.join(a, [*group, "b_a"]).join(b, [*group, "b_b"])
    far = F.abs(F.col("v_a") - F.col("v_b")) > tolerance * F.greatest(F.abs("v_a"), F.abs("v_b"))
    return pairs.where((F.col("k_a") < F.col("k_b")) & far).select(F.col("k_a").alias(f"{key}_a"), F.col("k_b").alias(f"{key}_b")).distinct()
