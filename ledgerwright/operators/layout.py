"""Tables from the words of a page: rows, currency signs, column gaps and anchors, headers, and the grid they make.

A page is one group, bounded by what fits on paper; pages are independent, so they spread over all tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from statistics import fmean

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in points: distance of a row's words from its mean top, of a currency sign from its number, of right edges
# of a column, and the least gap between columns; then the share of rows that must agree, and the most value columns.
ROW_TOLERANCE, SIGN_GAP, EDGE_TOLERANCE, LEAST_GAP, DOMINANT, MOST_COLUMNS = 2.0, 20.0, 6.0, 3.0, 0.5, 4
# Words that make a number part of a phrase.
CONNECTORS = frozenset(("and", "to", "or", "through"))
_NUMBER = re.compile(r"[($-]*\d[\d,]*(?:\.\d+)?[)%]*|[-–—]")
_YEAR = re.compile(r"(?:19|20)\d\d")


@dataclass
class Word:
    x0: float
    top: float
    x1: float
    text: str


def clustered(words: list[Word], tolerance: float = ROW_TOLERANCE) -> list[list[Word]]:
    """Words in rows by the running mean of their tops, each row from left to right."""
    rows: list[list[Word]] = []
    mean = 0.0
    for w in sorted(words, key=lambda w: (w.top, w.x0)):
        if rows and abs(w.top - mean) <= tolerance:
            mean += (w.top - mean) / (len(rows[-1]) + 1)
            rows[-1].append(w)
        else:
            rows.append([w])
            mean = w.top
    return [sorted(r, key=lambda w: w.x0) for r in rows]


def signs_joined(row: list[Word], gap: float = SIGN_GAP) -> list[Word]:
    """A currency sign of its own becomes part of the number right of it."""
    out: list[Word] = []
    for w in row:
        if out and out[-1].text == "$" and _NUMBER.fullmatch(w.text) and w.x0 - out[-1].x1 < gap:
            out[-1] = Word(out[-1].x0, w.top, w.x1, "$" + w.text)
        else:
            out.append(w)
    return out


def column_gap(edges: list[float], least: float = LEAST_GAP) -> float:
    """What parts columns: the middle of the largest jump, at least twofold, between the sorted gaps of right edges."""
    ordered = sorted(set(edges))
    gaps = sorted(b - a for a, b in zip(ordered, ordered[1:]) if b - a > 0)
    jumps = [(b / a, (a + b) / 2) for a, b in zip(gaps, gaps[1:]) if b / a >= 2]
    return max(least, max(jumps)[1]) if jumps else least


def numbers_of(row: list[Word]) -> list[Word]:
    """The numbers of a row that aren't part of a phrase."""
    return [w for i, w in enumerate(row) if _NUMBER.fullmatch(w.text) and not (i and row[i - 1].text.lower() in CONNECTORS) and not (i + 1 < len(row) and row[i + 1].text.lower() in CONNECTORS)]


def is_years_row(row: list[Word]) -> bool:
    found = numbers_of(row)
    return len(found) >= 2 and all(_YEAR.fullmatch(w.text) for w in found)


def anchors(rows: list[list[Word]], tolerance: float = EDGE_TOLERANCE) -> list[float]:
    """Right edges that numbers of two rows and more share; no cluster is wider than the tolerance."""
    edges = sorted((w.x1, i) for i, r in enumerate(rows) if len(numbers_of(r)) >= 2 and not is_years_row(r) for w in numbers_of(r))
    clusters: list[list[tuple[float, int]]] = []
    for e in edges:
        if clusters and e[0] - clusters[-1][0][0] <= tolerance:
            clusters[-1].append(e)
        else:
            clusters.append([e])
    return [fmean(x for x, _ in c) for c in clusters if len({i for _, i in c}) >= 2]


def nearest(x: float, found: list[float], tolerance: float = EDGE_TOLERANCE) -> int | None:
    at = min(range(len(found)), key=lambda k: abs(found[k] - x), default=None)
    return at if at is not None and abs(found[at] - x) <= tolerance else None


def dominant_share(rows: list[list[Word]], found: list[float]) -> float:
    """The share of rows with numbers that have the commonest set of columns."""
    shapes = Counter(tuple(k for w in numbers_of(r) if (k := nearest(w.x1, found)) is not None) for r in rows if numbers_of(r) and not is_years_row(r))
    shapes.pop((), None)
    return max(shapes.values()) / sum(shapes.values()) if shapes else 0.0


def grid(words: list[Word]) -> list[tuple[bool, list[str]]]:
    """(is header, cells) of each row of a page's table, label first; empty if the words make none.

    Rows without a number in a column are headers where they name years, else text outside the table.
    """
    rows = [signs_joined(r) for r in clustered(words)]
    found = anchors(rows)
    if not 2 <= len(found) or dominant_share(rows, found) < DOMINANT:
        return []
    headers = [r for r in rows if is_years_row(r)]
    if len(found) > MOST_COLUMNS and not any(len(numbers_of(r)) == len(found) for r in headers):
        return []
    out, data = [], 0
    for r in rows:
        cells = [""] * (len(found) + 1)
        label = []
        for w in r:
            at = nearest(w.x1, found) if _NUMBER.fullmatch(w.text) and w in numbers_of(r) else None
            if at is None or cells[at + 1]:
                label.append(w.text)
            else:
                cells[at + 1] = w.text
        cells[0] = " ".join(label)
        if is_years_row(r):
            out.append((True, cells))
        elif any(cells[1:]):
            out.append((False, cells))
            data += 1
    return out if data >= 2 else []


def tables_of_words(words: DataFrame) -> DataFrame:
    """doc, page, row_ix, is_header, cells of words (doc, page, x0, top, x1, text): the table of each page, by geometry.

    Words without text or place are left out; a page without table gives no row; repeated words are words.
    """

    def read(page: pd.DataFrame) -> pd.DataFrame:
        found = grid([Word(*w) for w in page[["x0", "top", "x1", "text"]].itertuples(index=False, name=None)])
        return pd.DataFrame([(page["doc"].iloc[0], page["page"].iloc[0], i, h, c) for i, (h, c) in enumerate(found)], columns=["doc", "page", "row_ix", "is_header", "cells"], dtype=object)

    clean = words.where("text IS NOT NULL AND trim(text) <> '' AND x0 IS NOT NULL AND x1 IS NOT NULL AND top IS NOT NULL").select("doc", "page", "x0", "top", "x1", F.trim("text").alias("text"))
    return clean.groupBy("doc", "page").applyInPandas(read, "doc string, page string, row_ix int, is_header boolean, cells array<string>")


def set_in_type(decoded: DataFrame, doc: str = "parent_id", page: str = "digest") -> DataFrame:
    """doc, page, x0, top, x1, text: decoded tables as words on a page, labels set left, values right in their columns."""
    rows = decoded.select(F.col(doc).alias("doc"), F.col(page).alias("page"), (F.col("row_ix") + 1).alias("line"), "row").unionByName(
        decoded.groupBy(F.col(doc).alias("doc"), F.col(page).alias("page")).agg(F.first("headers").alias("row")).withColumn("line", F.lit(0))
    )
    cell = rows.select("doc", "page", "line", F.posexplode("row").alias("column", "cell")).where("cell <> ''")
    parts = cell.select("doc", "page", "line", "column", F.length("cell").alias("size"), F.posexplode(F.split("cell", r"\s+")).alias("n", "text"), "cell")
    before = F.length(F.array_join(F.slice(F.split("cell", r"\s+"), 1, F.col("n")), " ")) + F.when(F.col("n") > 0, 1).otherwise(0)
    left = F.when(F.col("column") == 0, 10.0).otherwise(600.0 + 150.0 * F.col("column") - 5.0 * F.col("size")) + 5.0 * before
    return parts.where("text <> ''").select("doc", "page", left.alias("x0"), (12.0 * F.col("line")).alias("top"), (left + 5.0 * F.length("text")).alias("x1"), "text")


# ---------------------------------------------------------------- Markdown tables as arrays


def value_joined(token: Column) -> Column:
    """`$  1,503` as `$1,503`."""
    return F.regexp_replace(token, r"^\$\s+", "$")


def looks_numeric(cell: Column) -> Column:
    """A number as a whole, or more than half of two and more tokens are numbers."""
    number = r"^[($-]*[0-9][0-9,]*(\.[0-9]+)?[)%]*$"
    parts = F.filter(F.split(F.trim(cell), r"\s+"), lambda x: x != "")
    return F.trim(cell).rlike(number) | ((F.size(parts) >= 2) & (F.size(F.filter(parts, lambda x: x.rlike(number))) * 2 > F.size(parts)))


def crowded_share(rows: Column) -> Column:
    """The share of filled cells that hold two and more numbers; null under five cells. A fifth says that columns ran together."""
    filled = F.filter(F.flatten(rows), lambda c: c != "")
    crowded = F.filter(filled, lambda c: F.regexp_count(c, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?")) >= 2)
    return F.when(F.size(filled) >= 5, F.size(crowded) / F.size(filled))


def excerpt(text: Column, rows: int = 10, most: int = 1200) -> Column:
    """A page for display: of its table the header and the first rows, other lines as they are, in all at most so many characters."""
    lines = F.split(text, "\n")
    table = F.filter(lines, lambda x: F.trim(x).startswith("|"))
    prose = F.filter(lines, lambda x: ~F.trim(x).startswith("|") & (F.trim(x) != ""))
    more = F.when(F.size(table) > rows + 2, F.array(F.concat(F.lit("... "), (F.size(table) - rows - 2).cast("string"), F.lit(" more rows")))).otherwise(F.array().cast("array<string>"))
    return F.substring(F.array_join(F.concat(prose, F.slice(table, 1, rows + 2), more), "\n"), 1, most)
