"""Splitting oversized items at natural boundaries.

Method: a text's tokens give offset prefix sums; each token end is a boundary of some strength (paragraph, line,
sentence, clause, word). Of every strength the boundaries form a sorted array, in which a binary search finds the last
one under the limit. The next piece begins up to `overlap` characters earlier, at a word boundary where there is one.
Where a stretch has no boundary at all the cut is hard, but never inside a combining sequence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3_000, 120
#: A stronger boundary is preferred to a later weaker one if the piece is then at least this part full.
LEAST_FILL = 0.5

_TOKEN = re.compile(r"[^\s。！？；，、]*[。！？；，、]*\s*")
_SENTENCE = re.compile(r"(?:[.!?][\"'”’)\]]*\s|[。！？][”’」』）]*\s?)$")
_CLAUSE = re.compile(r"(?:[,;:][\"'”’)\]]*\s|[；，、]\s?)$")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*$")


def _strength(token: str) -> int:
    if "\n" in token:
        return 4 if _PARAGRAPH.search(token) else 3
    if _SENTENCE.search(token[-4:]):
        return 2
    return 1 if _CLAUSE.search(token[-4:]) else 0


def _joined(c: str) -> bool:
    """Whether the character continues the one before it."""
    return bool(unicodedata.combining(c)) or c == "‍" or "︀" <= c <= "️"


def _whole(text: str, at: int, least: int) -> int:
    """The last place at or before `at`, but after `least`, where no combining sequence is divided."""
    i = at
    while i > least + 1 and i < len(text) and (_joined(text[i]) or text[i - 1] == "‍"):
        i -= 1
    return i if i > least + 1 else at


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The (start, end) of each piece, in code points. A text within the limit is one piece, an empty one none.

    Pieces cover the text without a gap, none is longer than `limit`, and each begins 0 to `overlap` characters before
    the end of the one before.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must lie between 0 and half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    tokens = [t for t in _TOKEN.findall(text) if t]
    ends = np.cumsum([len(t) for t in tokens])
    strengths = np.fromiter(map(_strength, tokens), np.int8, len(tokens))
    by_strength = [ends[strengths >= s] for s in (4, 3, 2, 1, 0)]
    out, start = [], 0
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        end = 0
        for k, cuts in enumerate(by_strength):
            i = int(np.searchsorted(cuts, start + limit, side="right"))
            least = start + overlap if k == len(by_strength) - 1 else start + limit * LEAST_FILL
            if i and cuts[i - 1] > least:
                end = int(cuts[i - 1])
                break
        end = end or _whole(text, start + limit, start + overlap)
        out.append((start, end))
        i = int(np.searchsorted(ends, end - overlap, side="left"))
        again = int(ends[i]) if i < len(ends) and ends[i] < end else end - overlap
        while again < end and (_joined(text[again]) or text[again - 1] == "‍"):
            again += 1
        start = max(again, start + 1)


def split_oversized(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("ord", "page_number"), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the texts longer than `limit`: the key columns, then piece (from 1), pieces, start_at, end_at, piece_text.

    Sizes are code points of the text as stored. Texts within the limit, null and empty ones give no rows; repeated
    rows give their pieces each; a null key is carried along. Columns other than the keys are not, whatever their
    names; keys named like an output column are refused. Only oversized texts leave the JVM; no shuffle.
    """
    made = ("piece", "pieces", "start_at", "end_at", "piece_text")
    if clash := set(made) & set(keys):
        raise ValueError(f"key columns named like output columns: {sorted(clash)}")
    src = df.where(F.length(text) > limit).select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text"), "piece int, pieces int, start_at int, end_at int, piece_text string"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch.pop("_text")
            found = [spans(t, limit, overlap) for t in whole]
            counts = [len(f) for f in found]
            out = batch.iloc[np.repeat(np.arange(len(batch)), counts)].reset_index(drop=True)
            flat = [(k + 1, len(f), a, b, t[a:b]) for t, f in zip(whole, found) for k, (a, b) in enumerate(f)]
            yield pd.concat([out, pd.DataFrame(flat, columns=list(made))], axis=1)

    return src.mapInPandas(cut, schema)


def oversized(df: DataFrame, key: str = "ord", **kw) -> DataFrame:
    """The keys of the items that came out in more than one piece."""
    return split_oversized(df, keys=(key,), **kw).where("piece = 1 AND pieces > 1").select(key)
