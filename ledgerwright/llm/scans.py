"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

Method: a noisy channel. One pass over all notes counts words, word pairs and line shapes, all of them. The lexicon is
made of the counts by joins: a word whose rarity is explained by a frequent word and a confusion of characters is taken
out, and each token gets the words that one or two confusions may have turned into it (one from either side, meeting in
the middle). A second pass repairs each page: header and page-number lines are lifted out, words broken over line ends
are joined, and Viterbi decodes the doubtful words over their candidates, channel probability times pair likelihood.

A lexicon of up to MOST_ENTRIES words and pairs is broadcast; of a larger one each bucket of notes gets what it needs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.canonical import canonical
from ledgerwright.runtime import broadcast_if_small, cut

#: Words and pairs of a lexicon that is broadcast.
MOST_ENTRIES = 1_000_000
#: A line shape is a running header if this share of the pages with several lines has it, and at least LEAST_PAGES have.
HEADER_SHARE, LEAST_PAGES = 0.002, 3
#: A rarer shape is a running header of a filing if this share of that filing's pages with several lines has it, and at least LEAST_PAGES have.
FILING_SHARE = 0.2
#: A line without the company's name must stand on top or at the end of this share of its filing's pages with several lines.
BARE_SHARE = 0.5
#: A word this many times rarer than the word it would be a misreading of isn't a word of its own.
RATIO = 40.0
KINDS = ("hyphen", "misread", "header", "page_no")

# What is printed, what is read, and how probable the confusion is per occurrence.
CONFUSIONS = (
    ("e", "c", 1e-3), ("c", "e", 2e-4), ("t", "f", 1e-3), ("f", "t", 1e-4), ("n", "ri", 1e-3), ("ri", "n", 1e-4), ("i", "1", 1e-3), ("l", "1", 1e-3), ("a", "o", 1e-3), ("o", "a", 1e-4),
    ("o", "0", 1e-3), ("s", "5", 1e-3), ("g", "9", 1e-3), ("q", "9", 1e-4), ("d", "cl", 1e-3), ("cl", "d", 1e-3), ("u", "ii", 1e-3), ("m", "rn", 1e-3), ("rn", "m", 1e-3), ("h", "li", 1e-3), ("li", "h", 1e-4),
    ("i", "l", 5e-4), ("l", "i", 5e-4), ("w", "vv", 1e-3), ("b", "8", 1e-3), ("b", "6", 1e-3), ("z", "2", 1e-3), ("t", "7", 1e-4), ("f", "l", 1e-4), ("b", "h", 1e-4), ("h", "b", 1e-4),
    ("u", "v", 1e-4), ("v", "u", 1e-4), ("n", "u", 1e-4), ("u", "n", 1e-4), ("nn", "m", 1e-4), ("in", "m", 1e-4), ("e", "o", 1e-4), ("o", "e", 1e-4), ("g", "q", 1e-4), ("q", "g", 1e-4), ("y", "v", 1e-4),
)
# Letters read for figures.
FIGURES = str.maketrans("BbSsOoIlZzgqDQ", "86550011229900")

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
_NUMBER = re.compile(r"(?<![\w.,])(?:US)?\$?([0-9A-Za-z]{1,3}(?:,[0-9A-Za-z]{3})+(?:\.[0-9A-Za-z]+)?|[0-9A-Za-z]+\.[0-9A-Za-z]+|(?<=\$)[0-9A-Za-z]{1,3})(?![\w])%?")
_GROUPED = re.compile(r"(?:\d{1,3}(?:,\d{3})+|\d{1,3})(?:\.\d+)?")
_PAGE = re.compile(r"(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|page \d{1,4}(?: of \d{1,4})?|[a-z]-\d{1,3}|\d{1,3})", re.IGNORECASE)
_BESIDE = re.compile(r"^\s*(\d{1,3})\s{2,}|\s{2,}(?:\|\s*)?(\d{1,3})\s*$")
_BREAK = re.compile(r"(?<![\w'’-])([^\W\d_][\w'’-]*)[-¬‐‑]\s*$")
_BROKEN = ("-", "¬", "‐", "‑")
_END = re.compile(r"[.!?:;。！？]['\"”’)\]¹²³⁴]*\s*$")


@lru_cache(1)
def _reverse() -> dict[str, list[tuple[str, float]]]:
    back: dict[str, list[tuple[str, float]]] = {}
    for printed, read, p in CONFUSIONS:
        back.setdefault(read, []).append((printed, p))
    return back


def _once(word: str) -> Iterator[tuple[str, float, int]]:
    """The words that one confusion may have turned into `word`, the probability, and where the replacement ends."""
    back = _reverse()
    for i in range(len(word)):
        for size in (1, 2):
            for printed, p in back.get(word[i : i + size], ()) if i + size <= len(word) else ():
                yield word[:i] + printed + word[i + size :], p, i + len(printed)


def misreadings(word: str) -> dict[str, float]:
    """What one confusion may make of a word, with the best channel probability."""
    found: dict[str, float] = {}
    for printed, read, p in CONFUSIONS:
        at = word.find(printed)
        while at >= 0:
            x = word[:at] + read + word[at + len(printed) :]
            if x != word:
                found[x] = max(p, found.get(x, 0.0))
            at = word.find(printed, at + 1)
    return found


def readings(word: str, most: int = 2) -> dict[str, float]:
    """Words that up to `most` confusions may have turned into `word`, with the best channel probability."""
    found: dict[str, float] = {}
    front = {word: 1.0}
    for _ in range(most):
        nxt: dict[str, float] = {}
        for w, p in front.items():
            for x, q, _ in _once(w):
                if x != word and p * q > nxt.get(x, 0.0):
                    nxt[x] = p * q
        for x, p in nxt.items():
            found[x] = max(p, found.get(x, 0.0))
        front = nxt
    return found


def _body(text: str) -> tuple[str, str]:
    """(head, page text): the page text follows the words `Content: `."""
    head, sep, body = text.partition("Content: ")
    return (head + sep, body) if sep else ("", text)


# Legal forms after a company's name, and words of running titles.
_FORM = re.compile(r",?\s+(?:Inc|Incorporated|Ltd|Limited|LLC|LLP|PLC|plc|Corp|Corporation|Co|Company|AG|GmbH|SE|S\.?A|N\.?V|KG)\b\.?", re.IGNORECASE)
_TITLE = re.compile(r"(?:19|20)\d\d|annual report|quarterly report|form 10|table of contents|proxy statement", re.IGNORECASE)
_HEADING = re.compile(r"Overview|Note \d+.*|(?:19|20)\d\d", re.IGNORECASE)


def _shape(line: str, company: str) -> str | None:
    """A line's shape if it may be a running header: with the company's name and figures masked, letter case and blanks set aside."""
    if not company or company.lower() not in line.lower():
        return None
    line = re.sub(re.escape(company) + r"(?:\s+\w+)?", "\x00", line.strip(), flags=re.IGNORECASE)
    line = _BESIDE.sub("", re.sub("\x00" + _FORM.pattern, "\x00", line, flags=re.IGNORECASE))
    if _END.search(line) or line.endswith((",", "-", "¬")) or "," in line or ". " in line or line == "\x00":
        return None
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", line)).strip().lower()


def _bare_shape(line: str) -> str | None:
    """The shape of a line without the company's name that may be a running title: it names a year or a kind of report."""
    line = _BESIDE.sub("", line.strip())
    if not _TITLE.search(line) or _HEADING.fullmatch(line) or _PAGE.fullmatch(line) or _END.search(line) or line.endswith((",", "-", "¬")) or ". " in line or line.startswith("|") or len(line.split()) > 12:
        return None
    return "\x01" + re.sub(r"\s+", " ", re.sub(r"\d+", "9", line)).strip().lower()


_MIXED = re.compile(r"[0-9]{1,2}(?![0-9])(?:(?<=[^\W\d_][0-9])|(?<=[^\W\d_][0-9]{2})|(?=[^\W\d_]))")


def _mixed(low: str) -> Iterator[str]:
    """The tokens in which letters touch one or two figures; more can't all be misread letters of a word."""
    for m in _MIXED.finditer(low):
        a = m.start()
        while a and low[a - 1].isalnum():
            a -= 1
        yield _TOKEN.match(low, a)[0]


def _joined(lines: list[str]) -> Iterator[str]:
    """What the halves of words broken over line ends make, whichever of the next lines goes on."""
    for i, line in enumerate(lines):
        if line.rstrip().endswith(_BROKEN) and (m := _BREAK.search(line)):
            for nxt in lines[i + 1 : i + 6]:
                if tail := _WORD.match(nxt.strip()):
                    yield m[1] + tail[0]
                    yield f"{m[1]}-{tail[0]}"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {k: Counter() for k in ("w", "b", "c", "p", "h", "fp", "fh")}

    def flush() -> pd.DataFrame:
        rows = [(kind, " ".join(x) if kind == "b" else x, n) for kind, counter in counts.items() for x, n in counter.items()]
        for counter in counts.values():
            counter.clear()
        return pd.DataFrame(rows, columns=["kind", "item", "n"])

    for batch in batches:
        for text, company, filing in zip(batch["t"], batch["company"], batch["filing"]):
            body = _body(text)[1]
            several = "\n" in body
            if several:
                counts["p"][""] += 1
                if filing:
                    counts["fp"][filing] += 1
                lines = [x for x in body.split("\n") if x.strip()]
                # a line that begins a sentence which the next line continues is text, whatever its shape
                for shape in {s for a, x, b in zip([".", *lines], lines, [*lines[1:], ""]) if (s := _shape(x, company or "")) and not (_END.search(a) and b[:1].islower())}:
                    counts["h"][shape] += 1
                    counts["fh"][f"{filing}\x1f{shape}"] += 1
                for shape in {s for x in (*lines[:1], *lines[-1:]) if (not company or company.lower() not in x.lower()) and (s := _bare_shape(x))}:
                    counts["fh"][f"{filing}\x1f{shape}"] += 1
            low = body.lower()
            for line in low.split("\n") if several else (low,):
                words = _WORD.findall(line)
                if several and words and line.rstrip()[-1:] in "-¬":
                    words.pop()
                counts["w"].update(words)
                counts["b"].update(zip(words, words[1:]))
            counts["c"].update(_mixed(low))
            if several:
                counts["c"].update(_joined(low.split("\n")))
        if len(counts["w"]) + len(counts["b"]) + len(counts["c"]) > 400_000:
            yield flush()
    yield flush()


class Model:
    """Word and pair counts, the candidates of tokens, and header shapes. It may hold what some notes need only."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], headers: set[str], total: int, options: dict[str, list[tuple[str, float]]]):
        self.headers, self.total, self.words, self.pairs, self.options = headers, max(total, 1), words, pairs, options

    def candidates(self, token: str) -> list[tuple[str, float]]:
        """(word, log channel probability) of a lower-case token; itself last, with the likelihood of a word unknown."""
        return [*self.options.get(token, ()), (token, 0.0)]

    def log(self, word: str, before: str | None) -> float:
        n = self.words.get(word, 0)
        p = n / self.total if n else 0.05 / self.total * (1e-6 if any(c.isdigit() for c in word) else 1)
        if before is not None and (m := self.words.get(before)):
            p = 0.3 * p + 0.7 * self.pairs.get(f"{before} {word}", 0) / m
        return math.log(p)

    def decode(self, tokens: list[tuple[str, bool]]) -> list[str]:
        """Viterbi over the candidates of each token of a run of lower-case tokens; tokens that aren't doubtful stand as they are."""
        best: dict[str | None, tuple[float, tuple]] = {None: (0.0, ())}
        for token, doubtful in tokens:
            options = self.candidates(token) if doubtful else [(token, 0.0)]
            nxt: dict[str | None, tuple[float, tuple]] = {}
            for word, channel in options:
                for before, (score, path) in best.items():
                    s = score + channel + self.log(word, before)
                    if word not in nxt or s > nxt[word][0]:
                        nxt[word] = (s, (path, word))
            best = nxt
        path, out = max(best.values(), key=lambda x: x[0])[1], []
        while path:
            path, word = path
            out.append(word)
        return out[::-1]


def _cased(word: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or (like[:1].isdigit() and like[1:2].isupper()) else word


# Characters that tie a token to a code, path or address, in which nothing is corrected.
_CODE = frozenset("_/@#=\\:")


def _coded(text: str, m: re.Match) -> bool:
    """Whether a token is part of a code: tied to its neighbour by one of these characters without a blank."""
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    return before in _CODE or (after in _CODE and bool(text[m.end() + 1 : m.end() + 2].strip()))


def _misread(text: str, model: Model) -> tuple[str, bool]:
    """The text with misread words and numbers corrected, and whether there were any."""
    found = False

    def figures(m: re.Match) -> str:
        nonlocal found
        whole, number = m[0], m[1]
        letters = sum(c.isalpha() for c in number)
        if not letters or letters > 3 or sum(c.isdigit() for c in number) < 2 or whole.rstrip("%").endswith(("bn", "M")):
            return whole
        fixed = number.translate(FIGURES)
        if not _GROUPED.fullmatch(fixed):
            return whole
        found = True
        return whole.replace(number, fixed)

    text = _NUMBER.sub(figures, text)
    # a token without any other reading stays as it is, wherever it stands
    unsafe = set(_TOKEN.findall(text.lower())) & model.options.keys()
    if not unsafe:
        return text, found
    tokens = list(_TOKEN.finditer(text))
    doubtful = {i for i, m in enumerate(tokens) if m[0].lower() in unsafe and not _coded(text, m)}
    changes: list[tuple[int, int, str]] = []
    done = -1
    for i in sorted(doubtful):
        if i <= done:
            continue
        a = i - 1 if i and not _between(text, tokens[i - 1], tokens[i]) else i
        b = i + 1
        while b < len(tokens) and (b in doubtful or b - 1 in doubtful) and not _between(text, tokens[b - 1], tokens[b]):
            b += 1
        for k, word in zip(range(a, b), model.decode([(tokens[k][0].lower(), k in doubtful) for k in range(a, b)])):
            if k in doubtful and word != tokens[k][0].lower():
                changes.append((tokens[k].start(), tokens[k].end(), _cased(word, tokens[k][0])))
        done = b - 1
    if not changes:
        return text, found
    out, at = [], 0
    for s, e, word in changes:
        out += [text[at:s], word]
        at = e
    return "".join([*out, text[at:]]), True


def _between(text: str, a: re.Match, b: re.Match) -> bool:
    """Whether something other than blanks divides two tokens."""
    return bool(text[a.end() : b.start()].strip())


def repair(body: str, company: str, model: Model, own: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """(continuous text, kinds of noise) of one page text; `own` are header shapes of its filing alone. Text without noise that isn't wrapped comes out unchanged."""
    kinds: set[str] = set()
    lines = body.split("\n")
    kept: list[str] = []
    if len(lines) > 1:
        first, *_, last = [x.strip() for x in lines if x.strip()] * 2 or ["", ""]
        for line in lines:
            bare = line.strip()
            if bare and _PAGE.fullmatch(bare):
                kinds.add("page_no")
                continue
            shape = _shape(line, company)
            if (shape is not None and (shape in model.headers or shape in own)) or (shape is None and own and bare and bare in (first, last) and _bare_shape(line) in own):
                kinds.add("header")
                if _BESIDE.search(line.strip()):
                    kinds.add("page_no")
                continue
            kept.append(line)
    else:
        kept = lines
    text_lines = [x for x in kept if x.strip()]
    wrapped = any(not _END.search(x) and not x.lstrip().startswith("|") and y[:1].islower() for x, y in zip(text_lines, text_lines[1:])) or any(x.rstrip().endswith(_BROKEN) and _BREAK.search(x) for x in text_lines[:-1])
    if wrapped:
        parts: list[str] = []
        gap = False
        for line in kept:
            if not line.strip():
                gap = True
                continue
            clean = line.strip()
            if not parts:
                parts.append(clean)
                gap = False
                continue
            last = parts[-1]
            m = _BREAK.search(last) if last.endswith(_BROKEN) else None
            if m and clean[:1].islower():
                tail = _WORD.match(clean)
                whole = (m[1] + tail[0]).lower() if tail else ""
                dashed = f"{m[1]}-{tail[0]}".lower() if tail else ""
                compound = dashed in model.words and whole not in model.words
                if not compound:
                    kinds.add("hyphen")
                parts[-1] = re.sub(r"[-¬‐‑]\s*$", "-" if compound else "", last) + clean
            elif gap and _END.search(last) or re.match(r"[|•]", clean) or (len(parts) == 1 and re.fullmatch(r"Overview|Note \d+|(?:19|20)\d\d", last)):
                parts.append(clean)
            else:
                parts[-1] = f"{last} {clean}"
            gap = False
        out = "\n".join(parts)
    else:
        out = "\n".join(kept)
    fixed, misread = _misread(out, model)
    if misread:
        kinds.add("misread")
        out = fixed
    return (out if kinds or wrapped else body), [k for k in KINDS if k in kinds]


def _notes(df: DataFrame, text: str, key: str, company: str, kind: str, wanted: str) -> DataFrame:
    """k, company, t (canonical), filing, raw (the text where it isn't canonical)."""
    src = df.where(F.col(kind) == wanted).select(F.col(key).alias("k"), F.col(company).alias("company"), F.col(text).alias("raw")).where("raw IS NOT NULL")
    notes = src.select("k", "company", canonical(F.col("raw")).alias("t"), "raw")
    head = F.when(F.contains("t", F.lit("Content: ")), F.substring_index("t", "Content: ", 1)).otherwise("")
    filing = F.concat("company", F.lit("\x1f"), F.regexp_extract(head, r"(?:Document|Report): ([^ |]+)", 1))
    return notes.select("k", "company", "t", filing.alias("filing"), F.when(F.col("raw") != F.col("t"), F.col("raw")).alias("raw"))


def _spelled(words: DataFrame, how: Callable[[str], dict[str, float]], itself: bool) -> DataFrame:
    """item, other, p: every word with what a function makes of it, and itself."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, x, p) for w in batch["item"] for x, p in [*how(w).items(), *([(w, 1.0)] if itself else [])]], columns=["item", "other", "p"])

    return words.select("item").mapInPandas(spell, "item string, other string, p double")


def _once_read(word: str) -> dict[str, float]:
    return readings(word, 1)


def lexicon(words: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words(item, n), options(token, options)) of counted words(item, n) and tokens(item).

    A word explained as a misreading of a much more frequent one is no word. Unknown tokens may be misread twice, known
    words once. Both sides are spelled by one confusion and meet: no list of all words is needed anywhere.
    """
    near = _spelled(words, _once_read, False).join(words, "item").join(words.select(F.col("item").alias("other"), F.col("n").alias("m")), "other")
    explained = near.where(F.col("m") * F.col("p") / 1e-3 > RATIO * F.col("n")).select("item").distinct()
    real = words.join(explained, "item", "left_anti")
    all_tokens = words.select("item").unionByName(tokens.select("item")).distinct()
    # a confusion explains one figure at most, and words have none
    all_tokens = all_tokens.where("regexp_count(item, '[0-9]') <= 2 AND NOT item RLIKE '^[0-9]+$'")
    back = _spelled(all_tokens, _once_read, True).select(F.col("item").alias("token"), "other", "p")
    ahead = _spelled(real, misreadings, True).select(F.col("item").alias("word"), "other", F.col("p").alias("q"))
    steps = (F.col("token") != F.col("other")).cast("int") + (F.col("word") != F.col("other")).cast("int")
    meet = back.join(ahead, "other").where("token <> word").select("token", "word", steps.alias("steps"), (F.col("p") * F.col("q")).alias("p"))
    best = meet.groupBy("token", "word").agg(F.min("steps").alias("steps"), F.max("p").alias("p"))
    known = real.select(F.col("item").alias("token"), F.lit(True).alias("known"))
    best = best.join(known, "token", "left").where("steps = 1 OR known IS NULL")
    return real, best.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("word", "p"))).alias("options"))


def fit(notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, set[str], int, DataFrame]:
    """(words, options, pairs, headers, total, own) of a table k, company, t, filing; `own`(filing, own): header shapes of single filings.

    The headers are bounded by HEADER_SHARE; the rest stays distributed.
    """
    counts = notes.select("t", "company", "filing").mapInPandas(_count, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    counts = cut(counts)  # read several times below: the texts are counted once
    of = lambda k: counts.where(F.col("kind") == k).select("item", "n")
    words, options = lexicon(of("w"), of("c"))
    words, options = cut(words), cut(options)
    totals = {r.kind: r.total for r in counts.where(F.col("kind").isin("w", "p")).groupBy("kind").agg(F.sum("n").alias("total")).collect()}
    headers = {r.item for r in of("h").where(F.col("n") >= max(LEAST_PAGES, HEADER_SHARE * totals.get("p", 0))).collect()}
    at = F.split("item", " ", 2)
    pairs = of("b").select("item", "n", at[0].alias("a"), at[1].alias("z"))
    pairs = pairs.join(words.select(F.col("item").alias("a")), "a").join(words.select(F.col("item").alias("z")), "z").select("item", "n")
    shapes = of("fh").where(F.col("n") >= LEAST_PAGES).withColumn("shape", F.substring_index("item", "\x1f", -1)).where(~F.col("shape").isin(headers))
    shapes = shapes.select(F.expr("left(item, length(item) - length(shape) - 1)").alias("filing"), "shape", "n")
    pages = of("fp").select(F.col("item").alias("filing"), F.col("n").alias("pages"))
    share = F.when(F.col("shape").startswith("\x01"), BARE_SHARE).otherwise(FILING_SHARE)
    own = shapes.join(pages, "filing").where(F.col("n") >= F.col("pages") * share).groupBy("filing").agg(F.collect_set("shape").alias("own"))
    return words, options, cut(pairs), headers, totals.get("w", 0), own


def _mended(k, c: str | None, t: str, own, raw: str | None, model: Model) -> tuple:
    body = _body(t)[1]
    new, kinds = repair(body, c or "", model, frozenset(own) if own is not None else frozenset())
    # a clean page stays as it is, in its own characters
    return k, kinds, _body(raw)[1] if raw is not None and not kinds and new == body else new


def _pairs_of(body: str, model: Model) -> set[str]:
    """The pairs that decoding may ask for, whichever lines go."""
    lines = [x for x in (_TOKEN.findall(line) for line in body.lower().split("\n")) if x]
    met = {p for line in lines for p in zip(line, line[1:])} | {(a[-1], b[0]) for i, a in enumerate(lines) for b in lines[i + 1 : i + 6]}
    for i, line in enumerate(body.lower().split("\n")):
        for x in _joined(body.lower().split("\n")[i : i + 6]) if line.rstrip().endswith(_BROKEN) else ():
            own = _TOKEN.findall(line)
            met |= {(own[-2], x)} if len(own) > 1 else {(a[-1], x) for a in lines}
            met |= {(x, rest[1]) for rest in lines if len(rest) > 1} | {(x, b[0]) for b in lines}
    spell = lambda x: {w for w, _ in model.candidates(x)}
    return {f"{a} {b}" for x, y in met if x in model.options or y in model.options for a in spell(x) for b in spell(y)}


def _by_buckets(notes: DataFrame, words: DataFrame, options: DataFrame, pairs: DataFrame, headers: set[str], total: int, buckets: int, schema: str) -> DataFrame:
    """The repair where the lexicon is too large to broadcast: every bucket of notes meets the entries it asks for."""
    notes = notes.withColumn("bucket", F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int"))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list({(b, x) for b, t in zip(batch["bucket"], batch["t"]) for x in {*_TOKEN.findall(_body(t)[1].lower()), *_joined(_body(t)[1].lower().split("\n"))}}), columns=["bucket", "item"])

    wanted = notes.select("bucket", "t").mapInPandas(asked, "bucket int, item string").distinct()
    spelled = wanted.join(options.withColumnRenamed("token", "item"), "item").select("bucket", "item", "options")
    also = spelled.select("bucket", F.explode("options.word").alias("item")).unionByName(wanted).distinct()
    entry = "bucket int, item string, n long, options array<struct<word:string,p:double>>"
    held = cut(spelled.select("bucket", "item", F.lit(None).cast("long").alias("n"), "options").unionByName(also.join(words, "item").select("bucket", "item", "n", F.lit(None).cast("array<struct<word:string,p:double>>").alias("options"))))

    def model_of(entries: pd.DataFrame) -> Model:
        counted = entries[entries["n"].notna()]
        plain = {i: int(n) for i, n in zip(counted["item"], counted["n"])}
        spelled = entries[entries["options"].notna()]
        return Model({i: n for i, n in plain.items() if " " not in i}, {i: n for i, n in plain.items() if " " in i}, headers, total, {i: _logs(o) for i, o in zip(spelled["item"], spelled["options"])})

    def ask_pairs(mine: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        m = model_of(entries)
        made = {x for t in mine["t"] for x in _pairs_of(_body(t)[1], m)}
        return pd.DataFrame([(int(mine["bucket"].iloc[0]), x) for x in made], columns=["bucket", "item"], dtype=object)

    def mend(mine: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        m = model_of(entries)
        return pd.DataFrame([_mended(*x, m) for x in mine[["k", "company", "t", "own", "raw"]].itertuples(index=False, name=None)], columns=["k", "kinds", "repaired"], dtype=object)

    asking = notes.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(ask_pairs, "bucket int, item string")
    full = held.unionByName(asking.join(pairs, "item").select("bucket", "item", "n", F.lit(None).cast("array<struct<word:string,p:double>>").alias("options"))).select(*(x.split()[0] for x in entry.split(", ")))
    return notes.groupBy("bucket").cogroup(full.groupBy("bucket")).applyInPandas(mend, schema)


def _logs(options) -> list[tuple[str, float]]:
    return [(o["word"], math.log(o["p"])) for o in options]


def repaired(df: DataFrame, text: str = "content", key: str = "ord", company: str = "company", kind: str = "type", wanted: str = "text_note", most_entries: int = MOST_ENTRIES, buckets: int | None = None) -> DataFrame:
    """key, kinds (array), repaired: one row per note; a repaired page text is in canonical characters, a clean one as it was.

    Null texts give no row; an empty page comes out empty; a null company has no running headers; repeated rows come
    out each; tables that are empty give an empty result; other columns are ignored, whatever their names.
    A lexicon of more than `most_entries` isn't broadcast; the notes are then repaired in `buckets` (one per 2,000 notes).
    """
    notes = _notes(df, text, key, company, kind, wanted)
    words, options, pairs, headers, total, own = fit(notes)
    notes = notes.join(broadcast_if_small(own), "filing", "left").select("k", "company", "t", "own", "raw")
    schema = f"k {notes.schema['k'].dataType.simpleString()}, kinds array<string>, repaired string"
    if words.select("item").unionByName(options.select("token").withColumnRenamed("token", "item")).unionByName(pairs.select("item")).limit(most_entries + 1).count() > most_entries:
        return _by_buckets(notes, words, options, pairs, headers, total, buckets or max(200, notes.count() // 2000), schema).withColumnRenamed("k", key)
    local = Model({r.item: r.n for r in words.collect()}, {r.item: r.n for r in pairs.collect()}, headers, total, {r.token: _logs(r.options) for r in options.collect()})
    model = df.sparkSession.sparkContext.broadcast(local)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            yield pd.DataFrame([_mended(*x, m) for x in batch.itertuples(index=False, name=None)], columns=["k", "kinds", "repaired"])

    return notes.mapInPandas(mend, schema).withColumnRenamed("k", key)


def noise(df: DataFrame, key: str = "ord", **columns) -> DataFrame:
    """One row per note and kind of noise found by the repair."""
    return repaired(df, key=key, **columns).select(key, F.explode("kinds").alias("kind"))
