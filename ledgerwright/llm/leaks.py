"""Evaluation texts leaking into training text.

Method: latent semantic retrieval. All documents are read as passages of words; a randomised SVD of their TF-IDF matrix,
distributed as sums of small dense blocks, gives a latent space, in which every passage is compared by cosine with the
passages of all items. For the candidates a longest common subsequence aligns the item with the document, and the answer
check wants every figure, year and company in the aligned run to be the item's own.

The space is hashed, so its size and everything sent to the driver or broadcast is fixed: FEATURES x RANK numbers. Items
are taken MOST_ITEMS at a time, each block with a space of its own, so their number isn't bounded.

A leak must hold an own mark of its item (company, figure or year), so a passage is compared with the items whose marks
stand near it, not with all: an inverted list instead of all pairs. That leaves nothing out, as the answer check wants a mark.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.runtime import broadcast_if_small, cut

FEATURES, RANK, OVERSAMPLE = 1 << 14, 96, 16
#: Words of a passage, and of the step from one to the next. Any run of WINDOW - STEP words lies within one passage.
WINDOW, STEP = 32, 16
ITEM_WINDOW, ITEM_STEP = 20, 5
LEAST_COSINE = 0.6
LEAST_RUN, EDIT_SHARE = 15, 1 / 7
#: Items that are looked for at a time.
MOST_ITEMS = 50_000

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def tokens(text: str) -> list[str]:
    """Words and figures, whatever their case, spacing, punctuation and character form."""
    return _TOKEN.findall(_lower(text))


class Words:
    """Texts as arrays of features and marks. What a word between blanks holds is looked up once: tokens never span blanks.

    A figure has the feature FEATURES, which weighs nothing. `own` numbers the tokens that are marks, from 1; others have 0.
    """

    def __init__(self, own: dict[str, int] | None = None):
        self.own = own or {}
        self._clear()

    def _clear(self) -> None:
        self.code = _Codes(self._add)
        self.flat, self.marks, self.start = array("q"), array("q"), array("q", [0])

    def _add(self, raw: str) -> int:
        for token in _TOKEN.findall(raw):
            self.flat.append(FEATURES if token[0].isdigit() else zlib.crc32(token.encode()) % FEATURES)
            self.marks.append(self.own.get(token, 0))
        self.start.append(len(self.flat))
        return len(self.start) - 2

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features of all texts, marks of them, where each text begins and the last ends)."""
        if len(self.code) > 500_000:
            self._clear()
        words = [_lower(t).split() for t in texts]
        count = np.cumsum([0, *map(len, words)])
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(words)), np.int64, int(count[-1]))
        start = np.array(self.start)
        size = start[codes + 1] - start[codes]
        ends = np.cumsum(size)
        at = np.repeat(start[codes] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.array(self.flat, np.int64)[at], np.array(self.marks, np.int64)[at], np.r_[0, ends][count]


class _Codes(dict):
    def __init__(self, add):
        self.add = add

    def __missing__(self, raw: str) -> int:
        self[raw] = n = self.add(raw)
        return n


def _lower(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def _rows(ids: np.ndarray, bounds: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each passage, text of each, place of each in its text): each word counts once in a passage."""
    n = np.diff(bounds)
    count = np.maximum(-(-(n - (window - step)) // step), (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    place = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * step
    return _take(ids, bounds, owner, place, window), owner, place


def _take(ids: np.ndarray, bounds: np.ndarray, owner: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    at = (bounds[owner] + place)[:, None] + np.arange(window)
    padded = np.where(at < bounds[owner + 1][:, None], np.append(ids, FEATURES)[np.minimum(at, len(ids))], FEATURES)
    padded.sort(axis=1)
    again = padded[:, 1:] == padded[:, :-1]
    padded[:, 1:][again] = FEATURES
    return padded


def _times(rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The rows (each a set of features) times a dense matrix of FEATURES + 1 rows, of which the last is zero."""
    out = np.zeros((len(rows), dense.shape[1]), np.float32)
    for a in range(0, len(rows), 1024):
        part = out[a : a + 1024]
        for column in rows[a : a + 1024].T:
            part += dense[column]
    return out


def _transposed(rows: np.ndarray, dense: np.ndarray, into: np.ndarray) -> None:
    """Adds the transposed rows times a dense matrix: per block a small dense matrix of its features."""
    for a in range(0, len(rows), 1024):
        part = rows[a : a + 1024]
        number = np.zeros(FEATURES + 1, np.int64)
        number[part] = 1
        feature = np.flatnonzero(number)
        number[feature] = np.arange(len(feature))
        block = np.zeros((len(feature), len(part)), np.float32)
        block[number[part].ravel(), np.repeat(np.arange(len(part)), part.shape[1])] = 1
        into[feature] += block @ dense[a : a + 1024]


def _weighed(dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A matrix of FEATURES rows weighed by feature, with a row of zeros for figures."""
    return np.vstack([dense * weights[:, None], np.zeros((1, dense.shape[1]))]).astype(np.float32)


def _norms(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(_times(rows, _weighed(np.ones((FEATURES, 1)), weights**2))), 1e-9)


# ---------------------------------------------------------------- items


@dataclass
class Part:
    """The question, or the evidence without boilerplate, of an item."""

    item: int
    whole: bool
    words: list[str]
    own: list[bool]  # figures and the company: they must stand as they are
    counts: list[int] = field(default_factory=list)  # words as a reader counts them, at the first token of each


def _sentences(evidence: str) -> set[str]:
    return {" ".join(tokens(x)) for x in _SENTENCE.split(evidence)}


def shared_sentences(items: DataFrame) -> DataFrame:
    """sentence: what stands in the evidence of several items belongs to none (copies of an evidence are one)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(e, s) for e, t in zip(batch["e"], batch["t"]) for s in _sentences(t)], columns=["e", "sentence"])

    said = items.where("evidence IS NOT NULL").select(F.md5("evidence").alias("e"), F.col("evidence").alias("t")).dropDuplicates(["e"]).mapInPandas(split, "e string, sentence string")
    return said.groupBy("sentence").agg(F.count("*").alias("n")).where("n > 1").select("sentence")


def _part(item: int, text: str, company: str, whole: bool) -> Part | None:
    words, counts = [], []
    for w in unicodedata.normalize("NFKC", text).split():
        t = tokens(w)
        words += t
        counts += [1, *[0] * (len(t) - 1)] if t else []
    if len(words) < 4:
        return None
    return Part(item, whole, words, [w[0].isdigit() or w == company for w in words], counts)


def item_parts(items: pd.DataFrame, common: set[str]) -> list[Part]:
    """Nulls give no part; repeated items give theirs again; a part of under four words can't be told apart and is left out.

    `common`: sentences of the evidence that are boilerplate.
    """
    evidence = items["evidence"].fillna("").tolist()
    parts = []
    for k, doc, q, e in zip(items["item_id"], items["doc_name"], items["question"], evidence):
        company = tokens(re.split(r"[_\s]", str(doc or ""))[0])[:1]
        company = company[0] if company else ""
        own = " ".join(s for s in _SENTENCE.split(e) if " ".join(tokens(s)) not in common)
        parts += [p for p in (_part(int(k), q, company, True) if isinstance(q, str) else None, _part(int(k), own, company, False)) if p]
    return parts


# ---------------------------------------------------------------- exact check


def _align(a: list[str], b: list[str], least: float = 0) -> list[int] | None:
    """A longest common subsequence: for each word of a its place in b, or -1; null if it has under `least` words.

    A row of the table of lengths is kept as one number: bit j is 0 where the length grows with word j of b. So a row is
    made of the one before by a few operations on whole numbers, and a length is a count of bits.
    """
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for w in a:
        v = rows[-1]
        u = v & where.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    if len(b) - rows[-1].bit_count() < least:
        return None
    at = [-1] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            at[i - 1] = j - 1
            i, j = i - 1, j - 1
        # as long without this word of a as without this word of b, or longer
        elif j - (rows[i - 1] & ((1 << j) - 1)).bit_count() >= j - 1 - (rows[i] & ((1 << (j - 1)) - 1)).bit_count():
            i -= 1
        else:
            j -= 1
    n = len(a)
    # of equally long alignments the compact one: each match as close to the one before as it can be
    last = -1
    for i in range(n):
        if at[i] >= 0:
            if last >= 0:
                for k in range(last + 1, min(at[i], last + 5)):
                    if b[k] == a[i]:
                        at[i] = k
                        break
            last = at[i]
    return at


def leaked(part: Part, words: list[str], companies: set[str] = frozenset()) -> bool:
    """Whether a stretch of a document holds the whole question, or a run of LEAST_RUN words of the evidence.

    Up to one word in seven may be changed, dropped or added; no figure and no company among them may differ, and at
    least one must be there.
    """
    n = len(part.words)
    at = _align(part.words, words, (n if part.whole else LEAST_RUN) * (1 - EDIT_SHARE))
    if at is None:
        return False
    # per word of the item: is it there, and how many words of the document stand before it that aren't the item's
    extra, foul = [0] * n, [False] * n
    last = -1
    for i, j in enumerate(at):
        if j < 0:
            foul[i] = part.own[i]
        else:
            if last >= 0:
                between = words[at[last] + 1 : j]
                extra[i] = max(0, len(between) - (i - last - 1))
                foul[i] = any(w[0].isdigit() or w in companies for w in between) or extra[i] > 12
            last = i
    def good(a: int, b: int) -> bool:
        return at[a] >= 0 and at[b] >= 0

    if part.whole:
        hit = [i for i in range(n) if at[i] >= 0]
        if not hit or any(foul[i] for i in range(hit[0] + 1, n)) or any(part.own[i] and at[i] < 0 for i in range(n)):
            return False
        edits = sum(1 for j in at if j < 0) + sum(extra[i] for i in hit[1:])
        return edits <= n * EDIT_SHARE and any(part.own)
    for a in range(n):
        if at[a] < 0:
            continue
        run = edits = own = 0
        for b in range(a, n):
            if foul[b] and b > a:
                break
            run += part.counts[b]
            edits += (at[b] < 0) + (extra[b] if b > a else 0)
            own += part.own[b] and at[b] >= 0
            if edits > 20:
                break
            if good(a, b) and run >= LEAST_RUN and own and edits <= (b - a + 1) * EDIT_SHARE:
                return True
    return False


def _keys(words: list[str], own: list[bool]) -> set[str]:
    """What tells an item: its company and the figures that aren't small or a year; where there are none, all its own marks."""
    marks = {w for w, o in zip(words, own) if o}
    return {w for w in marks if not w[0].isdigit() or len(w) >= 3 and not re.fullmatch(r"(?:19|20)\d\d", w)} or marks


class Checker:
    """The answer check of candidates: which parts a stretch may hold at all, and whether it does."""

    def __init__(self, parts: list[Part]):
        self.parts = parts
        by_key: dict[str, list[int]] = defaultdict(list)
        for k, p in enumerate(parts):
            for w in _keys(p.words, p.own):
                by_key[w].append(k)
        #: the number of each mark, and per number the parts it tells
        self.own = {w: i for i, w in enumerate(by_key, 1)}
        self.start = np.cumsum([0, 0, *map(len, by_key.values())])
        self.told = np.fromiter(chain.from_iterable(by_key.values()), np.int64)
        self.companies = {w for p in parts for w, o in zip(p.words, p.own) if o and not w[0].isdigit()}
        self.companies_of = {k: {w for w, o in zip(p.words, p.own) if o and not w[0].isdigit()} for k, p in enumerate(parts)}

    def near(self, marks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, part) of the passages that have a mark of the part in them or within WINDOW words of them."""
        at = np.flatnonzero(marks)
        text = np.searchsorted(bounds, at, "right") - 1
        place, size = at - bounds[text], np.diff(bounds)[text]
        last = np.maximum(-(-(size - (WINDOW - STEP)) // STEP), 1) - 1
        lo = np.maximum(-(-(place - 2 * WINDOW + 1) // STEP), 0)
        hi = np.minimum((place + WINDOW) // STEP, last)
        n = np.maximum(hi - lo + 1, 0)
        passage = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text, mark = np.repeat(text, n), np.repeat(marks[at], n)
        code = np.unique((text << 44) | (passage << 24) | mark)  # a text has under a million passages at a time
        text, passage, mark = code >> 44, (code >> 24) & 0xFFFFF, code & 0xFFFFFF
        n = self.start[mark + 1] - self.start[mark]
        told = self.told[np.repeat(self.start[mark] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return np.repeat(text, n), np.repeat(passage * STEP, n), told

    def holds(self, k: int, words: list[str], spans: list[tuple[int, int]]) -> bool:
        """Whether the part is leaked at any of the passages. Each is aligned by itself with few words around it, since a
        run of LEAST_RUN words fits into one; for a question as many as it has, as it must be whole."""
        part = self.parts[k]
        reach = len(part.words) if part.whole else WINDOW // 2
        others = self.companies - self.companies_of[k]
        return any(leaked(part, words[max(0, a - reach) : b + reach], others) for a, b in spans)


# ---------------------------------------------------------------- the latent space


def _encoded(src: DataFrame, parts: list[Part]) -> DataFrame:
    """digest, ids, places, told of src(t): the features of each text, and the passages with the parts whose marks are near.

    The texts are tokenised here, once; the passes over the matrix read two bytes a word.
    """
    sent = src.sparkSession.sparkContext.broadcast(Checker(parts))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        checker = sent.value
        words = Words(checker.own)
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch[a : a + 256]
                ids, marks, bounds = words(some["t"].tolist())
                text, place, part = checker.near(marks, bounds)
                cuts = np.searchsorted(text, np.arange(len(some) + 1))
                small, place, part = ids.astype(np.int16), place.astype(np.int32), part.astype(np.int32)
                piece = lambda x, at: [x[i:j].tobytes() for i, j in zip(at, at[1:])]
                yield pd.DataFrame({"digest": some["digest"].to_numpy(), "ids": piece(small, bounds), "places": piece(place, cuts), "told": piece(part, cuts)})

    return src.select(F.md5("t").alias("digest"), "t").mapInPandas(encode, "digest string, ids binary, places binary, told binary")


def _read(blobs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(features of all texts, where each begins and the last ends)."""
    return np.frombuffer(b"".join(blobs), np.int16).astype(np.int64), np.cumsum([0, *(len(b) // 2 for b in blobs)])


def _document_counts(encoded: DataFrame) -> np.ndarray:
    """Of each feature the number of passages that hold it, and last the number of passages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for a in range(0, len(batch), 256):
                rows = _rows(*_read(batch["ids"].iloc[a : a + 256]), WINDOW, WINDOW)[0]
                total += np.bincount(rows.ravel(), minlength=FEATURES + 1)
                n += len(rows)
        at = np.flatnonzero(total[:-1])
        yield pd.DataFrame({"f": np.r_[at, FEATURES], "n": np.r_[total[at], n]})

    rows = encoded.select("ids").mapInPandas(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES + 1, np.int64)
    out[rows["f"]] = rows["n"]
    return out


_CHUNK = 512


def _merged(blocks: DataFrame, *by: str) -> DataFrame:
    """Blocks of the same keys added up, one at a time, so a task holds one sum of each however many come in."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for chunk, salt, block in zip(batch["chunk"], batch["salt"], batch["block"]):
                key = (chunk, salt if "salt" in by else 0)
                total[key] = total.get(key, 0) + np.frombuffer(block, np.float64)
        yield pd.DataFrame([(c, s, b.tobytes()) for (c, s), b in total.items()], columns=["chunk", "salt", "block"])

    return blocks.repartition(FEATURES // _CHUNK, *by).mapInPandas(merge, blocks.schema)


def _gram_times(encoded: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of all passages times a basis: each task adds its passages up, tasks are added by blocks of features, in two steps."""
    sent = encoded.sparkSession.sparkContext.broadcast((weights, basis))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, q = sent.value
        total, weighed = np.zeros((FEATURES + 1, q.shape[1])), _weighed(q, w)
        for batch in batches:
            for a in range(0, len(batch), 256):
                rows = _rows(*_read(batch["ids"].iloc[a : a + 256]), WINDOW, WINDOW)[0]
                _transposed(rows, _times(rows, weighed) / _norms(rows, w) ** 2, total)
        total = total[:-1] * w[:, None]
        yield pd.DataFrame({"chunk": range(FEATURES // _CHUNK), "block": [total[c : c + _CHUNK].tobytes() for c in range(0, FEATURES, _CHUNK)]})

    salts = max(1, encoded.rdd.getNumPartitions() // 64)
    partial = encoded.select("ids").mapInPandas(add, "chunk int, block binary").select("chunk", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "block")
    if salts > 1:
        partial = _merged(partial, "chunk", "salt")
    out = np.zeros(basis.shape)
    for r in _merged(partial, "chunk").collect():
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.block, np.float64).reshape(_CHUNK, -1)
    return out


def latent_space(encoded: DataFrame, parts: list[Part], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighed right singular vectors, vectors of the items' passages, first of each part): a randomised SVD with one power step.

    The passages of the items are rows of the matrix too, weighed to a third of its mass at every size of the corpus, so
    that the space can tell them apart however rare their words are.
    """
    counts = _document_counts(encoded)
    n = max(int(counts[-1]), 1)
    weights = np.log((n + 1) / (counts[:-1] + 1)).astype(np.float32) + 0.05
    flat = [FEATURES if w[0].isdigit() else zlib.crc32(w.encode()) % FEATURES for p in parts for w in p.words]
    rows, owner, _ = _rows(np.asarray(flat, np.int64), np.cumsum([0, *(len(p.words) for p in parts)]), ITEM_WINDOW, ITEM_STEP)
    norm = _norms(rows, weights)
    scale = n / 2 / max(len(rows), 1)

    def gram(basis: np.ndarray) -> np.ndarray:
        basis = basis.astype(np.float32)
        own = np.zeros((FEATURES + 1, basis.shape[1]))
        _transposed(rows, _times(rows, _weighed(basis, weights)) / norm**2, own)
        return _gram_times(encoded, weights, basis) + scale * own[:-1] * weights[:, None]

    q = np.linalg.qr(gram(np.random.default_rng(seed).standard_normal((FEATURES, RANK + OVERSAMPLE))))[0]
    z = gram(q)
    _, vector = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    space = _weighed(q @ vector[:, : -RANK - 1 : -1], weights)
    return space, _unit(_times(rows, space)), np.searchsorted(owner, np.arange(len(parts) + 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _near(z: np.ndarray, passage: np.ndarray, part: np.ndarray, mine: np.ndarray, first: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (passage, part) have a passage of the part within the cosine."""
    hit = np.zeros(len(part), bool)
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(bounds, bounds[1:]):
        at = order[a:b]
        k = part[at[0]]
        hit[at] = (z[passage[at]] @ mine[first[k] : first[k + 1]].T >= least).any(axis=1)
    return hit


def find_leaks(documents: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", least_cosine: float = LEAST_COSINE, most_items: int = MOST_ITEMS) -> DataFrame:
    """key, item_id: one row per document row and item it leaks.

    Null and empty texts leak nothing; copies of a document come out each; ties don't arise; null fields of an item give
    no part; with no items or documents the result is empty. Extra columns are ignored, whatever their names.
    More than `most_items` items are looked for in several blocks, each in a latent space of its own.
    """
    spark = documents.sparkSession
    own = items.select("item_id", "doc_name", "question", "evidence").where("item_id IS NOT NULL")
    blocks = max(1, -(-own.count() // most_items))
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    src = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t <> ''")
    kind = src.schema["k"].dataType.simpleString()
    found = spark.createDataFrame([], f"k {kind}, item_id long")
    shared = cut(shared_sentences(own)) if blocks > 1 else shared_sentences(own)
    for block in range(blocks):
        local = own.where(F.col("block") == block).drop("block").toPandas()
        said = {x for e in local["evidence"].dropna() for x in _sentences(e)}
        common = {r.sentence for r in shared.collect()} if blocks == 1 else {r.sentence for r in shared.join(spark.createDataFrame([(x,) for x in said], "sentence string"), "sentence", "left_semi").collect()}
        if parts := item_parts(local, common):
            found = found.unionByName(_searched(src, kind, parts, least_cosine))
    return found.withColumnRenamed("k", key)


def _searched(src: DataFrame, kind: str, parts: list[Part], least: float) -> DataFrame:
    encoded = cut(_encoded(src, parts))  # read four times below
    sent = src.sparkSession.sparkContext.broadcast(latent_space(encoded, parts))
    asked = src.sparkSession.sparkContext.broadcast(parts)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense, mine, first = sent.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch[a : a + 256]
                ids, bounds = _read(some["ids"])
                place, part = (np.frombuffer(b"".join(some[c]), np.int32).astype(np.int64) for c in ("places", "told"))
                doc = np.repeat(np.arange(len(some)), [len(b) // 4 for b in some["places"]])
                passage, at = np.unique((doc << 32) | place, return_inverse=True)
                z = _unit(_times(_take(ids, bounds, passage >> 32, passage & 0xFFFFFFFF, WINDOW), dense))
                hit = _near(z, at, part, mine, first, least)
                yield pd.DataFrame({"digest": some["digest"].to_numpy()[doc[hit]], "place": place[hit], "part": part[hit]})

    near = encoded.where("length(places) > 0").mapInPandas(search, "digest string, place int, part int")
    hits = cut(near.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("part", "place"))).alias("hits")))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = asked.value
        checker = Checker(parts)
        for batch in batches:
            found = []
            for k, t, hits in zip(batch["k"], batch["t"], batch["hits"]):
                words, spans = tokens(t), defaultdict(list)
                for h in hits:
                    spans[h["part"]].append((h["place"], h["place"] + WINDOW))
                found += [(k, item) for item in {parts[p].item for p, at in spans.items() if checker.holds(p, words, at)}]
            yield pd.DataFrame(found, columns=["k", "item_id"])

    # only texts with candidates leave the JVM once more
    held = src.withColumn("digest", F.md5("t")).join(broadcast_if_small(hits), "digest").select("k", "t", "hits")
    return held.mapInPandas(check, f"k {kind}, item_id long")
