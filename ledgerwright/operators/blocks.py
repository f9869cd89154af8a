"""Questions meet passages in blocks of at most some thousands of a company's passages: the two steps that run in Python.

A block is a table of the tokens asked for, so all its scores are one matrix product; questions of the same text share it.
The best passages of a question are then looked for among those with the best scores before its own factors, until an
upper bound says that no other one can be among the best.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

from ledgerwright.functions import text as T

# Texts of questions scored at once, cells of a score table, and passages looked at first for a question.
TEXTS, CELLS, FIRST = 128, 4_000_000, 512
# Separator of lists in marks, and the most cells of remembered tiers.
SEP, REMEMBERED = "\x1f", 32_000_000
_TOKEN, _TERMS, _ASCII = re.compile(T.TOKEN, re.ASCII), frozenset(T.TERMS), tuple(t for t in T.TERMS if t.isascii())
MET = "bucket int, store string, total long, tokens array<string>, dfs array<long>, block binary"


def _lists(column: pd.Series) -> tuple[np.ndarray, list[frozenset[str]]]:
    """Codes of a column of joined lists, and the lists."""
    codes, values = pd.factorize(column)
    return codes.astype(np.int32), [frozenset(v.split(SEP)) if v else frozenset() for v in values]


class Named:
    """Which of the terms a lower-cased text names as words of their own, also with a plural s; as functions.text.names_terms.

    A term that is named begins with a word of the text, and a token begins with that word, up to a point and decimals. So
    only terms that begin with one of the text's tokens are looked for; others than ASCII ones only where a text has such letters.
    """

    def __init__(self, terms: tuple[str, ...]):
        self.by_word, self.always, self.other = {}, [], []
        for term in dict.fromkeys(terms):
            seek = term, re.compile(rf"(?<!\w){re.escape(term)}s?(?!\w)").search
            first = re.match(r"[a-z][a-z0-9]*(?!\w)", term)
            for word in {first[0], first[0] + "s"} if first and first[0] == term else {first[0]} if first else ():
                self.by_word.setdefault(word, []).append(seek)
            if not first:
                (self.always if term.isascii() else self.other).append(seek)

    def __call__(self, low: str, tokens: list[str] | None = None) -> list[str]:
        """`tokens`: those of the text, if they are known already."""
        words = set(_TOKEN.findall(low) if tokens is None else tokens)
        if "." in low:
            words |= {t.partition(".")[0] for t in words if "." in t}
        near = (self.always if low.isascii() else self.always + self.other) + [s for w in words & self.by_word.keys() for s in self.by_word[w]]
        return [term for term, search in near if term in low and search(low)]


def _met(store: str, bucket: int, rows: pd.DataFrame, wanted: list[str], items: Named, variables: dict[str, str], core: Named, statements: dict[str, set[str]]) -> tuple:
    low, place = rows["low"].tolist(), {t: j for j, t in enumerate(wanted)}
    lengths, at, of, found = np.zeros(len(low), np.int64), [], [], []
    for i, text in enumerate(low):
        tokens = _TOKEN.findall(text)
        if "label" in rows:
            found.append(items(text, tokens))
        tokens += [t for t in (_ASCII if text.isascii() else T.TERMS) if t in text]
        lengths[i] = len(tokens)
        known = [j for t in tokens if (j := place.get(t)) is not None]
        of += known
        at += [i] * len(known)
    cell, tf = np.unique(np.asarray(of, np.int64) * len(low) + np.asarray(at, np.int64), return_counts=True)
    token, passage = cell // len(low), (cell % len(low)).astype(np.int32)
    ends = np.searchsorted(token, np.arange(len(wanted) + 1))
    inside = np.zeros((len(wanted), -(-len(low) // 8)), np.uint8)  # a bit for each passage
    for j, t in enumerate(wanted):
        if t in _TERMS:  # a term is a token wherever it is contained
            here = np.zeros(len(low), bool)
            here[passage[ends[j] : ends[j + 1]]] = True
        else:
            here = np.fromiter((t in text for text in low), bool, len(low))
        inside[j] = np.packbits(here)
    d = {"key": rows["key"].to_numpy(), "dl": lengths, "ends": ends, "passage": passage, "tf": tf.astype(np.int32), "inside": inside}
    if "label" in rows:
        keys = [SEP.join(sorted({t for t in ts if t in _TERMS} | {variables[t] for t in ts if t in variables})) for ts in found]
        of_label = {x: {s for t in core(x) for s in statements[t]} for x in rows["label"].unique()}
        sections = [SEP.join(sorted({*of_label[x], section} - {""})) for x, section in zip(rows["label"], rows["section"])]
        d |= {"items": _lists(pd.Series(keys)), "core": _lists(pd.Series(sections))} | {c: _lists(rows[c]) for c in ("named", "years")} | {c: rows[c].to_numpy(bool) for c in ("total_row", "weak", "composition")}
        codes, pairs = pd.factorize(pd.MultiIndex.from_frame(rows[["filing", "filing_year"]]))
        d |= {"filing": (codes.astype(np.int32), list(pairs))}
    return bucket, store, int(lengths.sum()), wanted, np.diff(ends).tolist(), zlib.compress(pickle.dumps(d, 5), 1)


def meeter(variables: dict[str, str], core: dict[str, tuple[str, ...]]):
    """A function of the passages and the tokens asked for in a bucket that gives a row for each store: how often the tokens occur, and the block.

    `variables` has the variable of each alias, `core` the core items of each statement.
    """

    def met(passages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        statements: dict[str, set[str]] = {}
        for statement, terms in core.items():
            for t in terms:
                statements.setdefault(t, set()).add(statement)
        of = Named((*T.TERMS, *variables)), variables, Named(tuple(statements)), statements
        wanted = dict(zip(asked["store"], asked["wanted"]))
        made = [_met(store, int(rows["bucket"].iloc[0]), rows, list(wanted[store]), *of) for store, rows in passages.groupby("store", sort=False) if store in wanted]
        return pd.DataFrame(made, columns=["bucket", "store", "total", "tokens", "dfs", "block"])

    return met


class Tiers:
    """How well the filings of a block fit the one a question names, for all filings of the block at once."""

    def __init__(self, filings: list[tuple[str, str]], factors: dict[str, float]):
        self.docs = [f for f, _ in filings]
        self.by_name, self.by_bare, self.by_word = {}, {}, {}
        for i, doc in enumerate(self.docs):
            self.by_name.setdefault(doc, []).append(i)
            self.by_bare.setdefault(doc.replace(" ", ""), []).append(i)
            for w in set(doc.split(" ")):
                self.by_word.setdefault(w, []).append(i)
        self.by_word = {w: np.asarray(i) for w, i in self.by_word.items()}
        self.bare_text, self.starts = "\n".join(self.by_bare), np.cumsum([0, *(len(b) + 1 for b in self.by_bare)])
        self.bares = list(self.by_bare.values())
        years = np.asarray([y for _, y in filings], object)
        self.year_of = {y: years == y for y in set(years)}
        self.dated = years != ""
        self.nameless = np.asarray([doc == "" for doc in self.docs])
        self.values = np.asarray([1.0, factors["other"], factors["partial"], factors["contained"], factors["exact"], factors["other_period"]])
        self.seen: dict[tuple[str, str], np.ndarray] = {}

    def codes(self, own: str, year: str) -> np.ndarray:
        if (own, year) not in self.seen:
            if len(self.seen) * len(self.docs) > REMEMBERED:
                self.seen.clear()
            self.seen[own, year] = self._codes(own, year)
        return self.seen[own, year]

    def _codes(self, own: str, year: str) -> np.ndarray:
        if own in ("", "company", "unknown"):
            return np.zeros(len(self.docs), np.uint8)
        words = [w for w in own.split(" ") if len(w) >= 2]
        shared = np.zeros(len(self.docs), np.int32)
        for w in words:
            if w in self.by_word:
                shared[self.by_word[w]] += 1
        code = np.where(shared > 0, 2, 1).astype(np.uint8) if words else np.zeros(len(self.docs), np.uint8)
        if words:
            code[shared == len(words)] = 3
        # what contains the name with its blanks also contains it without them, and the other way round
        bare, at = own.replace(" ", ""), -1
        while (at := self.bare_text.find(bare, at + 1)) >= 0:
            n = int(np.searchsorted(self.starts, at, "right")) - 1
            code[self.bares[n]] = 3
            at = int(self.starts[n + 1]) - 1
        for part in {bare[i:j] for i in range(len(bare)) for j in range(i + 1, len(bare) + 1)} if len(bare) ** 2 < 2 * len(self.bares) else (b for b in self.by_bare if b and b in bare):
            if part in self.by_bare:
                code[self.by_bare[part]] = 3
        code[self.by_name.get(own, [])] = 4
        if year:
            same = self.year_of.get(year, np.zeros(len(self.docs), bool))
            code[self.dated & ~same & (self.values[code] > 1)] = 5
        code[self.nameless] = 0
        return code


class Block:
    """The passages of one store in one bucket."""

    def __init__(self, packed: bytes, tokens: list[str], avgdl: float, overlap: float, bm25: float, k1: float, b: float):
        self.d = d = pickle.loads(zlib.decompress(packed))
        self.place, self.n = {t: j for j, t in enumerate(tokens)}, len(d["key"])
        self.weights, self.k1 = (bm25, overlap), k1
        self.norm = k1 * (1 - b + b * d["dl"] / avgdl)
        self.masks: dict[tuple[str, str], np.ndarray] = {}

    def parts(self, tokens: list[str]) -> np.ndarray:
        """What each of the tokens adds to the score of each passage, for a weight of 1."""
        d, out = self.d, np.zeros((len(tokens), self.n))
        for i, t in enumerate(tokens):
            j = self.place[t]
            if self.weights[1]:
                out[i] = np.unpackbits(d["inside"][j], count=self.n) * self.weights[1]
            at, tf = d["passage"][d["ends"][j] : d["ends"][j + 1]], d["tf"][d["ends"][j] : d["ends"][j + 1]]
            out[i, at] += self.weights[0] * tf * (self.k1 + 1) / (tf + self.norm[at])
        return out

    def shares(self, name: str, asked: str) -> np.ndarray:
        """Which passages have one of the asked marks."""
        if (name, asked) not in self.masks:
            codes, values = self.d[name]
            want = set(asked.split(SEP)) if asked else set()
            self.masks[name, asked] = np.asarray([not want.isdisjoint(v) for v in values], bool)[codes] if want else np.zeros(self.n, bool)
        return self.masks[name, asked]

    def rule(self, name: str, q) -> np.ndarray:
        d = self.d
        if name == "line_item_match":
            return self.shares("items", q.asked_items)
        if name == "total_row_boost":
            codes, values = d["named"]
            return d["total_row"] & (np.asarray([not v for v in values], bool)[codes] | self.shares("named", q.asked_stems))
        if name == "inventory_composition_boost":
            return d["composition"] & bool(q.goods)
        if name == "low_confidence_column_penalty":
            return d["weak"]
        if name == "year_match_boost":
            return self.shares("years", q.asked_years)
        return self.shares("core", q.hint)  # statement_type_hint_boost: the section is among them


def _best(score: np.ndarray, keys: np.ndarray, k: int, least: float) -> np.ndarray:
    """Places of the k best scores over the least one, ties by key; equal up to the sixth decimal is equal."""
    r = np.rint(score * 1e6)
    at = np.flatnonzero(r > least * 1e6) if least else np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[r[at] >= np.partition(r[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((keys[at], -r[at]))[:k]]


def _ranked(block: Block, asked: pd.DataFrame, k: int, least: float, rules: dict[str, float], tiers: dict[str, float] | None) -> Iterator[tuple]:
    """qid, keys, scores, bits of each question; a rule's bit is its place in the order of application."""
    names, d = list(rules), block.d
    marked = bool(names or tiers)
    by_text: dict[tuple, list] = {}
    for q in asked.itertuples(index=False):
        by_text.setdefault((q.tokens, q.weights.tobytes(), *((q.asked_items, q.asked_stems, q.goods, q.asked_years, q.hint) if marked else ())), []).append(q)
    codes, filings = d["filing"] if marked else (np.zeros(block.n, np.int32), [("", "")])
    fits = Tiers(filings, tiers) if tiers else None
    preferred = rules.get("preferred_filing_year_boost")
    years = np.asarray([y for _, y in filings], object)
    texts, size = list(by_text.values()), max(1, min(TEXTS, CELLS // max(1, block.n)))
    for batch in (texts[i : i + size] for i in range(0, len(texts), size)):
        block.masks.clear()
        used = list(dict.fromkeys(t for qs in batch for t in qs[0].tokens.split("\n")))
        row = {t: i for i, t in enumerate(used)}
        weights = np.zeros((len(batch), len(used)))
        for u, qs in enumerate(batch):
            weights[u, [row[t] for t in qs[0].tokens.split("\n")]] = qs[0].weights
        base, wide = np.zeros((len(batch), block.n)), max(1, CELLS // max(1, block.n))
        for i in range(0, len(used), wide):
            base += weights[:, i : i + wide] @ block.parts(used[i : i + wide])
        for u, qs in enumerate(batch):
            score, hits = base[u], {}
            for name in names:
                if name != "preferred_filing_year_boost":
                    hits[name] = block.rule(name, qs[0])
                    score = np.where(hits[name], score * rules[name], score)
            some = np.argpartition(score, block.n - FIRST)[block.n - FIRST :] if block.n > 2 * FIRST else None
            for q in qs:
                fit = fits.values[fits.codes(q.entity, q.entity_year)] if fits else np.ones(len(filings))
                latest = years == q.latest if preferred and not q.entity_year and q.latest else np.zeros(len(filings), bool)
                factor = np.where(latest, fit * preferred, fit) if preferred else fit
                at = None
                if some is not None:
                    near = score[some] * factor[codes[some]]
                    best = _best(near, d["key"][some], k, least)
                    bound = np.rint(score[some].min() * factor.max() * 1e6)  # of what isn't looked at
                    if len(best) == k and bound < np.rint(near[best[-1]] * 1e6) or bound <= least * 1e6 and score[some].min() * factor.max() <= least:
                        at, value = some[best], near[best]
                if at is None:
                    every = score * factor[codes]
                    at = _best(every, d["key"], k, least)
                    value = every[at]
                if not len(at):
                    continue
                bits = (fit[codes[at]] != 1.0).astype(np.int64)
                for i, name in enumerate(names, 1):
                    bits |= (latest[codes[at]] if name == "preferred_filing_year_boost" else hits[name][at]).astype(np.int64) << i
                yield q.qid, d["key"][at], value, bits


def ranker(k: int, least: float, rules: dict[str, float], tiers: dict[str, float] | None, overlap: float, bm25: float, k1: float, b: float):
    """A function of the blocks and the questions of a bucket that gives qid, key, score, bits of the k best of each store."""

    def ranked(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found, of = [], dict(list(asked.groupby("store", sort=False)))
        for r in blocks.itertuples(index=False):
            if r.store in of:
                block = Block(r.block, list(r.tokens), float(of[r.store]["avgdl"].iloc[0]), overlap, bm25, k1, b)
                found += _ranked(block, of[r.store], k, least, rules, tiers)
        if not found:
            return pd.DataFrame({"qid": [], "key": [], "score": [], "bits": []})
        sizes = [len(keys) for _, keys, _, _ in found]
        return pd.DataFrame({
            "qid": np.repeat(np.asarray([q for q, *_ in found], object), sizes), "key": np.concatenate([x for _, x, _, _ in found]),
            "score": np.concatenate([x for _, _, x, _ in found]), "bits": np.concatenate([x for *_, x in found]),
        })

    return ranked
