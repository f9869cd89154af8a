"""The operators for training text: literal cases, round trips, brute force and invariants."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwright.llm import canonical, containers, leaks, personal, pieces, scans

# ---------------------------------------------------------------- p1

SAME = [("Сοmраnу:　ＡＢ", "Company: AB"), ("étude", "étude"), ("a­b", "ab"), ("a­\nb", "a-\nb"), ("ﬁne‑x", "fine-x"), ("Å", "Å"), ("a​b⁠", "ab"), ("１２．５％", "12.5%"), ("x\r\ny", "x\ny"), ("е́", "é"), ("a b", "a b")]
APART = ["m²", "m2", "café", "cafe", "Cafe", "3", "³", "𝟛", "a  b", "a b", "a–b", "a-b", "Россия", "ﬂ"]


@pytest.mark.parametrize(("raw", "want"), SAME)
def test_one_form(raw, want):
    assert canonical.canonical_text(raw) == want


def test_visible_differences_stay():
    assert len({canonical.canonical_text(x) for x in APART}) == len(APART)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_canonical_is_stable_and_exact_on_stable_text(text):
    once = canonical.canonical_text(text)
    assert canonical.canonical_text(once) == once
    if all(ord(c) < 0x80 and c != "\r" for c in text):
        assert once == text


def test_canonical_over_a_table(spark):
    rows = [(1, "Company AB", 0), (2, "Ｃompany AB", 0), (3, "Company AB", 0), (4, "company AB", 0), (5, None, 0), (6, "", 0), (7, "Соmpany AB", 0), (8, "x" * 200_000 + "é", 0), (9, "x" * 200_000 + "é", 0), (None, "Ｃompany AB", 0)]
    df = spark.createDataFrame(rows, "ord long, content string, look int")
    form = {r.ord: r.canonical for r in canonical.canonical_form(df).collect()}
    assert form[2] == form[7] == "Company AB" and form[5] is None and form[6] == "" and form[8] == form[9]
    got = {tuple(r) for r in canonical.same_look_pairs(df).collect()}
    plain = [(k, t) for k, t, _ in rows if k and t is not None]
    want = {(a, b) for a, x in plain for b, y in plain if a < b and x != y and canonical.canonical_text(x) == canonical.canonical_text(y)}
    assert got == want == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7), (8, 9)}
    assert canonical.same_look_pairs(df.limit(0)).count() == 0


def test_rows_of_one_spelling_never_meet(spark):
    """A look with many rows in one spelling and one row in another: the joins bring no more rows together than there are pairs."""
    df = spark.range(3000).selectExpr("id AS ord", "IF(id = 1000, 'étude', 'e\u0301tude') AS content")
    pairs = canonical.same_look_pairs(df)
    assert {tuple(r) for r in pairs.collect()} == {(min(i, 1000), max(i, 1000)) for i in range(3000) if i != 1000}
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "k_a" in x and "k_b" in x]
    rows_meet = [x for x in joins if not re.search(r"(?<!NOT )\(s_b#\d+ = s_b#\d+\)", x)]
    assert joins and not rows_meet


# ---------------------------------------------------------------- p4


@given(st.text(alphabet="ab .\n，。é́", max_size=300), st.integers(5, 50), st.integers(0, 20))
@settings(max_examples=400, deadline=None)
def test_pieces(text, limit, overlap):
    overlap = min(overlap, limit // 2 - 1)
    got = pieces.spans(text, limit, overlap)
    assert bool(got) == bool(text)
    if got:
        assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in got)
    assert all(a < c <= b and b - c <= overlap and d > b for (a, b), (c, d) in zip(got, got[1:]))


def test_natural_boundaries():
    text = ("One sentence here. " * 30).strip() + "\n\n" + "Another one stands here. " * 30
    got = pieces.spans(text, 600, 40)
    assert text[: got[0][1]].endswith("\n\n") and all(text[b - 1] == " " or b == len(text) for _, b in got[1:])
    assert pieces.spans("x" * 10_000) == [(0, 3000), (2880, 5880), (5760, 8760), (8640, 10000)]


def test_pieces_over_a_table(spark):
    rows = [(1, 4, "ab " * 2000, "k"), (2, None, "ab " * 2000, "k"), (3, 1, None, "k"), (4, 1, "", "k"), (5, 1, "x" * 3000, "k"), (5, 1, "é" * 3001, "k"), (None, 1, "y" * 4000, "k")]
    df = spark.createDataFrame(rows, "ord long, page_number int, content string, piece string")
    got = pieces.split_oversized(df).toPandas()
    assert Counter(got.ord.fillna(-1)) == {1: 3, 2: 3, 5: 2, -1: 2} and got[got.ord == 1].page_number.eq(4).all() and got[got.ord == 2].page_number.isna().all()
    assert got.piece_text.str.len().eq(got.end_at - got.start_at).all() and sorted(r.ord or -1 for r in pieces.oversized(df).collect()) == [-1, 1, 2, 5]
    assert pieces.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(df, keys=("piece",))


# ---------------------------------------------------------------- p3

CLEAN = ["Inventory of dental trays was written down by $9.27 million, largely because of lower incentive compensation.", "Management expects pension cost in the Aftermarket segment to move for the third year running during the coming year.", "The long-term borrowings of the quarter came from the other segment and the cost of sales fell."]


@pytest.fixture(scope="module")
def noisy(spark):
    head = "Company: ACME | Document: ACME_2020_10K.pdf | Page: {} | Content: "
    bodies = {
        1: "Management expects pension cost in the Aftermarket segment to move for the third year run-\nning during the coming year.",
        2: "ACME FOODS   ANNUAL REPORT 2020   7\nInventory of dental trays was written down by $9,2B1.3 million, largely because of lower incen-\n\nACME FOODS   ANNUAL REPORT 2020\ntive compensation.",
        3: "Inventory of dental trays was writteri down by $9.27 million, largely\nbecause of lower incentive cornpensation.\n- 12 -",
        4: "Overview\nManagement expects pension cost in the Aftermarket segment to move for the third year running during the coming year.",
        5: "The long-\nterm borrowings of the quarter came from the other segment and the cost of sales fell.", 6: "", 7: "2018\n" + CLEAN[0],
    }
    rows = [(k, "ACME", "text_note", head.format(k) + t, None) for k, t in bodies.items()] + [(8, None, "text_note", None, None), (9, None, "text_note", "no head", None), (10, "ACME", "table_row", "x", None)]
    rows += [(100 + i, "ACME", "text_note", head.format(i) + CLEAN[i % 3], None) for i in range(300)] + [(500 + i, "ACME", "text_note", head.format(i) + "Acme Foods   Annual Report 2019\n" + CLEAN[i % 3], None) for i in range(3)]
    return spark.createDataFrame(rows, "ord long, company string, type string, content string, kind string")


def test_scans(noisy):
    got = {r.ord: r for r in scans.repaired(noisy).collect()}
    kinds = {k: set(r.kinds) for k, r in got.items()}
    assert kinds[1] == {"hyphen"} and got[1].repaired == CLEAN[1]
    assert kinds[2] == {"hyphen", "header", "page_no", "misread"} and got[2].repaired == CLEAN[0].replace("9.27", "9,281.3")
    assert kinds[3] == {"misread", "page_no"} and got[3].repaired == CLEAN[0]
    assert all(not kinds[k] for k in (4, 5, 6, 7, 9)) and got[4].repaired.startswith("Overview\n") and got[7].repaired == "2018\n" + CLEAN[0]
    assert got[5].repaired == CLEAN[2] and 8 not in got and 10 not in got
    assert all(not kinds[100 + i] and got[100 + i].repaired == CLEAN[i % 3] for i in range(300)) and all(kinds[500 + i] == {"header"} for i in range(3))
    assert {(r.ord, r.kind) for r in scans.noise(noisy).collect()} == {(k, x) for k, v in kinds.items() for x in v}
    assert scans.noise(noisy.limit(0)).count() == 0


def test_header_of_one_filing(spark):
    """A header that runs through a filing is found however many other pages there are; a line on one page of a filing stays."""
    page = lambda company, doc, body: (company, "text_note", f"Company: {company} | Document: {doc} | Page: 1 | Content: {body}")
    text = CLEAN[0].replace("largely ", "largely\n")
    rows = [page(f"C{i % 50}", "x.pdf", text) for i in range(2600)]
    rows += [page("ACME", "a.pdf", "Acme Foods quarterly binder\n" + text)] * 4 + [page("ACME", "b.pdf", "Acme Foods quarterly binder\n" + text)] + [page("ACME", "b.pdf", text)] * 4
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, company string, type string, content string")
    assert {(r.ord, r.kind) for r in scans.noise(df).collect()} == {(2600 + i, "header") for i in range(4)}


def test_channel():
    assert "from" in scans.readings("frorn") and "unreadable" in scans.readings("unreaclable") and "history" in scans.readings("h1story")
    model = scans.Model({"sales": 500, "increased": 400, "the": 900}, {"sales increased": 300}, set(), 5000, {"soles": [("sales", math.log(1e-4))]})
    assert model.decode([("soles", True), ("increased", False)]) == ["sales", "increased"] and model.decode([("the", True), ("zzz", True)]) == ["the", "zzz"]


def test_lexicon_matches_brute_force(spark):
    rnd = random.Random(6)
    words = {"".join(rnd.choice("acelmnriu1") for _ in range(rnd.randint(1, 6))).replace("1", "d"): rnd.choice([1, 3, 500]) for _ in range(300)}
    tokens = {"".join(rnd.choice("acelmnri10") for _ in range(rnd.randint(1, 6))) for _ in range(200)} - words.keys()
    tokens |= {"internationalizationalism".replace("n", "ri", 2), "x1" * 14}
    words["internationalizationalism"] = 9
    df = lambda x, s: spark.createDataFrame(list(x), s)
    real, options = scans.lexicon(df(words.items(), "item string, n long"), df(((t,) for t in tokens), "item string"))
    want = {w for w, n in words.items() if not any(words.get(x, 0) * p / 1e-3 > scans.RATIO * n for x, p in scans.readings(w, 1).items())}
    assert {r.item for r in real.collect()} == want
    got = {r.token: {(o.word, round(o.p, 12)) for o in r.options} for r in options.collect()}
    full = {t: {(w, round(p, 12)) for w, p in scans.readings(t, 1 if t in want else 2).items() if w in want and w != t} for t in words.keys() | {t for t in tokens if not t.isdigit()}}
    assert {t for t, x in full.items() if x} == got.keys() and all({w for w, _ in got[t]} == {w for w, _ in full[t]} for t in got)
    assert all(got[t] == full[t] for t in got if t not in want) and ("internationalizationalism", 1e-6) in got["iriterriationalizationalism"]


def test_large_lexicon(noisy):
    """Notes repaired in buckets, with what each asks for, come out as with the whole lexicon."""
    plain = sorted((r.ord, tuple(r.kinds), r.repaired) for r in scans.repaired(noisy).collect())
    assert sorted((r.ord, tuple(r.kinds), r.repaired) for r in scans.repaired(noisy, most_entries=0, buckets=3).collect()) == plain


def test_repeated_corpus_gives_the_same(noisy):
    once = sorted((r.ord, r.kind) for r in scans.noise(noisy).collect())
    again = noisy.crossJoin(noisy.sparkSession.range(8).withColumnRenamed("id", "copy"))
    again = again.select((F.col("ord") + F.col("copy") * 10_000).alias("ord"), "company", "type", "content")
    assert sorted((r.ord % 10_000, r.kind) for r in scans.noise(again).collect()) == sorted(once * 8)


def test_headers_without_the_name_and_with_a_legal_form(spark):
    text = CLEAN[0].replace("largely ", "largely\n")
    page = lambda i, head: (i, "ACME", "text_note", f"Company: ACME | Document: a.pdf | Page: {i} | Content: {head}{text}")
    rows = [page(i, "2023 Annual Report\n") for i in range(6)] + [page(10 + i, "ACME, Inc. Annual Report 2023\n") for i in range(4)] + [page(20, "Overview\n"), page(21, "Note 7\n")]
    got = {(r.ord, r.kind) for r in scans.noise(spark.createDataFrame(rows, "ord long, company string, type string, content string")).collect()}
    assert got == {(i, "header") for i in (*range(6), *range(10, 14))}


def test_clean_pages_stay_in_their_characters(spark):
    df = spark.createDataFrame([(1, "A", "text_note", "x | Content: Ｎｅｔ sales rose."), (2, "A", "text_note", "x | Content: Ｎｅｔ sales\nrose.\n- 3 -")], "ord long, company string, type string, content string")
    got = {r.ord: r.repaired for r in scans.repaired(df).collect()}
    assert got == {1: "Ｎｅｔ sales rose.", 2: "Net sales rose."}


# ---------------------------------------------------------------- p6


def test_bucket_bounds_are_optimal():
    rnd = random.Random(1)
    from itertools import combinations

    for _ in range(20):
        h = {rnd.randint(1, 40): rnd.randint(1, 9) for _ in range(8)}
        sizes = sorted(h)
        pad = lambda bounds: sum((min(b for b in bounds if b >= s) - s) * n for s, n in h.items())
        best = min(pad([*c, sizes[-1]]) for k in range(3) for c in combinations(sizes[:-1], k))
        assert pad(containers.bucket_bounds(h, 3)) == best


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    return [(i, " ".join(rnd.choice(["revenue", "of", "the", "segment", "rose", "ñandú", "毛利率"]) for _ in range(rnd.choice([3, 10, 30, 60])))) for i in range(400)]


def test_containers(spark, texts):
    rows = [*texts, (900, None), (901, ""), (902, "word " * 700), (903, "x" * 5000), (904, "same"), (904, "same"), (905, "多" * 3000)]
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, container string")
    got = containers.packed(df, capacity=128, buckets=16).toPandas()
    enc = containers.encoding()[0]
    by_id = defaultdict(list)
    for k, t in rows:
        by_id[k].append(t)
    full = got[got.n_tokens > 0]
    assert full.groupby("container").n_tokens.sum().max() <= 128 and got[got.n_tokens == 0].container.isna().all()
    assert set(got.doc_id) == set(by_id) and len(got[got.doc_id == 904]) == 2
    for k, g in full.groupby("doc_id"):
        t = by_id[k][0]
        if k != 904:
            assert "".join(t[a:b] for a, b in sorted(zip(g.start_at, g.end_at))) == t
        assert (len(enc.encode_ordinary(t)) > 128) == (len(g) > 1 and k != 904)
        assert all(len(enc.encode_ordinary(t[a:b])) == n for a, b, n in zip(g.start_at, g.end_at, g.n_tokens))
    row = containers.fill(containers.packed(df, capacity=128, buckets=16), 128).first()
    assert row.unused < 0.1 and row.fullest <= 128
    assert containers.packed(df.limit(0)).count() == 0


# ---------------------------------------------------------------- p7

EVIDENCE = "Zudaubrick Stores closed 6 sites around the Midlands during April, took $35.48 million of write-offs and moved frozen entrées into Industrial Coatings. Shareholders holding 24.84% of Zudaubrick Stores voted on October 27 to spend $115.63 million on valve assemblies. Amounts may not add up because of rounding in every table."
QUESTION = "What is the 2018 ratio of long-term borrowings to gross margin for Zudaubrick Stores, when amounts tied to pallet wrap are left out?"
OTHER = EVIDENCE.replace("Zudaubrick", "Wenaubrick").replace("35.48", "77.02").replace("24.84", "11.10").replace("115.63", "8.44")
FILL = "The effective tax rate was reflecting the closure of two smaller plants and the settlement of an earlier audit in the period. "


def test_leaks(spark):
    items = [(1, "ZUDAUBRICK_2018_10K", QUESTION, "Yes", "m", EVIDENCE), (2, "WENAUBRICK_2018_10K", None, "No", "m", OTHER), (3, None, None, None, None, None), (4, "X", "Why?", None, None, "")]
    run = "took $35.48 million of write-offs and moved frozen entrées into Industrial Coatings. Shareholders holding 24.84% of"
    docs = {
        1: FILL + QUESTION + FILL, 2: FILL + QUESTION.upper().replace(",", " ,") + FILL, 3: FILL + EVIDENCE[:150] + FILL, 4: FILL + run + FILL,
        5: FILL + QUESTION.replace("Zudaubrick", "Wenaubrick") + FILL, 6: FILL + QUESTION.replace("2018", "2019") + FILL, 7: FILL + "took $35.48 million of write-offs and moved frozen" + FILL,
        8: FILL + run.replace("35.48", "36.48").replace("24.84", "24.85") + FILL, 9: FILL + "Amounts may not add up because of rounding in every table." + FILL, 10: FILL + QUESTION.replace("ratio of", "share of").replace("left out", "kept out") + FILL,
        11: None, 12: "", 13: FILL * 300 + EVIDENCE + FILL * 300, 14: FILL + QUESTION + FILL, 15: FILL, 16: FILL + QUESTION.replace("ratio of long-term borrowings to", "total of equity over") + FILL,
    }
    d = spark.createDataFrame([(k, t, 0) for k, t in [*docs.items(), (1, docs[1])]], "doc_id long, text string, item_id int")
    e = spark.createDataFrame(items, "item_id long, doc_name string, question string, answer string, question_type string, evidence string")
    got = Counter(tuple(r) for r in leaks.find_leaks(d, e).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 1): 1, (10, 1): 1, (13, 1): 1, (14, 1): 1}
    assert Counter(tuple(r) for r in leaks.find_leaks(d, e, most_items=1).collect()) == got  # an item at a time
    assert leaks.find_leaks(d, e.limit(0)).count() == 0 and leaks.find_leaks(d.limit(0), e).count() == 0


def test_a_question_with_a_year_alone_is_found(spark):
    asked = "Which share of the pallet wrap that the warehouse ordered in 2018 had been returned by the end of the season?"
    d = spark.createDataFrame([(1, FILL + asked + FILL), (2, FILL + asked.replace("2018", "2017") + FILL), (3, FILL)], "doc_id long, text string")
    e = spark.createDataFrame([(7, None, asked, None, None, None)], "item_id long, doc_name string, question string, answer string, question_type string, evidence string")
    assert [tuple(r) for r in leaks.find_leaks(d, e).collect()] == [(1, 7)]


def test_alignment_is_a_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = (["ab"[rnd.random() < 0.5] for _ in range(rnd.randint(0, 12))] for _ in "xy")
        at = leaks._align(a, b)
        used = [j for j in at if j >= 0]
        assert used == sorted(set(used)) and all(a[i] == b[j] for i, j in enumerate(at) if j >= 0)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(used) == table[-1][-1] and (leaks._align(a, b, len(used) + 1) is None)


# ---------------------------------------------------------------- p8

MENTIONS = [
    ("Contact: 8095550152 or a.b+c@post.invalid.", [("phone", "8095550152"), ("email", "a.b+c@post.invalid")]),
    ("Write to orla.halvane [at] mail.example or x(at)y(dot)org; rolled @ 51.60 per tonne under order 2534-3360-08.", [("email", "orla.halvane [at] mail.example"), ("email", "x(at)y(dot)org")]),
    ("Call +44 20 7946 0397, (562) 555-0191, 020 7946 0160, 1 (657) 555-0155 ext. 298 or +61 2\n5550 3421 now.", [("phone", "+44 20 7946 0397"), ("phone", "(562) 555-0191"), ("phone", "020 7946 0160"), ("phone", "1 (657) 555-0155 ext. 298"), ("phone", "+61 2\n5550 3421")]),
    ("Lot 951-00-4458; file number 001-58385; employer identification no. 00-2564291; order 1186-9777-86.", []),
    ("The indemnity names Lucan Wexcombe (SSN 955429136, 753 North Gantry St., Dunmere, CO 00711) as beneficiary.", [("name", "Lucan Wexcombe"), ("id_number", "955429136"), ("address", "753 North Gantry St., Dunmere, CO 00711")]),
    ("The grantee (driver's licence Y-350-1908-20) and (NI number QQ 48 17 86 C), passport no. Q30871403, soc. sec. 923 31 2739.", [("id_number", "Y-350-1908-20"), ("id_number", "QQ 48 17 86 C"), ("id_number", "Q30871403"), ("id_number", "923 31 2739")]),
    ("Copies were mailed to Juno Drosthoff, P.O. Box 7267, Sable Point, WA 00241.", [("name", "Juno Drosthoff"), ("address", "P.O. Box 7267, Sable Point, WA 00241")]),
    ("By: /s/ BRAM LYSANDER-POE The indemnity. By: /s/ JUNO D'ORVIGNY\nDR. QUORBY of NORVANE FOODS", [("name", "BRAM LYSANDER-POE"), ("name", "JUNO D'ORVIGNY"), ("name", "QUORBY")]),
    ("Mr. Yarrowick replied. By: /s/ Orla L. Nackerby", [("name", "Yarrowick"), ("name", "Orla L. Nackerby")]),
    ("Bezdrik & Estrevane LLP served as counsel. The Quillet Lane store reopened. The Quill Lake project and the Marit Valley lease.", []),
    ("Ansprechpartner: Frau Bram Quorby, Tel. +49 30 23125 850, Drosselweg 21, 00553 Neuenfels. During 2016 it rose.", [("name", "Bram Quorby"), ("phone", "+49 30 23125 850"), ("address", "Drosselweg 21, 00553 Neuenfels")]),
    ("Le commissaire, M. van Kessterlo, est domicilié 11 rue des Tilleuls-Noirs, 00886 Valbrune.", [("name", "van Kessterlo"), ("address", "11 rue des Tilleuls-Noirs, 00886 Valbrune")]),
    ("Hedda Zembrandt, Chief Financial Officer of Lobehurst Instruments, may be reached.", [("name", "Hedda Zembrandt")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), MENTIONS)
def test_mentions(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in personal.mentions(text)] == want


@given(st.text(alphabet="0123456789", max_size=20), st.binary(min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_feistel_is_a_permutation_of_its_format(digits, key):
    image = personal.permute(digits, key, "t")
    assert len(image) == len(digits) and personal.permute(image, key, "t", back=True) == digits


def test_feistel_covers_the_format():
    assert len({personal.permute(f"{i:04d}", b"k") for i in range(10_000)}) == 10_000
    assert len({personal.permute(f"{chr(65 + i // 10)}{i % 10}", b"k") for i in range(260)}) == 260
    assert len({personal.walked(f"{i:03d}", b"k", "t", lambda x: int(int(x) % 3 == 0)) for i in range(1000)}) == 1000


def test_images_are_valid_and_hide_letters():
    key = b"k"
    rnd = random.Random(4)
    seen = set()
    for _ in range(300):
        ssn = f"{rnd.randint(1, 899):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}"
        if ssn.startswith("666"):
            continue
        image = personal.placeholder(ssn, "id_number", "ssn", key)[11:-1]
        assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", image)
        seen.add((ssn, image))
    assert len({a for a, _ in seen}) == len({b for _, b in seen})
    assert personal.placeholder("955429136", "id_number", "ssn", key)[11] == "9"
    licence = personal.placeholder("MORGA657054SM9IJ", "id_number", "licence", key)[11:-1]
    assert re.fullmatch(r"[A-Z]{5}\d{6}[A-Z]{2}\d[A-Z]{2}", licence) and licence[:5] != "MORGA" and licence[11:13] != "SM"
    ni = personal.placeholder("AB 12 34 56 c", "id_number", "ni", key)[11:-1]
    assert re.fullmatch(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] \d\d \d\d \d\d [abcd]", ni)
    phone = lambda t: personal.placeholder(t, "phone", "phone", key)[7:-1]
    assert phone("+44 20 7946 0958").startswith("+44 ") and phone("020 7946 0958") == "0" + phone("+44 20 7946 0958")[4:] and phone("+44 (0)20 7946 0958") == phone("+44 20 7946 0958").replace("+44 ", "+44 (0)")
    assert re.sub(r"\D", "", phone("+1 562-555-0191"))[1:] == re.sub(r"\D", "", phone("(562) 555-0191 ext. 4")) == phone("5625550191") and phone("5625550191")[0] in "23456789"
    assert personal.placeholder("orla.h [at] mail.example", "email", "email", key) == personal.placeholder("Orla.h@mail.example", "email", "email", key)
    assert len(personal.placeholder("Juno Drosthoff", "name", "name", key)) == len("[NAME ]") + 32


def test_dates_of_birth():
    key = b"k"
    text = "She was born on 1970-02-03 and hired on 2001-02-03. Date of birth: 3 February 1970; DOB 02/03/1970, born 31.12.1981, born 1970-02-30."
    got = [(k, text[a:b]) for a, b, k, _ in personal.mentions(text, dates=True)]
    assert got == [("date", "1970-02-03"), ("date", "3 February 1970"), ("date", "02/03/1970"), ("date", "31.12.1981"), ("date", "1970-02-30")] and personal.mentions(text) == []
    iso, words, us, german = (personal.permute_date(t, key) for _, t in got[:4])
    day = pd.Timestamp(iso)
    assert pd.Timestamp(words) == day == pd.to_datetime(us, format="%m/%d/%Y") and pd.to_datetime(german, format="%d.%m.%Y").year < 2100 and iso != "1970-02-03"
    assert personal.permute_date("1970-02-30", key) is None and len({personal.permute_date(str(d.date()), key) for d in pd.date_range("1990-01-01", "1994-12-31")}) == 1826


def test_masking(spark):
    texts = [(1, "Call (562) 555-0191 or 562.555.0191."), (2, "Mr. Zembrandt: reach 5625550191."), (3, None), (4, ""), (5, "nothing"), (6, "Dr. Zembrandt said so. " + "long text here. " * 20_000), (1, "Call (562) 555-0191 or 562.555.0191.")]
    got = personal.masked_texts(spark.createDataFrame([(k, t, "m") for k, t in texts], "doc_id long, text string, mentions string"), b"k").toPandas()
    one = got[got.doc_id == 1].masked.tolist()
    assert len(one) == 2 and one[0] == one[1] and "555-0191" not in one[0]
    import re

    digits = {re.sub(r"\D", "", x) for x in re.findall(r"\[PHONE ([^\]]+)\]", " ".join(got.masked.dropna()))}
    assert len(digits) == 1 and len(digits.pop()) == 10 and one[0].startswith("Call [PHONE (")
    names = set(re.findall(r"\[NAME \w+\]", " ".join(got.masked.dropna())))
    assert len(names) == 1 and pd.isna(got[got.doc_id == 3].masked.iloc[0]) and got[got.doc_id == 5].masked.iloc[0] == "nothing"
    found = {(r.doc_id, r.kind, r.start_at) for r in personal.found_mentions(spark.createDataFrame(texts, "doc_id long, text string"), b"k").collect()}
    assert found == {(1, "phone", 5), (1, "phone", 23), (2, "name", 4), (2, "phone", 21), (6, "name", 4)}


def test_what_else_changed_is_noticed():
    text = "Mr. Zembrandt: call 5625550191."
    found = personal.mentions(text)
    spans = [{"kind": k, "start_at": a, "end_at": b} for a, b, k, _ in found]
    new = personal.masked(text, found, b"k")
    assert personal.only_mentions_changed(text, new, spans) and not personal.only_mentions_changed(text, new + " ", spans) and not personal.only_mentions_changed(text, text, spans)
    assert not personal.only_mentions_changed(text, new.replace("[PHONE", "[NAME"), spans) and personal.only_mentions_changed(None, None, []) and not personal.only_mentions_changed("a", None, [])


def test_lexicon_finds_names_without_a_cue(spark):
    df = spark.createDataFrame([(i, "Copies were mailed to Juno Drosthoff, and so on.") for i in range(3)] + [(9, "Juno Drosthoff: Could you say more? Then Drosthoff, Juno: Yes. Operator: Good morning. Net Sales: 5."), (10, "TOTAL NET SALES: 4. JUNO DROSTHOFF: Could you? JUNO FOODS")], "doc_id long, text string")
    for most in (personal.MOST_WORDS, 0):  # the lexicon sent to every task, and joined with the words of the texts
        got = {(r.doc_id, r.start_at) for r in personal.found_mentions(df, b"k", most_words=most).collect()}
        assert got == {(0, 22), (1, 22), (2, 22), (9, 0), (9, 41), (10, 20)}
    with pytest.raises(ValueError):
        personal.masked_texts(df, b"")


def test_rare_names_are_kept_in_a_large_corpus(spark):
    """One name among very many others is in the lexicon as well."""
    names = spark.range(150_000).selectExpr("id AS doc_id", "concat('Mr. ', initcap(translate(cast(id + 100000 AS string), '0123456789', 'abcdefghik')), ' ', initcap(translate(cast(id + 100000 AS string), '0123456789', 'lmnopqrstu')), ' replied.') AS text")
    odd = spark.createDataFrame([(-1, "Mr. Zoltan Wexcombe replied."), (-2, "Then Zoltan Wexcombe left.")], "doc_id long, text string")
    got = personal.found_mentions(names.union(odd), b"k", most_words=1000).where("doc_id < 0")
    assert {(r.doc_id, r.start_at) for r in got.collect()} == {(-1, 4), (-2, 5)}


def test_unicode_data_backs_the_quick_check():
    assert all(unicodedata.is_normalized("NFC", c) for c in map(chr, range(0x80, 0x300)) if not canonical._unstable().fullmatch(c) and not unicodedata.combining(c))
