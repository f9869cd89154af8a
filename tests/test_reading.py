"""Page layout, shapes of texts and judging against literal expectations."""

import pytest
from pyspark.sql import functions as F

from ledgerwright.operators import grading, judging, layout, questions, ranking, series, shapes
from ledgerwright.operators.layout import Word


def words(lines, step=12.0):
    """Words of rows given as (left edge or right edge if negative, text)."""
    out = []
    for i, line in enumerate(lines):
        for at, text in line:
            x0 = float(at) if at >= 0 else -at - 5.0 * len(text)
            out.append(Word(x0, i * step + (0.8 if at < 0 else 0), x0 + 5.0 * len(text), text))
    return out


PAGE = [
    [(10, "Consolidated"), (80, "results")], [(-300, "2023"), (-400, "2022")], [(10, "Net"), (30, "sales"), (270, "$"), (-300, "1,503"), (-400, "1,200")], [(10, "Cost"), (-300, "(900)"), (-400, "(800)")],
    [(10, "Maturities"), (70, "from"), (100, "1"), (110, "to"), (125, "5"), (140, "years"), (-300, "12"), (-400, "—")], [(10, "See"), (30, "notes")],
]


def test_grid():
    assert layout.grid(words(PAGE)) == [(True, ["", "2023", "2022"]), (False, ["Net sales", "$1,503", "1,200"]), (False, ["Cost", "(900)", "(800)"]), (False, ["Maturities from 1 to 5 years", "12", "—"])]
    assert layout.grid(words(PAGE[:3])) == [] and layout.grid([]) == []
    drifting = [[(10, f"row{'abcdef'[i]}"), (-(300 + 4 * i), "1"), (-(400 + 40 * i), "2")] for i in range(3)]
    assert layout.grid(words(drifting)) == []


def test_pieces_of_layout():
    assert layout.column_gap([100, 101, 102, 150, 200]) == pytest.approx(24.5) and layout.column_gap([1, 2]) == 3.0
    row = words([[(-300, "2023"), (-400, "2022")]])
    assert layout.is_years_row(row) and not layout.is_years_row(row[:1]) and layout.nearest(303, [300, 400]) == 0 and layout.nearest(350, [300, 400]) is None
    assert [w.text for w in layout.signs_joined(words([[(10, "$"), (40, "5"), (60, "$"), (68, "7")]]))] == ["$", "5", "$7"]


def test_words_of_pages(spark):
    rows = [("d", p, w.x0, w.top, w.x1, w.text, "clash") for p in ("1", "2") for w in words(PAGE)] + [("d", "3", 1.0, 1.0, 2.0, "alone", ""), ("d", "1", None, 1.0, 2.0, "x", ""), ("d", "1", 1.0, 1.0, 2.0, None, "")]
    df = spark.createDataFrame(rows, "doc string, page string, x0 double, top double, x1 double, text string, cells string")
    got = [(r.page, r.is_header, r.cells) for r in layout.tables_of_words(df).orderBy("page", "row_ix").collect()]
    assert got == [(p, h, c) for p in ("1", "2") for h, c in layout.grid(words(PAGE))] and layout.tables_of_words(df.limit(0)).count() == 0


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


def test_shapes(spark):
    t = F.col("t")
    assert one(spark, shapes.leverage_pairs(t), "We saw leverage of fuel costs, deleverage in wages due to overtime and leverage of  fuel costs.") == ["fuel costs fell", "wages rose"]
    assert one(spark, shapes.raw_numbers(t, 3), "In 2023 sales were 1,503 and 7.5; 12, 13") == ["1503", "7.5", "12"]
    q = spark.createDataFrame([("1", "Which segment had the highest sales in Q3 and Q1?"), ("2", "How much did revenue grow in FY23, in billions?"), ("3", "What drove it?"), ("4", None)], "id string, question string")
    got = {r.id: r for r in shapes.question_shapes(q).collect()}
    assert got["1"].selection and got["1"].no_calculation and got["1"].quarters == "Q1,Q3" and got["2"].years == "2022,2023" and got["2"].scale == 0.001 and not got["2"].no_calculation and got["3"].attribution and "4" not in got
    d = spark.createDataFrame([(1, "We expect to incur costs of approximately $150 million, of which approximately 60% has been incurred."), (2, "nothing"), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in shapes.incurred_costs(d).collect()] == [(1, 150.0, "million", 60.0, 250.0, 100.0)]
    k = spark.createDataFrame([(1, "Table of Contents\nPart I\nPart II"), (2, "x\nRevenue    1,000   2,000\nNet income   5   (6)\nCost of sales   7   8"), (3, "| a |\n|---|"), (4, ""), (5, None)], "doc_id int, text string")
    assert {r.doc_id: r.kind for r in shapes.page_kinds(k).collect()} == {1: "contents", 2: "statement", 3: "markdown", 4: "prose"}


def test_judging(spark):
    pair = lambda f, a, b: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("x")).first().x
    numbers = lambda t: [(r.v, r.d) for r in one(spark, judging.numbers(F.col("t")), t)]
    assert numbers("1. Sales of $1,503.2 million (FY23), loss (5) and −3, 10-year, COVID-19") == [(1503.2e6, 1), (-5.0, 0), (-3.0, 0)]
    assert pair(judging.facts_present, "$1.5 billion in 2023", "It was 1,503 million in 2022").passes and not pair(judging.facts_present, "1.25", "1.30").passes and pair(judging.facts_present, "fell 5%", "a change of -5 percent").passes
    assert pair(judging.facts_present, "no number", "5").passes is None and pair(judging.facts_present, "0.12", "12%").passes
    assert [one(spark, judging.stance(F.col("t")), t) for t in ("Yes, it did", "No.", "It did not grow", "It grew", None)] == ["yes", "no", "no", None, None]
    assert pair(judging.terms_present, "Aerospace and Diagnostics", "the aerospacial and diagnostic units") and not pair(judging.terms_present, "Aerospace", "retail") and pair(judging.terms_present, "", "x") is None


def test_series_of_two(spark):
    best = spark.createDataFrame([("A", "x", y, 1.0, 1) for y in ("2020", "2021", "2023")] + [("A", "y", y, 1.0, 1) for y in ("2020", "2021")], "company string, canonical string, year string, val double, ord long")
    assert sorted((r.canonical, r.year) for r in series.latest_pair(best).collect()) == [("x", "2023"), ("y", "2020"), ("y", "2021")]


def test_resume_and_own_hits(spark):
    q = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    done = spark.createDataFrame([("1", "yes"), ("2", " "), ("3", None), ("3", "no")], "id string, answer string")
    assert sorted(r.id for r in grading.unfinished(q, done).collect()) == ["2", "4"]
    hits = spark.createDataFrame([("1", "ACME_2023.pdf", 1), ("1", "BETA", 2), ("1", None, 3), ("2", "BETA", 4), ("2", "GAMMA", 5), ("3", "X", 6)], "id string, filing string, ord int")
    who = spark.createDataFrame([("1", "acme-2023-10k"), ("2", "ACME")], "id string, entity string")
    assert sorted(r.ord for r in ranking.own_hits(hits, who).collect()) == [1, 3, 4, 5, 6]


def test_filings_by_prefix(spark):
    q = spark.createDataFrame([("1", "ACME_2023_10K"), ("2", "acme 2023"), ("3", "ACME_2023_10K_0001_x"), ("4", "BETA_2020"), ("5", None), ("6", "ACME_2022")], "id string, doc_name string")
    f = spark.createDataFrame([("ACME", "ACME_2023_10K_0001.pdf", 2), ("ACME", "ACME_2023_10K.pdf", 3), ("ACME", "ACME_2023_10K_0001.pdf", 1), ("GAMMA", "BETA_2020.pdf", 1)], "company string, filename string, ordinal long")
    assert {r.id: r.filename for r in questions.resolved(q, f).collect()} == {"1": "ACME_2023_10K.pdf", "2": "ACME_2023_10K_0001.pdf", "3": "ACME_2023_10K_0001.pdf"}
