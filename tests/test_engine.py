"""The engine's own operators: literal expectations; the catalogue runs against its SQL at the smallest scale."""

import glob
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerwright.api import Engine
from ledgerwright.functions import text as T
from ledgerwright.operators import answers, evidence, facts, grading, pages, questions, ranking, series, tables, usage
from ledgerwright.plans import catalogue
from ledgerwright.sources import readers
from ledgerwright.streaming import ledger

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("$1,503", 1503.0), ("(1,234.5)", -1234.5), ("12%", 12.0), ("—", None), ("", None), (None, None), ("n/a", None), ("-3", -3.0), ("1.2.3", None)])
def test_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.number(F.col("t"))).first()[0] == want


def test_text_functions(spark):
    assert one(spark, T.years(F.col("t")), t="FY23 and 2021, FY2019") == ["2019", "2021", "2023"]
    assert one(spark, T.year_span(F.col("t")), t="from 2018 to 2021, and 2023") == ["2018", "2019", "2020", "2021", "2023"]
    assert one(spark, T.company_key(F.col("t")), t="ACME_FOODS_2023Q1_10K.pdf") == "acme foods" and one(spark, T.filing_year(F.col("t")), t="ACME_2023q1.pdf") == "2023Q1"
    assert one(spark, T.tokens(F.col("t")), t="Net sales 7,772 毛") == ["net", "sales", "7,772", "毛", "net sales"]
    assert one(spark, T.cleaned(F.col("t")), t="a&nbsp;&amp;  b\n\n\n\nc") == "a & b\n\nc" and one(spark, T.identifier(F.col("t")), t="--") == "val"
    assert one(spark, T.compound_growth(F.col("a"), F.col("b"), F.col("n")), a=100.0, b=121.0, n=2.0) == pytest.approx(10) and one(spark, T.growth(F.col("a"), F.col("b")), a=-10.0, b=-5.0) == 50


PASSAGES = [
    ("ACME", 1, "Company: ACME | Line Item: Total revenue | 2023: 5,000", "table_row", "income_statement", '{"line_item": "Net sales", "2023": "5,000", "FY2022": "(4,000)", "Col1": "9"}'),
    ("ACME", 2, "revenue revenue revenue growth growth", "text_note", None, None), ("ACME", 3, "completely unrelated content about weather patterns", "text_note", None, None), ("ACME", 4, None, "text_note", None, None), ("OTHER", 5, "revenue growth", "text_note", None, None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    d = spark.createDataFrame(PASSAGES, "company string, ord long, content string, type string, section string, raw_data string")
    return d.withColumns({"period": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("string"), "parent_content": F.lit(None).cast("string")})


def test_search_by_hand(spark, corpus):
    q = spark.createDataFrame([("q1", "ACME_2023_10K", "revenue growth"), ("q2", None, "x"), ("q3", "ACME", None), ("q4", "acme-2023", "total revenue 2023")], "id string, doc_name string, question string")
    plain = {(r.id, r.ord): r for r in ranking.search(corpus, q, switched_off=frozenset(ranking.WHAT_RULES_DO)).collect()}
    docs = {o: c for _, o, c, *_ in PASSAGES if o < 5}
    toks = {1: ["company", "acme", "line", "item", "total", "revenue", "2023", "5,000", "revenue", "total revenue"], 2: ["revenue"] * 3 + ["growth"] * 2 + ["revenue"], 3: docs[3].split(), 4: []}
    n, avg = 4, sum(map(len, toks.values())) / 4
    want = {}
    for o, t in toks.items():
        bm = ov = 0.0
        for w in ["revenue", "growth", "revenue"]:
            df = sum(w in x for x in toks.values())
            idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
            tf = t.count(w)
            bm += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)) if tf else 0
            ov += idf if w in (docs[o] or "") else 0
        want[o] = 0.7 * bm + 0.3 * ov
    got = {o: r.relevance_score for (i, o), r in plain.items() if i == "q1"}
    assert got == {o: round(s, 4) for o, s in want.items() if s > 0.01} and {i for i, _ in plain} == {"q1", "q4"}
    ruled = {(r.id, r.ord): r for r in ranking.search(corpus, q).collect()}
    assert ruled["q1", 1].applied_rules == "company_match,line_item_match,total_row_boost" and ruled["q4", 1].applied_rules == "company_match,line_item_match,total_row_boost,year_match_boost"
    assert ranking.search(corpus.limit(0), q).count() == 0 and ranking.search(corpus, q.limit(0)).count() == 0


def test_rules_by_hand(spark):
    cases = [("ACME_2023_10K", "acme 2023", 2.0), ("ACME_2023_10K", "acme 2022", 0.4), ("ACME_FOODS_2023", "acme", 1.8), ("ACMEFOODS", "acme foods", 1.8), ("ACME_FOODS", "acme paper", 1.2), ("BETA", "acme", 0.05), ("BETA", "", 1.0), (None, "acme", 1.0), ("ACME", "company", 1.0)]
    d = spark.createDataFrame([(a, b, i) for i, (a, b, _) in enumerate(cases)], "a string, b string, i int")
    d = d.select("i", T.company_key(F.col("a")).alias("filing"), T.filing_year(F.col("a")).alias("filing_year"), T.company_key(F.col("b")).alias("entity"), T.filing_year(F.col("b")).alias("entity_year"))
    assert [r.x for r in d.select("i", ranking.company_factor().alias("x")).orderBy("i").collect()] == [x for *_, x in cases]
    named = lambda t: set(one(spark, T.names_terms(F.col("t"), ("net sale", "r&d", "cash", "存貨")), t=t))
    assert named("Net sales of R&D, cashier") == {"net sale", "r&d"} and named("cash.") == {"cash"} and named("") == set()
    items = one(spark, ranking.line_item_keys(F.col("t")), t="What was the turnover of inventories and capex?")
    assert "=inventory" in items and "inventories" in items and "capex" in items
    assert one(spark, ranking.core_statements(F.col("t")), t="Company: A | Line Item: Total assets | 2023: 5") == ["balance_sheet"] and ranking.rule_report(spark).count() == 8


def test_quota(spark):
    rows = [("q", f"a{i}", "0", 100 - i) for i in range(10)] + [("q", f"b{i}", "1", 30 - 10 * i) for i in range(3)]
    got = [r.ord for r in ranking.quota_window(spark.createDataFrame(rows, "id string, ord string, subquery string, score int"), 6).orderBy("position").collect()]
    assert got == ["a0", "a1", "a2", "a3", "b0", "b1"]


def test_facts_and_formulas(spark, corpus):
    f = facts.row_facts(corpus)
    assert {(r.item, r.year, r.val) for r in f.collect()} == {("Net sales", "2023", 5000.0), ("Net sales", "2022", -4000.0)}
    wide = facts.wide_facts(f)
    assert {(r.year, r.value) for r in facts.evaluate(wide, "revenue_yoy").collect()} == {("2023", -225.0)} and facts.evaluate(wide, "gross_margin").count() == 0
    label = lambda t: spark.createDataFrame([(t,)], "t string").select(facts.canonical_item(F.col("t"))).first()[0]
    assert label("Total current  assets") == "current_assets" and label("Change in inventories") is None and label("Consolidated net sales") == "revenue" and label(None) is None
    assert len(facts.FORMULAS) == 49
    for bad in ("__import__('os')", "revenue.x", "revenue if cogs else 1", "nonsense + 1", "revenue // 2"):
        with pytest.raises((ValueError, SyntaxError)):
            facts.formula_sql(bad, lambda a, b: f"{a}/{b}")


def test_tables(spark):
    md = "Prose\n| Line Item | FY2023 | 2022 |\n|---|---|---|\n| Net  sales | (5) | $1,000 |\n| Net  sales | 7 |  |\n|  |  |  |"
    df = spark.createDataFrame([("p", md, 1), ("n", None, 2), ("x", "no table", 3)], "parent_id string, parent_content string, row int")
    dec = tables.decode(df)
    long = {(r.row_ix, r.item, r.year, r.val, r.dup) for r in tables.duplicate_suffixes(tables.unpivot(dec)).collect()}
    assert long == {(0, "Net  sales", "2023", -5.0, 0), (0, "Net  sales", "2022", 1000.0, 0), (1, "Net  sales", "2023", 7.0, 1)}
    again = dec.groupBy("parent_id").agg(F.first("headers").alias("h"), F.collect_list("row").alias("rows")).select(tables.encode(F.col("h"), F.col("rows"))).first()[0]
    assert again.split("\n") == ["| Line Item | FY2023 | 2022 |", "|---|---|---|", "| Net  sales | (5) | $1,000 |", "| Net  sales | 7 |  |"]
    blocks = [(r.is_table, r.lines) for r in tables.blocks(df, "parent_content", "parent_id").where("parent_id = 'p'").orderBy("block").collect()]
    assert blocks == [(False, 1), (True, 4), (False, 1)] or blocks == [(False, 1), (True, 5)]
    w = lambda t: one(spark, tables.windows(F.col("t"), 10, 3), t=t)
    assert w("") == [] and w("x" * 10) == ["x" * 10] and [len(x) for x in w("y" * 25)] == [10, 10, 10, 4]
    assert one(spark, tables.html_tables(F.col("t")), t="<table><tr><th colspan=2>a</th></tr><tr><td>1&amp;2</td><td><b>3</b></td></tr></table>") == "| a | a |\n| 1&2 | 3 |"


def test_every_table_of_a_parent(spark):
    """Two filings of a company have the same parent_id: both tables are decoded, each for itself."""
    one_, two = (f"| Item | Q1 | Q2 | Q3 | Q4 | 2023 |\n|---|---|---|---|---|---|\n| {a} | 1 | 1 | 1 | 1 | {v} |\n| Stock | 1 | 2 | 3 | 4 | 10 |" for a, v in (("Change in stock", 4), ("Net cash", 7)))
    df = spark.createDataFrame([("p", one_), ("p", two), ("p", two), ("q", two)], "parent_id string, parent_content string")
    dec = tables.decode(df)
    assert sorted((r.parent_id, r.row_ix, r.row[0]) for r in dec.collect()) == [("p", 0, "Change in stock"), ("p", 0, "Net cash"), ("p", 1, "Stock"), ("p", 1, "Stock"), ("q", 0, "Net cash"), ("q", 1, "Stock")]
    long = tables.duplicate_suffixes(tables.unpivot(dec))
    assert sorted((r.parent_id, r.item, r.val, r.dup) for r in long.collect()) == [("p", "Change in stock", 4.0, 0), ("p", "Net cash", 7.0, 0), ("p", "Stock", 10.0, 0), ("p", "Stock", 10.0, 0), ("q", "Net cash", 7.0, 0), ("q", "Stock", 10.0, 0)]
    labels = series.change_labels(dec.select("parent_id", "digest", "row_ix", F.get("row", F.lit(0)).alias("item")))
    assert sorted(r.label for r in labels.where("parent_id = 'p'").collect()) == ["Change in Stock", "Change in stock", "Net cash", "Stock"]
    assert sorted((r.parent_id, r.row_ix) for r in evidence.quarterly_rows(dec).collect()) == [("p", 0), ("p", 1), ("p", 1), ("q", 1)]


def test_wide_rows_keep_all_cells(spark):
    cells = [f"c{i}" for i in range(1500)]
    wide = spark.createDataFrame([(cells, cells, "ACME"), (["h"], ["only"], "ACME"), ([], [], "ACME")], "headers array<string>, row array<string>, company string")
    said = [r.said for r in wide.select(tables.linearised(F.col("headers"), F.col("row"), F.col("company")).alias("said")).collect()]
    assert said == ["Company: ACME | Line Item: c0 | " + " | ".join(f"{c}: {c}" for c in cells[1:]), "Company: ACME | Line Item: only | ", "Company: ACME | "]
    quarters = spark.createDataFrame([("p", "d", 0, ["Sales"] + [""] * 200 + ["1", "2", "3", "4", "10"]), ("p", "d", 1, ["Sales"])], "parent_id string, digest string, row_ix int, row array<string>")
    assert [r.row_ix for r in evidence.quarterly_rows(quarters).collect()] == [0]


def test_pages(spark):
    bad = lambda t: one(spark, pages.is_malformed_label(F.col("t")), t=t)
    assert bad("89,463") and bad("$") and not bad("Revenues") and not bad("2027") and not bad("2031-2035")
    rows = [(1, "A", None, "Document: d |"), (2, "A", "notes", "Document: d |"), (3, "A", "unknown", "Document: d |"), (4, "A", None, "Document: e |")]
    got = {r.ord: r.carried for r in pages.carried_sections(spark.createDataFrame(rows, "ord long, company string, section string, content string")).collect()}
    assert got == {1: "cover_page", 2: "notes", 3: "notes", 4: "cover_page"}
    words = [("d", 1, x, y, x + 20.0, t) for y, cells in ((10.0, ("Sales", "5", "7")), (11.0, ()), (30.0, ("Cost", "(6)", "8"))) for x, t in zip((10.0, 100.0, 200.0), cells)]
    laid = pages.rows_of_words(spark.createDataFrame(words, "doc string, page int, x0 double, top double, x1 double, text string"))
    assert {r.row for r in laid.collect()} == {0, 1} and [r.anchor for r in pages.column_anchors(laid).orderBy("column").collect()] == [120.0, 220.0]


def test_questions(spark):
    rows = [("1", "ACME_2023_10K", "What was Acme Foods's capital spending in FY2023?"), ("2", "acme 2022", "How did Acme change its inventory between 2021 and 2022?"), ("3", "X", "Why did Acme shrink?"), ("4", None, None)]
    got = {r.id: r for r in questions.classified(spark.createDataFrame(rows, "id string, doc_name string, question string")).collect()}
    assert got["1"].strategy == "TARGETED_ROW" and got["1"].statement == "cash_flow" and got["2"].calculation == "change" and got["2"].years == ["2021", "2022"] and got["3"].answer_mode == "EXPLANATION" and "4" not in got
    steps = [r.query for r in questions.plan_steps(questions.classified(spark.createDataFrame(rows, "id string, doc_name string, question string"))).where("id = '2'").orderBy("step").collect()]
    assert steps == ["Acme inventory 2021", "Acme inventory 2022"]


def test_grading(spark):
    agree = lambda a, b: one(spark, grading.numbers_agree(F.col("a"), F.col("b")), a=a, b=b)
    assert agree("$16.6 million", "16,610,000") and agree("43.0%", "43.1 %") and agree("7.90", "9") is False and agree("Yes", "7") is None


def test_usage(spark):
    import datetime as dt

    at = dt.datetime(2025, 1, 1, 23, 50)
    rows = [(1, at), (1, at + dt.timedelta(minutes=20)), (1, at + dt.timedelta(minutes=60)), (2, None), (2, at)]
    got = sorted((r.pid, r.calls) for r in usage.sessions(spark.createDataFrame(rows, "pid int, at timestamp")).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_checks(spark, corpus):
    q = spark.createDataFrame([("q1", "ACME", "revenue growth 2023"), ("q2", "ACME", "revenue 2019"), ("q3", "NONE", "revenue")], "id string, doc_name string, question string")
    c = answers.checked(q, ranking.search(corpus, q).select("id", "ord"), corpus)
    got = {r.id: (r.decision, r.failure, r.missing_years) for r in c.collect()}
    assert got == {"q1": ("ACCEPT", None, ""), "q2": ("REJECT", "missing_years", "2019"), "q3": ("REJECT", "no_evidence", "")}
    assert {(r.id, r.action, r.top_k) for r in answers.retries(c).collect()} == {("q2", "targeted", 15), ("q3", "broaden", 5)}


def test_sources_and_engine(spark, tmp_path):
    (tmp_path / "ACME.txt").write_text("Revenue rose. " * 100)
    (tmp_path / "BETA.csv").write_text('Item,2023\nNet sales,"1,000"\n,\n')
    (tmp_path / "GAMMA.json").write_text(json.dumps({"company": "GAMMA", "statements": [{"title": "IS", "type": "income_statement", "headers": ["Line Item", "2023"], "rows": [["Net sales", "5"], ["Cost of sales"]]}], "notes": [{"title": "n", "text": "note text"}]}))
    e = Engine(spark).ingest_file(str(tmp_path / "ACME.txt")).ingest_file(str(tmp_path / "BETA.csv")).ingest_text("DELTA", "memo", "inventory fell in 2020")
    assert {(r.company, r.type): r["count"] for r in e.passages.groupBy("company", "type").count().collect()} == {("ACME", "text_note"): 2, ("BETA", "table_row"): 1, ("DELTA", "custom_upload"): 1}
    assert e.search("inventory 2020", "DELTA").first().rank == 1 and e.ask("Why did inventory fall in 2020?", "DELTA").first().decision == "ACCEPT"
    s = readers.read_statements(spark, str(tmp_path / "GAMMA.json"))
    assert sorted(r.type for r in s.collect()) == ["table_row", "table_row", "text_note"] and facts.row_facts(s.withColumn("raw_data", F.replace("raw_data", F.lit("Line Item"), F.lit("line_item")))).first().val == 5.0
    readers.append_passages(s, str(tmp_path / "store"))
    assert readers.read_store(spark, str(tmp_path / "store"), "GAMMA").count() == 3 and readers.newest(spark, str(tmp_path / "store")).first().files > 0


def test_encodings(spark, tmp_path):
    texts = {"utf8": "Umsatz für 2023 毛利".encode(), "mark": b"\xef\xbb\xbfNet sales", "big5": "營業收入為五億元".encode("cp950"), "latin": "Chiffre d'affaires: 5 \xa3\xff\xff".encode("latin1"), "none": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()] + [("null", None)], "k string, content binary")
    got = {r.k: r.t for r in df.select("k", readers.decoded(F.col("content")).alias("t")).collect()}
    assert got["utf8"] == "Umsatz für 2023 毛利" and got["mark"] == "Net sales" and got["big5"] == "營業收入為五億元" and got["latin"].startswith("Chiffre d'affaires: 5") and got["none"] == "" and got["null"] is None
    (tmp_path / "ACME.txt").write_bytes(texts["big5"])
    assert [r.content for r in readers.read_prose(spark, str(tmp_path / "ACME.txt")).collect()] == ["營業收入為五億元"]


def test_ingests_of_two_companies_stay_apart(spark):
    e = Engine(spark).ingest_text("ACME", "a", "inventory fell").ingest_text("BETA", "b", "inventory rose").ingest_text("ACME", "c", "inventory fell again")
    assert sorted(r.ord for r in e.passages.collect()) == sorted({r.ord for r in e.passages.collect()}) and e.passages.count() == 3
    company = {r.ord: r.company for r in e.passages.collect()}
    got = e.search("inventory", "ACME").collect()
    assert len(got) == 2 == len({r.ord for r in got}) and {company[r.ord] for r in got} == {"ACME"}


def test_runs_meet_the_ledger_by_day(spark):
    import datetime as dt

    at = dt.datetime(2025, 1, 1, 23, 50)
    lines = [(i, "t", "d", 1, "m", "c", 1, 1, 0, 10, 5, at + dt.timedelta(minutes=20 * i)) for i in range(4)]
    d = spark.createDataFrame(lines, "ledger_id long, ts string, date string, pid int, model string, caller string, prompt_tokens long, completion_tokens long, reasoning_tokens long, total_tokens long, prompt_chars int, read_at timestamp")
    d = d.withColumn("ts", F.col("ledger_id").cast("string"))
    runs = spark.createDataFrame([("a", at, at + dt.timedelta(minutes=40)), ("b", at + dt.timedelta(days=9), at + dt.timedelta(days=10)), ("c", at + dt.timedelta(minutes=40), at + dt.timedelta(days=1))], "run string, starts timestamp, ends timestamp")
    made = usage.within_runs(d, runs)
    assert {r.run: (r.calls, r.tokens) for r in made.collect()} == {"a": (2, 20), "b": (0, 0), "c": (2, 20)}
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()


def test_growth_over_the_stated_span(spark):
    rows = [("A", i, "x", "table_row", "s", json.dumps({"line_item": "Net sales", y: str(v)})) for i, (y, v) in enumerate((("2020", 100), ("2021", 50), ("2022", 121)))]
    d = spark.createDataFrame(rows, "company string, ord long, content string, type string, section string, raw_data string")
    got = {r.year: r.value for r in facts.evaluate(facts.wide_facts(facts.row_facts(d)), "cagr_generic").collect()}
    assert got == {"2021": -50.0, "2022": 10.0}


def test_a_row_without_label_keeps_its_first_value(spark):
    d = spark.createDataFrame([(["Item", "2023", "2022"], ["", "5", ""], "A")], "h array<string>, r array<string>, c string")
    assert d.select(tables.linearised(F.col("h"), F.col("r"), F.col("c"))).first()[0] == "Company: A | Line Item:  | 2023: 5"


def test_streams(spark, tmp_path):
    line = lambda t, pid, n: {"ts": t, "date": t[:10], "pid": pid, "model": "m", "caller": "answer", "total_tokens": n}
    lines = [line("2025-01-01T10:00:00Z", 1, 60), line("2025-01-01T10:01:00Z", 1, 60), line("2025-01-01T10:20:00Z", 2, None), line("n/a", 2, 5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    s = ledger.stream(spark, str(tmp_path / "in"))
    for name, df, mode in (("win", ledger.windowed(s), "complete"), ("alert", ledger.alerts(s, 100), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert sorted((r.calls, r.unknown, r.tokens) for r in spark.table("win").collect()) == [(1, 1, None), (2, 0, 120)]
    assert [(r.pid, r.tokens, r.step) for r in spark.table("alert").collect()] == [(1, 120, 1)]
    ledger.keep_totals(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    assert {(r.pid, r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).where("date = '2025-01-01'").collect()} == {(1, 120), (2, 0)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(k for k in catalogue.oracle_sql() if not k.startswith("formula_")))
def test_catalogue_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    res = duck.execute(catalogue.oracle_sql()[name])
    at = [x[0] for x in res.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(at) == cols and sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr) == want
