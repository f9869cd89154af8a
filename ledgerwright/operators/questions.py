"""Understanding questions in bulk: years, entity, kind of calculation, statement, answer mode, plan steps. Columns only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import text as T
from ledgerwright.operators.ranking import STATEMENTS, question_store

# Words that tell the kind of calculation, in order of precedence.
CALCULATION = {
    "yoy": ("yoy", "year over year", "growth rate", "growth"), "cagr": ("cagr", "compound annual growth"), "margin": ("margin",), "ratio": ("ratio", "percent"),
    "change": ("change", "difference"), "compare": ("compare", "versus", "vs"),
}
CHANGE_VERBS = ("grow", "drop", "decline", "decrease", "increase", "rise", "fell")
EXPLANATION = ("why", "what drove", "what caused", "driver", "drove", "explain")
ASSESSMENT = ("capital-intensive", "capital intensive", "useful metric", "not a useful metric", "should", "whether")
EXCLUSION = ("exclude", "excluding", "without", "adjusted for", "m&a", "organic", "merger")
# Metrics a question may ask for, and the statement each stands in.
METRICS = {
    "net sales": "income_statement", "gross margin": "income_statement", "operating income": "income_statement", "net income": "income_statement", "income tax expense": "income_statement",
    "interest expense": "income_statement", "selling and administrative expense": "income_statement", "restructuring charges": "income_statement", "pension cost": "income_statement",
    "accounts receivable": "balance_sheet", "inventory": "balance_sheet", "goodwill": "balance_sheet", "working capital": "balance_sheet", "long-term borrowings": "balance_sheet",
    "lease obligations": "balance_sheet", "deferred revenue": "balance_sheet", "warranty reserves": "balance_sheet", "free cash flow": "cash_flow", "capital spending": "cash_flow",
    "depreciation": "cash_flow", "share repurchases": "cash_flow",
}
_SKIP = "What Which How Why Did Does Is Are Was Were Has Have Do Using The In For Of As At By From If When Who Where Would Could Should A An And Between During".split()


def starts_with_any(words: tuple[str, ...]) -> str:
    """A pattern for any of the words where one begins; what follows doesn't matter."""
    return r"(^|[^a-z0-9_])(" + "|".join(re.escape(w) for w in words) + ")"


def entity(question: Column) -> Column:
    """The first capitalised word that is no question word, fiscal label or quarter; `company` if there is none."""
    words = F.regexp_extract_all(question, F.lit(r"([A-Z][A-Za-z0-9&]*)"), F.lit(1))
    named = F.filter(words, lambda w: ~w.isin(*_SKIP) & ~w.rlike(r"^(FY\d*|Q[1-4])$"))
    return F.coalesce(F.get(named, 0), F.lit("company"))


def metrics(question: Column) -> Column:
    low = F.lower(question)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in METRICS)))


def classified(questions: DataFrame) -> DataFrame:
    """id, store, entity, years, metrics, calculation, statement, answer_mode, strategy: one row per question with a text."""
    q, low = F.col("question"), F.lower("question")
    named = metrics(q)
    calculation = F.coalesce(*(F.when(low.rlike(starts_with_any(w)), F.lit(k)) for k, w in CALCULATION.items()), F.when(low.rlike(starts_with_any(CHANGE_VERBS)), F.lit("change")), F.lit("none"))
    votes = {s: F.size(F.array_intersect(named, F.array(*(F.lit(k) for k, v in METRICS.items() if v == s)))) for s in ("cash_flow", "income_statement", "balance_sheet")}
    literal = {s: low.rlike(p) for s, p in STATEMENTS.items()}
    one = sum((c.cast("int") for c in literal.values()), F.lit(0)) == 1
    most = F.greatest(*votes.values())
    statement = F.coalesce(F.when(one, F.coalesce(*(F.when(c, F.lit(s)) for s, c in literal.items()))), F.when(most > 0, F.coalesce(*(F.when(v == most, F.lit(s)) for s, v in votes.items()))), F.lit("none"))
    mode = (
        F.when(low.rlike(starts_with_any(EXCLUSION)), "EXCLUSION").when(low.rlike(starts_with_any(EXPLANATION)), "EXPLANATION")
        .when(calculation != "none", "NUMERIC").when(low.rlike(r"how much") & low.rlike(r"usd|dollar|million|billion|\$"), "NUMERIC")
        .when(low.rlike(starts_with_any(ASSESSMENT)), "ASSESSMENT").when(F.size(named) > 0, "NUMERIC").otherwise("EXPLANATION")
    )
    d = questions.where("question IS NOT NULL").select(
        "id", question_store(F.col("doc_name")).alias("store"), entity(q).alias("entity"), T.year_span(q).alias("years"), named.alias("metrics"), calculation.alias("calculation"),
        statement.alias("statement"), mode.alias("answer_mode"),
    )
    strategy = F.when(F.col("answer_mode") != "NUMERIC", "NARRATIVE").when(F.size("metrics") * F.greatest(F.size("years"), F.lit(1)) <= 1, "TARGETED_ROW").otherwise("MULTI_ROW")
    return d.withColumn("strategy", strategy)


def plan_steps(classes: DataFrame, most: int = 5) -> DataFrame:
    """id, step, query: the retrieval queries of each question, metric by year, at most `most`; without a metric the entity and years."""
    wanted = F.when(F.size("metrics") > 0, F.col("metrics")).otherwise(F.array(F.lit("overview")))
    when = F.when(F.size("years") > 0, F.col("years")).otherwise(F.array(F.lit("")))
    made = F.flatten(F.transform(wanted, lambda m: F.transform(when, lambda y: F.trim(F.concat_ws(" ", F.col("entity"), m, y)))))
    return classes.select("id", F.posexplode(F.slice(made, 1, most)).alias("at", "query")).select("id", (F.col("at") + 1).alias("step"), "query")


def resolved(questions: DataFrame, filings: DataFrame) -> DataFrame:
    """id, filename: the filing a question's document names: equal keys first, then a key that begins with the other.

    Keys meet on their prefixes, so a company's questions and filings aren't all paired; of several filings the one that
    was registered first counts.
    """
    key = lambda c: F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), r"\.[A-Za-z0-9]{1,4}$", "")), r"[^a-z0-9]+", "")
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.substring(c, F.lit(1), i)))
    f = filings.select(F.upper("company").alias("store"), key(F.col("filename")).alias("f"), "filename", "ordinal")
    q = questions.where("doc_name IS NOT NULL").select("id", question_store(F.col("doc_name")).alias("store"), key(F.col("doc_name")).alias("q"))
    longer = q.join(f.select("*", prefixes(F.col("f")).alias("q")), ["store", "q"]).select("id", "q", "f", "filename", "ordinal")
    shorter = q.select("*", prefixes(F.col("q")).alias("p")).where("p <> q").join(f.withColumnRenamed("f", "p"), ["store", "p"]).select("id", "q", F.col("p").alias("f"), "filename", "ordinal")
    pair = longer.unionByName(shorter)
    return pair.groupBy("id").agg(F.min_by("filename", F.struct((F.col("f") != F.col("q")).cast("int"), F.col("ordinal"))).alias("filename"))
