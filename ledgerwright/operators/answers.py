"""Answers from facts, checks of the evidence, and what to retry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import text as T
from ledgerwright.operators import facts as X
from ledgerwright.operators.questions import classified

# What to do about a failed check, with the number of passages to look at.
RETRIES = {"no_evidence": ("broaden", 5), "entity_mismatch": ("refine", 5), "missing_years": ("targeted", 15)}
# The variable a metric's name in a question stands for, where the label differs.
METRIC_VARIABLES = {
    "net sales": "revenue", "operating income": "operating_income", "net income": "net_income", "income tax expense": "income_tax", "interest expense": "interest_expense",
    "selling and administrative expense": "sga", "accounts receivable": "accounts_receivable", "inventory": "inventory", "goodwill": "goodwill", "long-term borrowings": "long_term_debt",
    "capital spending": "capex", "depreciation": "depreciation", "share repurchases": "repurchases",
}


def direct_lookup(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """id, metric, year, value, ord: the fact a question asks for, per metric and year it names, where its company states one."""
    names = F.create_map(*(F.lit(x) for kv in METRIC_VARIABLES.items() for x in kv))
    asked = classified(questions).select("id", "store", F.explode("metrics").alias("metric"), "years").select("id", "store", "metric", F.try_element_at(names, F.col("metric")).alias("canonical"), F.explode("years").alias("year"))
    best = X.best_facts(X.row_facts(passages)).withColumnRenamed("company", "store")
    return asked.join(best, ["store", "canonical", "year"]).select("id", "metric", "year", F.col("val").alias("value"), "ord")


def answered_change(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """id, metric, first_year, last_year, change, growth: first to last of the years a question names, where both are stated."""
    d = direct_lookup(questions, passages).groupBy("id", "metric").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("value", "year").alias("a"), F.max_by("value", "year").alias("b"))
    return d.where("first_year < last_year").select("id", "metric", "first_year", "last_year", F.round(F.col("b") - F.col("a"), 4).alias("change"), F.round(T.growth(F.col("a"), F.col("b")), 4).alias("growth"))


def checked(questions: DataFrame, hits: DataFrame, passages: DataFrame) -> DataFrame:
    """id, evidence, missing_years, decision, failure: whether the hits cover a question's years and name its company.

    Failures in order: no_evidence, entity_mismatch, missing_years; without one the evidence is accepted.
    """
    q = questions.where("question IS NOT NULL").select("id", F.lower(F.regexp_extract("doc_name", r"([A-Za-z0-9]+)", 1)).alias("name"), T.years(F.col("question")).alias("asked"))
    seen = hits.join(passages.select("ord", "content", "company", "period"), "ord").select("id", "company", T.years(F.concat_ws(" ", "period", "content")).alias("years"))
    per = seen.groupBy("id").agg(F.count("*").alias("evidence"), F.array_distinct(F.flatten(F.collect_list("years"))).alias("years"), F.collect_set(F.lower("company")).alias("companies"))
    d = q.join(per, "id", "left").select("id", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.array_sort(F.array_except("asked", F.coalesce("years", F.array().cast("array<string>")))).alias("missing"), F.coalesce(F.array_contains("companies", F.col("name")), F.lit(False)).alias("named"))
    failure = F.when(F.col("evidence") == 0, "no_evidence").when(~F.col("named"), "entity_mismatch").when(F.size("missing") > 0, "missing_years")
    return d.select("id", "evidence", F.array_join("missing", ",").alias("missing_years"), F.when(failure.isNull(), "ACCEPT").otherwise("REJECT").alias("decision"), failure.alias("failure"))


def retries(checks: DataFrame) -> DataFrame:
    """id, action, top_k: what to do about each rejected question."""
    table = F.create_map(*(x for k, (a, n) in RETRIES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("action"), F.lit(n).alias("top_k")))))
    return checks.where("failure IS NOT NULL").select("id", F.try_element_at(table, F.col("failure")).alias("r")).select("id", "r.action", "r.top_k")
