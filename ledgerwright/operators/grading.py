"""Grading answers: numbers compared, labels tabulated, disagreements, checks of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions import text as T

# The labels.
LABELS = ("C", "S", "P", "W")


def tabulated(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """part, question_type, C, S, P, W, graded, correct: counts of labels by part and type, of each and over all (`*`), as a cube."""
    one = labels.where("label IS NOT NULL").select("id", F.upper("label").alias("label"))
    d = questions.select("id", F.regexp_extract("id", r"^([a-z]+)-", 1).alias("part"), F.coalesce("question_type", F.lit("?")).alias("question_type")).join(one, "id")
    counts = [F.sum((F.col("label") == x).cast("int")).alias(x) for x in LABELS]
    cube = d.cube("part", "question_type").agg(*counts, F.count("*").alias("graded")).na.fill("*", ["part", "question_type"])
    return cube.withColumn("correct", F.round(F.col("C") / F.col("graded"), 4))


def disagreements(labels: DataFrame) -> DataFrame:
    """id, labels: questions with labels that differ."""
    return labels.where("label IS NOT NULL").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.upper("label"))), ",").alias("labels"), F.countDistinct(F.upper("label")).alias("n")).where("n > 1").select("id", "labels")


def unlabelled(questions: DataFrame, labels: DataFrame) -> DataFrame:
    return questions.join(labels.where("label IS NOT NULL"), "id", "left_anti").select("id")


def unfinished(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions that have no result, or only failed and empty ones, so that a run goes on where it ended; finished ones aren't run again."""
    return questions.join(results.where("answer IS NOT NULL AND trim(answer) <> ''"), "id", "left_anti")


def odd_rules(labels: DataFrame) -> DataFrame:
    """id, label, rule: labels that want a rule and have none, or have one and want none."""
    up = F.upper("label")
    return labels.where((up.isin("P", "W") & F.col("rule").isNull()) | ((up == "C") & F.col("rule").isNotNull())).select("id", up.alias("label"), "rule")


def answer_value(answer: Column) -> Column:
    """The number an answer states, scaled by a word of scale; null for words."""
    m = F.regexp_extract(answer, r"^\s*\(?\$?\s*(-?[\d,]+(?:\.\d+)?)", 1)
    low = F.lower(answer)
    scale = F.when(low.rlike(r"billion|bn"), 1e9).when(low.rlike(r"million"), 1e6).when(low.rlike(r"thousand"), 1e3).otherwise(1.0)
    return T.number(F.nullif(m, F.lit(""))) * scale


def numbers_agree(gold: Column, given: Column, tolerance: float = 0.01) -> Column:
    """Whether two answers state the same number within a tolerance of the gold one; null where one states none."""
    a, b = answer_value(gold), answer_value(given)
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.lit(1e-9)))


def answer_kinds(questions: DataFrame) -> DataFrame:
    """question_type, kind, n: kinds of gold answers by type of question."""
    a = F.col("answer")
    kind = F.when(a.isNull(), "missing").when(F.lower(F.trim(a)).isin("yes", "no"), "yes_no").when(a.rlike(r"%\s*$"), "percent").when(F.contains(a, F.lit("$")), "money").when(answer_value(a).isNotNull(), "number").otherwise("text")
    return questions.groupBy(F.coalesce("question_type", F.lit("?")).alias("question_type"), kind.alias("kind")).agg(F.count("*").alias("n"))
