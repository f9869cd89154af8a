"""What is shown of evidence, quarterly tables, and the fiscal periods filings speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.functions import text as T

# Characters of a snippet and of a page window, and the tolerance of a quarterly sum.
SNIPPET, WINDOW, QUARTER_TOLERANCE = 120, 400, 0.02


def snippet(text: Column, size: int = SNIPPET) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def page_window(page: Column, part: Column, size: int = WINDOW) -> Column:
    """`size` characters of a page around where a part of it begins; the whole page if it is shorter."""
    at = F.locate(part, page) if isinstance(part, str) else F.instr(page, part)
    start = F.greatest(F.lit(1), F.least(at - size // 2, F.length(page) - size + 1))
    return F.when(F.length(page) <= size, page).otherwise(F.substring(page, start, F.lit(size)))


def quarterly_rows(decoded: DataFrame, key: str = "parent_id") -> DataFrame:
    """key, digest, row_ix: rows of decoded tables whose first four numbers add up to the fifth within the tolerance."""
    nums = F.filter(F.transform(F.slice("row", 2, F.size("row")), lambda c: T.number(c)), lambda v: v.isNotNull())
    d = decoded.select(key, "digest", "row_ix", nums.alias("v")).where("size(v) >= 5")
    four = F.aggregate(F.slice("v", 1, 4), F.lit(0.0), lambda a, x: a + x)
    return d.where(F.abs(four - F.get("v", 4)) <= QUARTER_TOLERANCE * F.abs(F.get("v", 4))).select(key, "digest", "row_ix")


def fiscal_ends(documents: DataFrame) -> DataFrame:
    """company, month, mentions, first_year, last_year: the month a company's years end in, by what its texts say most often."""
    said = documents.where("text IS NOT NULL AND company IS NOT NULL")
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(r"year ended ([A-Z][a-z]+) (20\d\d)"), F.lit(1)).alias("m"), F.regexp_extract_all("text", F.lit(r"year ended ([A-Z][a-z]+) (20\d\d)"), F.lit(2)).alias("y"))
    d = said.select("company", F.explode(pairs).alias("p")).groupBy("company", F.col("p.m").alias("month")).agg(F.count("*").alias("mentions"), F.min("p.y").alias("first_year"), F.max("p.y").alias("last_year"))
    return d.withColumn("n", F.row_number().over(W.partitionBy("company").orderBy(F.desc("mentions"), "month"))).where("n = 1").drop("n")
