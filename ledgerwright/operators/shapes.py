"""What questions and pages look like: kinds of questions a calculation can't answer, contents pages, statements, directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.functions import text as T

# Shapes of questions, over their lower-case text.
QUESTION_SHAPES = {
    "attribution": r"\bwhat\s+(drove|caused|led\s+to)\b|\bwhy\s+(did|has|have)\b|\bdrivers?\s+of\b",
    "selection": r"\bwhich\b[^.?]{0,120}\b(highest|lowest|largest|biggest|smallest|greatest|fewest|most|least|best|worst)\b|\b(highest|lowest|largest|biggest|smallest)\b[^.?]{0,60}\b(segments?|regions?|categor(y|ies)|types?|divisions?|geograph\w*)\b",
    "guidance": r"\b(guidance|outlook|forecast(s|ed|ing)?)\b|\bexpected\s+to\s+(accelerate|decelerate|grow|increase|decrease|decline|slow)\b",
    "group_compare": r"\b(u\.?s\.?|domestic|international|foreign)\b[^.?]{0,60}\bcompare[sd]?\b|\bcompare[sd]?\b[^.?]{0,60}\b(u\.?s\.?|domestic|international|foreign)\b",
    "existence": r"\b(were|are|is|was|has|have)\s+there\s+any\s+([a-z-]+\s+){0,3}?(events?|items?|factors?|matters?|transactions?|nominees?)\b",
    "category_threshold": r"\b(categor(y|ies)|segments?)\b[^.?]{0,80}(represent|account(s|ed)?\s+for|exceed|more\s+than|greater\s+than)[^.?]{0,40}%",
    "ratio_direction": r"^\s*(did|does|do|was|were|is|are|has|have)\b[^?]{0,140}\bas\s+a\s+(percent(age)?|%|share|proportion)\s+of\b[^?]{0,80}\b(increase[sd]?|decrease[sd]?|risen?|fall|fell|grow|improve[sd]?|change[sd]?|decline[sd]?)\b",
    "acceleration": r"\b(accelerat\w*|decelerat\w*|slow(s|ing)?\s+down|speed(s|ing)?\s+up)\b",
    "share_of_sales": r"(percent|%)[^.?]{0,40}\b(sales|revenue)\b",
}
NO_CALCULATION = ("selection", "guidance", "group_compare", "existence", "category_threshold")
# Words of a trend, by which one year asked for means the year before, too.
TREND = r"\b(grow|grew|growth|increase[ds]?|decrease[ds]?|decline[ds]?|rose|rise|fell|drop(ped)?|improve[ds]?|change[ds]?)\b"
# What a page of statements speaks of.
STATEMENT_WORDS = (
    "revenue", "net sales", "net revenue", "total revenue", "gross profit", "gross margin", "operating income", "operating profit", "operating loss", "net income", "net loss", "net earnings", "cost of revenue", "cost of goods",
    "cost of sales", "ebitda", "ebit", "earnings per share", "eps", "diluted eps", "total assets", "total liabilities", "shareholders equity", "stockholders equity", "cash and cash equivalents", "long-term debt", "capital expenditure",
    "capex", "free cash flow", "depreciation", "amortization", "research and development", "r&d", "營業收入", "營收", "毛利", "毛利率", "營業利益", "本期淨利", "淨利", "每股盈餘", "資本支出", "研發費用", "總資產", "股東權益",
)
ALIGNED_ROW = r"(?m)^(.{2,55}?)\s{2,}([\(\-]?\d[\d,\.]*(?:\))?)\s{2,}([\(\-]?\d[\d,\.]*(?:\))?)"
# The idiom of a cost that fell (leverage) or rose (deleverage) against sales, and of costs incurred in part.
LEVERAGE = r"(?i)\b((?:de)?leverage)\s+(?:of|in)\s+([^,.;]+?)(?:\s+due\s+to\s+|[,.;]|\s+and\s+(?:de)?leverage\b|$)"
INCURRED = r"(?is)expects?\s+to\s+incur\s+costs?\s+of\s+approximately\s+\$?\s*([\d,]+(?:\.\d+)?)\s*(million|billion)\b[^.]{0,120}?of\s+which\s+approximately\s+(\d+(?:\.\d+)?)\s*%\s+has\s+been\s+incurred"


def question_shapes(questions: DataFrame) -> DataFrame:
    """id, a flag per shape, no_calculation, years (with the one a trend implies), quarters, scale: one row per question with a text."""
    low = F.lower("question")
    flags = {name: low.rlike(p) for name, p in QUESTION_SHAPES.items()}
    years = T.years(F.col("question"))
    implied = F.when((F.size(years) == 1) & low.rlike(TREND), F.array_sort(F.concat(F.array((F.get(years, 0).cast("int") - 1).cast("string")), years))).otherwise(years)
    quarters = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(r"\b[qQ]([1-4])\b"), F.lit(1)), lambda q: F.concat(F.lit("Q"), q))))
    scale = F.when(F.contains(low, F.lit("billion")), 0.001).when(F.contains(low, F.lit("thousand")), 1000.0).otherwise(1.0)
    none = F.lit(False)
    for name in NO_CALCULATION:
        none = none | flags[name]
    return questions.where("question IS NOT NULL").select("id", *(c.alias(n) for n, c in flags.items()), none.alias("no_calculation"), F.array_join(implied, ",").alias("years"), F.array_join(quarters, ",").alias("quarters"), scale.alias("scale"))


def page_kinds(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, kind, aligned_rows: `contents` (a table of contents), `markdown`, `statement` (two terms and three aligned rows) or `prose`."""
    t, zone = F.col(text), F.lower(F.substring(text, 1, 600))
    low = F.lower(t)
    rows = F.regexp_count(t, F.lit(ALIGNED_ROW))
    terms = F.size(F.filter(F.array(*map(F.lit, STATEMENT_WORDS)), lambda w: F.contains(low, w)))
    kind = F.when(zone.rlike(r"table\s+of\s+contents") & zone.rlike(r"\bpart\s+(i|ii|iii|iv)\b"), "contents").when(t.rlike(r"(?m)^\s*\|\s*:?-{3,}"), "markdown").when((terms >= 2) & (rows >= 3), "statement").otherwise("prose")
    return df.where(t.isNotNull()).select(key, kind.alias("kind"), rows.alias("aligned_rows"))


def raw_numbers(text: Column, most: int = 8) -> Column:
    """The first numbers of a text that are no years."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.slice(F.filter(found, lambda x: ~x.rlike(r"^(19|20)\d\d$")), 1, most)


def leverage_pairs(text: Column) -> Column:
    """`item fell` or `item rose` for every cost line a text says there was leverage or deleverage of; each once, in order."""
    how, item = (F.regexp_extract_all(text, F.lit(LEVERAGE), F.lit(i)) for i in (1, 2))
    made = F.transform(F.arrays_zip(how.alias("h"), item.alias("i")), lambda p: F.concat(F.trim(F.regexp_replace(p["i"], r"\s+", " ")), F.when(F.lower(p["h"]).startswith("de"), " rose").otherwise(" fell")))
    return F.array_distinct(made)


def incurred_costs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, incurred, unit, share, implied_total, remaining: costs of an initiative of which a share has been incurred."""
    g = lambda i: F.regexp_extract(text, INCURRED, i)
    d = df.where(F.col(text).rlike(INCURRED)).select(key, T.number(g(1)).alias("incurred"), F.lower(g(2)).alias("unit"), g(3).try_cast("double").alias("share")).where("share > 0")
    total = F.col("incurred") / (F.col("share") / 100)
    return d.select("*", F.round(total, 2).alias("implied_total"), F.round(total - F.col("incurred"), 2).alias("remaining"))


def header_carry(df: DataFrame, text: str = "content", key: str = "ord") -> DataFrame:
    """key, line_no, header: for every line of a text the last line before it, or itself, that names years; without one the first line."""
    line = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    by = W.partitionBy("key").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    years = F.when(F.col("line").rlike(r"(19|20)\d\d"), F.col("line"))
    return line.select("key", "line_no", F.coalesce(F.last(years, ignorenulls=True).over(by), F.first("line").over(by)).alias("header")).withColumnRenamed("key", key)


def merged_hits(hits: DataFrame, key: str = "id", order: str = "ord", score: str = "score") -> DataFrame:
    """key, order, score, place: hits of several searches, each key once with its best score, in the order of first appearance."""
    best = hits.groupBy(key).agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias(order), F.max(score).alias(score), F.min(order).alias("first"))
    return best.select(key, order, score, F.col("first").alias("place"))


def common_header_years(decoded: DataFrame) -> DataFrame:
    """year, tables: years that head columns of tables, of those at least half as frequent as the most frequent one."""
    y = decoded.select("parent_id", "digest", "headers").distinct().select(F.explode(F.array_distinct(F.transform("headers", T.year_label))).alias("year")).where("year IS NOT NULL")
    n = y.groupBy("year").agg(F.count("*").alias("tables"))
    return n.crossJoin(F.broadcast(n.agg(F.max("tables").alias("top")))).where("tables * 2 >= top").select("year", "tables")  # one row
