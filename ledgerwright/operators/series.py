"""Series of facts over years: prior balances, deltas, latest years, candidates, common sources, derived and composite items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.operators.facts import canonical_item

# Tolerances. A subtotal is what the others add up to within 2 %; a value under 5 % of the greatest is a misread one.
SUM_TOLERANCE, LEAST_SHARE = 0.02, 0.05


def named(facts: DataFrame) -> DataFrame:
    return facts.withColumn("canonical", canonical_item(F.col("item"))).where("canonical IS NOT NULL AND company IS NOT NULL")


def prior_balances(best: DataFrame, years: DataFrame) -> DataFrame:
    """company, canonical, year, prior_year, prior: for every asked (company, year) the latest value of an item before the year (as-of, backward)."""
    pair = years.join(best.select("company", "canonical", F.col("year").alias("y"), "val"), "company").where("y < year")
    return pair.groupBy("company", "canonical", "year").agg(F.max("y").alias("prior_year"), F.max_by("val", "y").alias("prior"))


def deltas(best: DataFrame) -> DataFrame:
    """company, canonical, first_year, last_year, delta, direction, steps: from the first to the last year, and the changes between neighbours in order."""
    g = best.groupBy("company", "canonical").agg(F.array_sort(F.collect_list(F.struct("year", "val"))).alias("s")).where("size(s) > 1")
    delta = F.round(F.element_at("s", -1)["val"] - F.get("s", 0)["val"], 4)
    steps = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.round(F.get("s", i)["val"] - F.get("s", i - 1)["val"], 4))
    direction = F.when(F.col("delta") > 0, "increased").when(F.col("delta") < 0, "decreased").otherwise("stayed flat")
    return g.select("company", "canonical", F.get("s", 0)["year"].alias("first_year"), F.element_at("s", -1)["year"].alias("last_year"), delta.alias("delta"), F.array_join(F.transform(steps, lambda x: F.format_string("%.4f", x)), ";").alias("steps")).withColumn("direction", direction)


def latest(best: DataFrame, n: int = 3) -> DataFrame:
    """The `n` latest years of each item."""
    return best.withColumn("n", F.row_number().over(W.partitionBy("company", "canonical").orderBy(F.desc("year")))).where(F.col("n") <= n)


def candidates(facts: DataFrame) -> DataFrame:
    """company, canonical, year, val, left: what is left of an item's candidates in a year, stage by stage.

    Values under 5 % of the greatest go; then the value most rows state stays; of values that still differ by more than
    five times the greatest; then the one with the shortest label, the greatest and the earliest row.
    """
    w = W.partitionBy("company", "canonical", "year")
    d = named(facts).withColumn("size", F.abs("val")).withColumn("top", F.max("size").over(w)).where(F.col("size") >= LEAST_SHARE * F.col("top"))
    d = d.withColumn("agree", F.count("*").over(W.partitionBy("company", "canonical", "year", "val"))).withColumn("most", F.max("agree").over(w)).where("agree = most")
    d = d.withColumn("top", F.max("size").over(w)).withColumn("low", F.min("size").over(w)).where("top <= 5 * low OR size = top")
    left = F.size(F.collect_set("val").over(w))
    d = d.withColumn("left", left).withColumn("n", F.row_number().over(w.orderBy(F.length("item"), F.desc("size"), "ord")))
    return d.where("n = 1").select("company", "canonical", "year", "val", "left")


def common_sources(facts: DataFrame) -> DataFrame:
    """company, canonical, ord, years: per item the row that states the most years, the earliest of several."""
    g = named(facts).groupBy("company", "canonical", "ord").agg(F.countDistinct("year").alias("years"))
    return g.withColumn("n", F.row_number().over(W.partitionBy("company", "canonical").orderBy(F.desc("years"), "ord"))).where("n = 1 AND years > 1").select("company", "canonical", "ord", "years")


def derived_gross_profit(wide: DataFrame) -> DataFrame:
    """company, year, value, stated: gross profit from sales and costs where both are there, and whether a row states it within the tolerance."""
    made = F.col("revenue") - F.abs("cogs")
    agrees = F.abs(F.col("gross_profit") - made) <= SUM_TOLERANCE * F.abs(made)
    return wide.where("revenue IS NOT NULL AND cogs IS NOT NULL").select("company", "year", F.round(made, 4).alias("value"), F.coalesce(agrees, F.lit(False)).alias("stated"))


def composites(best: DataFrame, parts: dict[str, tuple[str, ...]]) -> DataFrame:
    """company, composite, year, value, items: sums of the items a composite is made of, each once, by year."""
    made = best.sparkSession.createDataFrame([(c, p) for c, ps in parts.items() for p in ps], "composite string, canonical string")
    return best.join(F.broadcast(made), "canonical").groupBy("company", "composite", "year").agg(F.round(F.sum("val"), 4).alias("value"), F.array_join(F.array_sort(F.collect_set("canonical")), "+").alias("items"))


def change_labels(long: DataFrame) -> DataFrame:
    """parent_id, digest, row_ix, label: labels of decoded rows, prefixed while a table is inside its section of changes in working capital.

    The section begins at a row named like it and ends at a net cash row: the last such event before a row decides.
    """
    event = F.when(F.lower("item").rlike("^(change|changes) in"), True).when(F.lower("item").rlike("net cash|cash from"), False)
    inside = F.last(event, ignorenulls=True).over(W.partitionBy("parent_id", "digest").orderBy("row_ix").rowsBetween(W.unboundedPreceding, 0))
    bare = ~F.lower("item").rlike("^(change|changes) in")
    return long.select("parent_id", "digest", "row_ix", F.when(F.coalesce(inside, F.lit(False)) & bare, F.concat(F.lit("Change in "), F.col("item"))).otherwise(F.col("item")).alias("label"))


def nearest_filings(documents: DataFrame, filings: DataFrame, days: int = 45) -> DataFrame:
    """doc_id, filename, gap: the filing of a document's company that was uploaded nearest to its date, within `days`; later ones first.

    Documents and filings meet on company and blocks of the window's length, so a range join touches two blocks only.
    """
    block = lambda c: F.floor(F.unix_date(c) / days)
    d = documents.where("filed_at IS NOT NULL").select("doc_id", "company", F.to_date("filed_at").alias("day"))
    d = d.select("*", F.explode(F.array(block(F.col("day")) - 1, block(F.col("day")), block(F.col("day")) + 1)).alias("b"))
    f = filings.where("uploaded_at IS NOT NULL").select("company", "filename", "ordinal", F.to_date("uploaded_at").alias("up")).withColumn("b", block(F.col("up")))
    gap = F.datediff("up", "day")
    pair = d.join(f, ["company", "b"]).where(F.abs(gap) <= days).withColumn("gap", gap)
    key = F.struct(F.when(F.col("gap") >= 0, F.col("gap")).otherwise(F.abs("gap") + 100), "ordinal")
    return pair.groupBy("doc_id").agg(F.min_by("filename", key).alias("filename"), F.min_by("gap", key).alias("gap"))


def sharded(df: DataFrame, shards: int, key: str = "id") -> DataFrame:
    """key, shard: rows dealt to shards by a stable hash; no order over all rows is needed for it."""
    return df.select(key, F.pmod(F.crc32(F.col(key).cast("string")), F.lit(shards)).cast("int").alias("shard"))


def latest_pair(best: DataFrame) -> DataFrame:
    """company, canonical, year, val, place: the latest year of each item, and the one before it where it is the year before."""
    by = W.partitionBy("company", "canonical").orderBy(F.desc("year"))
    d = best.withColumn("place", F.row_number().over(by)).withColumn("later", F.lag("year").over(by).cast("int"))
    return d.where("place = 1 OR (place = 2 AND later = CAST(year AS INT) + 1)").select("company", "canonical", "year", "val", "place")


def distinct_sums(facts: DataFrame, items: tuple[str, ...]) -> DataFrame:
    """company, canonical, year, rows, total: sums of items of which the same value in several rows counts once."""
    d = named(facts).where(F.col("canonical").isin(*items))
    return d.groupBy("company", "canonical", "year").agg(F.count("*").alias("rows"), F.round(F.sum_distinct("val"), 4).alias("total"))


def strict_quick_ratio(wide: DataFrame, share: float = 0.15) -> DataFrame:
    """company, year, value, strict: quick ratio without inventory, and without prepaid items where they are a share of current liabilities."""
    strict = F.coalesce(F.abs("prepaid"), F.lit(0.0)) >= share * F.abs("current_liabilities")
    left = F.col("current_assets") - F.col("inventory") - F.when(strict, F.col("prepaid")).otherwise(0.0)
    d = wide.where("current_assets IS NOT NULL AND inventory IS NOT NULL AND current_liabilities <> 0")
    return d.select("company", "year", F.round(left / F.col("current_liabilities"), 4).alias("value"), strict.alias("strict"))
