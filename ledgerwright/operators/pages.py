"""Pages: sections and their carry-forward, captions and units, malformed rows, garbled pages, repair by splicing, parents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.functions import text as T

# What begins a section, over lower-case text, in order; the first that is found counts.
SECTIONS = (
    ("income_statement", r"consolidated\s+statements?\s+of\s+(?:operations|income|earnings|comprehensive)"),
    ("income_statement", r"statements?\s+of\s+(?:operations|income|earnings)"),
    ("balance_sheet", r"consolidated\s+balance\s+sheets?"),
    ("balance_sheet", r"balance\s+sheets?|financial\s+position"),
    ("cash_flow", r"consolidated\s+statements?\s+of\s+cash\s+flows?"),
    ("cash_flow", r"statements?\s+of\s+cash\s+flows?|cash\s+flow\s+statements?"),
    ("equity_statement", r"statements?\s+of\s+(?:stockholders|shareholders|changes\s+in).*equity"),
    ("general_mda", r"item\s+7[^a-z].*management.{0,20}discussion|management.{0,20}discussion.{0,40}analysis"),
    ("notes_market_risk", r"item\s+7a[^a-z].*quantitative.*market\s+risk"),
    ("income_statement", r"item\s+8[^a-z].*financial\s+statements"),
    ("notes_litigation", r"note\s+\d+[^\n]*(?:litigation|legal\s+proceed|contingenc)"),
    ("notes_income_tax", r"note\s+\d+[^\n]*(?:income\s+tax|tax\s+provision)"),
    ("notes_debt", r"note\s+\d+[^\n]*(?:long.term\s+debt|debt|borrowing)"),
    ("notes_segments", r"note\s+\d+[^\n]*(?:segment|geographic)"),
    ("notes_pension", r"note\s+\d+[^\n]*(?:pension|retirement|benefit)"),
    ("notes_leases", r"note\s+\d+[^\n]*(?:lease|right.of.use)"),
    ("notes_acquisitions", r"note\s+\d+[^\n]*(?:acquisit|business\s+combination)"),
    ("notes_stock_comp", r"note\s+\d+[^\n]*(?:stock.based|share.based|equity\s+award)"),
    ("notes_general", r"notes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+statements?"),
    ("risk_factors", r"item\s+1a[^a-z].*risk\s+factors?"),
    ("business_overview", r"item\s+1[^a-z].*business|overview\s+of\s+(?:our\s+)?business"),
    ("selected_data", r"selected\s+(?:financial|consolidated)\s+data"),
    ("cover_page", r"annual\s+report|form\s+10-?k|united\s+states.*securities"),
)
# Thresholds of a garbled page, and of words of a row.
GARBLED_TOKENS, GARBLED_SHARE, ROW_TOLERANCE = 25, 0.12, 2.0


def section_of(text: Column) -> Column:
    """The section the first 600 characters announce, or null."""
    head = F.lower(F.substring(text, 1, 600))
    return F.coalesce(*(F.when(head.rlike(p), F.lit(name)) for name, p in SECTIONS))


def carried_sections(passages: DataFrame, initial: str = "cover_page") -> DataFrame:
    """ord, company, carried: the section of each passage, or the last one before it in its company's reading order.

    The order of a company is cut at its documents, so no window holds more than a document.
    """
    doc = F.regexp_extract("content", r"(?:Document|Report): ([^ |]+)", 1)
    known = F.when(F.lower("section") != "unknown", F.col("section"))
    by = W.partitionBy("company", "doc").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return passages.select("ord", "company", doc.alias("doc"), known.alias("known")).select("ord", "company", F.coalesce(F.last("known", ignorenulls=True).over(by), F.lit(initial)).alias("carried"))


def year_headers(text: Column) -> Column:
    """Distinct years of the first 400 characters, in order."""
    return F.array_distinct(F.regexp_extract_all(F.substring(text, 1, 400), F.lit(r"((?:19|20)\d\d)"), F.lit(1)))


def page_unit(text: Column) -> Column:
    """`USD millions` and the like if a text names exactly one scale, else null."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:in|usd) (millions|billions|thousands)\b"), F.lit(1)))
    return F.when(F.size(found) == 1, F.concat(F.lit("USD "), F.get(found, 0)))


def is_malformed_label(label: Column) -> Column:
    """A label that is only a number or currency sign, years excepted."""
    t = F.trim(label)
    return t.rlike(r"^[$€£(]?\s*[\d,.]*\s*[)%]?$") & ~t.rlike(r"^(19|20)\d\d(\s*-\s*(19|20)\d\d)?$")


def malformed_pages(passages: DataFrame) -> DataFrame:
    """company, page_number, bad_rows: pages with rows whose label is malformed."""
    bad = passages.where("type = 'table_row' AND line_item IS NOT NULL").where(is_malformed_label(F.col("line_item")))
    return bad.groupBy("company", "page_number").agg(F.count("*").alias("bad_rows"))


def is_garbled(token: Column) -> Column:
    """A token that mixes letters and figures, or has no vowel in five letters."""
    return token.rlike(r"^(?=.*[a-zA-Z])(?=.*\d)[a-zA-Z\d]{4,}$") | token.rlike(r"^[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{5,}$")


def garbled_passages(passages: DataFrame) -> DataFrame:
    """ord, n_tokens, garbled_share: notes with enough tokens of which enough are garbled, without any explode."""
    toks = F.filter(F.split("content", r"[^A-Za-z0-9]+"), lambda t: t != "")
    d = passages.where("type <> 'table_row'").select("ord", F.size(toks).alias("n_tokens"), F.size(F.filter(toks, is_garbled)).alias("bad")).where(F.col("n_tokens") >= GARBLED_TOKENS)
    return d.select("ord", "n_tokens", F.round(F.col("bad") / F.col("n_tokens"), 4).alias("garbled_share")).where(F.col("garbled_share") >= GARBLED_SHARE)


def spliced(passages: DataFrame, replacements: DataFrame, source: str) -> DataFrame:
    """The passages without malformed rows of the pages that `replacements` re-read, and the replacements, tagged with their source."""
    pages = replacements.select("company", "page_number").distinct()
    bad = passages.where("type = 'table_row'").where(is_malformed_label(F.col("line_item"))).join(pages, ["company", "page_number"], "left_semi").select("ord")
    return passages.join(bad, "ord", "left_anti").unionByName(replacements.withColumn("table_repair_source", F.lit(source)), allowMissingColumns=True)


def parents(passages: DataFrame) -> DataFrame:
    """parent_id, company, parent_content: the text the first passage of a parent carries."""
    return passages.where("parent_id IS NOT NULL AND parent_content IS NOT NULL").groupBy("company", "parent_id").agg(F.min_by("parent_content", "ord").alias("parent_content"))


def with_parents(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Hits (id, ord) with the text of the parent each was cut from, empty where there is none."""
    own = hits.join(passages.select("ord", "company", "parent_id"), "ord")
    return own.join(parents(passages), ["company", "parent_id"], "left").select("id", "ord", "parent_id", F.coalesce("parent_content", F.lit("")).alias("parent_content"))


def rows_of_words(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """doc, page, row, text, x0, x1 of words (doc, page, x0, top, x1, text): words whose top lies near the running mean of a row.

    The mean runs with the words, so a page is one group; a page is bounded by what fits on paper.
    """

    def cluster(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "x0"], kind="stable")
        row, mean, n, out = -1, None, 0, []
        for top in page["top"]:
            if mean is None or abs(top - mean) > tolerance:
                row, mean, n = row + 1, top, 1
            else:
                mean, n = (mean * n + top) / (n + 1), n + 1
            out.append(row)
        page = page.assign(row=out).sort_values(["row", "x0"], kind="stable")
        return page[["doc", "page", "row", "text", "x0", "x1"]]

    return words.groupBy("doc", "page").applyInPandas(cluster, "doc string, page int, row int, text string, x0 double, x1 double")


def column_anchors(rows: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """doc, page, column, anchor: right edges that numbers of at least two rows share, as gaps and islands over sorted edges."""
    number = rows.where(F.col("text").rlike(r"^[$(]?\(?[\d,]+(\.\d+)?\)?%?$"))
    by = W.partitionBy("doc", "page").orderBy("x1")
    island = number.withColumn("new", (F.col("x1") - F.coalesce(F.lag("x1").over(by), F.lit(-1e9)) > tolerance).cast("int")).withColumn("island", F.sum("new").over(by))
    found = island.groupBy("doc", "page", "island").agg(F.countDistinct("row").alias("support"), F.round(F.avg("x1"), 3).alias("anchor")).where("support >= 2")
    return found.select("doc", "page", F.row_number().over(W.partitionBy("doc", "page").orderBy("anchor")).alias("column"), "anchor")


def reread(pages: DataFrame, reader, schema: str) -> DataFrame:
    """Runs a page re-reader over pages, batch by batch; a page that fails gives no row, never an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                try:
                    yield pd.DataFrame(reader(r))
                except Exception:  # noqa: BLE001 - a page that can't be read stays as it is
                    continue

    return pages.mapInPandas(run, schema)


