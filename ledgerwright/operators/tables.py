"""Markdown tables and chunks: encode, decode, linearise, unpivot, blocks, sliding windows. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.functions import text as T

# Sizes of prose chunks.
CHUNK, OVERLAP = 800, 120


def is_separator(line: Column) -> Column:
    return F.trim(line).rlike(r"^\|?(\s*:?-{3,}:?\s*\|)+\s*:?-*:?\s*\|?$")


def is_table_line(line: Column) -> Column:
    return F.contains(line, F.lit("|")) & (line.rlike(r"[\p{L}\p{N}]") | is_separator(line))


def cells(line: Column) -> Column:
    """The trimmed cells of a pipe row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def table_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|"))


def decode(df: DataFrame, text: str = "parent_content", key: str = "parent_id") -> DataFrame:
    """key, digest, headers, row_ix, row: the rows of the first Markdown table of each distinct text; parents are decoded once.

    A key may stand for several texts (parent_id repeats across filings): key and digest of the text tell the tables apart.
    """
    src = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    lines = src.select("key", F.md5("text").alias("digest"), F.transform(table_lines(F.col("text")), cells).alias("rows"), F.exists(table_lines(F.col("text")), is_separator).alias("ok"))
    body = lines.where("ok AND size(rows) >= 3").select("key", "digest", F.get("rows", 0).alias("headers"), F.posexplode(F.expr("slice(rows, 3, size(rows) - 2)")).alias("row_ix", "row"))
    return body.withColumnRenamed("key", key)


def encode(headers: Column, rows: Column) -> Column:
    """A Markdown table of headers and rows: rows that are blank are dropped, short ones padded, pipes and line ends in cells replaced."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    esc = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", "/"), r"\s*\n\s*", " "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), esc), " | "), F.lit(" |"))
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(kept, line)), "\n")


def linearised(headers: Column, row: Column, company: Column) -> Column:
    """A table row as one text: company, label, then each caption with its cell; empty cells are left out."""
    pairs = F.arrays_zip(headers.alias("h"), row.alias("c"))
    stated = F.filter(F.slice(pairs, 2, F.size(pairs)), lambda p: F.coalesce(p["c"], F.lit("")) != "")
    said = F.transform(stated, lambda p: F.concat(p["h"], F.lit(": "), p["c"]))
    return F.concat_ws(" | ", F.concat(F.lit("Company: "), company), F.concat(F.lit("Line Item: "), F.get(row, 0)), F.array_join(said, " | "))


def unpivot(decoded: DataFrame, key: str = "parent_id") -> DataFrame:
    """key, digest, row_ix, item, year, val: the long form of decoded tables; captions that are no year and cells that are no number are left out."""
    cell = decoded.select(key, "digest", "row_ix", F.get("row", 0).alias("item"), F.explode(F.arrays_zip(F.col("headers").alias("h"), F.col("row").alias("c"))).alias("p"))
    return cell.select(key, "digest", "row_ix", "item", T.year_label(F.col("p.h")).alias("year"), T.number(F.col("p.c")).alias("val")).where("year IS NOT NULL AND val IS NOT NULL")


def duplicate_suffixes(long: DataFrame, key: str = "parent_id") -> DataFrame:
    """Adds `dup`: 0 for the first value a label has in a year of a table, 1 for the second that differs, and so on."""
    first = F.min("row_ix").over(W.partitionBy(key, "digest", "item", "year", "val"))
    return long.withColumn("first", first).withColumn("dup", F.dense_rank().over(W.partitionBy(key, "digest", "item", "year").orderBy("first")) - 1).drop("first")


def blocks(df: DataFrame, text: str = "content", key: str = "ord") -> DataFrame:
    """key, block, is_table, lines, body: runs of table and of prose lines, by gaps and islands over the lines of each text."""
    line = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    line = line.withColumn("is_table", is_table_line(F.col("line")))
    by = W.partitionBy("key").orderBy("at")
    line = line.withColumn("new", F.coalesce((F.col("is_table") != F.lag("is_table").over(by)).cast("int"), F.lit(0))).withColumn("block", F.sum("new").over(by))
    out = line.groupBy("key", "block", "is_table").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return out.withColumnRenamed("key", key)


def windows(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Sliding windows over a text; a text that fits is one window, an empty one none."""
    n = F.length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - overlap) / (size - overlap)).cast("int"))
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))


def chunks(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk, body: prose windows of each text, in order."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk", "body"))


def html_tables(html: Column) -> Column:
    """The rows of an HTML page's tables as Markdown rows, spanning cells repeated."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def row(r: Column) -> Column:
        cell = F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
        span = F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]([^>]*)>"), F.lit(1)), lambda a: F.greatest(F.coalesce(F.regexp_extract(a, r'colspan\s*=\s*"?(\d+)', 1).try_cast("int"), F.lit(1)), F.lit(1)))
        made = F.flatten(F.transform(F.arrays_zip(cell.alias("c"), span.alias("n")), lambda p: F.array_repeat(F.trim(T.cleaned(F.regexp_replace(p["c"], r"<[^>]+>", " "))), p["n"])))
        return F.concat(F.lit("| "), F.array_join(made, " | "), F.lit(" |"))

    return F.array_join(F.transform(rows, row), "\n")
