"""Readers and writers: prose, CSV, JSON and statement files into passages; the ledger's JSON lines; snapshots of a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

from ledgerwright.functions import text as T
from ledgerwright.operators import tables

#: The columns of a passage. Every reader fills what it knows; the rest is null.
PASSAGE = "id string, company string, table_name string, period string, page_number int, content string, type string, section string, statement_type string, line_item string, raw_data string, parent_id string, parent_content string, is_child boolean, table_repair_source string, ord bigint"
LEDGER = "ts string, date string, pid int, model string, caller string, prompt_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, total_tokens bigint, prompt_chars int"
STATEMENTS = "company string, statements array<struct<title:string, type:string, headers:array<string>, rows:array<array<string>>>>, notes array<struct<title:string, text:string>>"
_PROSE = 5_000


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]{1,5})?$", 1)


def _passages(df: DataFrame) -> DataFrame:
    """All passage columns in order, null where a reader has none; `ord` by file and place, without a global sort."""
    have = set(df.columns)
    typed = [f.strip().rsplit(" ", 1) for f in PASSAGE.split(",")]
    return df.select(*(F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in typed if n != "ord"), (F.col("ord") if "ord" in have else F.monotonically_increasing_id()).alias("ord"))


# Encodings that are tried in order where bytes are no UTF-8, and the share of unreadable characters that is too many.
ENCODINGS, UNREADABLE = ("cp950", "big5", "gbk", "utf-16", "latin1"), 0.05


@F.pandas_udf(StringType())
def _other_encoding(content: pd.Series) -> pd.Series:
    def read(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ENCODINGS:
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            if text.count("\ufffd") < UNREADABLE * max(len(text), 1):
                return text
        return raw.decode("utf-8", errors="ignore")

    return content.map(read, na_action="ignore")


def decoded(content: Column) -> Column:
    """The text of a file's bytes: UTF-8 in the JVM, with or without its mark; only what isn't goes to Python, encoding by encoding."""
    valid = F.is_valid_utf8(content.cast("string"))
    text = F.when(valid, F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(_other_encoding(F.when(~valid, content)))
    return F.when(content.isNotNull(), text)


def read_prose(spark: SparkSession, path: str, size: int = tables.CHUNK, overlap: int = tables.OVERLAP) -> DataFrame:
    """Text and Markdown files of any of the known encodings as chunks; the parent of a chunk is the beginning of its file. Empty files give no passage."""
    files = spark.read.format("binaryFile").load(path)
    src = files.select(_stem(F.col("path")).alias("company"), T.cleaned(decoded(F.col("content"))).alias("t")).where("t <> ''")
    c = src.select("company", F.substring("t", 1, _PROSE).alias("parent_content"), F.posexplode(tables.windows(F.col("t"), size, overlap)).alias("n", "body"))
    return _passages(c.select(F.concat(F.lit("txt_"), "company", F.lit("_"), "n").alias("id"), "company", F.lit("Uploaded Text").alias("period"), F.col("body").alias("content"), F.lit("text_note").alias("type"), F.concat(F.lit("parent_"), "company", F.lit("_txt")).alias("parent_id"), "parent_content", F.lit(True).alias("is_child")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Any JSON file as chunks of its text, kept whole in raw_data."""
    src = spark.read.text(path, wholetext=True).select(_stem(F.input_file_name()).alias("company"), "value").where("trim(value) <> ''")
    c = src.select("company", F.col("value").alias("raw_data"), F.posexplode(tables.windows(T.cleaned(F.col("value")))).alias("n", "body"))
    return _passages(c.select("raw_data", F.concat(F.lit("json_"), "company", F.lit("_"), "n").alias("id"), "company", F.lit("Uploaded JSON").alias("period"), F.col("body").alias("content"), F.lit("text_note").alias("type")))


def read_csv(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """A CSV file with a header as a passage per row: `caption: cell` pairs; cells are kept as they stand."""
    d = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    cells = [F.when(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`")))) for c in d.columns]
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in d.columns)))
    who = F.lit(company) if company else _stem(F.input_file_name())
    d = d.select(who.alias("company"), F.concat_ws(" | ", *cells).alias("said"), raw.alias("raw_data"), F.trim(F.col(f"`{d.columns[0]}`")).alias("line_item"), F.monotonically_increasing_id().alias("ord"))
    d = d.where("said <> ''")
    return _passages(d.select(F.concat(F.lit("csv_"), "company", F.lit("_row"), "ord").alias("id"), "company", F.lit("Uploaded CSV").alias("period"), F.concat(F.lit("Company: "), "company", F.lit(" | "), "said").alias("content"), F.lit("table_row").alias("type"), "line_item", "raw_data", F.concat(F.lit("parent_"), "company", F.lit("_csv_table")).alias("parent_id"), "ord"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Structured statements (company, statements with headers and rows, notes): a passage per row and per chunk of a note.

    The id holds the company, so that statements of the same title don't collide.
    """
    d = spark.read.schema(STATEMENTS).json(path, multiLine=True).where("company IS NOT NULL")
    s = d.select("company", F.explode("statements").alias("s")).select("company", "s.*")
    md = tables.encode(F.col("headers"), F.col("rows"))
    rows = s.select("company", "title", F.col("type").alias("statement_type"), "headers", md.alias("md"), F.posexplode("rows").alias("n", "row"))
    cells = F.map_from_arrays(F.col("headers"), F.transform(F.sequence(F.lit(0), F.size("headers") - 1), lambda i: F.coalesce(F.get("row", i), F.lit(""))))
    table_rows = rows.select(
        F.concat_ws("_", "company", "title", "n").alias("id"), "company", F.col("title").alias("table_name"), tables.linearised(F.col("headers"), F.col("row"), F.col("company")).alias("content"), F.lit("table_row").alias("type"),
        "statement_type", F.get("row", F.lit(0)).alias("line_item"), F.to_json(cells).alias("raw_data"), F.concat_ws("_", F.lit("parent"), "company", "title").alias("parent_id"), F.col("md").alias("parent_content"), F.lit(True).alias("is_child"),
    )
    n = d.select("company", F.explode("notes").alias("n")).select("company", "n.title", F.posexplode(tables.windows(T.cleaned(F.col("n.text")))).alias("k", "body"))
    notes = n.select(F.concat_ws("_", "company", "title", "k").alias("id"), "company", F.col("title").alias("table_name"), F.col("body").alias("content"), F.lit("text_note").alias("type"))
    return _passages(table_rows.unionByName(notes, allowMissingColumns=True))


def append_passages(passages: DataFrame, path: str) -> None:
    """Adds passages to a corpus partitioned by company, so that one company's store is a partition."""
    passages.write.mode("append").partitionBy("company").parquet(path)


def read_store(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """A corpus, or the store of one company by partition pruning."""
    d = spark.read.parquet(path)
    return d if company is None else d.where(F.col("company") == company)


def first_parents(passages: DataFrame) -> DataFrame:
    """parent_id, parent_content: the first writer of a parent wins."""
    n = F.row_number().over(W.partitionBy("parent_id").orderBy("ord"))
    return passages.where("parent_id IS NOT NULL AND parent_content IS NOT NULL").withColumn("n", n).where("n = 1").select("parent_id", "parent_content")


def newest(spark: SparkSession, path: str) -> DataFrame:
    """modified, files: the last change of a folder's files, to tell whether a snapshot is fresh."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("modificationTime").alias("modified"), F.count("*").alias("files"))


def write_ledger(lines: DataFrame, path: str) -> None:
    """Adds ledger lines as JSON; every task writes a file of its own, so writers don't meet."""
    lines.select(*(f.strip().split(" ")[0] for f in LEDGER.split(","))).write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Ledger lines, malformed ones left out; of one day if it is given."""
    d = spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)
    return d if day is None else d.where(F.col("date") == day)
