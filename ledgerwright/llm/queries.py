"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.llm import canonical, containers, leaks, personal, pieces, scans
from ledgerwright.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]
#: The key of the pseudonyms of the invented people in the test tables. Real data need a key of their own.
TEST_SECRET = b"for the test tables only"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.same_look_pairs(spread(table(spark, sf_dir, "passages"), "ord", "content"))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_form(spread(table(spark, sf_dir, "passages"), "ord", "content"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(table(spark, sf_dir, "passages"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "passages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(spread(table(spark, sf_dir, "passages"), "ord", "company", "type", "content"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(spread(table(spark, sf_dir, "passages"), "ord", "company", "type", "content"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.packed(spread(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fill(containers.packed(spread(table(spark, sf_dir, "documents"), "doc_id", "text")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found_mentions(spread(table(spark, sf_dir, "documents"), "doc_id", "text"), TEST_SECRET)


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.masked_texts(spread(table(spark, sf_dir, "documents"), "doc_id", "text"), TEST_SECRET).select("doc_id", "masked")


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized passage: the characters its pieces cover, whether all are within the limit, and whether each joins the one before with up to 120 repeated."""
    p = pieces.split_oversized(table(spark, sf_dir, "passages"))
    again = F.lag("end_at").over(W.partitionBy("ord").orderBy("piece")) - F.col("start_at")
    p = p.withColumn("joined", F.coalesce(again.between(0, 120), F.col("start_at") == 0))
    return p.groupBy("ord").agg((F.max("end_at") - F.min("start_at")).alias("covered"), F.bool_and(F.length("piece_text") <= 3000).alias("within"), F.bool_and("joined").alias("joined"))


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters that were placed, containers above their capacity, and rows that are divided although they fit."""
    placed = p6_containers(spark, sf_dir)
    over = placed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.sum((F.col("n") > containers.CAPACITY).cast("int")).alias("over"))
    of = placed.where("n_tokens > 0").groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.sum(F.col("end_at") - F.col("start_at")).alias("chars"))
    all_of = of.agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= containers.CAPACITY)).cast("int")).alias("divided"))
    return all_of.crossJoin(over)  # one row by one


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether everything outside its mentions is as it was, and each mention is a placeholder of its kind."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id", "text")
    both = personal.masked_texts(docs, TEST_SECRET).join(docs, "doc_id")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, personal.only_mentions_changed(t, m, x)) for k, t, m, x in batch[["doc_id", "text", "masked", "mentions"]].itertuples(index=False, name=None)], columns=["doc_id", "kept"])

    return both.mapInPandas(check, "doc_id long, kept boolean")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_canonical, p3_found, p3_repaired, p4_found, p4_pieces, p4_coverage, p6_containers, p6_fill, p6_limits, p7_found, p8_found, p8_masked, p8_kept)}


def _look_sql() -> str:
    """The canonical form in SQL, for texts whose words are each of one look (no words of other alphabets)."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    one = wide | canonical.LOOKALIKES | {chr(c): " " for c in (0xA0, 0x202F, 0x3000, *range(0x2000, 0x200B))} | {"\u2010": "-", "\u2011": "-"}
    t = "replace(content, chr(173) || chr(10), '-' || chr(10))"
    t = f"regexp_replace({t}, '[{canonical.INVISIBLE}]', '', 'g')"
    for joined, parts in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬆ", "st"), ("ﬅ", "st")):
        t = f"replace({t}, '{joined}', '{parts}')"
    source, target = ("".join(x).replace("'", "''") for x in zip(*one.items()))
    return f"nfc_normalize(translate({t}, '{source}', '{target}'))"


def oracle_sql() -> dict[str, str]:
    look = _look_sql()
    return {
        "p1_canonical": f"SELECT ord, content, {look} AS canonical FROM passages",
        "p1_found": f"WITH c AS (SELECT ord, content, {look} AS look FROM passages) SELECT a.ord AS ord_a, b.ord AS ord_b FROM c a JOIN c b ON a.look = b.look AND a.ord < b.ord AND a.content <> b.content",
        "p4_found": "SELECT ord FROM passages WHERE length(content) > 3000",
        "p4_coverage": "SELECT ord, length(content)::INT AS covered, true AS within, true AS joined FROM passages WHERE length(content) > 3000",
        "p6_limits": "SELECT count(*) AS docs, sum(length(text))::BIGINT AS chars, 0 AS divided, 0 AS over FROM documents WHERE text <> ''",
        "p8_kept": "SELECT doc_id, true AS kept FROM documents",
    }
