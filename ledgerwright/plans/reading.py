"""Queries of page layout, shapes of texts and judging, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.operators import facts, grading, judging, layout, ranking, series, shapes, tables, usage
from ledgerwright.plans.analytics import _DECODED, _FACTS
from ledgerwright.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    return tables.decode(table(spark, d, "passages"))


# A table whose rows all have as many plain numbers as there are columns, of which two to four, comes back from its words.
_PLAIN = r"[($-]*\d[\d,]*(?:\.\d+)?[)%]*"


def _regular(spark: SparkSession, d: str) -> DataFrame:
    dec = _decoded(spark, d)
    good = F.forall(F.slice("row", 2, F.size("row")), lambda c: c.rlike(f"^{_PLAIN}$") & ~c.rlike(r"^(19|20)\d\d$"))
    ok = dec.groupBy("parent_id", "digest").agg(F.min((good & (F.size("row") == F.size("headers")) & F.size("row").between(3, 5) & F.get("row", 0).rlike(r"^[A-Za-z]+( [A-Za-z]+)*$")).cast("int")).alias("ok"), F.count("*").alias("n"))
    return dec.join(ok.where("ok = 1 AND n >= 2").select("parent_id", "digest"), ["parent_id", "digest"], "left_semi")


@query(rf"""{_DECODED}, g AS (SELECT *, len(row) = len(headers) AND len(row) BETWEEN 3 AND 5 AND regexp_full_match(row[1], '[A-Za-z]+( [A-Za-z]+)*')
    AND len(list_filter(row[2:], lambda c: NOT regexp_full_match(c, '{_PLAIN}') OR regexp_full_match(c, '(19|20)\d\d'))) = 0 AS good FROM dec),
  ok AS (SELECT parent_id, digest FROM g GROUP BY ALL HAVING bool_and(good) AND count(*) >= 2 AND bool_and(NOT regexp_matches(lower(row[1]), '(^| )(and|to|or|through)$')))
SELECT parent_id, digest, array_to_string(row, ';') AS cells FROM g JOIN ok USING (parent_id, digest)""")
def rebuilt_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables set in type as words on pages, and read back by geometry."""
    regular = _regular(spark, d)
    phrase = regular.groupBy("parent_id", "digest").agg(F.max(F.lower(F.get("row", F.lit(0))).rlike("(^| )(and|to|or|through)$").cast("int")).alias("p")).where("p = 0")
    words = layout.set_in_type(regular.join(phrase, ["parent_id", "digest"], "left_semi"))
    made = layout.tables_of_words(words).where("NOT is_header AND exists(slice(cells, 2, size(cells)), c -> c <> '')")
    plain = F.exists(F.slice("cells", 2, F.size("cells")), lambda c: c.rlike(f"^{_PLAIN}$") & ~c.rlike(r"^(19|20)\d\d$"))
    return made.where(plain).select(F.col("doc").alias("parent_id"), F.col("page").alias("digest"), F.array_join("cells", ";").alias("cells"))


@query(f"""{_DECODED}, c AS (SELECT parent_id, digest, flatten(list(row)) AS cells, count(*) AS data_rows FROM dec GROUP BY ALL), f AS (SELECT parent_id, digest, data_rows, list_filter(cells, lambda x: x <> '') AS cells FROM c)
SELECT parent_id, digest, data_rows, CASE WHEN len(cells) >= 5 THEN round(len(list_filter(cells, lambda x: len(regexp_extract_all(x, '[0-9][0-9,]*(?:\\.[0-9]+)?')) >= 2)) / len(cells), 6) END AS crowded FROM f""")
def crowded_tables(spark: SparkSession, d: str) -> DataFrame:
    g = _decoded(spark, d).groupBy("parent_id", "digest").agg(F.collect_list("row").alias("rows"), F.count("*").alias("data_rows"))
    return g.select("parent_id", "digest", "data_rows", F.round(layout.crowded_share(F.col("rows")), 6).alias("crowded"))


@query(rf"""WITH par AS (SELECT DISTINCT parent_content AS t FROM passages WHERE parent_content IS NOT NULL), l AS (SELECT md5(t) AS digest, list_filter(string_split(t, chr(10)), lambda x: starts_with(trim(x), '|')) AS tab, list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(trim(x), '|') AND trim(x) <> '') AS prose FROM par)
SELECT digest, substr(array_to_string(list_concat(prose, tab[1:12], CASE WHEN len(tab) > 12 THEN ['... ' || (len(tab) - 12) || ' more rows'] ELSE [] END), chr(10)), 1, 1200) AS shown FROM l""")
def table_excerpts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").where("parent_content IS NOT NULL").select("parent_content").distinct()
    return p.select(F.md5("parent_content").alias("digest"), layout.excerpt(F.col("parent_content")).alias("shown"))


@query(rf"""{_DECODED}, c AS (SELECT DISTINCT unnest(row[2:]) AS cell FROM dec)
SELECT cell, regexp_replace(cell, '^\$\s+', '$') AS joined, regexp_full_match(trim(cell), '[($-]*[0-9][0-9,]*(\.[0-9]+)?[)%]*') OR (len(list_filter(regexp_split_to_array(trim(cell), '\s+'), lambda x: x <> '')) >= 2
  AND len(list_filter(regexp_split_to_array(trim(cell), '\s+'), lambda x: regexp_full_match(x, '[($-]*[0-9][0-9,]*(\.[0-9]+)?[)%]*'))) * 2 > len(list_filter(regexp_split_to_array(trim(cell), '\s+'), lambda x: x <> ''))) AS numeric FROM c""")
def numeric_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _decoded(spark, d).select(F.explode(F.slice("row", 2, F.size("row"))).alias("cell")).distinct()
    return c.select("cell", layout.value_joined(F.col("cell")).alias("joined"), layout.looks_numeric(F.col("cell")).alias("numeric"))


@query(rf"""{_DECODED}, y AS (SELECT unnest(list_distinct(list_transform(headers, lambda h: regexp_extract(trim(h), '^(?:FY|Fiscal )?\s*((?:19|20)\d\d)$', 1)))) AS year FROM (SELECT DISTINCT parent_id, digest, headers FROM dec)), n AS (SELECT year, count(*) AS tables FROM y WHERE year <> '' GROUP BY ALL)
SELECT year, tables FROM n WHERE tables * 2 >= (SELECT max(tables) FROM n)""")
def header_years(spark: SparkSession, d: str) -> DataFrame:
    return shapes.common_header_years(_decoded(spark, d))


# ---------------------------------------------------------------- shapes

_q = lambda p: p.replace("'", "''")
_FLAGS = ", ".join(f"regexp_matches(low, '{_q(p)}') AS {n}" for n, p in shapes.QUESTION_SHAPES.items())
_YRS = "list_sort(list_distinct(list_concat(regexp_extract_all(question, '(20\\d\\d)', 1), list_transform(regexp_extract_all(question, 'FY(\\d\\d)(?:[^\\d]|$)', 1), lambda y: '20' || y))))"


@query(f"""WITH q AS (SELECT id, question, lower(question) AS low FROM questions WHERE question IS NOT NULL), f AS (SELECT id, low, {_FLAGS}, {_YRS} AS ys, list_sort(list_distinct(list_transform(regexp_extract_all(question, '\\b[qQ]([1-4])\\b', 1), lambda x: 'Q' || x))) AS qs FROM q)
SELECT * EXCLUDE (low, ys, qs), {" OR ".join(shapes.NO_CALCULATION)} AS no_calculation, array_to_string(CASE WHEN len(ys) = 1 AND regexp_matches(low, '{shapes.TREND}') THEN [(ys[1]::INT - 1)::VARCHAR, ys[1]] ELSE ys END, ',') AS years,
  array_to_string(qs, ',') AS quarters, CASE WHEN contains(low, 'billion') THEN 0.001 WHEN contains(low, 'thousand') THEN 1000.0 ELSE 1.0 END::DOUBLE AS scale FROM f""")
def question_shapes(spark: SparkSession, d: str) -> DataFrame:
    return shapes.question_shapes(table(spark, d, "questions"))


_TERMS = ", ".join(f"'{w}'" for w in shapes.STATEMENT_WORDS)


@query(f"""WITH r AS (SELECT doc_id, text, len(regexp_extract_all(text, '{shapes.ALIGNED_ROW}'))::INT AS aligned_rows, len(list_filter([{_TERMS}], lambda w: contains(lower(text), w))) AS terms, lower(substr(text, 1, 600)) AS zone FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(zone, 'table\\s+of\\s+contents') AND regexp_matches(zone, '\\bpart\\s+(i|ii|iii|iv)\\b') THEN 'contents' WHEN regexp_matches(text, '(?m)^\\s*\\|\\s*:?-{{3,}}') THEN 'markdown' WHEN terms >= 2 AND aligned_rows >= 3 THEN 'statement' ELSE 'prose' END AS kind, aligned_rows FROM r""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    return shapes.page_kinds(table(spark, d, "documents"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '(\d[\d,]*(?:\.\d+)?)', 1), lambda x: replace(x, ',', '')), lambda x: NOT regexp_full_match(x, '(19|20)\d\d'))[1:8], ';') AS numbers FROM documents WHERE text IS NOT NULL")
def raw_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(shapes.raw_numbers(F.col("text")), ";").alias("numbers"))


@query("""WITH l AS (SELECT ord, i - 1 AS line_no, string_split(content, chr(10))[i] AS line FROM (SELECT ord, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM passages WHERE content IS NOT NULL))
SELECT ord, CAST(line_no AS INT) AS line_no, coalesce(last_value(CASE WHEN regexp_matches(line, '(19|20)\\d\\d') THEN line END IGNORE NULLS) OVER w, first_value(line) OVER w) AS header FROM l WINDOW w AS (PARTITION BY ord ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def header_carry(spark: SparkSession, d: str) -> DataFrame:
    return shapes.header_carry(table(spark, d, "passages"))


@query("SELECT id, arg_max(ord, (length(content), -ord)) AS ord, max(length(content)) AS score, min(ord) AS place FROM passages WHERE content IS NOT NULL GROUP BY id")
def merged_hits(spark: SparkSession, d: str) -> DataFrame:
    """Passages read several times under one id, the longest reading of each."""
    return shapes.merged_hits(table(spark, d, "passages").where("content IS NOT NULL").select("id", "ord", F.length("content").alias("score")))


@query(f"""WITH {_FACTS} SELECT company, canonical, year, val, row_number() OVER (PARTITION BY company, canonical ORDER BY year DESC) AS place FROM best QUALIFY row_number() OVER (PARTITION BY company, canonical ORDER BY year DESC) <= 2
  AND (row_number() OVER (PARTITION BY company, canonical ORDER BY year DESC) = 1 OR CAST(lag(year) OVER (PARTITION BY company, canonical ORDER BY year DESC) AS INT) = CAST(year AS INT) + 1)""")
def latest_pair(spark: SparkSession, d: str) -> DataFrame:
    return series.latest_pair(facts.best_facts(facts.row_facts(table(spark, d, "passages"))))


@query(f"WITH {_FACTS} SELECT company, canonical, year, count(*) AS rows, round(sum(DISTINCT val), 4) AS total FROM named WHERE canonical IN ('short_term_debt', 'long_term_debt') GROUP BY ALL")
def distinct_debt(spark: SparkSession, d: str) -> DataFrame:
    return series.distinct_sums(facts.row_facts(table(spark, d, "passages")), ("short_term_debt", "long_term_debt"))


@query(f"""WITH {_FACTS}, w AS (SELECT company, year, max(val) FILTER (WHERE canonical = 'current_assets') AS ca, max(val) FILTER (WHERE canonical = 'inventory') AS inv, max(val) FILTER (WHERE canonical = 'prepaid') AS pre, max(val) FILTER (WHERE canonical = 'current_liabilities') AS cl FROM best GROUP BY ALL)
SELECT company, year, round((ca - inv - CASE WHEN coalesce(abs(pre), 0) >= 0.15 * abs(cl) THEN pre ELSE 0 END) / nullif(cl, 0), 4) AS value, coalesce(abs(pre), 0) >= 0.15 * abs(cl) AS strict FROM w WHERE ca IS NOT NULL AND inv IS NOT NULL AND cl <> 0""")
def quick_ratio_strict(spark: SparkSession, d: str) -> DataFrame:
    return series.strict_quick_ratio(facts.wide_facts(facts.row_facts(table(spark, d, "passages"))))


@query("SELECT upper(company) AS store, token, count(*) AS df FROM (SELECT DISTINCT company, ord, unnest(regexp_extract_all(lower(content), '([a-z]{3,})', 1)) AS token FROM passages WHERE content IS NOT NULL) GROUP BY ALL")
def words_grown(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of the rows of tables, grown by those of notes and uploads as they come in."""
    p = table(spark, d, "passages").where("content IS NOT NULL")
    of = lambda x: x.select(F.upper("company").alias("store"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([a-z]{3,})"), F.lit(1)))).alias("token")).groupBy("store", "token").agg(F.count("*").alias("df"))
    return ranking.grown(of(p.where("type = 'table_row'")), of(p.where("type IS NULL OR type <> 'table_row'")))


@query("""WITH once AS (SELECT min(ledger_id) AS ledger_id, coalesce(total_tokens, prompt_tokens + completion_tokens) AS tokens, min(read_at)::DATE AS day FROM usage_ledger GROUP BY ts, date, pid, model, caller, prompt_tokens, completion_tokens, reasoning_tokens, total_tokens, prompt_chars),
  r AS (SELECT day, ledger_id, sum(tokens) OVER (PARTITION BY day ORDER BY ledger_id)::BIGINT AS run FROM once WHERE tokens IS NOT NULL), s(step) AS (VALUES (0.5::DOUBLE), (0.8), (1.0))
SELECT day, step, min(ledger_id) AS ledger_id, arg_min(run, ledger_id) AS tokens FROM r, s WHERE run >= step * 200000 GROUP BY ALL""")
def ledger_notices(spark: SparkSession, d: str) -> DataFrame:
    return usage.notices(table(spark, d, "usage_ledger"), 200_000)


# ---------------------------------------------------------------- judging


@query("SELECT id FROM questions WHERE id NOT IN (SELECT id FROM questions WHERE answer IS NOT NULL AND trim(answer) <> '')")
def unfinished_questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    return grading.unfinished(q.select("id"), q.select("id", "answer"))


@query(r"""WITH a AS (SELECT id, trim(answer) AS t, lower(trim(answer)) AS low FROM questions WHERE answer IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(low, '^yes\b') THEN 'yes' WHEN regexp_matches(low, '^no\b') THEN 'no' WHEN regexp_matches(substr(low, 1, 200), '\b(no|not|did not|does not|do not|cannot|was not|were not|is not|are not|never|neither)\b') THEN 'no' END AS stance FROM a""")
def answer_stance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").where("answer IS NOT NULL").select("id", judging.stance(F.col("answer")).alias("stance"))


@query(r"""WITH a AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(question), '\s+', ' ', 'g'), ' '), lambda w: w <> '') AS words,
    list_distinct(list_transform(list_filter(regexp_extract_all(question, '([A-Za-z]{4,})', 1), lambda w: regexp_matches(w, '^[A-Z]') OR length(w) > 6), lambda w: lower(w)[1:5])) AS terms,
    list_distinct(list_transform(regexp_extract_all(lower(evidence), '([a-z]{4,})', 1), lambda w: w[1:5])) AS have FROM eval_items WHERE question IS NOT NULL AND evidence IS NOT NULL)
SELECT item_id, CASE WHEN len(words) <= 25 AND len(terms) > 0 THEN len(list_intersect(terms, have)) >= 0.6 * len(terms) END AS present FROM a""")
def terms_in_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").where("question IS NOT NULL AND evidence IS NOT NULL")
    return e.select("item_id", judging.terms_present(F.col("question"), F.col("evidence")).alias("present"))


@query()
def facts_in_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of an answer that its evidence states. No SQL: numbers are told by what stands before them, for which its patterns have no means."""
    e = table(spark, d, "eval_items").where("answer IS NOT NULL AND evidence IS NOT NULL")
    return e.select("item_id", judging.facts_present(F.col("answer"), F.col("evidence")).alias("j")).select("item_id", "j.wanted", "j.found", "j.passes")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
