"""The queries of the engine's own operators over the test tables, each with independent SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.functions import text as T
from ledgerwright.operators import answers, evidence, facts, grading, pages, questions, ranking, series, tables, usage
from ledgerwright.runtime import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- pieces of SQL shared by several queries

_TERMS = ", ".join("'" + t.replace("'", "''") + "'" for t in T.TERMS)


def _tokens(c: str) -> str:
    return f"list_concat(regexp_extract_all(lower({c}), '({T.TOKEN})', 1), list_filter([{_TERMS}], lambda t: contains(lower({c}), t)))"


_NUM = lambda c: f"(CASE WHEN regexp_full_match(regexp_replace({c}, '[$,%()\\s]', '', 'g'), '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST(regexp_replace({c}, '[$,%()\\s]', '', 'g') AS DOUBLE) * (CASE WHEN trim({c}) LIKE '(%)' THEN -1 ELSE 1 END) END)"
_STORE = "upper(regexp_extract(trim(doc_name), '^([A-Za-z0-9]+)', 1))"
_INDEX = f"""
  base AS (SELECT company AS store, ord, period, section, content, {_tokens("content")} AS toks FROM passages),
  post AS (SELECT store, ord, len(toks) AS dl, token, count(*) AS tf FROM (SELECT store, ord, toks, unnest(toks) AS token FROM base) GROUP BY ALL),
  dfreq AS (SELECT store, token, count(*) AS df FROM post GROUP BY ALL),
  stat AS (SELECT store, count(*) AS n, coalesce(avg(coalesce(len(toks), 0)), 50.0) AS avgdl FROM base GROUP BY ALL),
  asked AS (SELECT id AS qid, {_STORE} AS store, question FROM questions WHERE question IS NOT NULL),
  qtok AS (SELECT qid, store, unnest({_tokens("question")}) AS token FROM asked)"""
_BM25 = """
  bm AS (SELECT q.qid, p.ord, sum(q.qn * ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS bm25
    FROM (SELECT qid, store, token, count(*) AS qn FROM qtok GROUP BY ALL) q JOIN dfreq d USING (store, token) JOIN stat s USING (store) JOIN post p USING (store, token) GROUP BY ALL)"""
_OVERLAP = """
  qw AS (SELECT q.qid, q.store, q.token, ln((s.n - coalesce(d.df, 0) + 0.5) / (coalesce(d.df, 0) + 0.5) + 1) AS w FROM qtok q JOIN stat s USING (store) LEFT JOIN dfreq d USING (store, token)),
  ov AS (SELECT q.qid, b.ord, sum(q.w) AS overlap FROM qw q JOIN base b USING (store) WHERE contains(lower(b.content), q.token) GROUP BY ALL)"""
_STEMS = lambda c: f"list_distinct(list_transform(regexp_extract_all(lower({c}), '([a-z]{{3,}})', 1), lambda w: w[1:5]))"
_YEARS = lambda c: f"list_concat(regexp_extract_all({c}, '(20\\d\\d)', 1), list_transform(regexp_extract_all({c}, 'FY(\\d\\d)(?:[^\\d]|$)', 1), lambda y: '20' || y))"


_ITEM_NAMES = {a: f"={name}" for name, aliases in facts.ALIASES.items() for a in (name.replace("_", " "), *aliases)}
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_named = lambda c, words: f"list_filter([{_quoted(words)}], lambda t: CASE WHEN contains(lower({c}), t) THEN regexp_matches(lower({c}), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(t) || 's?([^\\p{{L}}\\p{{N}}_]|$)') ELSE false END)"
_ITEMS = lambda c: f"list_concat({_named(c, T.TERMS)}, list_transform({_named(c, _ITEM_NAMES)}, lambda a: MAP {{{', '.join(f"{_quoted([a])}: '{n}'" for a, n in _ITEM_NAMES.items())}}}[a]))"
_NORMAL = lambda c: f"array_to_string(list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(trim({c}), '\\.[A-Za-z0-9]{{1,4}}$', ''), '[_\\-]', ' ', 'g')), '\\s+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '(20\\d\\d)(q[1-4])?|(10k|10q|8k)')), ' ')"
_PERIOD = lambda c: f"nullif(upper(regexp_extract(lower({c}), '(20\\d\\d(?:q[1-4])?)', 1)), '')"
_LABEL = "trim(regexp_extract(content, 'Line Item:\\s*([^|]+)', 1))"
_FILING = "coalesce(nullif(regexp_extract(content, '(?:Document|Report): ([^ |]+)', 1), ''), company)"
_CORE = "list_filter([" + ", ".join(f"CASE WHEN len({_named(_LABEL, items)}) > 0 THEN '{s}' END" for s, items in ranking.CORE_ITEMS.items()) + "], lambda x: x IS NOT NULL)"
_FIT = """CASE WHEN coalesce(filing, '') = '' OR coalesce(entity, '') IN ('', 'company', 'unknown') THEN 1.0 WHEN tier > 1 AND filing_year IS NOT NULL AND entity_year IS NOT NULL AND filing_year <> entity_year THEN 0.4 ELSE tier END"""
_TIER = """CASE WHEN filing = entity THEN 2.0 WHEN contains(filing, entity) OR contains(entity, filing) OR contains(replace(filing, ' ', ''), replace(entity, ' ', '')) OR contains(replace(entity, ' ', ''), replace(filing, ' ', ''))
    OR (len(ew) > 0 AND len(list_filter(ew, lambda w: list_contains(string_split(filing, ' '), w))) = len(ew)) THEN 1.8 WHEN len(ew) = 0 THEN 1.0 WHEN len(list_filter(ew, lambda w: list_contains(string_split(filing, ' '), w))) > 0 THEN 1.2 ELSE 0.05 END"""


def _search_sql(top: int, off: frozenset[str] = frozenset()) -> str:
    hints = " + ".join(f"CAST(regexp_matches(lower(question), '{p}') AS INT)" for p in ranking.STATEMENTS.values())
    hint = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{s}'" for s, p in ranking.STATEMENTS.items()) + " END"
    conditions = {
        "line_item_match": "list_has_any(items, asked_items)",
        "total_row_boost": f"regexp_matches(content, 'Line Item:\\s*Total\\b') AND (len(list_filter({_STEMS("regexp_extract(content, 'Line Item:\\s*Total\\b([^|]*)', 1)")}, lambda x: x <> 'total')) = 0 OR list_has_any({_STEMS("regexp_extract(content, 'Line Item:\\s*Total\\b([^|]*)', 1)")}, {_STEMS('question')}))",
        "inventory_composition_boost": f"regexp_matches(lower(content), '{ranking.COMPOSITION}') AND regexp_matches(lower(question), '\\bfinished\\s+goods\\b')",
        "preferred_filing_year_boost": f"entity_year IS NULL AND filing_year = list_max({_YEARS('question')})",
        "low_confidence_column_penalty": "regexp_matches(content, '\\bCol\\d+:')",
        "year_match_boost": f"list_has_any({_YEARS("concat_ws(' ', period, content)")}, {_YEARS('question')})",
        "statement_type_hint_boost": f"({hints}) = 1 AND (coalesce(section = ({hint}), false) OR list_contains(core, ({hint})))",
    }
    flags = ", ".join(f"({'coalesce(' + c + ', false)' if n not in off else 'false'}) AS {n}" for n, c in conditions.items())
    fit = _FIT if "company_match" not in off else "1.0"
    product = "fit * " + " * ".join(f"(CASE WHEN {n} THEN {ranking.RULES[n]} ELSE 1.0 END)" for n in conditions)
    named = "CASE WHEN fit <> 1.0 THEN 'company_match' END, " + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in conditions)
    return f"""WITH {_INDEX}, {_BM25}, {_OVERLAP},
  c AS (SELECT qid, ord, 0.7 * coalesce(bm25, 0) + 0.3 * coalesce(overlap, 0) AS score0 FROM bm FULL JOIN ov USING (qid, ord)),
  pm AS MATERIALIZED (SELECT ord, period, section, content, {_ITEMS('content')} AS items, {_CORE} AS core, {_NORMAL(_FILING)} AS filing, {_PERIOD(_FILING)} AS filing_year FROM passages),
  qm AS MATERIALIZED (SELECT id AS qid, question, {_ITEMS('question')} AS asked_items, {_NORMAL('doc_name')} AS entity, {_PERIOD('doc_name')} AS entity_year, list_filter(string_split({_NORMAL('doc_name')}, ' '), lambda w: length(w) >= 2) AS ew FROM questions),
  j AS (SELECT c.*, pm.* EXCLUDE (ord), qm.* EXCLUDE (qid), {_TIER} AS tier FROM c JOIN pm USING (ord) JOIN qm ON qm.qid = c.qid),
  f AS (SELECT qid, ord, score0, {fit} AS fit, {flags} FROM j),
  s AS (SELECT qid AS id, ord, score0 * {product} AS score, concat_ws(',', {named}) AS applied_rules FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, ord) AS rank FROM s WHERE round(score, 6) > 0.01)
SELECT id, ord, rank, round(score, 4) AS relevance_score, applied_rules FROM r WHERE rank <= {top}"""


_ALIAS = ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{n}')" for n, aliases in facts.ALIASES.items() for a in aliases)
_FACTS = f"""
  raw AS (SELECT ord, company, section, trim(json_extract_string(raw_data, '$.line_item')) AS item, unnest(json_keys(raw_data)) AS caption, raw_data FROM passages WHERE type = 'table_row' AND raw_data IS NOT NULL),
  cell AS (SELECT ord, company, section, item, nullif(regexp_extract(trim(caption), '^(?:FY|Fiscal )?\\s*((?:19|20)\\d\\d)$', 1), '') AS year, json_extract_string(raw_data, '$."' || caption || '"') AS t FROM raw WHERE item IS NOT NULL),
  fact AS (SELECT ord, company, section, item, year, {_NUM("t")} AS val FROM cell WHERE year IS NOT NULL AND {_NUM("t")} IS NOT NULL),
  alias(a, canonical) AS (VALUES {_ALIAS}),
  lab AS (SELECT DISTINCT item, regexp_replace(lower(trim(item)), '\\s+', ' ', 'g') AS low FROM fact),
  canon AS (SELECT lab.item, coalesce(max(CASE WHEN a = low THEN canonical END), CASE WHEN NOT bool_or(regexp_matches(low, '^(change|changes) in |^non-|^deferred |^unearned |^adjusted |^segment ')) THEN arg_min(canonical, (-length(a), a)) FILTER (WHERE contains(low, a) AND length(a) > 5) END) AS canonical
    FROM lab CROSS JOIN alias GROUP BY lab.item),
  named AS (SELECT f.*, c.canonical, count(*) OVER (PARTITION BY company, canonical, year, val) AS agree FROM fact f JOIN canon c USING (item) WHERE c.canonical IS NOT NULL AND company IS NOT NULL),
  best AS (SELECT company, canonical, year, val, ord FROM named QUALIFY row_number() OVER (PARTITION BY company, canonical, year ORDER BY (lower(item) LIKE 'total%') DESC, agree DESC, length(item), abs(val) DESC, ord) = 1)"""
_WIDE = (
    _FACTS
    + f""",
  wide0 AS (SELECT company, year, {", ".join(f"max(val) FILTER (WHERE canonical = '{v}') AS {v}" for v in facts.ALIASES)} FROM best GROUP BY company, year),
  wide AS (SELECT *, {", ".join(f"CASE WHEN CAST(lag(year) OVER w AS INT) = CAST(year AS INT) - 1 THEN lag({v}) OVER w END AS {v}_old" for v in facts.ALIASES)} FROM wide0 WINDOW w AS (PARTITION BY company ORDER BY year))"""
)
_WIDE = _WIDE.replace(
    "wide AS (SELECT *,",
    "wide AS (SELECT *, CASE WHEN first_value(revenue IGNORE NULLS) OVER since > 0 THEN first_value(revenue IGNORE NULLS) OVER since END AS revenue_first, "
    "(CAST(year AS INT) - CAST(min(CASE WHEN revenue IS NOT NULL THEN year END) OVER since AS INT))::DOUBLE AS revenue_span,",
)[:-1] + ", since AS (PARTITION BY company ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_DIVIDE = lambda a, b: f"({a} / nullif({b}, 0))"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages")


# ---------------------------------------------------------------- index and ranking


@query(f"WITH {_INDEX} SELECT store, token, df FROM dfreq")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return ranking.document_frequency(ranking.postings(spread(_passages(spark, d), "ord", "company", "content")))


@query(f"WITH {_INDEX} SELECT store, n, round(avgdl, 6) AS avgdl FROM stat")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d)
    s = ranking.store_stats(ranking.postings(p), p)
    return s.select("store", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_INDEX}, {_BM25} SELECT qid AS id, ord, round(bm25, 5) AS bm25 FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, ord) <= 5")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.bm25(ranking.Index(_passages(spark, d)), table(spark, d, "questions"), 5)
    return best.select(F.col("qid").alias("id"), F.col("key").alias("ord"), F.round("bm25", 5).alias("bm25"))


def _window(part: str, *order):
    from pyspark.sql.window import Window

    return Window.partitionBy(part).orderBy(*order)


@query(_search_sql(5))
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.search(_passages(spark, d), table(spark, d, "questions"))


@query(_search_sql(15, frozenset(ranking.WHAT_RULES_DO)))
def search_rules_off(spark: SparkSession, d: str) -> DataFrame:
    return ranking.search(_passages(spark, d), table(spark, d, "questions"), 15, frozenset(ranking.WHAT_RULES_DO))


@query("""SELECT * FROM (VALUES (1, 'company_match', '2.0 to 0.05', 'scales by how well the passage''s filing fits the one the question names'), (2, 'line_item_match', '1.5', 'the passage names a line item the question names, by any of its names'),
  (3, 'total_row_boost', '1.3', 'a total row whose label shares a stem with the question'), (4, 'inventory_composition_boost', '3.0', 'a breakdown of inventories, if finished goods are asked for'),
  (5, 'preferred_filing_year_boost', '1.3', 'a filing of the latest year asked for, if the question names a company without year'), (6, 'low_confidence_column_penalty', '0.5', 'a row with generic column captions'),
  (7, 'year_match_boost', '1.4', 'the passage speaks of a year asked for'), (8, 'statement_type_hint_boost', '1.5', 'the passage stands in the statement asked for, or its label is a core item of it')) t(place, rule, factor, what)""")
def rule_report(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rule_report(spark)


@query(f"SELECT * FROM ({_search_sql(6)}) WHERE rank > 1".replace("SELECT * FROM (WITH", "SELECT id, ord, rank - 1 AS rank, relevance_score, applied_rules FROM (WITH"))
def search_excluding_best(spark: SparkSession, d: str) -> DataFrame:
    p, q = _passages(spark, d), table(spark, d, "questions")
    index = ranking.Index(p)
    return ranking.search(p, q, 5, exclude=ranking.search(p, q, 1, index=index, ahead=5).select("id", "ord"), index=index)


@query(f"""SELECT id, ord, relevance_score, position FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY relevance_score DESC, ord) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY (sub <= 2) DESC, relevance_score DESC, ord) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY relevance_score DESC, ord) AS sub FROM ({_search_sql(15)}) JOIN (SELECT ord, type FROM passages) USING (ord))) WHERE place <= 6)""")
def quota_window(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d)
    hits = ranking.search(p, table(spark, d, "questions"), 15).join(p.select("ord", F.col("type").alias("subquery")), "ord").withColumnRenamed("relevance_score", "score")
    return ranking.quota_window(hits, 6).select("id", "ord", F.col("score").alias("relevance_score"), "position")


@query(f"""WITH hit AS ({_search_sql(5)}), par AS (SELECT company, parent_id, arg_min(parent_content, ord) AS pc FROM passages WHERE parent_id IS NOT NULL AND parent_content IS NOT NULL GROUP BY ALL)
SELECT h.id, h.ord, p.parent_id, coalesce(par.pc, '') AS parent_content FROM hit h JOIN passages p USING (ord) LEFT JOIN par ON par.company = p.company AND par.parent_id = p.parent_id""")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d)
    return pages.with_parents(ranking.search(p, table(spark, d, "questions")).select("id", "ord"), p)


# ---------------------------------------------------------------- facts and formulas


@query(f"WITH {_FACTS} SELECT ord, item, year, val FROM fact")
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.row_facts(_passages(spark, d)).select("ord", "item", "year", "val")


@query(f"WITH {_FACTS} SELECT item, canonical FROM canon")
def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    return facts.row_facts(_passages(spark, d)).select("item").distinct().select("item", facts.canonical_item(F.col("item")).alias("canonical"))


@query(f"WITH {_FACTS} SELECT company, canonical, year, val, ord FROM best")
def best_rows(spark: SparkSession, d: str) -> DataFrame:
    return facts.best_facts(facts.row_facts(_passages(spark, d)))


@query(f"WITH {_FACTS} SELECT company, canonical, year, count(DISTINCT val) AS values FROM named GROUP BY ALL HAVING count(DISTINCT val) > 1")
def conflicting_values(spark: SparkSession, d: str) -> DataFrame:
    return facts.conflicting(facts.row_facts(_passages(spark, d)))


@query(f"""WITH {_FACTS}, p AS (SELECT *, lag(val) OVER w AS prior, lag(year) OVER w AS prior_year FROM best WINDOW w AS (PARTITION BY company, canonical ORDER BY year))
SELECT company, canonical, year, prior_year, round(val - prior, 4) AS change, round(CASE WHEN prior = 0 THEN 0 ELSE (val - prior) / abs(prior) * 100 END, 4) AS growth FROM p WHERE prior IS NOT NULL""")
def yoy_growth(spark: SparkSession, d: str) -> DataFrame:
    return facts.growth_pairs(facts.row_facts(_passages(spark, d)))


@query(f"""WITH {_FACTS}, g AS (SELECT company, canonical, min(year) AS first_year, max(year) AS last_year, arg_min(val, year) AS a, arg_max(val, year) AS b FROM best GROUP BY ALL)
SELECT company, canonical, first_year, last_year, round(CASE WHEN a <= 0 OR b < 0 THEN 0 ELSE (power(b / a, 1.0 / (CAST(last_year AS INT) - CAST(first_year AS INT))) - 1) * 100 END, 4) AS cagr FROM g WHERE first_year < last_year""")
def cagr(spark: SparkSession, d: str) -> DataFrame:
    return facts.compound_growth(facts.row_facts(_passages(spark, d)))


def _formula_query(key: str, spark: SparkSession, d: str) -> DataFrame:
    return facts.evaluate(facts.wide_facts(facts.row_facts(_passages(spark, d))), key)


for _key in facts.FORMULAS:
    QUERIES[f"formula_{_key}"] = partial(_formula_query, _key)
    _value = f"round({facts.formula_sql(facts.FORMULAS[_key], _DIVIDE, _key in facts.PERCENT)}, 4)"
    SQL[f"formula_{_key}"] = f"WITH {_WIDE} SELECT company, year, {_value} AS value FROM wide WHERE {_value} IS NOT NULL"


@query(f"WITH {_WIDE} SELECT * FROM (" + " UNION ALL ".join(f"SELECT company, year, '{k}' AS formula, round({facts.formula_sql(e, _DIVIDE, k in facts.PERCENT)}, 4) AS value FROM wide" for k, e in facts.FORMULAS.items()) + ") WHERE value IS NOT NULL")
def formulas_all(spark: SparkSession, d: str) -> DataFrame:
    return facts.evaluate_all(facts.wide_facts(facts.row_facts(_passages(spark, d))))


@query(f"WITH {_WIDE}, v AS (SELECT company, round(gross_profit / nullif(revenue, 0) * 100, 4) AS value FROM wide) SELECT company, count(value) AS years, round(avg(value), 4) AS value FROM v WHERE value IS NOT NULL GROUP BY ALL")
def period_average(spark: SparkSession, d: str) -> DataFrame:
    return facts.period_average(facts.wide_facts(facts.row_facts(_passages(spark, d))), "gross_margin")


# ---------------------------------------------------------------- tables, chunks, pages

_PARENTS = "par AS (SELECT DISTINCT parent_id, parent_content AS t, md5(parent_content) AS digest FROM passages WHERE parent_content IS NOT NULL)"
_CELLS = lambda c: f"list_transform(string_split(regexp_replace(trim({c}), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x))"
_DECODED = f"""WITH {_PARENTS}, l AS (SELECT parent_id, digest, list_filter(string_split(t, chr(10)), lambda x: starts_with(trim(x), '|')) AS ls FROM par),
  r AS (SELECT parent_id, digest, {_CELLS("ls[1]")} AS headers, ls, unnest(range(3, len(ls) + 1)) AS i FROM l WHERE len(ls) >= 3 AND len(list_filter(ls, lambda x: regexp_full_match(trim(x), '\\|?(\\s*:?-{{3,}}:?\\s*\\|)+\\s*:?-*:?\\s*\\|?'))) > 0),
  dec AS (SELECT parent_id, digest, headers, CAST(i - 3 AS INT) AS row_ix, {_CELLS("ls[i]")} AS row FROM r)"""


@query(_DECODED + " SELECT parent_id, row_ix, array_to_string(headers, ';') AS headers, array_to_string(row, ';') AS cells FROM dec")
def markdown_decode(spark: SparkSession, d: str) -> DataFrame:
    x = tables.decode(_passages(spark, d))
    return x.select("parent_id", "row_ix", F.array_join("headers", ";").alias("headers"), F.array_join("row", ";").alias("cells"))


@query(_DECODED + """, g AS (SELECT parent_id, digest, any_value(headers) AS h, list(row ORDER BY row_ix) AS rows FROM dec GROUP BY parent_id, digest)
SELECT parent_id, '| ' || array_to_string(h, ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(h)) || chr(10) || array_to_string(list_transform(list_filter(rows, lambda r: array_to_string(r, '') <> ''), lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) AS markdown FROM g""")
def markdown_encode(spark: SparkSession, d: str) -> DataFrame:
    x = tables.decode(_passages(spark, d)).groupBy("parent_id", "digest").agg(F.first("headers").alias("h"), F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "row"))), lambda r: r["row"]).alias("rows"))
    return x.select("parent_id", tables.encode(F.col("h"), F.col("rows")).alias("markdown"))


_UNPIVOT = _DECODED + f""", c AS (SELECT parent_id, digest, row_ix, row[1] AS item, unnest(headers) AS h, unnest(row) AS c FROM dec),
  long AS (SELECT parent_id, digest, row_ix, item, nullif(regexp_extract(trim(h), '^(?:FY|Fiscal )?\\s*((?:19|20)\\d\\d)$', 1), '') AS year, {_NUM("c")} AS val FROM c)"""


@query(_UNPIVOT + " SELECT * EXCLUDE (digest) FROM long WHERE year IS NOT NULL AND val IS NOT NULL")
def unpivot_facts(spark: SparkSession, d: str) -> DataFrame:
    return tables.unpivot(tables.decode(_passages(spark, d))).drop("digest")


@query(_UNPIVOT + """, f AS (SELECT *, min(row_ix) OVER (PARTITION BY parent_id, digest, item, year, val) AS first FROM long WHERE year IS NOT NULL AND val IS NOT NULL)
SELECT parent_id, row_ix, item, year, val, dense_rank() OVER (PARTITION BY parent_id, digest, item, year ORDER BY first) - 1 AS dup FROM f""")
def duplicate_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicate_suffixes(tables.unpivot(tables.decode(_passages(spark, d)))).drop("digest")


@query(_DECODED + ", co AS (SELECT parent_id, min(company) AS company FROM passages GROUP BY ALL) SELECT parent_id, row_ix, 'Company: ' || company || ' | Line Item: ' || row[1] || CASE WHEN len(list_filter(row[2:], lambda x: x <> '')) > 0 THEN ' | ' ELSE ' | ' END || array_to_string(list_filter(list_transform(range(2, len(row) + 1), lambda i: CASE WHEN row[i] <> '' THEN headers[i] || ': ' || row[i] END), lambda x: x IS NOT NULL), ' | ') AS line FROM dec JOIN co USING (parent_id) WHERE len(headers) = len(row) AND row[1] <> ''")
def linearize_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d)
    x = tables.decode(p).join(p.groupBy("parent_id").agg(F.min("company").alias("company")), "parent_id").where((F.size("headers") == F.size("row")) & (F.get("row", F.lit(0)) != ""))
    return x.select("parent_id", "row_ix", tables.linearised(F.col("headers"), F.col("row"), F.col("company")).alias("line"))


@query(f"""SELECT doc_id, chunk, substr(text, chunk * {tables.CHUNK - tables.OVERLAP} + 1, {tables.CHUNK}) AS body FROM (
  SELECT doc_id, text, CAST(unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {tables.CHUNK} THEN 1 ELSE CAST(ceil((length(text) - {tables.OVERLAP}) / {tables.CHUNK - tables.OVERLAP}.0) AS BIGINT) END)) AS INT) AS chunk FROM documents WHERE text IS NOT NULL)""")
def chunk_prose(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(table(spark, d, "documents"))


@query("""WITH l AS (SELECT ord, i AS line_no, string_split(content, chr(10))[i] AS line FROM (SELECT ord, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM passages WHERE content IS NOT NULL)),
  t AS (SELECT *, contains(line, '|') AND (regexp_matches(line, '[\\p{L}\\p{N}]') OR regexp_full_match(trim(line), '\\|?(\\s*:?-{3,}:?\\s*\\|)+\\s*:?-*:?\\s*\\|?')) AS is_table FROM l),
  b AS (SELECT *, sum(CASE WHEN is_table <> lag_t THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY line_no) AS block FROM (SELECT *, lag(is_table) OVER (PARTITION BY ord ORDER BY line_no) AS lag_t FROM t))
SELECT ord, CAST(block AS BIGINT) AS block, is_table, count(*) AS lines, string_agg(line, chr(10) ORDER BY line_no) AS body FROM b GROUP BY ord, block, is_table""")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    return tables.blocks(_passages(spark, d))


@query("""SELECT ord, company, coalesce(last_value(CASE WHEN lower(section) <> 'unknown' THEN section END IGNORE NULLS) OVER (PARTITION BY company, regexp_extract(content, '(?:Document|Report): ([^ |]+)', 1) ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'cover_page') AS carried FROM passages""")
def section_carry(spark: SparkSession, d: str) -> DataFrame:
    return pages.carried_sections(_passages(spark, d))


_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(lower(substr(text, 1, 600)), '{p}') THEN '{s}'" for s, p in pages.SECTIONS) + " END"


@query(f"SELECT doc_id, {_SECTION} AS section, array_to_string(list_filter(regexp_extract_all(substr(text, 1, 400), '((?:19|20)\\d\\d)', 1), lambda y, i: list_position(regexp_extract_all(substr(text, 1, 400), '((?:19|20)\\d\\d)', 1), y) = i), ',') AS years FROM documents WHERE text IS NOT NULL AND {_SECTION} IS NOT NULL")
def section_detect(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", pages.section_of(F.col("text")).alias("section"), F.array_join(pages.year_headers(F.col("text")), ",").alias("years"))
    return x.where("section IS NOT NULL")


@query("""SELECT table_name, CASE WHEN len(u) = 1 THEN 'USD ' || u[1] END AS unit FROM (SELECT table_name, list_distinct(regexp_extract_all(lower(table_name), '\\b(?:in|usd) (millions|billions|thousands)\\b', 1)) AS u FROM (SELECT DISTINCT table_name FROM passages WHERE table_name IS NOT NULL))""")
def page_units(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).where("table_name IS NOT NULL").select("table_name").distinct().select("table_name", pages.page_unit(F.col("table_name")).alias("unit"))


@query("""SELECT company, page_number, count(*) AS bad_rows FROM passages WHERE type = 'table_row' AND line_item IS NOT NULL AND regexp_full_match(trim(line_item), '[$€£(]?\\s*[\\d,.]*\\s*[)%]?')
  AND NOT regexp_full_match(trim(line_item), '(19|20)\\d\\d(\\s*-\\s*(19|20)\\d\\d)?') GROUP BY ALL""")
def malformed_rows(spark: SparkSession, d: str) -> DataFrame:
    return pages.malformed_pages(_passages(spark, d))


@query("""WITH t AS (SELECT ord, list_filter(regexp_split_to_array(content, '[^A-Za-z0-9]+'), lambda x: x <> '') AS toks FROM passages WHERE type <> 'table_row' AND content IS NOT NULL),
  g AS (SELECT ord, len(toks) AS n_tokens, len(list_filter(toks, lambda x: (regexp_full_match(x, '[a-zA-Z0-9]{4,}') AND regexp_matches(x, '[a-zA-Z]') AND regexp_matches(x, '[0-9]')) OR regexp_full_match(x, '[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{5,}'))) AS bad FROM t)
SELECT ord, CAST(n_tokens AS INT) AS n_tokens, round(bad / n_tokens, 4) AS garbled_share FROM g WHERE n_tokens >= 25 AND round(bad / n_tokens, 4) >= 0.12""")
def garbled_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.garbled_passages(_passages(spark, d))


@query("SELECT company, type, count(*) AS passages, count(DISTINCT page_number) AS pages, count(content) AS with_text, sum(length(content))::BIGINT AS chars, max(length(content)) AS longest FROM passages GROUP BY ALL")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).groupBy("company", "type").agg(F.count("*").alias("passages"), F.countDistinct("page_number").alias("pages"), F.count("content").alias("with_text"), F.sum(F.length("content")).alias("chars"), F.max(F.length("content")).alias("longest"))


# ---------------------------------------------------------------- questions, filings, grading

_KW = lambda words: questions.starts_with_any(words)
_METRICS = ", ".join(f"'{m}'" for m in questions.METRICS)
_CALC = "CASE " + " ".join(f"WHEN regexp_matches(low, '{_KW(w)}') THEN '{k}'" for k, w in questions.CALCULATION.items()) + f" WHEN regexp_matches(low, '{_KW(questions.CHANGE_VERBS)}') THEN 'change' ELSE 'none' END"
_VOTE = {s: "len(list_filter(metrics, lambda m: m IN (" + ", ".join(f"'{k}'" for k, v in questions.METRICS.items() if v == s) + ")))" for s in ("cash_flow", "income_statement", "balance_sheet")}
_LIT = {s: f"regexp_matches(low, '{p}')" for s, p in ranking.STATEMENTS.items()}
_CLASSES = f"""WITH q AS (SELECT id, {_STORE} AS store, question, lower(question) AS low, list_filter([{_METRICS}], lambda m: contains(lower(question), m)) AS metrics,
    coalesce(list_filter(regexp_extract_all(question, '([A-Z][A-Za-z0-9&]*)', 1), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in questions._SKIP)}) AND NOT regexp_full_match(w, 'FY\\d*|Q[1-4]'))[1], 'company') AS entity,
    regexp_extract_all(question, '(?i)(20\\d\\d)\\s*(?:[-–—]|to)\\s*(?:FY)?(20\\d\\d)', 1) AS lo, regexp_extract_all(question, '(?i)(20\\d\\d)\\s*(?:[-–—]|to)\\s*(?:FY)?(20\\d\\d)', 2) AS hi FROM questions WHERE question IS NOT NULL),
  c AS (SELECT *, {_CALC} AS calculation, {", ".join(f"{v} AS v_{s}" for s, v in _VOTE.items())},
    list_sort(list_distinct(list_concat(regexp_extract_all(question, '(20\\d\\d)', 1), flatten(list_transform(range(1, len(lo) + 1), lambda i: CASE WHEN hi[i]::INT - lo[i]::INT BETWEEN 1 AND 10 THEN list_transform(range(lo[i]::INT, hi[i]::INT + 1), lambda y: y::VARCHAR) ELSE [] END))))) AS years FROM q),
  s AS (SELECT *, CASE WHEN {" + ".join(f"{c}::INT" for c in _LIT.values())} = 1 THEN CASE {" ".join(f"WHEN {c} THEN '{k}'" for k, c in _LIT.items())} END
      WHEN greatest({", ".join(f"v_{x}" for x in _VOTE)}) > 0 THEN CASE {" ".join(f"WHEN v_{x} = greatest({', '.join('v_' + y for y in _VOTE)}) THEN '{x}'" for x in _VOTE)} END ELSE 'none' END AS statement,
    CASE WHEN regexp_matches(low, '{_KW(questions.EXCLUSION)}') THEN 'EXCLUSION' WHEN regexp_matches(low, '{_KW(questions.EXPLANATION)}') THEN 'EXPLANATION' WHEN calculation <> 'none' THEN 'NUMERIC'
      WHEN regexp_matches(low, 'how much') AND regexp_matches(low, 'usd|dollar|million|billion|\\$') THEN 'NUMERIC' WHEN regexp_matches(low, '{_KW(questions.ASSESSMENT)}') THEN 'ASSESSMENT'
      WHEN len(metrics) > 0 THEN 'NUMERIC' ELSE 'EXPLANATION' END AS answer_mode FROM c),
  k AS (SELECT *, CASE WHEN answer_mode <> 'NUMERIC' THEN 'NARRATIVE' WHEN len(metrics) * greatest(len(years), 1) <= 1 THEN 'TARGETED_ROW' ELSE 'MULTI_ROW' END AS strategy FROM s)"""


@query(_CLASSES + " SELECT id, store, entity, array_to_string(years, ',') AS years, array_to_string(metrics, ',') AS metrics, calculation, statement, answer_mode, strategy FROM k")
def classify_questions(spark: SparkSession, d: str) -> DataFrame:
    x = questions.classified(table(spark, d, "questions"))
    return x.withColumns({"years": F.array_join("years", ","), "metrics": F.array_join("metrics", ",")})


@query(_CLASSES + """, p AS (SELECT id, flatten(list_transform(CASE WHEN len(metrics) > 0 THEN metrics ELSE ['overview'] END, lambda m: list_transform(CASE WHEN len(years) > 0 THEN years ELSE [''] END, lambda y: trim(concat_ws(' ', entity, m, y)))))[1:5] AS qs FROM k)
SELECT id, CAST(i AS INT) AS step, qs[i] AS query FROM (SELECT id, qs, unnest(range(1, len(qs) + 1)) AS i FROM p)""")
def plan_steps(spark: SparkSession, d: str) -> DataFrame:
    return questions.plan_steps(questions.classified(table(spark, d, "questions")))


_FKEY = lambda c: f"regexp_replace(lower(regexp_replace(trim({c}), '\\.[A-Za-z0-9]{{1,4}}$', '')), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH f AS (SELECT upper(company) AS store, {_FKEY("filename")} AS f, filename, ordinal FROM filings), q AS (SELECT id, {_STORE} AS store, {_FKEY("doc_name")} AS q FROM questions WHERE doc_name IS NOT NULL)
SELECT id, filename FROM q JOIN f USING (store) WHERE f = q OR starts_with(f, q) OR starts_with(q, f) QUALIFY row_number() OVER (PARTITION BY id ORDER BY (f <> q), ordinal) = 1""")
def resolve_filings(spark: SparkSession, d: str) -> DataFrame:
    return questions.resolved(table(spark, d, "questions"), table(spark, d, "filings"))


@query("""WITH n AS (SELECT company, count(*) AS found FROM passages GROUP BY ALL), f AS (SELECT company, sum(passage_count)::BIGINT AS stated, count(*) AS filings FROM (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY filename ORDER BY ordinal) = 1) GROUP BY ALL)
SELECT coalesce(f.company, n.company) AS company, coalesce(filings, 0) AS filings, stated, coalesce(found, 0) AS found FROM f FULL JOIN n ON n.company = f.company""")
def registry_check(spark: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(_window("filename", "ordinal"))
    f = table(spark, d, "filings").withColumn("n", first).where("n = 1").groupBy("company").agg(F.sum("passage_count").alias("stated"), F.count("*").alias("filings"))
    n = _passages(spark, d).groupBy("company").agg(F.count("*").alias("found"))
    return f.join(n, "company", "full").select("company", F.coalesce("filings", F.lit(0)).alias("filings"), "stated", F.coalesce("found", F.lit(0)).alias("found"))


@query("""WITH d AS (SELECT q.id, regexp_extract(q.id, '^([a-z]+)-', 1) AS part, coalesce(question_type, '?') AS question_type, upper(label) AS label FROM questions q JOIN grading_labels USING (id) WHERE label IS NOT NULL)
SELECT coalesce(part, '*') AS part, coalesce(question_type, '*') AS question_type, count(*) FILTER (WHERE label = 'C') AS C, count(*) FILTER (WHERE label = 'S') AS S, count(*) FILTER (WHERE label = 'P') AS P, count(*) FILTER (WHERE label = 'W') AS W,
  count(*) AS graded, round(count(*) FILTER (WHERE label = 'C') / count(*), 4) AS correct FROM d GROUP BY CUBE (part, question_type)""")
def label_cube(spark: SparkSession, d: str) -> DataFrame:
    return grading.tabulated(table(spark, d, "questions"), table(spark, d, "grading_labels"))


@query("SELECT id, string_agg(DISTINCT upper(label), ',' ORDER BY upper(label)) AS labels FROM grading_labels WHERE label IS NOT NULL GROUP BY id HAVING count(DISTINCT upper(label)) > 1")
def label_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return grading.disagreements(table(spark, d, "grading_labels"))


@query("SELECT id FROM questions WHERE id NOT IN (SELECT id FROM grading_labels WHERE label IS NOT NULL AND id IS NOT NULL)")
def unlabelled_questions(spark: SparkSession, d: str) -> DataFrame:
    return grading.unlabelled(table(spark, d, "questions"), table(spark, d, "grading_labels"))


@query("SELECT id, upper(label) AS label, rule FROM grading_labels WHERE (upper(label) IN ('P', 'W') AND rule IS NULL) OR (upper(label) = 'C' AND rule IS NOT NULL)")
def odd_labels(spark: SparkSession, d: str) -> DataFrame:
    return grading.odd_rules(table(spark, d, "grading_labels"))


@query("""SELECT coalesce(question_type, '?') AS question_type, CASE WHEN answer IS NULL THEN 'missing' WHEN lower(trim(answer)) IN ('yes', 'no') THEN 'yes_no' WHEN regexp_matches(answer, '%\\s*$') THEN 'percent' WHEN contains(answer, '$') THEN 'money'
  WHEN regexp_matches(answer, '^\\s*\\(?\\$?\\s*-?[\\d,]+') THEN 'number' ELSE 'text' END AS kind, count(*) AS n FROM questions GROUP BY ALL""")
def answer_kinds(spark: SparkSession, d: str) -> DataFrame:
    return grading.answer_kinds(table(spark, d, "questions"))


# ---------------------------------------------------------------- answers and checks

_MVAR = ", ".join(f"('{a}', '{b}')" for a, b in answers.METRIC_VARIABLES.items())
_LOOKUP = f"""{_CLASSES}, {_FACTS}, mv(metric, canonical) AS (VALUES {_MVAR}),
  e AS (SELECT id, store, metric, unnest(years) AS year FROM (SELECT id, store, unnest(metrics) AS metric, years FROM k)),
  look AS (SELECT e.id, e.metric, e.year, b.val AS value, b.ord FROM e JOIN mv USING (metric) JOIN best b ON b.company = e.store AND b.canonical = mv.canonical AND b.year = e.year)"""


@query(_LOOKUP + " SELECT * FROM look")
def direct_lookup(spark: SparkSession, d: str) -> DataFrame:
    return answers.direct_lookup(table(spark, d, "questions"), _passages(spark, d))


@query(_LOOKUP + """, g AS (SELECT id, metric, min(year) AS first_year, max(year) AS last_year, arg_min(value, year) AS a, arg_max(value, year) AS b FROM look GROUP BY ALL)
SELECT id, metric, first_year, last_year, round(b - a, 4) AS change, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / abs(a) * 100 END, 4) AS growth FROM g WHERE first_year < last_year""")
def answered_change(spark: SparkSession, d: str) -> DataFrame:
    return answers.answered_change(table(spark, d, "questions"), _passages(spark, d))


_CHECK = f"""WITH hit AS ({_search_sql(5)}), q AS (SELECT id, lower(regexp_extract(doc_name, '([A-Za-z0-9]+)', 1)) AS name, list_distinct({_YEARS("question")}) AS asked FROM questions WHERE question IS NOT NULL),
  p AS (SELECT h.id, count(*) AS evidence, flatten(list({_YEARS("concat_ws(' ', period, content)")})) AS years, list(lower(company)) AS companies FROM hit h JOIN passages USING (ord) GROUP BY h.id),
  m AS (SELECT q.id, coalesce(evidence, 0) AS evidence, list_sort(list_filter(asked, lambda y: NOT list_contains(coalesce(years, []), y))) AS missing, coalesce(list_contains(companies, name), false) AS named FROM q LEFT JOIN p USING (id)),
  f AS (SELECT id, evidence, array_to_string(missing, ',') AS missing_years, CASE WHEN evidence = 0 THEN 'no_evidence' WHEN NOT named THEN 'entity_mismatch' WHEN len(missing) > 0 THEN 'missing_years' END AS failure FROM m)"""


@query(_CHECK + " SELECT id, evidence, missing_years, CASE WHEN failure IS NULL THEN 'ACCEPT' ELSE 'REJECT' END AS decision, failure FROM f")
def tricheck(spark: SparkSession, d: str) -> DataFrame:
    p, q = _passages(spark, d), table(spark, d, "questions")
    return answers.checked(q, ranking.search(p, q).select("id", "ord"), p)


@query(_CHECK + " SELECT id, CASE failure WHEN 'no_evidence' THEN 'broaden' WHEN 'entity_mismatch' THEN 'refine' ELSE 'targeted' END AS action, CASE failure WHEN 'missing_years' THEN 15 ELSE 5 END AS top_k FROM f WHERE failure IS NOT NULL")
def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    p, q = _passages(spark, d), table(spark, d, "questions")
    return answers.retries(answers.checked(q, ranking.search(p, q).select("id", "ord"), p))


# ---------------------------------------------------------------- series


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.row_facts(_passages(spark, d))


@query(f"WITH {_FACTS}, y AS (SELECT DISTINCT company, year FROM best) SELECT y.company, canonical, y.year, max(b.year) AS prior_year, arg_max(val, b.year) AS prior FROM y JOIN best b ON b.company = y.company AND b.year < y.year GROUP BY ALL")
def asof_prior_balance(spark: SparkSession, d: str) -> DataFrame:
    best = facts.best_facts(_facts(spark, d))
    return series.prior_balances(best, best.select("company", "year").distinct())


@query(f"""WITH {_FACTS}, g AS (SELECT company, canonical, list(val ORDER BY year) AS v, min(year) AS first_year, max(year) AS last_year FROM best GROUP BY ALL HAVING count(*) > 1), x AS (SELECT *, round(v[-1] - v[1], 4) AS delta FROM g)
SELECT company, canonical, first_year, last_year, delta, array_to_string(list_transform(range(2, len(v) + 1), lambda i: printf('%.4f', round(v[i] - v[i - 1], 4))), ';') AS steps, CASE WHEN delta > 0 THEN 'increased' WHEN delta < 0 THEN 'decreased' ELSE 'stayed flat' END AS direction FROM x""")
def multi_year_delta(spark: SparkSession, d: str) -> DataFrame:
    return series.deltas(facts.best_facts(_facts(spark, d)))


@query(f"WITH {_FACTS} SELECT company, canonical, year, val FROM best QUALIFY row_number() OVER (PARTITION BY company, canonical ORDER BY year DESC) <= 3")
def latest_years(spark: SparkSession, d: str) -> DataFrame:
    return series.latest(facts.best_facts(_facts(spark, d))).select("company", "canonical", "year", "val")


@query(f"""WITH {_FACTS}, a AS (SELECT *, abs(val) AS size, max(abs(val)) OVER w AS top FROM named WINDOW w AS (PARTITION BY company, canonical, year)),
  b AS (SELECT * REPLACE (count(*) OVER (PARTITION BY company, canonical, year, val) AS agree) FROM a WHERE size >= 0.05 * top), c AS (SELECT *, max(agree) OVER (PARTITION BY company, canonical, year) AS most FROM b),
  e AS (SELECT * REPLACE (max(size) OVER (PARTITION BY company, canonical, year) AS top), min(size) OVER (PARTITION BY company, canonical, year) AS low FROM c WHERE agree = most),
  f AS (SELECT * FROM e WHERE top <= 5 * low OR size = top), n AS (SELECT company, canonical, year, count(DISTINCT val)::INT AS left_over FROM f GROUP BY ALL)
SELECT f.company, f.canonical, f.year, val, left_over AS "left" FROM f JOIN n USING (company, canonical, year) QUALIFY row_number() OVER (PARTITION BY f.company, f.canonical, f.year ORDER BY length(item), size DESC, ord) = 1""")
def resolve_candidates(spark: SparkSession, d: str) -> DataFrame:
    return series.candidates(_facts(spark, d))


@query(f"WITH {_FACTS}, g AS (SELECT company, canonical, ord, count(DISTINCT year) AS years FROM named GROUP BY ALL) SELECT * FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY company, canonical ORDER BY years DESC, ord) = 1) WHERE years > 1")
def common_source(spark: SparkSession, d: str) -> DataFrame:
    return series.common_sources(_facts(spark, d))


@query(f"WITH {_WIDE} SELECT company, year, round(revenue - abs(cogs), 4) AS value, coalesce(abs(gross_profit - (revenue - abs(cogs))) <= 0.02 * abs(revenue - abs(cogs)), false) AS stated FROM wide WHERE revenue IS NOT NULL AND cogs IS NOT NULL")
def gross_profit_derived(spark: SparkSession, d: str) -> DataFrame:
    return series.derived_gross_profit(facts.wide_facts(_facts(spark, d)))


_COMPOSITES = {"total_debt": ("short_term_debt", "long_term_debt"), "operating_expenses": ("selling_expenses", "sga", "rd_expense"), "liquid_assets": ("cash", "short_term_investments", "accounts_receivable")}


@query(f"WITH {_FACTS}, m(composite, canonical) AS (VALUES {', '.join(f"('{c}', '{p}')" for c, ps in _COMPOSITES.items() for p in ps)}) SELECT company, composite, year, round(sum(val), 4) AS value, string_agg(canonical, '+' ORDER BY canonical) AS items FROM best JOIN m USING (canonical) GROUP BY company, composite, year")
def composite_sum(spark: SparkSession, d: str) -> DataFrame:
    return series.composites(facts.best_facts(_facts(spark, d)), _COMPOSITES)


@query(_DECODED + """, r2 AS (SELECT parent_id, digest, row_ix, row[1] AS item FROM dec), e AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(lower(item), '^(change|changes) in') THEN true WHEN regexp_matches(lower(item), 'net cash|cash from') THEN false END IGNORE NULLS)
  OVER (PARTITION BY parent_id, digest ORDER BY row_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM r2)
SELECT parent_id, row_ix, CASE WHEN inside AND NOT regexp_matches(lower(item), '^(change|changes) in') THEN 'Change in ' || item ELSE item END AS label FROM e""")
def change_labels(spark: SparkSession, d: str) -> DataFrame:
    return series.change_labels(tables.decode(_passages(spark, d)).select("parent_id", "digest", "row_ix", F.get("row", F.lit(0)).alias("item"))).drop("digest")


@query("""WITH p AS (SELECT doc_id, filename, ordinal, date_diff('day', filed_at::DATE, uploaded_at::DATE) AS gap FROM documents d JOIN filings f USING (company) WHERE filed_at IS NOT NULL AND uploaded_at IS NOT NULL)
SELECT doc_id, filename, gap::INT AS gap FROM p WHERE abs(gap) <= 45 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN gap >= 0 THEN gap ELSE abs(gap) + 100 END, ordinal) = 1""")
def date_proximity(spark: SparkSession, d: str) -> DataFrame:
    return series.nearest_filings(table(spark, d, "documents"), table(spark, d, "filings"))


@query(f"WITH {_INDEX} SELECT store, token, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfreq JOIN stat USING (store)")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    p = spread(_passages(spark, d), "ord", "company", "content")
    post = ranking.postings(p)
    return ranking.document_frequency(post).join(ranking.store_stats(post, p), "store").select("store", "token", F.round(ranking.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(_LOOKUP + rf""", a AS (SELECT id, answer, {_NUM(r"nullif(regexp_extract(answer, '^\s*\(?\$?\s*(-?[\d,]+(?:\.\d+)?)', 1), '')")} * (CASE WHEN regexp_matches(lower(answer), 'billion|bn') THEN 1e9 WHEN regexp_matches(lower(answer), 'million') THEN 1e6 WHEN regexp_matches(lower(answer), 'thousand') THEN 1e3 ELSE 1.0 END) AS gold FROM questions)
SELECT id, metric, year, value, gold, abs(gold - value) <= 0.01 * greatest(abs(gold), 1e-9) AS agrees FROM look JOIN a USING (id) WHERE gold IS NOT NULL""")
def grade_numeric(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    gold = q.select("id", grading.answer_value(F.col("answer")).alias("gold")).where("gold IS NOT NULL")
    return answers.direct_lookup(q, _passages(spark, d)).join(gold, "id").select("id", "metric", "year", "value", "gold", (F.abs(F.col("gold") - F.col("value")) <= 0.01 * F.greatest(F.abs("gold"), F.lit(1e-9))).alias("agrees"))


@query(r"SELECT doc_name, array_to_string(list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(trim(doc_name), '\.[A-Za-z0-9]{1,4}$', ''), '[_\-]', ' ', 'g')), '\s+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '(20\d\d)(q[1-4])?|(10k|10q|8k)')), ' ') AS name, nullif(upper(regexp_extract(lower(doc_name), '(20\d\d(?:q[1-4])?)', 1)), '') AS filing_year FROM (SELECT DISTINCT doc_name FROM questions WHERE doc_name IS NOT NULL)")
def company_norm(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "questions").where("doc_name IS NOT NULL").select("doc_name").distinct()
    return n.select("doc_name", T.company_key(F.col("doc_name")).alias("name"), T.filing_year(F.col("doc_name")).alias("filing_year"))


# ---------------------------------------------------------------- evidence


@query(f"SELECT id, ord, CASE WHEN length(content) > 120 THEN substr(content, 1, 120) || '...' ELSE content END AS snippet FROM ({_search_sql(5)}) JOIN (SELECT ord, content FROM passages) USING (ord)")
def evidence_snippets(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d)
    return ranking.search(p, table(spark, d, "questions")).select("id", "ord").join(p.select("ord", "content"), "ord").select("id", "ord", evidence.snippet(F.col("content")).alias("snippet"))


@query("SELECT ord, CASE WHEN length(parent_content) <= 400 THEN parent_content ELSE substr(parent_content, greatest(1, least(instr(parent_content, line_item) - 200, length(parent_content) - 399)), 400) END AS shown FROM passages WHERE parent_content IS NOT NULL AND line_item IS NOT NULL")
def page_windows(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).where("parent_content IS NOT NULL AND line_item IS NOT NULL")
    return p.select("ord", evidence.page_window(F.col("parent_content"), F.col("line_item")).alias("shown"))


@query(_DECODED + f""", v AS (SELECT parent_id, row_ix, list_filter(list_transform(row[2:], lambda c: {_NUM("c")}), lambda x: x IS NOT NULL) AS v FROM dec)
SELECT parent_id, row_ix FROM v WHERE len(v) >= 5 AND abs(v[1] + v[2] + v[3] + v[4] - v[5]) <= 0.02 * abs(v[5])""")
def quarter_sum_check(spark: SparkSession, d: str) -> DataFrame:
    return evidence.quarterly_rows(tables.decode(_passages(spark, d))).drop("digest")


@query(r"""WITH p AS (SELECT company, unnest(regexp_extract_all(text, 'year ended ([A-Z][a-z]+) (20\d\d)', 1)) AS month, unnest(regexp_extract_all(text, 'year ended ([A-Z][a-z]+) (20\d\d)', 2)) AS y FROM documents WHERE text IS NOT NULL AND company IS NOT NULL),
  g AS (SELECT company, month, count(*) AS mentions, min(y) AS first_year, max(y) AS last_year FROM p GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY company ORDER BY mentions DESC, month) = 1""")
def filing_periods(spark: SparkSession, d: str) -> DataFrame:
    return evidence.fiscal_ends(table(spark, d, "documents"))


@query(f"SELECT ord, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct FROM (SELECT ord, {_tokens('content')} AS toks FROM passages WHERE content IS NOT NULL)")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).where("content IS NOT NULL").select("ord", T.tokens(F.col("content")).alias("t"))
    return p.select("ord", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_YEARS('text')})), ',') AS years FROM documents WHERE text IS NOT NULL")
def year_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(T.years(F.col("text")), ",").alias("years"))


# ---------------------------------------------------------------- the ledger

_TIDY = """once AS (SELECT ts, date, pid, lower(model) AS model, nullif(lower(caller), '?') AS caller, coalesce(total_tokens, prompt_tokens + completion_tokens) AS tokens, min(read_at) AS read_at
  FROM usage_ledger l GROUP BY ts, date, pid, l.model, l.caller, prompt_tokens, completion_tokens, reasoning_tokens, total_tokens, prompt_chars)"""


@query(f"WITH {_TIDY}, d AS (SELECT coalesce(caller, 'unknown') AS c, coalesce(model, 'unknown') AS m, tokens FROM once) SELECT coalesce(c, '*') AS caller, coalesce(m, '*') AS model, count(*) AS calls, sum((tokens IS NULL)::INT)::BIGINT AS unknown, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM d GROUP BY GROUPING SETS ((c), (m), ())")
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage.totals(table(spark, d, "usage_ledger"))


@query(f"WITH {_TIDY}, d AS (SELECT read_at::DATE AS day, count(*) AS calls, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM once GROUP BY ALL) SELECT *, sum(tokens) OVER (ORDER BY day)::BIGINT AS running_tokens FROM d")
def ledger_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_read_day(table(spark, d, "usage_ledger"))


@query(f"WITH {_TIDY}, d AS (SELECT pid, read_at::DATE AS day, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM once GROUP BY ALL) SELECT *, round(tokens / 50000, 4) AS share FROM d WHERE tokens > 50000")
def ledger_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return usage.over_budget(table(spark, d, "usage_ledger"), 50_000)


@query(f"WITH {_TIDY} SELECT pid, count(*) AS calls, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM once GROUP BY ALL ORDER BY tokens DESC, pid LIMIT 12")
def ledger_top_writers(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_writers(table(spark, d, "usage_ledger"))


@query("""WITH e AS (SELECT user_id AS pid, ts AS at_ts FROM events WHERE ts IS NOT NULL), g AS (SELECT *, CASE WHEN at_ts <= lag(at_ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY pid ORDER BY at_ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY pid ORDER BY at_ts)::BIGINT AS session FROM g) SELECT pid, session, min(at_ts) AS started, max(at_ts) AS ended, count(*)::BIGINT AS calls FROM s GROUP BY ALL""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return usage.sessions(table(spark, d, "events").select(F.col("user_id").alias("pid"), F.col("ts").alias("at")))


_RUNS = [("first", "2025-01-01", "2025-04-01"), ("second", "2025-04-01", "2025-07-01"), ("later", "2025-07-01", "2027-01-01"), ("never", "1990-01-01", "1990-01-02")]


@query(f"WITH {_TIDY}, r(run, s, e) AS (VALUES {', '.join(f"('{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for a, b, c in _RUNS)}) SELECT run, count(read_at) AS calls, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM r LEFT JOIN once ON read_at >= s AND read_at < e GROUP BY ALL")
def run_window_usage(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.createDataFrame(_RUNS, "run string, s string, e string").select("run", F.col("s").cast("timestamp_ntz").alias("starts"), F.col("e").cast("timestamp_ntz").alias("ends"))
    return usage.within_runs(table(spark, d, "usage_ledger"), runs)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
