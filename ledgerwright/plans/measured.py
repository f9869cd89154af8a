"""The pN_ queries of the core, timestamps and quantities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.operators import instants, quantities
from ledgerwright.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.wrong_days(table(spark, sf_dir, "usage_ledger"), table(spark, sf_dir, "ledger_writers"))


def p2_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.normalise(table(spark, sf_dir, "usage_ledger"), table(spark, sf_dir, "ledger_writers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.contradictions(table(spark, sf_dir, "passages"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantities.common_values(table(spark, sf_dir, "passages"))
    return v.select("ord", "company", F.lower("measure").alias("measure"), "fiscal_year", F.when(F.abs("value") < 1000, F.round("value", 6)).otherwise(F.round("value", 1)).alias("value"))


P2_FOUND_SQL = r"""
WITH l AS (
  SELECT ledger_id, trim(ts) AS t, trim(date) AS d, w.zone_name AS z, coalesce(w.day_order = 'dmy', false) AS dmy
  FROM usage_ledger LEFT JOIN ledger_writers w USING (pid)),
p AS (
  SELECT *, CASE
    WHEN regexp_full_match(t, '\d{4}[-/]\d\d[-/]\d\d[T ].*') THEN try_strptime(replace(replace(t[1:19], 'T', ' '), '/', '-'), '%Y-%m-%d %H:%M:%S')
    WHEN regexp_full_match(t, '\d{8}T\d{6}Z?') THEN try_strptime(t[1:15], '%Y%m%dT%H%M%S')
    WHEN regexp_full_match(t, '\w{3}, .*') THEN try_strptime(regexp_extract(t, ', (\d+ \w{3} \d{4} [\d:]+)', 1), '%d %b %Y %H:%M:%S')
    WHEN regexp_full_match(t, '\d+-\w{3}-\d\d [\d:]+') THEN try_strptime(t, '%d-%b-%y %H:%M')
    WHEN regexp_full_match(t, '\w{3} \d+, .*') THEN try_strptime(regexp_extract(t, '^(.* [AP]M)', 1), '%b %d, %Y %I:%M:%S %p')
    WHEN regexp_full_match(t, '\d+[/.]\d+[/.]\d\d \d+:\d+') THEN CASE WHEN dmy THEN try_strptime(replace(t, '.', '/'), '%d/%m/%y %H:%M') ELSE try_strptime(replace(t, '.', '/'), '%m/%d/%y %H:%M') END
    WHEN regexp_full_match(t, '\d+/\d+/\d{4} .* [AP]M') THEN CASE WHEN dmy THEN try_strptime(t, '%d/%m/%Y %I:%M:%S %p') ELSE try_strptime(t, '%m/%d/%Y %I:%M:%S %p') END
    END AS lt,
    CASE WHEN regexp_full_match(t, '\d{9,}(\.\d+)?') THEN epoch_ms(CASE length(split_part(t, '.', 1)) WHEN 10 THEN split_part(t, '.', 1)::BIGINT * 1000
      WHEN 13 THEN t::BIGINT WHEN 16 THEN t::BIGINT // 1000 END) END AS epoch,
    regexp_extract(t, '([+-]\d\d:?\d\d)$', 1) AS sg,
    regexp_extract(t, '([A-Za-z]+/[A-Za-z_]+)', 1) AS named,
    regexp_matches(t, '(Z|UTC)$') AS utc,
    regexp_extract(t, ' ([A-Z]{3,4})$', 1) AS abbr,
    CASE WHEN regexp_full_match(d, '\d{4}-\d\d-\d\d') THEN try_strptime(d, '%Y-%m-%d') WHEN regexp_full_match(d, '\d{8}') THEN try_strptime(d, '%Y%m%d')
      WHEN regexp_full_match(d, '\d{4}/\d\d/\d\d') THEN try_strptime(d, '%Y/%m/%d') WHEN regexp_full_match(d, '\w{3} \d+, \d{4}') THEN try_strptime(d, '%b %d, %Y')
      ELSE CASE WHEN dmy THEN try_strptime(replace(d, '.', '/'), '%d/%m/%Y') ELSE try_strptime(replace(d, '.', '/'), '%m/%d/%Y') END END::DATE AS written
  FROM l),
o AS (SELECT *, CASE WHEN named <> '' THEN named ELSE z END AS zn, CASE WHEN NOT regexp_full_match(t, '\d{4}-\d\d-\d\d') THEN sg ELSE '' END AS s FROM p),
q AS (SELECT *, CASE WHEN s = '' AND NOT utc AND lt IS NOT NULL THEN timezone(zn, lt) END AS late FROM o),
u AS (
  SELECT ledger_id, written, coalesce(epoch,
    CASE WHEN s <> '' THEN lt - to_minutes((CASE WHEN s[1] = '-' THEN -1 ELSE 1 END) * (s[2:3]::INT * 60 + right(s, 2)::INT)) END,
    CASE WHEN utc THEN lt END,
    CASE WHEN timezone(zn, late) = lt THEN timezone('UTC', CASE WHEN timezone(zn, late - INTERVAL 1 HOUR) = lt AND abbr NOT IN ('EST', 'CST', 'MST', 'PST', 'CET', 'GMT', 'AEST', 'NZST') THEN late - INTERVAL 1 HOUR ELSE late END) END) AS utc_at
  FROM q)
SELECT ledger_id FROM u WHERE utc_at::DATE <> written
"""

_MEASURES = "Electricity used|Selling area|Fuel burned|Dividend per share|Capital commitments|Freight carried|Fleet distance|Average borrowing rate|Customer deposits|Order backlog"
P5_VALUES_SQL = rf"""
WITH f(unit, factor) AS (VALUES ('kwh', 1.0::DOUBLE), ('thousand kwh', 1e3), ('mwh', 1e3), ('gwh', 1e6), ('terajoules', 1e6 / 3.6), ('square metres', 1), ('m²', 1), ('square feet', 0.09290304), ('thousands of square feet', 92.90304),
    ('million sq ft', 92903.04), ('acres', 4046.8564224), ('hectares', 1e4), ('litres', 1), ('us gallons', 3.785411784), ('thousand gallons', 3785.411784), ('barrels', 42 * 3.785411784), ('cubic metres', 1e3), ('dollars', 1), ('us$', 1),
    ('$', 1), ('cents', 0.01), ('us dollars', 1), ('usd thousands', 1e3), ('usd millions', 1e6), ('usd billions', 1e9), ('$m', 1e6), ('$ million', 1e6), ('$ billion', 1e9), ('us$bn', 1e9), ('usd thousand', 1e3), ('usd million', 1e6),
    ('kilograms', 1), ('pounds', 0.45359237), ('million lbs', 453592.37), ('short tons', 907.18474), ('metric tons', 1e3), ('thousand tonnes', 1e6), ('kilometres', 1), ('thousand km', 1e3), ('miles', 1.609344),
    ('million miles', 1609344), ('percent', 1), ('%', 1), ('basis points', 0.01)),
p AS (SELECT ord, company, type, content, string_split(content, ' | ') AS parts FROM passages WHERE section = 'operating_data' AND content IS NOT NULL),
t AS (SELECT ord, company, regexp_extract(content, 'Line Item: ({_MEASURES})', 1) AS measure, unnest(parts) AS part,
    coalesce(nullif(regexp_extract(content, 'Line Item: [^|(]+\(([^)]+)\)', 1), ''), nullif(regexp_extract(content, 'Unit: ([^|]+)', 1), ''), regexp_extract(content, 'Operating data \((?:in )?([^)]+)\)', 1)) AS around
  FROM p WHERE type = 'table_row'),
c AS (SELECT ord, company, measure, regexp_extract(part, '^(?:FY|Fiscal )?((?:19|20)\d\d): ', 1) AS y, regexp_replace(part, '^[^:]*: ', '') AS cell, around FROM t WHERE regexp_matches(part, '^(?:FY|Fiscal )?(?:19|20)\d\d: ')),
n AS (SELECT ord, company, unnest(string_split(regexp_replace(regexp_extract(content, 'Content: (.*)', 1, 's'), '([.;!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM p WHERE type <> 'table_row'),
v AS (SELECT ord, company, regexp_extract(s, '(?i)({_MEASURES})', 1) AS measure, regexp_extract(s, '(?:FY|fiscal |for |end of )((?:19|20)\d\d)', 1) AS y, NULL AS around,
    regexp_extract(s, '(?i)(?:gives|was|amounted to|came to|(?:{_MEASURES}) of) (.*?)(?: as the |, according|, which|; |\.?$)', 1) AS cell FROM n WHERE regexp_matches(s, '(?i){_MEASURES}')),
a AS (SELECT ord, company, lower(measure) AS measure, y::INT AS fiscal_year, TRY_CAST(replace(regexp_extract(cell, '([\d,]*\.?\d+)', 1), ',', '') AS DOUBLE) AS x,
    coalesce(nullif(lower(trim(regexp_replace(regexp_replace(cell, '[\d,]*\.?\d+', ''), '\s+', ' ', 'g'))), ''), lower(trim(around))) AS unit FROM (SELECT * FROM c UNION ALL BY NAME SELECT * FROM v) WHERE y <> '' AND measure <> '')
SELECT ord, company, measure, fiscal_year, CASE WHEN abs(x * factor) < 1000 THEN round(x * factor, 6) ELSE round(x * factor, 1) END AS value FROM a JOIN f USING (unit) WHERE x IS NOT NULL"""
P5_FOUND_SQL = f"""WITH x AS ({P5_VALUES_SQL})
SELECT DISTINCT a.ord AS ord_a, b.ord AS ord_b FROM x a JOIN x b ON a.company = b.company AND a.measure = b.measure AND a.fiscal_year = b.fiscal_year AND a.ord < b.ord
WHERE abs(a.value - b.value) > 0.02 * greatest(abs(a.value), abs(b.value))"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_instants, p5_found, p5_values)}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND_SQL, "p5_found": P5_FOUND_SQL, "p5_values": P5_VALUES_SQL}
