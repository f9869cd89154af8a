"""Column functions over text: tokens, years, numbers, names, labels. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token grammar of the lexical index (a CJK character, a grouped number, a word or number with decimals).
TOKEN = r"[一-鿿]|\d{1,3}(?:,\d{3})+(?:\.\d+)?|[a-z0-9]+(?:\.\d+)?"
# Multi-word terms that count as one more token where a text contains them.
TERMS = (
    "營業收入", "營收", "毛利", "毛利率", "營業利益", "營業利益率", "營業費用", "研發費用", "本期淨利", "淨利", "每股盈餘", "資本支出", "銷貨成本", "營業成本", "存貨", "應付帳款", "應收帳款",
    "revenue", "gross profit", "gross margin", "operating income", "operating margin", "net income", "eps", "capital expenditure", "capex",
    "capital spending", "r&d", "net sales", "total revenue", "cost of revenue", "ebitda", "free cash flow", "inventory", "inventories",
    "accounts payable", "accounts receivable", "receivables", "cost of goods sold", "cost of sales", "cost of products sold", "total assets",
    "total liabilities", "current liabilities", "current assets", "provision for income taxes", "income tax", "dividends paid",
    "net cash provided by operating activities", "property and equipment", "property, plant and equipment",
    "acquisitions, net of cash acquired", "acquisitions net of cash acquired",
)


def tokens(text: Column) -> Column:
    """Tokens in order, then each term the text contains, once. The lower-cased text is bound once, not made again for each term."""
    terms = F.array(*map(F.lit, TERMS))
    made = F.transform(F.array(F.lower(text)), lambda low: F.concat(F.regexp_extract_all(low, F.lit(f"({TOKEN})"), F.lit(1)), F.filter(terms, lambda t: F.contains(low, t))))
    return F.get(made, 0)


def years(text: Column) -> Column:
    """Distinct years 20dd a text names, `FY23` included, ascending."""
    full = F.regexp_extract_all(text, F.lit(r"(20\d\d)"), F.lit(1))
    short = F.transform(F.regexp_extract_all(text, F.lit(r"FY(\d\d)(?:[^\d]|$)"), F.lit(1)), lambda y: F.concat(F.lit("20"), y))
    return F.array_sort(F.array_union(full, short))


def year_span(text: Column) -> Column:
    """The years a question asks for: those named, and all between the ends of ranges of up to ten years; ascending."""
    low = F.regexp_extract_all(text, F.lit(r"(?i)(20\d\d)\s*(?:[-–—]|to)\s*(?:FY)?(20\d\d)"), F.lit(1))
    high = F.regexp_extract_all(text, F.lit(r"(?i)(20\d\d)\s*(?:[-–—]|to)\s*(?:FY)?(20\d\d)"), F.lit(2))
    pairs = F.filter(F.arrays_zip(low.alias("a"), high.alias("b")), lambda p: (p["b"].cast("int") - p["a"].cast("int")).between(1, 10))
    between = F.flatten(F.transform(pairs, lambda p: F.transform(F.sequence(p["a"].cast("int"), p["b"].cast("int")), lambda y: y.cast("string"))))
    return F.array_sort(F.array_union(between, F.regexp_extract_all(text, F.lit(r"(20\d\d)"), F.lit(1))))


def number(text: Column) -> Column:
    """Accounting number: dollar signs, grouping, percent signs and blanks dropped, brackets negative; null if there is none."""
    t = F.trim(text)
    bare = F.regexp_replace(t, r"[$,%()\s]", "")
    value = F.when(bare.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), bare.try_cast("double"))
    return F.when(t.startswith("(") & t.endswith(")"), -value).otherwise(value)


def year_label(text: Column) -> Column:
    """A column caption as a year, `FY2023` and `Fiscal 2023` included, else null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(?:FY|Fiscal )?\s*((?:19|20)\d\d)$", 1), F.lit(""))


def company_key(name: Column) -> Column:
    """A filing or company name without extension, years, quarters and form names; words in lower case."""
    low = F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"\.[A-Za-z0-9]{1,4}$", ""), r"[_\-]", " "))
    return F.array_join(F.filter(F.split(low, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^(20\d\d)(q[1-4])?$|^(10k|10q|8k)$")), " ")


def names_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Which of the terms a text names as words of their own, also with a plural s."""
    edge = r"[^\p{L}\p{N}_]"

    def named(low: Column) -> Column:
        whole = lambda t: F.regexp_like(low, F.concat(F.lit(f"(^|{edge})\\Q"), t, F.lit(f"\\Es?({edge}|$)")))
        return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t) & whole(t))

    return F.get(F.transform(F.array(F.lower(text)), named), 0)


def filing_year(name: Column) -> Column:
    """The year a filing's name carries, with its quarter if there is one."""
    return F.nullif(F.upper(F.regexp_extract(F.lower(name), r"(20\d\d(?:q[1-4])?)", 1)), F.lit(""))


def identifier(text: Column) -> Column:
    """A label as an identifier of up to 24 characters; `val` if nothing is left."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, 24)
    return F.when(clean == "", "val").otherwise(clean)


def stems(text: Column) -> Column:
    """First five letters of the words of three letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,})"), F.lit(1)), lambda w: F.substring(w, 1, 5)))


def cleaned(text: Column) -> Column:
    """Control characters dropped, common entities decoded, runs of blanks and of blank lines shortened."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def readable(text: Column, least: int = 5) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= least


def growth(old: Column, new: Column) -> Column:
    """Growth in percent of the old value's size; 0 from nothing."""
    return F.when(old == 0, 0.0).otherwise((new - old) / F.abs(old) * 100)


def compound_growth(first: Column, last: Column, periods: Column) -> Column:
    """Compound growth a period in percent; 0 if it isn't defined."""
    return F.when((first <= 0) | (periods <= 0) | (last < 0), 0.0).otherwise((F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), periods)) - 1) * 100)


def share(part: Column, whole: Column) -> Column:
    """A margin in percent; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100)
