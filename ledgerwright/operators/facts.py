"""Facts from table rows and Markdown tables, canonical line items, the best row of each item and year, and formulas."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerwright.functions import text as T

# Names of a line item, by the variable the formulas use.
ALIASES = {
    "revenue": ("net sales", "revenue", "total revenue"), "cogs": ("cost of products sold", "cost of goods sold", "cost of sales", "cost of revenue"),
    "gross_profit": ("gross profit",), "operating_income": ("operating income", "income from operations"), "interest_income": ("interest income",),
    "interest_expense": ("interest expense",), "pretax_income": ("income before taxes", "income before income taxes"), "income_tax": ("provision for taxes", "provision for income taxes"),
    "net_income": ("net income", "net earnings"), "eps_basic": ("basic earnings per share",), "eps_diluted": ("diluted earnings per share",),
    "rd_expense": ("development expenses", "research and development"), "sga": ("administrative expenses", "selling, general and administrative"), "selling_expenses": ("selling expenses",),
    "cash": ("cash and equivalents", "cash and cash equivalents", "cash"), "short_term_investments": ("marketable securities", "short-term investments"),
    "accounts_receivable": ("trade receivables, net", "accounts receivable, net", "accounts receivable"), "inventory": ("inventories", "inventory"), "prepaid": ("prepaid items", "prepaid expenses"),
    "current_assets": ("total current assets",), "ppe": ("plant and equipment, net", "property, plant and equipment, net"), "goodwill": ("goodwill",), "total_assets": ("total assets",),
    "accounts_payable": ("trade payables", "accounts payable"), "accrued_liabilities": ("accrued liabilities",), "short_term_debt": ("current portion of debt",), "current_liabilities": ("total current liabilities",),
    "long_term_debt": ("long-term debt", "long-term borrowings"), "total_liabilities": ("total liabilities",), "shareholders_equity": ("total equity", "shareholders' equity", "total shareholders' equity"),
    "depreciation": ("depreciation and amortization",), "cash_from_operations": ("net cash from operations", "cash from operating activities", "cash provided by operations", "net cash provided by operating activities"),
    "capex": ("purchases of plant and equipment", "purchases of equipment", "purchases of property and equipment", "capital expenditures"), "repurchases": ("repurchase of shares",), "dividends_paid": ("dividends paid",), "shares_outstanding": ("shares outstanding",),
}
# The formulas. _old is the year before, _new the year itself.
FORMULAS = {
    "quick_ratio": "(current_assets - inventory) / current_liabilities", "working_capital": "current_assets - current_liabilities", "current_ratio": "current_assets / current_liabilities",
    "cash_ratio": "(cash + short_term_investments) / current_liabilities", "operating_cash_flow_ratio": "cash_from_operations / current_liabilities",
    "gross_margin": "gross_profit / revenue", "operating_margin": "operating_income / revenue", "net_margin": "net_income / revenue", "da_margin": "depreciation / revenue",
    "effective_tax_rate": "abs(income_tax) / pretax_income", "ebitda_margin": "ebitda / revenue", "ebitda_margin_unadjusted": "(op_income + depreciation) / revenue",
    "ebitda_unadjusted_less_capex": "op_income + depreciation - abs(capex)", "ebitda_unadjusted": "op_income + depreciation",
    "roe": "net_income / ((shareholders_equity_old + shareholders_equity_new) / 2)", "roa": "net_income / ((total_assets_old + total_assets_new) / 2)", "roic": "nopat / invested_capital",
    "dividend_payout_ratio": "abs(dividends_paid) / net_income_attributable", "retention_ratio": "(net_income_attributable - abs(dividends_paid)) / net_income_attributable",
    "debt_to_equity": "total_debt / shareholders_equity", "debt_to_assets": "total_debt / total_assets", "debt_change_yoy": "total_borrowings_new - total_borrowings_old",
    "interest_coverage": "max(0, ebit) / abs(interest_expense)", "fixed_asset_turnover": "revenue / ((ppe_old + ppe_new) / 2)", "asset_turnover": "revenue / ((total_assets_old + total_assets_new) / 2)",
    "capital_intensity_ratio": "total_assets / revenue", "fixed_assets_to_total_assets": "ppe / total_assets",
    "cash_conversion_cycle": "365 * ((inv_old + inv_new) / 2) / abs(cogs) + 365 * ((ar_old + ar_new) / 2) / revenue - 365 * ((ap_old + ap_new) / 2) / (abs(cogs) + (inv_new - inv_old))",
    "inventory_turnover_avg": "abs(cogs) / ((inventory_old + inventory_new) / 2)", "inventory_turnover": "abs(cogs) / inventory", "receivables_turnover": "revenue / accounts_receivable",
    "dpo": "365 * ((ap_old + ap_new) / 2) / (abs(cogs) + (inv_new - inv_old))", "eps": "net_income / shares_outstanding", "free_cash_flow": "cash_from_operations - abs(capex)",
    "revenue_yoy": "(revenue_new - revenue_old) / revenue_old * 100", "net_income_yoy": "(net_income_new - net_income_old) / net_income_old * 100",
    "operating_income_yoy": "(operating_income_new - operating_income_old) / operating_income_old * 100", "cagr_generic": "(value_end / value_start) ** (1 / years) - 1",
    "cogs_ratio": "abs(cogs) / revenue", "capex_to_revenue": "abs(capex) / revenue", "days_sales_outstanding": "365 * accounts_receivable / revenue", "days_inventory_outstanding": "365 * inventory / abs(cogs)",
    "equity_multiplier": "total_assets / shareholders_equity", "liquidation_value_per_share": "tangible_book_value_per_share", "book_value_per_share": "shareholders_equity / shares_outstanding",
    "operating_expense_ratio": "abs(operating_expenses) / revenue", "rd_to_revenue": "abs(rd_expense) / revenue", "sga_to_revenue": "abs(sga) / revenue",
    "long_term_debt_to_capitalization": "long_term_debt / (long_term_debt + shareholders_equity)",
}
# The formulas that come out in percent.
PERCENT = frozenset("gross_margin operating_margin net_margin da_margin effective_tax_rate ebitda_margin ebitda_margin_unadjusted roic debt_to_assets fixed_assets_to_total_assets cagr_generic cogs_ratio capex_to_revenue operating_expense_ratio rd_to_revenue sga_to_revenue long_term_debt_to_capitalization".split())
# Variables that are made of others where no row states them.
DERIVED = {
    "op_income": "operating_income", "ebit": "operating_income", "ebitda": "operating_income + depreciation", "net_income_attributable": "net_income", "total_debt": "short_term_debt + long_term_debt",
    "total_borrowings": "short_term_debt + long_term_debt", "inv": "inventory", "ar": "accounts_receivable", "ap": "accounts_payable", "operating_expenses": "selling_expenses + sga + rd_expense",
    "nopat": "operating_income * (1 - abs(income_tax) / pretax_income)", "invested_capital": "short_term_debt + long_term_debt + shareholders_equity",
    "tangible_book_value_per_share": "(shareholders_equity - goodwill) / shares_outstanding", "value_start": "revenue_first", "value_end": "max(0, revenue)", "years": "revenue_span",
}


# Beside the variables and those of the year before: the first revenue stated, if it is above nothing, and the years since.
SPAN = ("revenue_first", "revenue_span")


class Formula(ast.NodeVisitor):
    """Compiles the arithmetic of a formula to SQL; anything else is refused. `divide` writes a division that yields null by zero."""

    def __init__(self, variable, divide):
        self.variable, self.divide = variable, divide

    def compile(self, text: str) -> str:
        return self.visit(ast.parse(text, mode="eval").body)

    def visit_BinOp(self, node: ast.BinOp) -> str:
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Div):
            return self.divide(a, b)
        if isinstance(node.op, ast.Pow):
            return f"power({a}, {b})"
        sign = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}.get(type(node.op))
        if sign is None:
            raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")
        return f"({a} {sign} {b})"

    def visit_UnaryOp(self, node: ast.UnaryOp) -> str:
        if not isinstance(node.op, ast.USub):
            raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")
        return f"(-{self.visit(node.operand)})"

    def visit_Call(self, node: ast.Call) -> str:
        name = {"abs": "abs", "min": "least", "max": "greatest"}.get(getattr(node.func, "id", ""))
        if name is None or node.keywords:
            raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")
        return f"{name}({', '.join(map(self.visit, node.args))})"

    def visit_Constant(self, node: ast.Constant) -> str:
        if isinstance(node.value, bool) or not isinstance(node.value, int | float):
            raise ValueError(f"not allowed in a formula: {node.value!r}")
        return f"CAST({node.value} AS DOUBLE)"

    def visit_Name(self, node: ast.Name) -> str:
        return self.variable(node.id)

    def generic_visit(self, node):
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")


def formula_sql(text: str, divide, percent: bool = False, columns: tuple[str, ...] = (*ALIASES, *SPAN)) -> str:
    """SQL of a formula over the columns of the wide table; unknown variables are refused."""

    def variable(name: str) -> str:
        if name in columns:
            return name
        stem, old = (name[:-4], True) if name.endswith("_old") else (name.removesuffix("_new"), False)
        if stem in columns:
            return f"{stem}_old" if old else stem
        if stem not in DERIVED:
            raise ValueError(f"unknown variable: {name}")
        part = Formula(variable_old if old else variable, divide).compile(DERIVED[stem])
        return f"({part})"

    def variable_old(name: str) -> str:
        return f"{name}_old" if name in columns else variable(f"{name}_old")

    sql = Formula(variable, divide).compile(text)
    return f"({sql}) * 100" if percent else sql


def row_facts(passages: DataFrame) -> DataFrame:
    """ord, company, section, item, year, val: every number a table row states for a year, from its structured cells."""
    rows = passages.where("type = 'table_row' AND raw_data IS NOT NULL").select("ord", "company", "section", F.from_json("raw_data", "map<string,string>").alias("cells"))
    rows = rows.withColumn("item", F.trim(F.try_element_at("cells", F.lit("line_item")))).where("item IS NOT NULL")
    cell = rows.select("ord", "company", "section", "item", F.explode("cells").alias("caption", "text"))
    return cell.select("ord", "company", "section", "item", T.year_label(F.col("caption")).alias("year"), T.number(F.col("text")).alias("val")).where("year IS NOT NULL AND val IS NOT NULL")


def canonical_item(item: Column) -> Column:
    """The variable a label names: exactly, else by the longest alias it contains as words; null if none or it is negated.

    Labels about changes, segments or deferred amounts don't name the item they contain.
    """
    low = F.regexp_replace(F.lower(F.trim(item)), r"\s+", " ")
    exact = F.create_map(*(F.lit(x) for name, aliases in ALIASES.items() for a in aliases for x in (a, name)))
    ordered = sorted(((a, name) for name, aliases in ALIASES.items() for a in aliases if len(a) > 5), key=lambda x: (-len(x[0]), x[0]))
    negated = low.rlike(r"^(change|changes) in |^non-|^deferred |^unearned |^adjusted |^segment ")
    inside = F.coalesce(*(F.when(F.contains(low, F.lit(a)), F.lit(name)) for a, name in ordered))
    return F.coalesce(F.try_element_at(exact, low), F.when(~negated, inside))


def best_facts(facts: DataFrame) -> DataFrame:
    """company, canonical, year, val, ord: per item and year the row that says it best.

    Exact `total` labels first, then the value most rows agree on, the shorter label, the greater size, the earlier row.
    """
    named = facts.withColumn("canonical", canonical_item(F.col("item"))).where("canonical IS NOT NULL AND company IS NOT NULL")
    same = F.count("*").over(W.partitionBy("company", "canonical", "year", "val"))
    named = named.withColumn("agree", same)
    order = W.partitionBy("company", "canonical", "year").orderBy(F.desc(F.lower("item").startswith("total").cast("int")), F.desc("agree"), F.length("item"), F.desc(F.abs("val")), "ord")
    return named.withColumn("n", F.row_number().over(order)).where("n = 1").select("company", "canonical", "year", "val", "ord")


def wide_facts(facts: DataFrame) -> DataFrame:
    """company, year and a column per variable, then each variable of the year before as <variable>_old (null unless it is the
    year before), and the first stated revenue with the years since."""
    wide = best_facts(facts).groupBy("company", "year").pivot("canonical", list(ALIASES)).agg(F.first("val"))
    by = W.partitionBy("company").orderBy("year")
    before = F.lag("year").over(by).cast("int") == F.col("year").cast("int") - 1
    since = by.rowsBetween(W.unboundedPreceding, 0)
    first = F.first("revenue", ignorenulls=True).over(since)
    span = F.col("year").cast("int") - F.min(F.when(F.col("revenue").isNotNull(), F.col("year"))).over(since).cast("int")
    old = [F.when(before, F.lag(v).over(by)).alias(f"{v}_old") for v in ALIASES]
    return wide.select("company", "year", *ALIASES, *old, F.when(first > 0, first).alias(SPAN[0]), span.cast("double").alias(SPAN[1]))


def evaluate(wide: DataFrame, key: str) -> DataFrame:
    """company, year, value of a formula wherever all its variables are there and nothing is divided by zero."""
    sql = formula_sql(FORMULAS[key], lambda a, b: f"try_divide({a}, {b})", key in PERCENT)
    return wide.select("company", "year", F.round(F.expr(sql), 4).alias("value")).where("value IS NOT NULL")


def evaluate_all(wide: DataFrame) -> DataFrame:
    """company, year, formula, value of all formulas in one pass over the wide table."""
    made = [F.struct(F.lit(k).alias("formula"), F.round(F.expr(formula_sql(e, lambda a, b: f"try_divide({a}, {b})", k in PERCENT)), 4).alias("value")) for k, e in FORMULAS.items()]
    return wide.select("company", "year", F.explode(F.array(*made)).alias("f")).select("company", "year", "f.formula", "f.value").where("value IS NOT NULL")


def growth_pairs(facts: DataFrame) -> DataFrame:
    """company, canonical, year, prior_year, change, growth: each item against its latest earlier year (an as-of join as a window)."""
    by = W.partitionBy("company", "canonical").orderBy("year")
    d = best_facts(facts).withColumn("prior", F.lag("val").over(by)).withColumn("prior_year", F.lag("year").over(by)).where("prior IS NOT NULL")
    return d.select("company", "canonical", "year", "prior_year", F.round(F.col("val") - F.col("prior"), 4).alias("change"), F.round(T.growth(F.col("prior"), F.col("val")), 4).alias("growth"))


def compound_growth(facts: DataFrame) -> DataFrame:
    """company, canonical, first_year, last_year, cagr over the years an item is stated for, 4 places."""
    g = best_facts(facts).groupBy("company", "canonical").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("val", "year").alias("a"), F.max_by("val", "year").alias("b"))
    n = F.col("last_year").cast("int") - F.col("first_year").cast("int")
    return g.where("first_year < last_year").select("company", "canonical", "first_year", "last_year", F.round(T.compound_growth(F.col("a"), F.col("b"), n.cast("double")), 4).alias("cagr"))


def period_average(wide: DataFrame, key: str) -> DataFrame:
    """company, years, value: the mean of a ratio over a company's years."""
    return evaluate(wide, key).groupBy("company").agg(F.count("*").alias("years"), F.round(F.avg("value"), 4).alias("value"))


def conflicting(facts: DataFrame) -> DataFrame:
    """company, canonical, year, values: items for which the rows of a year don't agree."""
    named = facts.withColumn("canonical", canonical_item(F.col("item"))).where("canonical IS NOT NULL AND company IS NOT NULL")
    return named.groupBy("company", "canonical", "year").agg(F.countDistinct("val").alias("values")).where("values > 1")
