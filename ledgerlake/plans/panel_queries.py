"""Queries of the monthly panel, with their SQL."""

from __future__ import annotations

from datetime import timedelta
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.columns import winsorised
from ledgerlake.operators import panel as P
from ledgerlake.plans.bindings import HORIZON, raw
from ledgerlake.plans.mapping_queries import mapped, mapped_ctes
from ledgerlake.sources.staging import staged

END = HORIZON.snapshot - timedelta(days=1)


def rounded(df: DataFrame, places: int = 2) -> DataFrame:
    """df with doubles rounded and without negative zeros."""
    return df.select(*((F.round(c, places).cast("double") + F.lit(0.0)).alias(c) if t == "double" or t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


class Domain:
    """The panel's tables over the test data, each built from the ones before it when it is first asked for.

    Transactions and invoices are each read once: what all others start from is staged, as is what several of them read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, partitions: int | None = None):
        """partitions: to how many for each split of the largest table the raw transactions and invoices are dealt first, if
        to any number of their own; so they grow with the tables, and no task gets more than a share of a split."""
        self.spark, self.sf_dir, self.partitions = spark, sf_dir, partitions
        self.banking, self.debt, self.companies = (raw(spark, sf_dir, f"raw_{x}") for x in ("banking_products", "debt_products", "companies"))

    def _dealt(self, name: str) -> DataFrame:
        df = mapped(self.spark, self.sf_dir, name)
        if not self.partitions:
            return df
        splits = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").rdd.getNumPartitions()
        return df.repartition(self.partitions * splits)

    @cached_property
    def moves(self) -> DataFrame:
        return staged(P.movements(self._dealt("transactions"), self.banking, self.companies), "movements")

    @cached_property
    def entries(self) -> DataFrame:
        return self.moves.where("bank")

    @cached_property
    def bills(self) -> DataFrame:
        return staged(P.bills(self._dealt("invoices")), "bills")

    @cached_property
    def rows(self) -> DataFrame:
        return staged(P.bank_ledger(self.entries), "bank-ledger")

    @cached_property
    def rates(self) -> DataFrame:
        return P.pair_rates(self.entries)

    @cached_property
    def anchors(self) -> DataFrame:
        return P.anchors(raw(self.spark, self.sf_dir, "raw_balances"), self.banking, self.companies, self.rates)

    @cached_property
    def levels(self) -> DataFrame:
        return P.daily_levels(self.rows, self.anchors, END)

    @cached_property
    def cash(self) -> DataFrame:
        return P.month_cash(self.levels)

    @cached_property
    def flows(self) -> DataFrame:
        return P.monthly_flows(self.rows, HORIZON)

    @cached_property
    def panel(self) -> DataFrame:
        return staged(P.monthly_panel(self.flows, self.cash), "month-panel")

    @cached_property
    def invoices(self) -> DataFrame:
        return P.issued_invoices(P.invoice_amounts(self.bills))

    @cached_property
    def receivables(self) -> DataFrame:
        return P.receivables(self.invoices, HORIZON)

    @cached_property
    def payables(self) -> DataFrame:
        return P.payables(self.invoices, HORIZON)

    @cached_property
    def full_panel(self) -> DataFrame:
        return staged(P.full_panel(self.panel, self.invoices, self.receivables, self.payables), "full-panel")

    def full(self) -> DataFrame:
        return self.full_panel


def pn01_winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("amount"))
    return winsorised(lines, "amount").withColumn("amount", F.round("amount", 4))


def _static(d: Domain) -> DataFrame:
    return P.company_static(d.companies, d.debt, d.invoices, d.rows, d.anchors, d.panel)


_QUERIES = {
    "pn05_pair_rates": lambda d: rounded(d.rates, 6), "pn07_anchors": lambda d: rounded(d.anchors), "pn08_daily_net": lambda d: rounded(d.rows.groupBy("company_id", "day").agg(F.sum("amount").alias("net"))),
    "pn09_daily_cash": lambda d: rounded(d.levels), "pn10_month_cash": lambda d: rounded(d.cash), "pn12_monthly_flows": lambda d: rounded(d.flows), "pn16_monthly_panel": lambda d: rounded(d.panel),
    "pn19_receivables": lambda d: rounded(d.receivables), "pn23_payables": lambda d: rounded(d.payables), "pn24_full_panel": lambda d: rounded(d.full()), "pn25_company_static": lambda d: rounded(_static(d)),
}
QUERIES = {"pn01_winsorised": pn01_winsorised} | {n: (lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))) for n, f in _QUERIES.items()}

_L, _F, _S = (f"DATE '{x}'" for x in (HORIZON.last, HORIZON.first, HORIZON.snapshot))
#: The panel's tables as common table expressions, by name: what they need, and their SQL.
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "bank0": (("transactions",), "SELECT t.company_id, CAST(date AS DATE) AS day, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN exchange_rate > 0 THEN amount / exchange_rate ELSE amount END AS a0, exchange_rate, category, b.currency AS pcur, c.currency AS ccur FROM transactions_mapped t JOIN raw_banking_products b ON t.product_id = b.product_id LEFT JOIN raw_companies c ON t.company_id = c.company_id"),
    "bank": (("bank0",), "SELECT *, CAST(round(least(greatest(a0, lo), hi), 4) AS DECIMAL(20, 4)) AS amount FROM bank0, (SELECT quantile_cont(a0, 0.001) AS lo, quantile_cont(a0, 0.999) AS hi FROM bank0) q"),
    "rates": (("bank0",), "SELECT pcur, ccur, median(exchange_rate) AS rate FROM bank0 WHERE pcur <> ccur AND exchange_rate > 0 GROUP BY pcur, ccur"),
    "anchors": (("rates", "balances"), "SELECT b.company_id, sum(CAST(round(CASE WHEN p.currency = c.currency THEN balance ELSE balance / rate END, 4) AS DECIMAL(20, 4))) AS anchor FROM raw_balances b JOIN raw_banking_products p ON b.product_id = p.product_id LEFT JOIN raw_companies c ON b.company_id = c.company_id LEFT JOIN rates r ON r.pcur = p.currency AND r.ccur = c.currency WHERE abs(balance) < 1e8 GROUP BY b.company_id HAVING sum(CAST(round(CASE WHEN p.currency = c.currency THEN balance ELSE balance / rate END, 4) AS DECIMAL(20, 4))) IS NOT NULL"),
    "nets": (("bank",), "SELECT company_id, day, sum(amount) AS net FROM bank GROUP BY company_id, day"),
    "levels": (("nets", "anchors"), f"SELECT d.company_id, d.day, a.anchor - s.total + sum(coalesce(n.net, 0)) OVER (PARTITION BY d.company_id ORDER BY d.day) AS level FROM (SELECT company_id, CAST(unnest(generate_series(min(day), greatest(max(day), DATE '{END}'), INTERVAL 1 DAY)) AS DATE) AS day FROM nets GROUP BY company_id) d JOIN anchors a ON a.company_id = d.company_id JOIN (SELECT company_id, sum(net) AS total FROM nets GROUP BY company_id) s ON s.company_id = d.company_id LEFT JOIN nets n ON n.company_id = d.company_id AND n.day = d.day"),
    "cash": (("levels",), f"SELECT company_id, CAST(date_trunc('month', day) AS DATE) AS month, arg_max(level, day) AS cash_end, min(level) AS cash_min, count(*) FILTER (WHERE level < 0) AS days_negative FROM levels WHERE day <= DATE '{END}' GROUP BY 1, 2"),
    "flows0": (("bank",), f"SELECT company_id, month, sum(amount) AS net_bank, coalesce(sum(amount) FILTER (WHERE amount > 0 AND coalesce(category NOT IN ('transfer', 'investment_deployment', 'investment_return', 'debt_repayment'), true)), 0) AS inflow_op, coalesce(-sum(amount) FILTER (WHERE amount < 0 AND coalesce(category NOT IN ('transfer', 'investment_deployment', 'investment_return', 'debt_repayment'), true)), 0) AS outflow_op, coalesce(-sum(amount) FILTER (WHERE category = 'debt_repayment'), 0) AS debt_service, coalesce(sum(amount) FILTER (WHERE category = 'transfer'), 0) AS transfer_net, coalesce(-sum(amount) FILTER (WHERE category = 'salary'), 0) AS out_salary, coalesce(-sum(amount) FILTER (WHERE category = 'social_security'), 0) AS out_social_security, coalesce(-sum(amount) FILTER (WHERE category = 'tax'), 0) AS out_tax, coalesce(-sum(amount) FILTER (WHERE category IN ('interest_charge', 'fee')), 0) AS out_fin_cost, count(*) AS n_tx FROM bank WHERE month <= {_L} GROUP BY company_id, month"),
    "flows": (("flows0",), f"SELECT g.company_id, g.month, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*P.MONEY, 'n_tx'))}, coalesce(inflow_op, 0) - coalesce(outflow_op, 0) AS net_op FROM (SELECT company_id, CAST(unnest(generate_series(min(month), {_L}, INTERVAL 1 MONTH)) AS DATE) AS month FROM flows0 GROUP BY company_id) g LEFT JOIN flows0 f ON f.company_id = g.company_id AND f.month = g.month"),
    "panel0": (("flows", "cash"), "SELECT f.*, cash_end, cash_min, days_negative, coalesce(min(cash_end) OVER (PARTITION BY f.company_id) < 0, false) AS inconsistent_balance, row_number() OVER (PARTITION BY f.company_id ORDER BY f.month) AS hist_months, " + ", ".join(f"CASE WHEN count(*) OVER w = 3 THEN sum({c}) OVER w END AS {c}_3m" for c in ("net_op", "inflow_op", "outflow_op", "debt_service")) + " FROM flows f LEFT JOIN cash c ON c.company_id = f.company_id AND c.month = f.month WINDOW w AS (PARTITION BY f.company_id ORDER BY f.month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "panel": (("panel0",), "SELECT *, CAST(net_op_3m AS DOUBLE) / nullif(inflow_op_3m + outflow_op_3m, 0) AS margin_3m, CAST(cash_end AS DOUBLE) / nullif(CAST(outflow_op_3m AS DOUBLE) / 3, 0) AS runway_m, CAST(debt_service_3m AS DOUBLE) / nullif(inflow_op_3m, 0) AS debt_service_ratio_3m, hist_months < 6 AS short_history FROM panel0"),
    "inv0": (("invoices",), "SELECT company_id, CAST(issuance_date AS DATE) AS issued, CAST(due_date AS DATE) AS due, CAST(payment_date AS DATE) AS paid_on, CASE WHEN exchange_rate > 0 THEN amount / exchange_rate ELSE amount END AS a0, status = 'paid' AS paid FROM invoices_mapped WHERE status <> 'cancelled' AND document_type IN ('invoice', 'invoiceGroup')"),
    "inv": (("inv0",), "SELECT *, CAST(round(least(greatest(a0, lo), hi), 4) AS DECIMAL(20, 4)) AS amount FROM inv0, (SELECT quantile_cont(a0, 0.001) AS lo, quantile_cont(a0, 0.999) AS hi FROM inv0) q"),
    "months": ((), f"SELECT CAST(unnest(generate_series({_F}, {_L}, INTERVAL 1 MONTH)) AS DATE) AS month"),
    "sales": (("inv",), "SELECT *, CAST(date_trunc('month', due) AS DATE) AS due_m, CAST(date_trunc('month', issued) AS DATE) AS iss_m, CASE WHEN paid THEN CAST(date_trunc('month', paid_on) AS DATE) END AS pay_m FROM inv WHERE amount > 0"),
    "owed0": (("sales", "months"), f"SELECT c.company_id, m.month, (SELECT coalesce(sum(amount), 0) FROM sales s WHERE s.company_id = c.company_id AND (due_m <= m.month OR due_m IS NULL OR (m.month >= {_F} AND due_m < {_F}))) - (SELECT coalesce(sum(amount), 0) FROM sales s WHERE s.company_id = c.company_id AND paid AND coalesce(CASE WHEN pay_m >= due_m THEN pay_m ELSE due_m END <= m.month, true)) AS stock, (SELECT coalesce(sum(amount), 0) FROM sales s WHERE s.company_id = c.company_id AND iss_m <= m.month AND iss_m > m.month - INTERVAL 3 MONTH AND iss_m >= {_F}) AS sales_3m, (SELECT avg(least(greatest(paid_on - issued, 0), 365)) FROM sales s WHERE s.company_id = c.company_id AND paid AND pay_m = m.month) AS dso_m FROM (SELECT DISTINCT company_id FROM sales) c, months m"),
    "owed": (("owed0",), "SELECT company_id, month, greatest(stock, 0) AS overdue_amt, sales_3m, CASE WHEN sales_3m <> 0 THEN least(greatest(greatest(stock, 0) / CAST(sales_3m AS DOUBLE), 0), 5) END AS pct_overdue, avg(dso_m) OVER (PARTITION BY company_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS dso FROM owed0"),
    "owing0": (("inv", "months"), "SELECT company_id, month, sum(-amount) AS payables_overdue90, coalesce(sum(-amount) FILTER (WHERE due > last_day(month) - 180), 0) AS payables_overdue90_recent FROM inv, months WHERE amount < 0 AND (NOT paid OR paid_on > last_day(month)) AND due <= last_day(month) - 90 GROUP BY company_id, month"),
    "owing": (("owing0",), f"SELECT g.company_id, g.month, coalesce(payables_overdue90, 0) AS payables_overdue90, coalesce(payables_overdue90_recent, 0) AS payables_overdue90_recent FROM (SELECT company_id, CAST(unnest(generate_series(min(month), {_L}, INTERVAL 1 MONTH)) AS DATE) AS month FROM owing0 GROUP BY company_id) g LEFT JOIN owing0 o ON o.company_id = g.company_id AND o.month = g.month"),
    "fullpanel": (("panel", "owed", "owing"), "SELECT p.*, i.company_id IS NOT NULL AS has_invoices, CASE WHEN i.company_id IS NOT NULL THEN overdue_amt END AS overdue_amt, CASE WHEN i.company_id IS NOT NULL THEN sales_3m END AS sales_3m, CASE WHEN i.company_id IS NOT NULL THEN pct_overdue END AS pct_overdue, CASE WHEN i.company_id IS NOT NULL THEN dso END AS dso, CASE WHEN i.company_id IS NOT NULL THEN coalesce(payables_overdue90, 0) END AS payables_overdue90, CASE WHEN i.company_id IS NOT NULL THEN coalesce(payables_overdue90_recent, 0) END AS payables_overdue90_recent FROM panel p LEFT JOIN (SELECT DISTINCT company_id FROM inv) i ON i.company_id = p.company_id LEFT JOIN owed o ON o.company_id = p.company_id AND o.month = p.month LEFT JOIN owing w ON w.company_id = p.company_id AND w.month = p.month"),
}
_MAPPED = {"transactions", "balances", "invoices", "companies"}


def panel_ctes(*names: str) -> str:
    """The named tables and all they need, as common table expressions."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for x in TABLES[n][0] if n in TABLES else ():
            add(x)
        order.append(n)

    reduce(lambda _, n: add(n), names, None)
    source = [n for n in order if n in _MAPPED] or ["companies"]
    return mapped_ctes(*dict.fromkeys([*source, "companies"])) + "".join(f",\n{n} AS ({TABLES[n][1]})" for n in order if n in TABLES)


def sql_rounded(table: str, doubles: list[str], others: list[str], places: int = 2, where: str = "") -> str:
    return f"{panel_ctes(table)}\nSELECT {', '.join([*others, *(f'CAST(round({c}, {places}) AS DOUBLE) + 0.0 AS {c}' for c in doubles)])} FROM {table} {where}"


def _static_ctes() -> str:
    """Those of the panel, invoices and anchors, and the raw debt products."""
    return panel_ctes("panel", "inv", "anchors")


_FLOW = [*P.MONEY, "net_op"]
_PANEL = [*_FLOW, "cash_end", "cash_min", "net_op_3m", "inflow_op_3m", "outflow_op_3m", "debt_service_3m", "margin_3m", "runway_m", "debt_service_ratio_3m"]
_OWN = ["company_id", "month"]
_FLAGS = [*_OWN, "n_tx", "days_negative", "inconsistent_balance", "hist_months", "short_history"]
ORACLE_SQL = {
    "pn01_winsorised": "SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS amount FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi FROM lineitem) q",
    "pn05_pair_rates": sql_rounded("rates", ["rate"], ["pcur", "ccur"], 6), "pn07_anchors": sql_rounded("anchors", ["anchor"], ["company_id"]), "pn08_daily_net": sql_rounded("nets", ["net"], ["company_id", "day"]),
    "pn09_daily_cash": sql_rounded("levels", ["level"], ["company_id", "day"], where=f"WHERE day <= DATE '{END}'"), "pn10_month_cash": sql_rounded("cash", ["cash_end", "cash_min"], [*_OWN, "days_negative"]),
    "pn12_monthly_flows": sql_rounded("flows", _FLOW, [*_OWN, "n_tx"]), "pn16_monthly_panel": sql_rounded("panel", _PANEL, _FLAGS),
    "pn19_receivables": sql_rounded("owed", ["overdue_amt", "sales_3m", "pct_overdue", "dso"], _OWN), "pn23_payables": sql_rounded("owing", ["payables_overdue90", "payables_overdue90_recent"], _OWN),
    "pn24_full_panel": sql_rounded("fullpanel", [*_PANEL, "overdue_amt", "sales_3m", "pct_overdue", "dso", "payables_overdue90", "payables_overdue90_recent"], [*_FLAGS, "has_invoices"]),
    "pn25_company_static": _static_ctes() + """
SELECT c.company_id, group_id, country, currency, erp, n_debt_products, round(debt_granted, 2) + 0.0 AS debt_granted, round(debt_outstanding, 2) + 0.0 AS debt_outstanding, CASE WHEN n_debt_products IS NOT NULL THEN round(least(greatest(debt_outstanding / debt_granted, 0), 1), 2) + 0.0 END AS debt_util,
  c.company_id IN (SELECT company_id FROM inv) AS has_invoices, c.company_id IN (SELECT company_id FROM bank WHERE category = 'debt_repayment') AS pays_bank_debt, c.company_id IN (SELECT company_id FROM anchors) AS has_balance,
  c.company_id IN (SELECT company_id FROM bank WHERE pcur <> ccur) AS mixed_currency, months_of_history, coalesce(inconsistent_balance, false) AS inconsistent_balance, n_debt_products IS NOT NULL AS has_debt_product, erp IS NOT NULL AS has_erp
FROM raw_companies c LEFT JOIN (SELECT company_id, count(*) AS n_debt_products, sum(abs(granted)) AS debt_granted, sum(abs(outstanding)) AS debt_outstanding FROM raw_debt_products WHERE abs(granted) > 0 GROUP BY company_id) d ON d.company_id = c.company_id
LEFT JOIN (SELECT company_id, count(*) AS months_of_history, bool_or(inconsistent_balance) AS inconsistent_balance FROM panel GROUP BY company_id) p ON p.company_id = c.company_id""",
}
