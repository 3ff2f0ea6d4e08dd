"""Cash history by account and company, month by month, kept as tables that late transactions change only where they must.

What is stored by month is small (an account and month have a row), and the transactions themselves aren't read again. A
month's closing cash is the known balance less all that moved later, so a late transaction changes the closing cash of the
months before its own, and the spending of its own month and the two that follow; nothing else is written.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.constants import AMOUNT_SENTINEL, UNITS_PER_EUR
from ledgerlake.functions.columns import safe_div, units_per_eur
from ledgerlake.operators.checks import account_anchors, diagnosis
from ledgerlake.operators.panel import exact
from ledgerlake.sources.versions import Manifest, VersionedTable

#: Months whose spending a month's coverage looks at.
SPENDING = 3
MONTHLY = ("nets", "panel_product", "panel_company", "cash_metrics")
TABLES = (*MONTHLY, "cash_product", "tx_flags", "sentinel_tx", "company_flags", "cash_summary", "fx_gap")


def is_sentinel(amount: Column) -> Column:
    return F.coalesce(F.abs(amount) >= F.lit(AMOUNT_SENTINEL), F.lit(False))


def cash_product(balances: DataFrame, banking: DataFrame) -> DataFrame:
    """(product_id, company_id, currency, anchor, is_artifact, has_rate) of accounts with a known balance."""
    known = account_anchors(balances).join(banking.select("product_id", "currency"), "product_id")
    return known.select("product_id", "company_id", "currency", "anchor", "is_artifact", F.coalesce(F.upper(F.trim("currency")).isin(*UNITS_PER_EUR), F.lit(False)).alias("has_rate"))


def flags(tx: DataFrame) -> DataFrame:
    """(company_id, movements, sentinels) of transactions."""
    return tx.groupBy("company_id").agg(F.count(F.lit(1)).alias("movements"), F.count_if(is_sentinel(F.col("amount"))).alias("sentinels"))


def nets(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """(product_id, month, net, spent) of accounts' transactions; sentinels don't count."""
    rows = tx.where(~is_sentinel(F.col("amount"))).join(accounts.where("NOT is_artifact").select("product_id"), "product_id", "left_semi")
    amount = exact("amount")
    return rows.groupBy("product_id", F.trunc("date", "month").alias("month")).agg(F.sum(amount).alias("net"), F.coalesce(F.sum(F.when(amount < 0, -amount)), F.lit(0)).cast("decimal(30,4)").alias("spent"))


def panel_product(moved: DataFrame, accounts: DataFrame, last: date) -> DataFrame:
    """(company_id, product_id, month, cash, cash_eur, spent_eur): every month from an account's first movement to last."""
    span = moved.groupBy("product_id").agg(F.min("month").alias("a"), F.max("month").alias("z")).where(F.col("a") <= F.lit(last))
    grid = span.select("product_id", F.explode(F.sequence("a", F.greatest("z", F.lit(last)), F.expr("interval 1 month"))).alias("month"))
    after = Window.partitionBy("product_id").orderBy(F.col("month").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = grid.join(moved, ["product_id", "month"], "left").withColumn("later", F.coalesce(F.sum("net").over(after), F.lit(0))).where(F.col("month") <= F.lit(last))
    rows = rows.join(accounts, "product_id")
    cash = F.col("anchor") - F.col("later")
    euro = lambda c: F.when(F.col("has_rate"), exact(c.cast("double") / units_per_eur(F.col("currency"))))
    return rows.select("company_id", "product_id", "month", cash.alias("cash"), euro(cash).alias("cash_eur"), euro(F.coalesce("spent", F.lit(0))).alias("spent_eur"))


def panel_company(products: DataFrame) -> DataFrame:
    """(company_id, month, cash_eur, spent_eur): accounts without a rate don't count."""
    return products.where("cash_eur IS NOT NULL").groupBy("company_id", "month").agg(F.sum("cash_eur").alias("cash_eur"), F.sum("spent_eur").alias("spent_eur"))


def cash_metrics(panel: DataFrame) -> DataFrame:
    """(company_id, month, cash_eur, coverage): months for which the cash lasts, by the mean spending of SPENDING months; null
    before there are so many."""
    w = Window.partitionBy("company_id").orderBy("month").rowsBetween(-(SPENDING - 1), 0)
    spent = F.when(F.count(F.lit(1)).over(w) == SPENDING, F.sum("spent_eur").over(w)).cast("double") / SPENDING
    return panel.select("company_id", "month", "cash_eur", safe_div(F.col("cash_eur"), spent).alias("coverage"))


def company_flags(counted: DataFrame, accounts: DataFrame) -> DataFrame:
    """(company_id, is_reliable): neither a sentinel movement nor a sentinel account."""
    bad = accounts.groupBy("company_id").agg(F.count_if("is_artifact").alias("artifacts"))
    return counted.join(bad, "company_id", "full").select("company_id", ((F.coalesce("sentinels", F.lit(0)) == 0) & (F.coalesce("artifacts", F.lit(0)) == 0)).alias("is_reliable"))


def cash_summary(metrics: DataFrame, products: DataFrame, accounts: DataFrame) -> DataFrame:
    """(company_id, month, cash_eur, coverage, diagnosis, has_drift) of each company's last month. Drift: an account whose
    known balance isn't negative, but some month before it is."""
    drift = products.join(accounts.select("product_id", "anchor"), "product_id").groupBy("company_id").agg(F.max((F.col("anchor") >= 0) & (F.col("cash") < 0)).alias("has_drift"))
    last = metrics.groupBy("company_id").agg(F.max_by(F.struct("month", "cash_eur", "coverage"), "month").alias("x")).select("company_id", "x.*")
    return last.join(drift, "company_id", "left").select("company_id", "month", "cash_eur", "coverage", diagnosis(F.col("coverage")).alias("diagnosis"), F.coalesce("has_drift", F.lit(False)).alias("has_drift"))


def fx_gap(accounts: DataFrame) -> DataFrame:
    """(currency, n_products) without a rate."""
    return accounts.where("NOT has_rate").groupBy("currency").agg(F.count(F.lit(1)).alias("n_products"))


class CashHistory:
    """The tables under a folder: build() makes them from all transactions, add() takes late ones in."""

    def __init__(self, spark: SparkSession, root: str, last: date):
        self.spark, self.last = spark, last
        self.tables = {n: VersionedTable(spark, f"{root}/{n}") for n in TABLES}

    def table(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _put(self, name: str, df: DataFrame, replaces: set[str] | None = None) -> Manifest:
        return self.tables[name].publish(df, F.col("month") if name in MONTHLY else None, replaces=replaces)

    def build(self, tx: DataFrame, balances: DataFrame, banking: DataFrame) -> None:
        self._put("cash_product", cash_product(balances, banking))
        accounts = self.table("cash_product")
        self._put("tx_flags", flags(tx))
        self._put("nets", nets(tx, accounts))
        self._put("panel_product", panel_product(self.table("nets"), accounts, self.last))
        self._put("panel_company", panel_company(self.table("panel_product")))
        self._put("cash_metrics", cash_metrics(self.table("panel_company")))
        self._put("fx_gap", fx_gap(accounts))
        self._rest()

    def _rest(self) -> None:
        """Tables of a row a company."""
        counted, accounts = self.table("tx_flags"), self.table("cash_product")
        self._put("sentinel_tx", counted.where("sentinels > 0").select("company_id", "sentinels"))
        self._put("company_flags", company_flags(counted, accounts))
        self._put("cash_summary", cash_summary(self.table("cash_metrics"), self.table("panel_product"), accounts))

    def add(self, late: DataFrame) -> dict[str, int]:
        """Takes late transactions in, once each; returns how many months of each table were written."""
        accounts = self.table("cash_product")
        counted = self.table("tx_flags").unionByName(flags(late)).groupBy("company_id").agg(F.sum("movements").alias("movements"), F.sum("sentinels").alias("sentinels"))
        self._put("tx_flags", counted)
        new = nets(late, accounts)
        changed = sorted(str(r[0]) for r in new.select("month").distinct().collect())
        written = dict.fromkeys(MONTHLY, 0)
        if changed:
            old = self.table("nets")
            both = old.where(F.col("month").cast("string").isin(changed)).unionByName(new)
            self._put("nets", both.groupBy("product_id", "month").agg(F.sum("net").cast("decimal(30,4)").alias("net"), F.sum("spent").cast("decimal(30,4)").alias("spent")), set(changed))
            months = {str(r[0]) for r in self.spark.createDataFrame([(changed[0], self.last)], "a string, z date").selectExpr("explode(sequence(CAST(a AS DATE), z, interval 1 month))").collect()} | {n.partition("=")[2] for n in self.tables["panel_product"].manifest().folders}
            spending = {str(r[0]) for r in self.spark.createDataFrame([(c,) for c in changed], "c string").selectExpr(f"explode(transform(sequence(0, {SPENDING - 1}), k -> add_months(CAST(c AS DATE), k)))").collect()}
            touched = {m for m in months if m < changed[-1] or m in changed}
            covered = touched | (spending & months)
            self._put("panel_product", panel_product(self.table("nets"), accounts, self.last).where(F.col("month").cast("string").isin(*touched)), touched)
            self._put("panel_company", panel_company(self.tables["panel_product"].read(parts=touched)), touched)
            self._put("cash_metrics", cash_metrics(self.table("panel_company")).where(F.col("month").cast("string").isin(*covered)), covered)
            written |= {"panel_product": len(touched), "panel_company": len(touched), "cash_metrics": len(covered)}
            written["nets"] = len(changed)
        self._rest()
        return written
