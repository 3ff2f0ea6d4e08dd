"""The client book: payment behaviour of each client, peak exposure, cover decisions and limits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.constants import INVOICE_TYPES
from ledgerlake.functions.columns import month_index, unit_hash, whole_text
from ledgerlake.operators.panel import exact

# What a decision and an offer depend on.
DECLINE_DELAY, MAX_DELAY, MIN_PAID, MIN_MONTHS = 60, 45, 8, 6
COVERS = (0.75, 0.80, 0.85, 0.90, 0.95)
PREMIUM_RATE, MIN_SALES, MIN_ROWS, TOP_CLIENTS = 0.0035, 1000, 12, 25


def base(invoices: DataFrame, snapshot: date) -> DataFrame:
    """Issued invoices to known clients, and whether they were collected by the snapshot."""
    day = {c: F.to_date(f"{c}_date") for c in ("issuance", "due", "payment")}
    rows = invoices.where((F.col("amount") > 0) & F.col("document_type").isin(*INVOICE_TYPES) & (F.col("status") != "cancelled") & F.col("counterparty_id").isNotNull())
    rows = rows.select("company_id", F.col("counterparty_id").alias("client"), exact("amount").alias("amount"), exact(F.abs("pending_amount")).alias("pending"), "status", *(c.alias(n) for n, c in day.items()))
    rows = rows.where(F.col("issuance") <= F.lit(snapshot))
    return rows.withColumn("collected", F.coalesce((F.col("payment") <= F.lit(snapshot)) & (F.col("status") == "paid"), F.lit(False)))


def behaviour(rows: DataFrame, snapshot: date, year_start: date) -> DataFrame:
    """Ten facts of each client of each company; relation months are month boundaries crossed."""
    open_, got, s = F.col("status") != "paid", F.col("collected"), F.lit(snapshot)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("pending"))), F.lit(0))
    return rows.groupBy("company_id", "client").agg(
        F.count(F.lit(1)).alias("n_invoices"), F.count_if(got).alias("n_collected"), F.coalesce(F.sum(F.when(F.col("issuance") >= F.lit(year_start), F.col("amount"))), F.lit(0)).alias("sales_12m"),
        total(open_).alias("exposure"), total(open_ & (F.col("due") < s)).alias("overdue"), total(open_ & (F.col("due") < F.date_sub(s, 90))).alias("overdue_90"),
        F.round(F.avg(F.when(got, F.datediff("payment", "due"))), 1).alias("mean_delay"), (100.0 * F.count_if(got & (F.col("payment") > F.col("due"))) / F.nullif(F.count_if(got), F.lit(0))).alias("late_pct"),
        (month_index(s) - month_index(F.min("issuance"))).cast("long").alias("relation_months"), F.max(F.when(got, F.col("payment"))).alias("last_collection"),
    )


def peaks(rows: DataFrame, year_start: date, snapshot: date) -> DataFrame:
    """Largest amount that was open at a month's start. Invoices change the open amount when they are issued and paid, so
    running sums over at most 13 months replace a join of invoices with months."""
    first = lambda d: F.when(d == F.trunc(d, "month"), d).otherwise(F.add_months(F.trunc(d, "month"), 1))
    r = rows.select("company_id", "client", "amount", F.greatest(first(F.col("issuance")), F.lit(year_start)).alias("s"), first(F.col("payment")).alias("e"))
    r = r.where(F.col("e").isNull() | (F.col("e") > F.col("s"))).where(F.col("s") <= F.lit(snapshot))
    moves = r.select("company_id", "client", F.col("s").alias("month"), "amount").unionByName(r.where(F.col("e") <= F.lit(snapshot)).select("company_id", "client", F.col("e").alias("month"), (-F.col("amount")).alias("amount")))
    by = moves.groupBy("company_id", "client", "month").agg(F.sum("amount").alias("change"))
    upto = Window.partitionBy("company_id", "client").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("open", F.sum("change").over(upto)).groupBy("company_id", "client").agg(F.max("open").alias("peak"))


def book(facts: DataFrame, peak: DataFrame) -> DataFrame:
    """Clients with sales: those from MIN_SALES on or among the first MIN_ROWS, and of these the first TOP_CLIENTS."""
    order = Window.partitionBy("company_id").orderBy(F.col("sales_12m").desc(), "client")
    out = facts.join(peak, ["company_id", "client"], "left").withColumn("peak", F.coalesce("peak", F.lit(0))).where("sales_12m > 0")
    out = out.withColumn("rank", F.row_number().over(order)).where((F.col("sales_12m") >= MIN_SALES) | (F.col("rank") <= MIN_ROWS))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_CLIENTS)


def stepped(v: Column) -> Column:
    """v rounded down to a multiple of a step that grows with it, and at least one step; 0 unless v is positive."""
    step = F.when(v < 5_000, 500).when(v < 50_000, 1000).when(v < 500_000, 5000).otherwise(25_000)
    return F.when(v > 0, F.greatest(F.floor(v / step) * step, step)).otherwise(0).cast("double")


def money_text(v: Column) -> Column:
    return F.concat(F.translate(whole_text(v), ",", "."), F.lit(" €"))


def offers(book_rows: DataFrame) -> DataFrame:
    """The decision, file, cover, limit and premium of each client of the book; hashes make them the same on each run."""
    delay, peak, sales = F.col("mean_delay"), F.col("peak").cast("double"), F.col("sales_12m").cast("double")
    missing = F.filter(F.array(F.when(F.col("n_collected") < MIN_PAID, "collected"), F.when(F.col("relation_months") < MIN_MONTHS, "relation"), F.when(delay > MAX_DELAY, "delay")), lambda x: x.isNotNull())
    first = stepped(peak)
    state = F.when((F.col("overdue_90") > 0) | F.coalesce(delay > DECLINE_DELAY, F.lit(False)), "declined").when((F.size(missing) > 0) | (first <= 0), "study").otherwise("preapproved")
    complete = F.conv(F.substring(F.sha1(F.concat_ws(":", "company_id", "client").cast("binary")), 1, 2), 16, 10).cast("int") % 2 == 0
    tier = F.floor(unit_hash(F.col("company_id"), F.col("client"), F.lit("cover")) * len(COVERS)) + F.when((delay <= 0) & (F.col("overdue_90") == 0), 1).otherwise(0)
    cover = F.element_at(F.array(*map(F.lit, COVERS)), (F.least(tier, F.lit(len(COVERS) - 1)) + 1).cast("int"))
    drawn = stepped(first * (0.8 + 0.5 * unit_hash(F.col("company_id"), F.col("client"), F.lit("limit"))))
    limit = F.when((state == "study") & complete & (drawn <= 0), stepped(F.greatest(peak, sales / 6, F.lit(500.0)))).otherwise(drawn)
    reason = F.when(F.col("overdue_90") > 0, F.concat(money_text(F.col("overdue_90")), F.lit(" overdue by more than 90 days"))).when(state == "declined", "pays too late").when(state == "study", F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise("clean record")
    return book_rows.select("company_id", "client", "rank", state.alias("state"), F.when(complete, "complete").otherwise("incomplete").alias("file"), cover.alias("cover"), limit.alias("credit_limit"), F.round(sales * cover * PREMIUM_RATE, 2).alias("premium"), reason.alias("reason"))


def surety(debt: DataFrame) -> DataFrame:
    return debt.where("type = 'guarantee'").groupBy("company_id").agg(F.count(F.lit(1)).alias("products"), F.sum(exact(F.abs(F.coalesce("granted", "outstanding")))).alias("line"), F.sum(exact(F.abs("outstanding"))).alias("bonded"))


def companies_book(offer_rows: DataFrame, book_rows: DataFrame, bonds: DataFrame) -> DataFrame:
    """One row per company with clients or a surety line: sales, clients by state, the line."""
    totals = book_rows.groupBy("company_id").agg(F.sum("sales_12m").alias("sales_12m"))
    states = offer_rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("clients"), *(F.count_if(F.col("state") == s).alias(s) for s in ("declined", "study", "preapproved")))
    return totals.join(states, "company_id").join(bonds, "company_id", "full")
