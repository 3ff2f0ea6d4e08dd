"""Daily cash forecast: known invoices and habitual payments on top of the last cash, shortfalls and surpluses."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import month_of
from ledgerlake.operators.panel import exact

#: Months of cushion, least surplus, latest habitual pay day.
CUSHION_MONTHS, MIN_SURPLUS, LAST_DAY = 1, 25_000.0, 28
RECURRING = {"salary": "salaries", "social_security": "social_security", "debt_repayment": "debt"}


@dataclass(frozen=True)
class Window3:
    """The days that are forecast, after the snapshot, and the first of the months that habits are read from."""

    snapshot: date
    start: date
    end: date
    habits_from: date


def pay_days(moves: DataFrame, w: Window3) -> DataFrame:
    """(company_id, category, pay_day) of movements(): the day of the month with the largest total, the earliest of equal ones."""
    rows = moves.where(F.col("category").isin(*RECURRING) & (F.col("day") >= F.lit(w.habits_from)))
    by_day = rows.groupBy("company_id", "category", F.dayofmonth("day").alias("day")).agg(F.abs(F.sum(exact("booked"))).alias("total"))
    best = F.max_by("day", F.struct("total", -F.col("day")))
    return by_day.groupBy("company_id", "category").agg(F.least(best, F.lit(LAST_DAY)).alias("pay_day"))


def medians(panel: DataFrame, w: Window3) -> DataFrame:
    """Of the last six months: salaries, social security, debt service and all spending."""
    return panel.where(F.col("month") >= F.lit(w.habits_from)).groupBy("company_id").agg(
        F.median("out_salary").alias("salary"), F.median("out_social_security").alias("social_security"), F.median("debt_service").alias("debt_repayment"), F.median(F.col("outflow_op") + F.col("debt_service")).alias("spend")
    )


def open_invoices(rows: DataFrame, companies: DataFrame, w: Window3) -> DataFrame:
    """Unpaid ones of bills() that fall due in the window, in the company's own currency: day, signed amount, kind,
    counterparty."""
    rows = rows.where(~F.col("paid") & (F.abs("pending_amount") > 0) & (F.col("issued") <= F.lit(w.snapshot)) & F.col("due").between(F.lit(w.start), F.lit(w.end)))
    rows = rows.join(companies.select("company_id", F.col("currency").alias("own")), "company_id").where("currency = own")
    ours = F.col("booked") > 0
    return rows.select("company_id", F.col("due").alias("day"), exact(F.when(ours, F.abs("pending_amount")).otherwise(-F.abs("pending_amount"))).alias("amount"), F.when(ours, "receipts").otherwise("suppliers").alias("kind"), "counterparty_id")


def cash_events(invoices: DataFrame, habits: DataFrame, days: DataFrame, w: Window3) -> DataFrame:
    """Open invoices and habitual payments, one of each kind a month on its pay day."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind"), F.col(c).alias("amount")) for c, k in RECURRING.items()))).alias("x")
    usual = habits.select("company_id", each).select("company_id", "x.*").where("amount > 0").join(days, ["company_id", "category"], "left")
    month = F.explode(F.sequence(F.trunc(F.lit(w.start), "month"), F.trunc(F.lit(w.end), "month"), F.expr("interval 1 month"))).alias("month")
    usual = usual.select("*", month).select("company_id", F.date_add("month", F.coalesce("pay_day", F.lit(LAST_DAY)) - 1).alias("day"), exact(-F.col("amount")).alias("amount"), "kind", F.lit(None).cast("string").alias("counterparty_id"))
    return invoices.unionByName(usual)


def openings(panel: DataFrame, last: date) -> DataFrame:
    """(company_id, cash) of the last month where it is known, consistent and positive."""
    return panel.where((F.col("month") == F.lit(last)) & ~F.col("inconsistent_balance") & (F.col("cash_end") > 0)).select("company_id", exact("cash_end").alias("cash"))


def monthly(events: DataFrame, opening: DataFrame) -> DataFrame:
    kinds = ("receipts", "suppliers", "salaries", "social_security", "debt")
    return events.join(opening.select("company_id"), "company_id", "left_semi").groupBy("company_id", month_of("day").alias("month")).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).alias(k) for k in kinds))


def daily_path(events: DataFrame, opening: DataFrame, w: Window3) -> DataFrame:
    """(company_id, day, level) of every day of the window; events outside it don't count."""
    net = events.groupBy("company_id", "day").agg(F.sum("amount").alias("net"))
    days = opening.select("company_id", "cash", F.explode(F.sequence(F.lit(w.start), F.lit(w.end))).alias("day"))
    upto = Window.partitionBy("company_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(net, ["company_id", "day"], "left").select("company_id", "day", "cash", (F.col("cash") + F.sum(F.coalesce("net", F.lit(0))).over(upto)).alias("level"))


def forecast(path: DataFrame, events: DataFrame, habits: DataFrame) -> DataFrame:
    """One row per company: cash, lowest level and day, the first shortfall with what led to it and what ends it, surplus.

    With a shortfall, the low is that of its first streak, even if a later one is deeper. A surplus is what stays above a
    cushion of spending on the lowest day, without any shortfall and from MIN_SURPLUS on.
    """
    company = Window.partitionBy("company_id")
    marked = path.withColumn("first", F.min(F.when(F.col("level") < 0, F.col("day"))).over(company))
    marked = marked.withColumn("back", F.min(F.when((F.col("day") > F.col("first")) & (F.col("level") >= 0), F.col("day"))).over(company))
    streak = F.col("first").isNull() | ((F.col("day") >= F.col("first")) & (F.col("back").isNull() | (F.col("day") < F.col("back"))))
    low = F.min(F.when(streak, F.struct("level", "day")))
    per = marked.groupBy("company_id").agg(F.first("cash").alias("cash"), F.first("first").alias("break_from"), F.first("back").alias("back"), low.alias("low"))
    met = events.join(per.where("break_from is not null").select("company_id", "break_from", "back"), "company_id")
    before, rescue = (F.col("day") <= F.col("break_from")) & (F.col("amount") < 0), (F.col("day") == F.col("back")) & (F.col("kind") == "receipts")
    around = met.groupBy("company_id").agg(
        F.coalesce(-F.sum(F.when(before, F.col("amount"))), F.lit(0)).alias("paid_before"), F.count_if(before).alias("n_paid_before"),
        F.max(F.when(rescue, F.struct("amount", "counterparty_id"))).alias("rescue"), F.sum(F.when(rescue, F.col("amount"))).alias("rescue_day_total"),
    )
    out = per.join(around, "company_id", "left").join(habits.select("company_id", F.coalesce("spend", F.lit(0.0)).alias("spend")), "company_id", "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))
    cushion = CUSHION_MONTHS * F.col("spend").cast("double")
    surplus = F.col("low.level").cast("double") - cushion
    return out.select(
        "company_id", "cash", F.col("low.level").alias("low"), F.col("low.day").alias("low_date"), "break_from", F.date_sub("back", 1).alias("break_to"), "paid_before", "n_paid_before",
        F.when(F.col("rescue").isNotNull(), F.col("back")).alias("rescue_date"), F.col("rescue.amount").alias("rescue_amount"), F.col("rescue.counterparty_id").alias("rescue_counterparty"), "rescue_day_total",
        F.when(F.col("break_from").isNull() & (F.col("spend") > 0) & (surplus >= MIN_SURPLUS), surplus).alias("surplus"), F.col("spend").cast("double").alias("monthly_spend"),
    )


def category_breakdown(ledger: DataFrame, since: date, until: date) -> DataFrame:
    """(company_id, month, category, amount) of the ledger of bank accounts, whose amounts are winsorised over all dates."""
    rows = ledger.where((F.col("month") >= F.lit(since)) & (F.col("month") < F.lit(until)))
    name = F.coalesce(F.nullif("category", F.lit("uncategorized")), F.lit("no_category"))
    return rows.groupBy("company_id", "month", name.alias("category")).agg(F.sum("amount").alias("amount")).where(F.abs("amount") >= 0.005)


def nested_categories(breakdown: DataFrame) -> DataFrame:
    """(company_id, categories): month to category to amount, as nested maps."""
    by_month = breakdown.groupBy("company_id", F.date_format("month", "yyyy-MM").alias("month")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.round("amount", 2).cast("double"))))).alias("amounts"))
    return by_month.groupBy("company_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", F.map_entries("amounts").alias("e"))))).alias("m")).select("company_id", F.transform_values("m", lambda _, e: F.map_from_entries(e)).alias("categories"))


def check_cases(found: DataFrame, short: tuple[str, ...] = (), surplus: tuple[str, ...] = ()) -> None:
    """Raises if one of the companies that are shown as cases no longer has its shortfall, or its surplus."""
    named = found.where(F.col("company_id").isin(*short, *surplus)).select("company_id", F.col("break_from").isNotNull().alias("b"), F.col("surplus").isNotNull().alias("s")).collect()
    have = {r["company_id"]: r for r in named}
    lost = [c for c in short if c not in have or not have[c]["b"]] + [c for c in surplus if c not in have or not have[c]["s"]]
    if lost:
        raise ValueError(f"no longer cases: {', '.join(lost)}")
