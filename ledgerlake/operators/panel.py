"""The monthly panel: daily cash rebuilt backwards from a known balance, flows, receivables and payables by month.

Every table is keyed by company and month (first day). Companies never meet in a loop: grids are sequences that are
exploded, running values are windows over rows that are already one a day or a month.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import constants as K
from ledgerlake.functions.columns import clip, month_of, quantiles_by, rolling, safe_div, winsorised

MONEY = ("net_bank", "inflow_op", "outflow_op", "debt_service", "transfer_net", "out_salary", "out_social_security", "out_tax", "out_fin_cost")


#: Money that is summed: exact, so that sums don't depend on their order.
EXACT, SUMMED = "decimal(20,4)", "decimal(28,4)"


def exact(c: Column | str) -> Column:
    return F.round(c, 4).cast(EXACT)


def converted(amount: str, rate: str) -> Column:
    """In the company's currency, where a positive rate is known."""
    return F.when(F.col(rate) > 0, F.col(amount) / F.col(rate)).otherwise(F.col(amount))


def currencies(df: DataFrame, banking: DataFrame, companies: DataFrame) -> DataFrame:
    """df's rows of banking products, with the currencies of product and company (pcur, ccur)."""
    product = banking.select("product_id", F.col("currency").alias("pcur"))
    return df.join(product, "product_id").join(companies.select("company_id", F.col("currency").alias("ccur")), "company_id", "left")


def movements(tx: DataFrame, banking: DataFrame, companies: DataFrame) -> DataFrame:
    """Transactions, one row each: amount as booked and in the company's currency, day, month, whether operating, and bank:
    whether of a banking product. All that reads transactions starts from here."""
    product = banking.select("product_id", F.col("currency").alias("pcur"), F.lit(True).alias("of_bank"))
    rows = tx.select("company_id", "product_id", "date", F.col("amount").alias("booked"), "exchange_rate", "category").join(product, "product_id", "left").join(companies.select("company_id", F.col("currency").alias("ccur")), "company_id", "left")
    operating = F.coalesce(~F.col("category").isin(*K.NON_OPERATING), F.lit(True))
    return rows.select("company_id", F.to_date("date").alias("day"), month_of("date").alias("month"), "booked", converted("booked", "exchange_rate").alias("amount"), "exchange_rate", "category", operating.alias("op"), "pcur", "ccur", F.coalesce("of_bank", F.lit(False)).alias("bank"))


def bank_ledger(entries: DataFrame) -> DataFrame:
    """Entries winsorised and summed by company, day, category, sign and whether currencies differ: amount, n_tx.

    It is what all tables of the panel read, and as small as days and categories are, however many transactions there are.
    """
    rows = winsorised(entries, "amount").withColumn("amount", exact("amount"))
    foreign = F.coalesce(F.col("pcur") != F.col("ccur"), F.lit(False))
    keys = ("company_id", "day", "month", "category", "op", foreign.alias("foreign"), F.signum("amount").alias("sign"))
    return rows.groupBy(*keys).agg(F.sum("amount").cast(SUMMED).alias("amount"), F.count(F.lit(1)).alias("n_tx")).drop("sign")


def pair_rates(entries: DataFrame) -> DataFrame:
    """Median rate of each pair of different currencies."""
    return quantiles_by(entries.where("pcur <> ccur and exchange_rate > 0"), ["pcur", "ccur"], "exchange_rate", {"rate": 0.5})


def anchors(balances: DataFrame, banking: DataFrame, companies: DataFrame, rates: DataFrame) -> DataFrame:
    """The known balance of each company, in its currency: sentinels don't count, unknown rates neither."""
    rows = currencies(balances.where(F.abs("balance") < K.AMOUNT_SENTINEL).select("company_id", "product_id", "balance"), banking, companies)
    rows = rows.join(F.broadcast(rates), ["pcur", "ccur"], "left")
    own = F.when(F.col("pcur") == F.col("ccur"), F.col("balance")).otherwise(F.col("balance") / F.col("rate"))
    return rows.groupBy("company_id").agg(F.sum(exact(own)).alias("anchor")).where("anchor is not null")


def daily_levels(rows: DataFrame, anchor: DataFrame, end: date) -> DataFrame:
    """(company_id, day, level): the balance at the end of each day from the first transaction to ``end``.

    level = anchor - all net flow + net flow up to the day; flow after ``end`` counts. Companies without an anchor have no days.
    """
    net = rows.groupBy("company_id", "day").agg(F.sum("amount").alias("net"))
    span = net.groupBy("company_id").agg(F.min("day").alias("a"), F.max("day").alias("z"), F.sum("net").alias("total")).join(anchor, "company_id")
    days = span.select("company_id", "anchor", "total", F.explode(F.sequence("a", F.greatest("z", F.lit(end)))).alias("day"))
    upto = Window.partitionBy("company_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("anchor") - (F.col("total") - F.sum(F.coalesce("net", F.lit(0))).over(upto))
    return days.join(net, ["company_id", "day"], "left").select("company_id", "day", level.alias("level")).where(F.col("day") <= F.lit(end))


def month_cash(levels: DataFrame) -> DataFrame:
    return levels.groupBy("company_id", month_of("day").alias("month")).agg(
        F.max_by("level", "day").alias("cash_end"), F.min("level").alias("cash_min"), F.count_if(F.col("level") < 0).alias("days_negative")
    )


def month_grid(first: DataFrame, last: date) -> DataFrame:
    """(company_id, month) from each company's ``first`` month to ``last``."""
    return first.select("company_id", F.explode(F.sequence("first", F.lit(last), F.expr("interval 1 month"))).alias("month"))


def monthly_flows(rows: DataFrame, horizon: K.Horizon) -> DataFrame:
    """Flows by month from each company's first month on, months without transactions as zeros."""
    when = lambda cond, sign=1: F.coalesce(F.sum(F.when(cond, sign * F.col("amount"))), F.lit(0))
    amount, category = F.col("amount"), F.col("category")
    flows = rows.where(F.col("month") <= F.lit(horizon.last)).groupBy("company_id", "month").agg(
        F.sum("amount").alias("net_bank"), when((amount > 0) & F.col("op")).alias("inflow_op"), when((amount < 0) & F.col("op"), -1).alias("outflow_op"),
        when(category == "debt_repayment", -1).alias("debt_service"), when(category == "transfer").alias("transfer_net"), when(category == "salary", -1).alias("out_salary"),
        when(category == "social_security", -1).alias("out_social_security"), when(category == "tax", -1).alias("out_tax"), when(category.isin("interest_charge", "fee"), -1).alias("out_fin_cost"),
        F.sum("n_tx").alias("n_tx"),
    )
    grid = month_grid(flows.groupBy("company_id").agg(F.min("month").alias("first")), horizon.last)
    return grid.join(flows, ["company_id", "month"], "left").fillna(0, [*MONEY, "n_tx"]).withColumn("net_op", F.col("inflow_op") - F.col("outflow_op"))


def monthly_panel(flows: DataFrame, cash: DataFrame) -> DataFrame:
    """Flows and cash with sums of three months, ratios, length of history and the flag of companies whose cash is ever negative."""
    company = Window.partitionBy("company_id")
    w = company.orderBy("month")
    out = flows.join(cash, ["company_id", "month"], "left").withColumn("inconsistent_balance", F.coalesce(F.min("cash_end").over(company) < 0, F.lit(False)))
    out = out.withColumns({f"{c}_3m": rolling(F.sum, c, w, 3) for c in ("net_op", "inflow_op", "outflow_op", "debt_service")})
    out = out.withColumns({
        "margin_3m": safe_div(F.col("net_op_3m"), F.col("inflow_op_3m") + F.col("outflow_op_3m")), "runway_m": safe_div(F.col("cash_end"), F.col("outflow_op_3m") / 3),
        "debt_service_ratio_3m": safe_div(F.col("debt_service_3m"), F.col("inflow_op_3m")), "hist_months": F.row_number().over(w).cast("long"),
    })
    return out.withColumn("short_history", F.col("hist_months") < K.MIN_HISTORY)


def bills(invoices: DataFrame) -> DataFrame:
    """Invoices that count, not cancelled ones, one row each: amounts as booked and in the company's currency. All that
    reads these invoices starts from here."""
    rows = invoices.where((F.col("status") != "cancelled") & F.col("document_type").isin(*K.INVOICE_TYPES))
    return rows.select("company_id", F.to_date("issuance_date").alias("issued"), F.to_date("due_date").alias("due"), F.to_date("payment_date").alias("paid_on"), F.col("amount").alias("booked"), "pending_amount", "currency", "counterparty_id", converted("amount", "exchange_rate").alias("amount"), (F.col("status") == "paid").alias("paid"))


def invoice_amounts(rows: DataFrame) -> DataFrame:
    return rows.select("company_id", "issued", "due", "paid_on", "amount", "paid")


def issued_invoices(rows: DataFrame) -> DataFrame:
    """Rows of invoice_amounts(), winsorised over all of them."""
    return winsorised(rows, "amount").withColumn("amount", exact("amount"))


def receivables(invoices: DataFrame, horizon: K.Horizon) -> DataFrame:
    """By company with sales and month: overdue stock, sales of three months, their ratio, days of sales outstanding.

    What fell due before the first month counts in it. Only paid invoices leave the overdue stock, in the later of the
    months they fell due and were paid.
    """
    first = F.lit(horizon.first)
    clamped = lambda m: F.when(m >= first, m).otherwise(first)
    sales = invoices.where("amount > 0").withColumns({"due_m": month_of("due"), "iss_m": month_of("issued"), "pay_m": F.when(F.col("paid"), month_of("paid_on"))})
    left = F.when(F.col("pay_m") >= F.col("due_m"), F.col("pay_m")).otherwise(F.col("due_m"))
    none = F.lit(None).cast(EXACT)
    move = lambda month, moved, sold: F.struct(month.alias("month"), moved.alias("moved"), sold.alias("sold"))
    moves = F.array(move(clamped(F.col("due_m")), F.col("amount"), none), F.when(F.col("paid"), move(clamped(left), -F.col("amount"), none)), move(F.col("iss_m"), none, F.col("amount")))
    by_month = sales.select("company_id", F.explode(moves).alias("m")).where("m is not null").groupBy("company_id", "m.month").agg(*(F.coalesce(F.sum(f"m.{c}"), F.lit(0)).alias(c) for c in ("moved", "sold")))
    days = clip(F.datediff("paid_on", "issued").cast("double"), 0, 365)
    dso = sales.where("paid").groupBy("company_id", F.col("pay_m").alias("month")).agg(F.avg(days).alias("dso_m"))
    grid = month_grid(sales.select("company_id").distinct().withColumn("first", first), horizon.last)
    w = Window.partitionBy("company_id").orderBy("month")
    out = grid.join(by_month, ["company_id", "month"], "left").join(dso, ["company_id", "month"], "left").fillna(0, ["moved", "sold"])
    out = out.withColumns({"overdue_amt": F.greatest(F.sum("moved").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), "sales_3m": rolling(F.sum, "sold", w, 3, 1), "dso": rolling(F.avg, "dso_m", w, 3, 1)})
    return out.select("company_id", "month", "overdue_amt", "sales_3m", clip(safe_div(F.col("overdue_amt"), F.col("sales_3m")), 0, 5).alias("pct_overdue"), "dso")


def payables(invoices: DataFrame, horizon: K.Horizon) -> DataFrame:
    """By company and month: bills over 90 days late at the month's end and unpaid then, and of those the ones of under 180.

    A bill enters in the month in which it is 90 days late and leaves when it is paid (or 180 days late), so a running sum
    of both changes does for every month what would else be a join of all bills with all months. A bill marked as paid
    without a date was never late.
    """
    bills = invoices.where("amount < 0 and due is not null and not (paid and paid_on is null)").withColumn("amount", -F.col("amount"))
    enter, paid, old = month_of(F.date_add("due", 90)), F.when(F.col("paid"), month_of("paid_on")), month_of(F.date_add("due", 180))
    bills = bills.withColumns({"s": F.greatest(enter, F.lit(horizon.first)), "e": paid, "r": F.least(paid, old)})
    none = F.lit(None).cast(EXACT)
    move = lambda keep, month, every, recent: F.when(F.expr(keep), F.struct(F.col(month).alias("month"), every.alias("all"), recent.alias("recent")))
    amount = F.col("amount")
    moves = F.array(move("e is null or e > s", "s", amount, none), move("e > s", "e", -amount, none), move("r > s", "s", none, amount), move("r > s", "r", none, -amount))
    by = bills.select("company_id", F.explode(moves).alias("m")).where(F.col("m").isNotNull() & (F.col("m.month") <= F.lit(horizon.last))).groupBy("company_id", "m.month").agg(*(F.coalesce(F.sum(f"m.{k}"), F.lit(0)).alias(k) for k in ("all", "recent")))
    grid = month_grid(by.groupBy("company_id").agg(F.min("month").alias("first")), horizon.last)
    upto = Window.partitionBy("company_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(upto)
    return grid.join(by, ["company_id", "month"], "left").select("company_id", "month", total("all").alias("payables_overdue90"), total("recent").alias("payables_overdue90_recent"))


def full_panel(panel: DataFrame, invoices: DataFrame, owed: DataFrame, owing: DataFrame) -> DataFrame:
    """The panel with invoice columns: null for companies without invoices, zero payables for others without any."""
    out = panel.join(invoices.select("company_id").distinct().withColumn("has_invoices", F.lit(True)), "company_id", "left").join(owed, ["company_id", "month"], "left").join(owing, ["company_id", "month"], "left")
    out = out.withColumn("has_invoices", F.coalesce("has_invoices", F.lit(False)))
    zero = {c: F.when(F.col("has_invoices"), F.coalesce(c, F.lit(0))) for c in ("payables_overdue90", "payables_overdue90_recent")}
    return out.withColumns(zero | {c: F.when(F.col("has_invoices"), F.col(c)) for c in ("overdue_amt", "sales_3m", "pct_overdue", "dso")})


def company_static(companies: DataFrame, debt: DataFrame, invoices: DataFrame, rows: DataFrame, anchor: DataFrame, panel: DataFrame) -> DataFrame:
    """One row per company: debt, which data it has, length of history."""
    granted, owed = F.abs("granted"), F.abs("outstanding")
    loans = debt.where(granted > 0).groupBy("company_id").agg(F.count(F.lit(1)).alias("n_debt_products"), F.sum(granted).alias("debt_granted"), F.sum(owed).alias("debt_outstanding"))
    loans = loans.withColumn("debt_util", clip(F.col("debt_outstanding") / F.col("debt_granted"), 0, 1))
    flags = {
        "has_invoices": invoices, "pays_bank_debt": rows.where("category = 'debt_repayment'"), "has_balance": anchor, "mixed_currency": rows.where("foreign"),
    }
    out = companies.select("company_id", "group_id", "country", "currency", "erp").join(loans, "company_id", "left")
    for name, df in flags.items():
        out = out.join(df.select("company_id").distinct().withColumn(name, F.lit(True)), "company_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    history = panel.groupBy("company_id").agg(F.count(F.lit(1)).alias("months_of_history"), F.bool_or("inconsistent_balance").alias("inconsistent_balance"))
    out = out.join(history, "company_id", "left").withColumn("inconsistent_balance", F.coalesce("inconsistent_balance", F.lit(False)))
    return out.withColumns({"has_debt_product": F.col("n_debt_products").isNotNull(), "has_erp": F.col("erp").isNotNull()})
