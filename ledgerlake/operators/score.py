"""Score series: smoothing, projection, pillars, sector comparison, attribution and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import clip, median_over, month_index, quantiles_by, rolling, safe_div

# The damped trend and the smoothing.
BETA, PHI, AHEAD, MIN_POINTS, ALPHA = 0.3, 0.8, 3, 4, 0.5
NOISE = 0.05
#: Points that are added up: exact.
POINTS = "decimal(20,4)"
# The features of each pillar.
PILLARS = {
    "liquidez": ("runway", "lc_util"),
    "rentabilidad": ("oper_growth_12m",),
    "solvencia": ("debt_burden", "payroll_cv", "payroll_continuity_6m"),
    "disciplina": ("ap_late_share", "ar_late_share", "ap_overdue_ratio", "ar_overdue_90_ratio", "refund_rate"),
    "estabilidad": ("activity_trend", "transfer_dep", "hhi_ar_6m", "net_vol_6m", "cust_trend", "lost_share", "oper_persistence_6m"),
}


def band(score: Column) -> Column:
    return F.when(score >= 65, "healthy").when(score >= 35, "watch").when(score.isNotNull(), "risk")


def trailing_run(series: DataFrame) -> DataFrame:
    """(id, month, value) of the last stretch of months without a gap; null and NaN values don't count."""
    w = Window.partitionBy("id").orderBy("month")
    known = series.where(F.col("value").isNotNull() & ~F.isnan("value"))
    known = known.withColumn("island", month_index(F.col("month")) - F.row_number().over(w))
    return known.withColumn("last", F.max("island").over(Window.partitionBy("id"))).where("island = last").drop("island", "last")


def project(series: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """(id, month, value): a damped trend from the last value, within 0 and 100, one decimal; none with a short history.

    The trend is folded over the ordered values of a series, which is one row; series are as long as their history.
    """
    rows = trailing_run(series).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("p")).where(F.size("p") >= MIN_POINTS)
    v = F.transform("p", lambda x: x["value"])
    start = F.named_struct(F.lit("last"), v[1], F.lit("trend"), v[1] - v[0])
    end = F.aggregate(F.slice(v, 3, F.size(v)), start, lambda a, x: F.named_struct(F.lit("last"), x, F.lit("trend"), BETA * (x - a["last"]) + (1 - BETA) * PHI * a["trend"]))
    damped, steps = 0.0, []
    for k in range(1, ahead + 1):
        damped += PHI**k
        steps.append(F.struct(F.lit(k).alias("k"), F.lit(damped).alias("d")))
    out = rows.select("id", end.alias("e"), F.element_at("p", -1)["month"].alias("at"), F.explode(F.array(*steps)).alias("s"))
    return out.select("id", F.add_months("at", F.col("s.k")).alias("month"), F.round(clip(F.col("e.last") + F.col("s.d") * F.col("e.trend"), 0, 100), 1).alias("value"))


def smoothed(series: DataFrame) -> DataFrame:
    """(id, month, value, ewma): each value and its past, the weight of the past halving each month."""
    rows = series.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("p"))
    first = F.slice(F.transform("p", lambda x: x["value"]), 1, 1)
    run = F.aggregate(F.slice(F.transform("p", lambda x: x["value"]), 2, F.size("p")), first, lambda a, x: F.concat(a, F.array(ALPHA * x + (1 - ALPHA) * F.element_at(a, -1))))
    return rows.select("id", F.explode(F.arrays_zip("p", run.alias("e"))).alias("z")).select("id", F.col("z.p.month").alias("month"), F.col("z.p.value").alias("value"), F.col("z.e").alias("ewma"))


def pillar_of(feature: Column) -> Column:
    literal = F.create_map(*(F.lit(x) for p, fs in PILLARS.items() for f in fs for x in (f, p)))
    return F.coalesce(F.try_element_at(literal, feature), F.lit("additional"))


def pillars(drivers: DataFrame, keys: list[str]) -> DataFrame:
    """By pillar: how many drivers, and the sum of their contributions, null unless all are numbers."""
    x = F.nanvl("contribution", F.lit(None).cast("double"))
    return drivers.groupBy(*keys, pillar_of(F.col("feature")).alias("pillar")).agg(F.count(F.lit(1)).alias("n_drivers"), F.when(F.count(x) == F.count(F.lit(1)), F.sum(x)).alias("contribution"))


def contribution_label(x: Column) -> Column:
    one = F.replace(F.format_string("%.1f", F.round(F.abs(x), 1)), F.lit("."), F.lit(","))
    return F.when(x.isNull(), "no contribution").when(F.abs(x) < NOISE, "0,0").otherwise(F.concat(F.when(x > 0, "+").otherwise("-"), one))


def sector_stats(scores: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, month, n, mean, median) of (id, month, value)."""
    rows = scores.where("value is not null").join(sectors, "id").select("sector", "month", "value")
    stats = rows.groupBy("sector", "month").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    middle = quantiles_by(rows, ["sector", "month"], "value", {"median": 0.5}).withColumnsRenamed({"sector": "_s", "month": "_m"})
    return stats.join(middle, F.col("sector").eqNullSafe(F.col("_s")) & (F.col("month") == F.col("_m")), "left").drop("_s", "_m")


def aligned(scores: DataFrame, sectors: DataFrame, stats: DataFrame, which: str) -> DataFrame:
    """Months that both a company and its sector have."""
    return scores.where("value is not null").join(sectors, "id").join(stats.select("sector", "month", F.col(which).alias("sector_value"), "n"), ["sector", "month"]).where("sector_value is not null").select("id", "month", "value", "sector_value", "n")


def attribution(drivers: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, month, feature, delta_points): what each feature and the rules on top moved the score since the month before.

    Differences are rounded to two decimals; what they leave of the score's own change is the feature "rules". Changes
    under NOISE aren't shown. A feature without a contribution in one of the months counts as 0 there.
    """
    w = Window.partitionBy("id").orderBy("month")
    drivers = drivers.withColumn("contribution", F.col("contribution").cast(POINTS))
    scores = scores.withColumn("value", F.col("value").cast(POINTS))
    steps = scores.select("id", "month", F.lag("month").over(w).alias("before"), F.round(F.col("value") - F.lag("value").over(w), 2).alias("delta")).where("before is not null")
    now = drivers.join(steps.select("id", "month"), ["id", "month"], "left_semi").select("id", "month", "feature", F.col("contribution").alias("now"))
    then = drivers.join(steps.select("id", F.col("month").alias("m"), F.col("before").alias("month")), ["id", "month"]).select("id", F.col("m").alias("month"), "feature", F.col("contribution").alias("then"))
    moved = now.join(then, ["id", "month", "feature"], "full").withColumn("delta_points", F.round(F.coalesce("now", F.lit(0)) - F.coalesce("then", F.lit(0)), 2))
    explained = moved.groupBy("id", "month").agg(F.sum("delta_points").alias("explained"))
    rest = steps.join(explained, ["id", "month"], "left").select("id", "month", F.lit("rules").alias("feature"), F.round(F.col("delta") - F.coalesce("explained", F.lit(0)), 2).alias("delta_points"))
    return moved.select("id", "month", "feature", "delta_points").unionByName(rest).withColumn("delta_points", F.col("delta_points").cast("double")).where(F.abs("delta_points") >= NOISE)


def summaries(changes: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, month, delta, why): the two largest changes in the score's own direction."""
    w = Window.partitionBy("id").orderBy("month")
    steps = scores.select("id", "month", F.round(F.col("value") - F.lag("value").over(w), 2).alias("delta")).where("delta is not null")
    ranked = F.array_sort(F.collect_list(F.when(F.signum("delta_points") == F.signum("delta"), F.struct((-F.abs("delta_points")).alias("k"), "feature"))))
    met = steps.join(changes, ["id", "month"], "left").groupBy("id", "month", "delta").agg(F.slice(ranked, 1, 2).alias("top"))
    return met.select("id", "month", "delta", F.when(F.size("top") > 0, F.array_join(F.transform("top", lambda x: x["feature"]), " and ")).otherwise("small changes").alias("why"))


def features(panel: DataFrame) -> DataFrame:
    """Features that need the panel alone, by company and month."""
    w = Window.partitionBy("company_id").orderBy("month")
    mean = lambda c, n: rolling(F.avg, c, w, n)
    out = panel.select("company_id", "month", F.col("n_tx").cast("double").alias("n_tx"), *(F.col(c).cast("double").alias(c) for c in ("cash_end", "outflow_op", "inflow_op", "net_op", "debt_service", "out_fin_cost", "out_salary", "transfer_net")))
    out = out.withColumns({"deficit2": F.pow(F.least("net_op", F.lit(0.0)), F.lit(2.0)), "owed": F.col("debt_service") + F.col("out_fin_cost"), "paid_staff": (F.col("out_salary") > 0).cast("double"), "usual_inflow": F.when(F.count("inflow_op").over(w.rowsBetween(-11, 0)) == 12, median_over(F.col("inflow_op")).over(w.rowsBetween(-11, 0)))})
    out = out.withColumn("persists", (F.col("inflow_op") >= 0.5 * F.col("usual_inflow")).cast("double"))
    months = safe_div(F.col("cash_end"), F.greatest(mean("outflow_op", 3), mean("outflow_op", 12)))
    return out.select(
        "company_id", "month", (F.signum(months) * F.log1p(F.abs(months))).alias("runway"), F.log(F.nullif(safe_div(mean("inflow_op", 3), mean("inflow_op", 12)), F.lit(0.0))).alias("oper_growth_12m"), safe_div(rolling(F.sum, "owed", w, 3), rolling(F.sum, "inflow_op", w, 3)).alias("debt_burden"),
        mean("paid_staff", 6).alias("payroll_continuity_6m"), safe_div(mean("n_tx", 3), mean("n_tx", 12)).alias("activity_trend"), safe_div(rolling(F.sum, "transfer_net", w, 3), rolling(F.sum, "inflow_op", w, 3)).alias("transfer_dep"),
        safe_div(F.sqrt(mean("deficit2", 6)), mean("outflow_op", 6)).alias("net_vol_6m"), mean("persists", 6).alias("oper_persistence_6m"),
    )


def client_features(invoices: DataFrame, grid: DataFrame) -> DataFrame:
    """hhi_ar_6m and cust_trend of (company_id, month) in grid, from sales(company_id, client, month, amount).

    Sales are summed by client and month first; each sum is then given to the months whose window it is in.
    """
    sums = invoices.groupBy("company_id", "client", "month").agg(F.sum("amount").alias("amount"))
    seen = lambda n: sums.select("company_id", "client", "amount", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.add_months("month", k.cast("int")))).alias("month"))
    by_client = seen(6).groupBy("company_id", "month", "client").agg(F.sum("amount").cast("double").alias("x"))
    hhi = by_client.groupBy("company_id", "month").agg(safe_div(F.sum(F.col("x") * F.col("x")), F.sum("x") * F.sum("x")).alias("hhi_ar_6m"))
    clients = lambda n: seen(n).select("company_id", "month", "client").distinct().groupBy("company_id", "month").agg(F.count(F.lit(1)).alias(f"c{n}"))
    out = grid.select("company_id", "month").join(hhi, ["company_id", "month"], "left").join(clients(3), ["company_id", "month"], "left").join(clients(12), ["company_id", "month"], "left")
    return out.select("company_id", "month", "hhi_ar_6m", F.log((F.coalesce("c3", F.lit(0)) + 1) / (F.coalesce("c12", F.lit(0)) + 1)).alias("cust_trend"))


def payroll_cv(panel: DataFrame) -> DataFrame:
    """(company_id, month, payroll_cv): how far payrolls of six months fall below their mean, in proportion to it; null
    without payroll. Payrolls above the mean don't count."""
    w = Window.partitionBy("company_id").orderBy("month").rowsBetween(-5, 0)
    rows = panel.select("company_id", "month", F.col("out_salary").cast("double").alias("x")).withColumns({"xs": F.collect_list("x").over(w), "m": F.avg("x").over(w), "n": F.count("x").over(w)})
    below = F.aggregate(F.transform("xs", lambda x: F.pow(F.least(x - F.col("m"), F.lit(0.0)), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.select("company_id", "month", F.when((F.col("n") == 6) & (F.col("m") > 0), F.sqrt(below / 6) / F.col("m")).alias("payroll_cv"))


def credit_use(debt: DataFrame) -> DataFrame:
    """(company_id, lc_util): what is drawn of the limit of credit lines; none without a limit."""
    lines = debt.where("type = 'lineofcredit'").groupBy("company_id").agg(F.sum(F.abs("outstanding")).alias("drawn"), F.sum(F.abs("granted")).alias("granted"))
    return lines.where("granted > 0").select("company_id", safe_div(F.col("drawn"), F.col("granted")).alias("lc_util"))


#: Days by which an invoice has to be late.
LATE_DAYS = 15


def invoice_features(invoices: DataFrame, panel: DataFrame) -> DataFrame:
    """Late shares and overdue ratios of invoices(company_id, due, paid_on, paid, amount) by company and month of panel.

    A late share counts, of the invoices that fell due in three months and over LATE_DAYS before the month's end, those
    unpaid or paid over LATE_DAYS late. Overdue amounts are of the last twelve months' due dates and unpaid at the
    month's end; receivables only those due before the month before. An invoice is given to the months in whose window
    it is, twelve at most, instead of joining invoices with months.
    """
    due_m = F.trunc("due", "month")
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct(k.alias("age"), F.add_months(due_m, k.cast("int")).alias("month")))).alias("s")
    rows = invoices.where("due is not null").select("company_id", "due", F.when(F.col("paid"), F.col("paid_on")).alias("paid_on"), "paid", "amount", spread).select("*", "s.*")
    end = F.last_day("month")
    counted = (F.col("age") <= 2) & (F.datediff(end, "due") > LATE_DAYS)
    late = F.col("paid_on").isNull() | (F.datediff("paid_on", "due") > LATE_DAYS)
    unpaid = F.when(~F.col("paid") | (F.col("paid_on") > end), F.col("amount"))
    ours = F.col("amount") > 0
    share = lambda side: safe_div(F.count_if(counted & late & side), F.count_if(counted & side))
    sums = rows.where("amount <> 0").groupBy("company_id", "month").agg(
        share(~ours).alias("ap_late_share"), share(ours).alias("ar_late_share"), F.coalesce(-F.sum(F.when(~ours & (F.col("due") <= end), unpaid)), F.lit(0)).alias("ap"), F.coalesce(F.sum(F.when(ours & (F.col("age") >= 2), unpaid)), F.lit(0)).alias("ar")
    )
    w = Window.partitionBy("company_id").orderBy("month")
    flows = panel.select("company_id", "month", *(rolling(F.avg, c, w, 3).alias(f"{c}_mean") for c in ("outflow_op", "inflow_op")))
    out = flows.join(sums, ["company_id", "month"], "left")
    ratio = lambda c, of: safe_div(F.coalesce(c, F.lit(0)), F.col(of))
    return out.select("company_id", "month", "ap_late_share", "ar_late_share", ratio("ap", "outflow_op_mean").alias("ap_overdue_ratio"), ratio("ar", "inflow_op_mean").alias("ar_overdue_90_ratio"))


def refund_rate(ledger: DataFrame, panel: DataFrame, refunds: tuple[str, ...] = ("collection_refund",)) -> DataFrame:
    """(company_id, month, refund_rate): refunds of three months over operating inflow."""
    back = ledger.where(F.col("category").isin(*refunds)).groupBy("company_id", "month").agg((-F.sum("amount")).alias("back"))
    w = Window.partitionBy("company_id").orderBy("month")
    rows = panel.select("company_id", "month", "inflow_op").join(back, ["company_id", "month"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    return rows.select("company_id", "month", safe_div(rolling(F.sum, "back", w, 3), rolling(F.sum, "inflow_op", w, 3)).alias("refund_rate"))


def lost_share(sales: DataFrame, grid: DataFrame, least: int = 3) -> DataFrame:
    """(company_id, month, lost_share): of the sales 3 to 11 months ago, the share of clients without sales in the last
    three; null with fewer than ``least`` such clients. sales(company_id, client, month, amount)."""
    sums = sales.groupBy("company_id", "client", "month").agg(F.sum("amount").alias("amount"))
    ages = F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct(k.alias("age"), F.add_months("month", k.cast("int")).alias("at")))).alias("s")
    by = sums.select("company_id", "client", "amount", ages).groupBy("company_id", "client", F.col("s.at").alias("month")).agg(F.sum(F.when(F.col("s.age") >= 3, F.col("amount"))).cast("double").alias("prior"), F.count_if(F.col("s.age") < 3).alias("recent"))
    per = by.where("prior is not null").groupBy("company_id", "month").agg(F.count(F.lit(1)).alias("n"), safe_div(F.coalesce(F.sum(F.when(F.col("recent") == 0, F.col("prior"))), F.lit(0.0)), F.sum("prior")).alias("x"))
    return grid.select("company_id", "month").join(per.where(F.col("n") >= least).select("company_id", "month", F.col("x").alias("lost_share")), ["company_id", "month"], "left")
