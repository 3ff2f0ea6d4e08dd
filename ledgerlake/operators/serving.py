"""Views ready to serve: portfolio, alerts, board, searches, statements, sections of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlake.functions.columns import half_up, whole_text
from ledgerlake.operators.score import band

def by_month() -> WindowSpec:
    return Window.partitionBy("company_id").orderBy("month")


def from_latest() -> WindowSpec:
    return Window.partitionBy("company_id").orderBy(F.col("month").desc())


# What counts as an alert, an implausible figure, a surplus worth placing.
ALERT_DROP, LOW_CONFIDENCE, MAX_CASH, MAX_RUNWAY, MIN_SURPLUS = 10, 0.4, 1e8, 36, 25_000
# Lines of the cash-flow statement by group.
LINES = {
    "receipts": {"customers": ("collection",), "batches": ("bulk_collection",), "card terminals": ("pos_settlement",), "cash": ("cash_settlement",), "refunds of payments": ("payment_refund",), "tax refunds": ("tax_refund",)},
    "payments": {"suppliers": ("payment",), "batches": ("bulk_payment",), "salaries": ("salary",), "social security": ("social_security",), "taxes": ("tax",), "utilities": ("utility",), "bank fees": ("fee",), "cash": ("cash_withdrawal",), "card terminals": ("pos_withdrawal",), "refunds of receipts": ("collection_refund",)},
    "financing": {"debt repayments": ("debt_repayment",), "interest": ("interest_charge",)},
    "investment": {"investments": ("investment_deployment",), "returns": ("investment_return",)},
    "intercompany": {"transfers": ("transfer",)},
}


def from_end(df: DataFrame) -> DataFrame:
    """df with rn: a row's place from its company's last month, from the same sort as what looks back."""
    return df.withColumn("rn", F.count(F.lit(1)).over(Window.partitionBy("company_id")) - F.row_number().over(by_month()) + 1)


def portfolio(panel: DataFrame, scores: DataFrame, static: DataFrame) -> DataFrame:
    """One row per company with a score: its last month, values three rows back, the last twelve months as arrays. Panel and
    scores are each sorted once and summed up once."""
    ranked = from_end(panel.withColumns({"runway_prev": F.lag("runway_m", 3).over(by_month()), "dso_prev": F.lag("dso", 3).over(by_month())})).where("rn <= 12")
    flow = F.struct("month", F.coalesce("inflow_op", F.lit(0)).alias("in"), F.abs(F.coalesce("outflow_op", F.lit(0))).alias("out"), F.coalesce("cash_end", F.lit(0)).alias("cash"))
    last = F.struct("cash_end", F.col("runway_m").alias("runway_now"), "runway_prev", F.col("dso").alias("dso_now"), "dso_prev", F.round(F.col("pct_overdue") * 100, 1).alias("overdue_share"), "margin_3m", "debt_service_ratio_3m", "n_tx")
    now = ranked.groupBy("company_id").agg(F.sort_array(F.collect_list(flow)).alias("flows"), F.max(F.when(F.col("rn") == 1, last)).alias("l")).select("company_id", "l.*", "flows")
    health = from_end(scores.withColumns({"delta3": F.col("score") - F.lag("score", 3).over(by_month()), "n_months": F.count(F.lit(1)).over(Window.partitionBy("company_id"))})).where("rn <= 12")
    head = F.struct(F.col("month").alias("last_month"), F.round("score", 1).alias("score"), band(F.col("score")).alias("band"), F.round("delta3", 1).alias("delta3"), "n_months")
    history = F.transform(F.sort_array(F.collect_list(F.struct("month", "score"))), lambda x: F.round(x["score"], 1))
    seen = health.groupBy("company_id").agg(F.max(F.when(F.col("rn") == 1, head)).alias("h"), history.alias("history")).select("company_id", "h.*", "history")
    facts = static.select("company_id", "group_id", F.coalesce("currency", F.lit("EUR")).alias("currency"), F.coalesce("has_erp", F.lit(False)).alias("has_erp"), "debt_outstanding", "debt_util")
    return seen.join(facts, "company_id", "left").join(now, "company_id", "left").withColumn("n_tx", F.coalesce("n_tx", F.lit(0)))


def alert(score_band: Column, delta3: Column, confidence: Column) -> Column:
    return F.when(delta3 <= -ALERT_DROP, F.concat(F.lit("falls by "), whole_text(-delta3), F.lit(" points in 3 months"))).when(score_band == "risk", "in the risk band").when(confidence < LOW_CONFIDENCE, "too little data")


def plausible_cash(c: Column) -> Column:
    return F.when(F.abs(c) <= MAX_CASH, c)


def plausible_runway(c: Column) -> Column:
    return F.when((c >= 0) & (c <= MAX_RUNWAY), c)


def action(has_break: Column, has_surplus: Column, score_band: Column) -> Column:
    return F.when(has_break, "finance").when(has_surplus & score_band.isNotNull() & (score_band != "risk"), "place")


def board(view: DataFrame, forecast: DataFrame, panel: DataFrame) -> DataFrame:
    """Status, impact, urgency and suggestion of each company; the order of the rules of status matters."""
    last = panel.withColumn("rn", F.row_number().over(from_latest())).where("rn = 1").select("company_id", F.col("net_op").alias("net_op"))
    f = forecast.select("company_id", "low", "low_date", "monthly_spend", F.col("break_from").isNotNull().alias("has_break"), F.col("surplus").isNotNull().alias("has_surplus"))
    rows = view.join(f, "company_id", "left").join(last, "company_id", "left").withColumns({"has_break": F.coalesce("has_break", F.lit(False)), "has_surplus": F.coalesce("has_surplus", F.lit(False)), "runway": plausible_runway(F.col("runway_now").cast("double"))})
    status = F.when(F.col("has_break"), "alert").when(F.col("runway") < 1, "alert").when((F.col("net_op") < 0) & (F.col("runway").isNull() | (F.col("runway") < 3)), "alert").when(F.col("has_surplus") & (F.col("band") == "healthy"), "opportunity").otherwise("watch")
    impact = half_up(F.col("low").cast("double") - F.col("monthly_spend")).cast("long")
    suggestion = F.when(impact < 0, "finance").when((impact >= MIN_SURPLUS) & ~F.coalesce(F.col("band") == "risk", F.lit(False)), "place").otherwise("follow")
    return rows.select("company_id", "band", status.alias("status"), impact.alias("impact"), F.datediff("low_date", F.last_day("last_month")).cast("long").alias("urgency_days"), suggestion.alias("suggestion"), action(F.col("has_break"), F.col("has_surplus"), F.col("band")).alias("action"), plausible_cash(F.col("cash_end").cast("double")).alias("cash_end"), F.col("runway").alias("runway_m"))


def counts_of(df: DataFrame, c: str, values: tuple[str, ...]) -> DataFrame:
    """How often each of the values occurs, 0 included."""
    return df.agg(F.array(*(F.struct(F.lit(v).alias(c), F.count_if(F.col(c) == v).alias("n")) for v in values)).alias("x")).select(F.inline("x"))


def search(view: DataFrame, chosen: DataFrame, mode: str, limit: int) -> DataFrame:
    """The first companies of a curated set by worst score, biggest fall or biggest rise, and how many there are."""
    rows = view.join(chosen, "company_id", "left_semi")
    order = {"worst": F.col("score").asc_nulls_last(), "fall": F.col("delta3").asc_nulls_last(), "rise": F.col("delta3").desc_nulls_last()}[mode]
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(order, "company_id").limit(limit).select("company_id", "score", "delta3", "band").join(F.broadcast(total), F.lit(True))


def table_stats(view: DataFrame) -> DataFrame:
    share = lambda c: F.concat(F.count_if(c).cast("string"), F.lit(" ("), half_up(100.0 * F.count_if(c) / F.nullif(F.count("score"), F.lit(0))).cast("string"), F.lit("%)"))
    return view.where("score is not null").agg(F.count("score").alias("companies"), F.round(F.avg("score"), 1).alias("mean_score"), share(F.col("band") == "risk").alias("in_risk"), share(F.col("delta3") < 0).alias("falling"))


def statement(breakdown: DataFrame, panel: DataFrame) -> DataFrame:
    """(company_id, month, line_group, line, amount): lines and subtotals by group, what no line knows, opening, closing
    and the adjustment that closes the balance. Subtotals are grouping sets of one pass."""
    literal = F.create_map(*(F.lit(x) for g, lines in LINES.items() for line, cats in lines.items() for c in cats for x in (c, f"{g}|{line}")))
    known = F.try_element_at(literal, F.col("category"))
    rows = breakdown.select("company_id", "month", "amount", F.coalesce(F.split(known, r"\|")[0], F.lit("uncategorised")).alias("line_group"), F.coalesce(F.split(known, r"\|")[1], F.lit("uncategorised")).alias("line"))
    sums = rows.groupingSets([["company_id", "month", "line_group", "line"], ["company_id", "month", "line_group"], ["company_id", "month"]], "company_id", "month", "line_group", "line").agg(F.sum("amount").alias("amount"), F.grouping_id().alias("g"))
    lines = sums.where("g < 3").select("company_id", "month", "line_group", F.coalesce("line", F.lit("subtotal")).alias("line"), "amount")
    before = F.lag("cash_end").over(by_month())
    cash = panel.select("company_id", "month", "cash_end", F.when(F.row_number().over(by_month()) > 1, before).otherwise(F.col("cash_end") - F.coalesce("net_bank", F.lit(0))).alias("start"))
    both = cash.join(sums.where("g = 3").select("company_id", "month", F.col("amount").alias("total")), ["company_id", "month"])
    edge = both.select("company_id", "month", F.explode(F.array(F.struct(F.lit("opening").alias("line"), F.col("start").alias("amount")), F.struct(F.lit("adjustment").alias("line"), (F.col("cash_end") - F.col("start") - F.col("total")).alias("amount")), F.struct(F.lit("closing").alias("line"), F.col("cash_end").alias("amount")))).alias("x"))
    return lines.unionByName(edge.select("company_id", "month", F.lit("balance").alias("line_group"), "x.line", "x.amount"))


def sections(messages: DataFrame) -> DataFrame:
    """Each reply with the last question before it, and its place from the newest: conv_id, turn, question, reply, place."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.trim("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumn("question", F.coalesce(asked, F.lit(""))).where("role <> 'user'")
    return rows.select("conv_id", "turn", "question", F.col("text").alias("reply"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())).cast("long").alias("place"))


def last_per_slot(charts: DataFrame) -> DataFrame:
    """Of charts(message, seq, slot, kind): the last of each slot of a message; tables, where there are any, alone."""
    last = charts.withColumn("rn", F.row_number().over(Window.partitionBy("message", "slot").orderBy(F.col("seq").desc()))).where("rn = 1").drop("rn")
    return last.withColumn("t", F.bool_or(F.col("kind") == "table").over(Window.partitionBy("message"))).where("not t or kind = 'table'").drop("t")


def assign(leads: DataFrame, team: DataFrame) -> DataFrame:
    """(employee_id, open_leads, is_next): open leads of each member of the team, 0 included; the next lead goes to the
    member with the fewest, the least id of equal ones."""
    load = team.join(leads.where("status <> 'closed'").groupBy(F.col("assigned_to").alias("employee_id")).agg(F.count(F.lit(1)).alias("open_leads")), "employee_id", "left").withColumn("open_leads", F.coalesce("open_leads", F.lit(0)))
    first = load.agg(F.min(F.struct("open_leads", "employee_id")).alias("m")).select(F.col("m.employee_id").alias("first"))
    return load.join(F.broadcast(first), F.lit(True)).withColumn("is_next", F.col("employee_id") == F.col("first")).drop("first")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: new's rows replace those of old with the same key."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_o").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_o")
