"""Stress events: a registry of rules over the monthly panel, evaluated as 1, 0 or null (not applicable)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlake.constants import MIN_HISTORY
from ledgerlake.functions.columns import median_over, previous

def by_month() -> WindowSpec:
    return Window.partitionBy("company_id").orderBy("month")




@dataclass(frozen=True)
class Event:
    """A rule and where it can be evaluated; both may use ``extra`` columns, which are computed first."""

    name: str
    dimension: str
    severity: str
    applicable: Column
    rule: Column


def with_history(panel: DataFrame) -> DataFrame:
    """Months with enough history (earlier ones go before any window), and what the rules look back at."""
    out = panel.where(F.col("hist_months") >= MIN_HISTORY)
    paid = {f"_usual_{c}": previous(F.sum, (F.col(c) > 0).cast("int"), by_month(), 6) >= 5 for c in OBLIGATIONS}
    return out.withColumns(paid | {"_fin_median": previous(median_over, F.col("out_fin_cost"), by_month(), 6)})


OBLIGATIONS = ("out_salary", "out_social_security", "out_tax")


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def registry() -> list[Event]:
    c = F.col
    return [
        Event("regular_payment_missing", "payment", "high", _any([c(f"_usual_{o}") for o in OBLIGATIONS]) & (c("n_tx") > 0), _any([c(f"_usual_{o}") & (c(o) <= 0) for o in OBLIGATIONS])),
        Event("bills_overdue", "payment", "medium", c("has_invoices") & (c("outflow_op_3m") > 0), c("payables_overdue90_recent") >= 0.25 * (c("outflow_op_3m") / 3)),
        Event("negative_balance", "liquidity", "high", c("days_negative").isNotNull(), c("days_negative") >= 5),
        Event("cash_running_out", "cash", "high", c("runway_m").isNotNull() & c("margin_3m").isNotNull(), (c("net_op_3m") < 0) & (c("runway_m") < 1)),
        Event("financial_cost_jump", "debt", "medium", c("_fin_median").isNotNull() & (c("outflow_op") > 0), (c("out_fin_cost") > 3 * c("_fin_median")) & (c("out_fin_cost") > 0.02 * c("outflow_op")) & (c("_fin_median") > 0)),
    ]


NAMES = ("regular_payment_missing", "bills_overdue", "negative_balance", "cash_running_out", "financial_cost_jump")


def evaluate(panel: DataFrame, events: Callable[[], list[Event]] = registry) -> DataFrame:
    """(company_id, month, one column for each event): 1, 0, or null where the event isn't applicable."""
    no = F.lit(False)
    values = [F.when(F.coalesce(e.applicable, no), F.coalesce(e.rule, no).cast("double")).alias(e.name) for e in events()]
    return with_history(panel).select("company_id", "month", *values)


def forward(events: DataFrame, horizon: int, names: tuple[str, ...] = NAMES) -> DataFrame:
    """For each event: whether it happens in one of the next ``horizon`` months; null if any of them is unknown."""
    ahead = by_month().rowsBetween(1, horizon)
    return events.select("company_id", "month", *(F.when(F.count(n).over(ahead) == horizon, F.max(n).over(ahead)).alias(f"{n}_y{horizon}") for n in names))


def _long(events: DataFrame, names: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias("event"), F.col(n).alias("x")) for n in names))
    return events.select("company_id", "month", F.explode(pairs).alias("e")).select("company_id", "month", "e.event", "e.x")


def diagnose(events: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Of each event, in percent: applicable rows, base rate, companies that ever had it, persistence."""
    w = Window.partitionBy("company_id", "event").orderBy("month")
    rows = _long(events, names).withColumn("before", F.lag("x").over(w))
    share = lambda cond, among, places: F.round(100.0 * F.count_if(cond) / F.nullif(F.count_if(among), F.lit(0)), places)
    x, known = F.col("x"), F.col("x").isNotNull()
    ever = rows.groupBy("event", "company_id").agg(F.max("x").alias("m")).groupBy("event").agg(share(F.col("m") == 1, F.col("m").isNotNull(), 1).alias("ever_pct"))
    again = (F.col("before") == 1) & known
    out = rows.groupBy("event").agg(share(known, F.lit(True), 1).alias("applicable_pct"), share(x == 1, known, 2).alias("base_rate_pct"), share(again & (x == 1), again, 1).alias("persistence_pct"))
    return out.join(ever, "event")


def cooccurrence(events: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Jaccard index of each pair of events on the rows where both are applicable, from one pass of conditional counts."""
    counts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("both"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull() & ((F.col(a) == 1) | (F.col(b) == 1))).alias("either")) for a in names for b in names]
    out = events.agg(F.array(*counts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return out.select("a", "b", F.round(F.col("both") / F.greatest("either", F.lit(1)), 3).alias("jaccard"))


def any_rates(events: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(left_out, rows, rate_pct) of any event, of all of them and without each in turn."""
    groups = {"": names} | {n: tuple(x for x in names if x != n) for n in names}
    cells = [F.struct(F.lit(k).alias("left_out"), F.count(F.greatest(*g)).alias("rows"), F.round(100.0 * F.avg((F.greatest(*g) == 1).cast("int")), 1).alias("rate_pct")) for k, g in groups.items()]
    return events.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")
