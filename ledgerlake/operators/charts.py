"""What charts and tables show: periods, rows worth showing, comparisons with peers, suggestions, scales, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import quantiles_by, safe_div
from ledgerlake.sources.staging import placed

# What is too small to show, the verdict's threshold, yield and capacity of a surplus, padding of a scale.
TINY, NEAR, NET_YIELD, CAPACITY, PADDING = 0.005, 0.45, 0.015, 4, 0.12


def periods(panel: DataFrame, months: DataFrame) -> DataFrame:
    """(company_id, month, period): the months of panel that have a breakdown (months), in the periods 3M, 6M and YTD;
    the year is that of the company's last such month."""
    rows = panel.select("company_id", "month").join(months.select("company_id", "month").distinct(), ["company_id", "month"], "left_semi")
    w = Window.partitionBy("company_id")
    rows = rows.withColumns({"back": F.row_number().over(w.orderBy(F.col("month").desc())), "year": F.year(F.max("month").over(w))})
    in_period = F.array(F.when(F.col("back") <= 3, "3M"), F.when(F.col("back") <= 6, "6M"), F.when(F.year("month") == F.col("year"), "YTD"))
    return rows.select("company_id", "month", F.explode(F.filter(in_period, lambda x: x.isNotNull())).alias("period"))


def shown_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of lines of which some amount is worth showing."""
    return lines.groupBy(*keys).agg(F.max(F.abs("amount")).alias("most")).where(F.col("most") >= TINY).select(*keys)


def suggestions(rows: DataFrame, name: str, needle: str, taken: str | None = None, limit: int = 8) -> DataFrame:
    """The first companies whose name, sector or id holds the needle, whatever its case, but for the one that is taken."""
    text = F.lower(F.concat_ws(" ", name, "sector", "company_id"))
    met = rows.where(text.contains(needle.strip().lower()) & ((F.col("company_id") != taken) if taken else F.lit(True)))
    return met.orderBy("company_id").limit(limit)


def by_impact(board: DataFrame) -> DataFrame:
    """The board with places: the worst impact first, unknown ones last."""
    return placed(board, F.col("impact").asc_nulls_last(), F.col("company_id").asc())


def benchmarks(peers: DataFrame) -> DataFrame:
    """Medians of each sector: score, delta3, runway, and days of sales among those that have any."""
    values = {"score_med": F.col("score"), "delta3_med": F.col("delta3"), "runway_med": F.col("runway"), "dso_med": F.when(F.col("dso") > 0, F.col("dso"))}
    each = peers.select("sector", F.inline(F.array(*(F.struct(F.lit(n).alias("of"), v.cast("double").alias("x")) for n, v in values.items()))))
    middle = quantiles_by(each, ["sector", "of"], "x", {"m": 0.5}).groupBy(F.col("sector").alias("_s")).agg(*(F.max(F.when(F.col("of") == n, F.col("m"))).alias(n) for n in values))
    counts = peers.groupBy("sector").agg(F.count(F.lit(1)).alias("peers"))
    return counts.join(middle, F.col("sector").eqNullSafe(F.col("_s")), "left").drop("_s")


def verdict(value: Column, median: Column, invert: bool = False) -> Column:
    """Better, worse or about as good as the median; less is better if inverted. Nothing to compare with is flat."""
    d = value - median
    better = d < 0 if invert else d > 0
    return F.when(d.isNull() | (F.abs(d) < NEAR), "flat").when(better, "up").otherwise("down")


def median_series(histories: DataFrame) -> DataFrame:
    """(sector, place, median): medians of histories(sector, history) by place in the array, one decimal; places that
    nobody has are left out."""
    return histories.select("sector", F.posexplode("history").alias("place", "x")).where("x is not null").groupBy("sector", "place").agg((F.floor(F.median("x") * 10 + 0.5) / 10).alias("median"))


def clients_by_state(offers: DataFrame, needle: str) -> DataFrame:
    return offers.where(F.lower("client").contains(needle.strip().lower())).groupBy("company_id", "state").agg(F.count(F.lit(1)).alias("n"))


def surety_capacity(surplus: Column) -> Column:
    return F.when(surplus > 0, surplus * CAPACITY)


def checklist(book: DataFrame) -> DataFrame:
    """(company_id, client, place, item): one row for each thing that keeps a client's file from being complete, numbered by
    place: first those that follow from the client's own figures, which differ by client, then the same few for everybody."""
    rule = lambda cond, text: F.when(cond, text)
    items = F.array(
        rule(F.col("n_collected") < 8, F.concat(F.lit("collections: "), F.col("n_collected").cast("string"), F.lit(" of 8"))), rule(F.col("relation_months") < 6, F.concat(F.lit("months of relation: "), F.col("relation_months").cast("string"), F.lit(" of 6"))),
        rule(F.col("mean_delay") > 45, F.concat(F.lit("delay: "), F.format_number("mean_delay", 0), F.lit(" days, 45 at most"))), rule(F.coalesce(F.col("peak"), F.lit(0)) == 0, F.lit("no earlier debt to go by")), F.lit("annual accounts"), F.lit("defaults and lawsuits"),
    )
    return book.select("company_id", "client", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("place", "item"))


def actions(forecast: DataFrame) -> DataFrame:
    """Of each forecast: what a surplus would yield in a year and a month, how deep the gap is and how many days it lasts."""
    days = F.greatest(F.lit(1), F.datediff(F.coalesce("break_to", "low_date"), "break_from") + 1)
    yearly = F.coalesce(F.col("surplus") * NET_YIELD, F.lit(0.0))
    hole = F.when(F.col("break_from").isNotNull(), F.abs(F.col("low").cast("double"))).otherwise(0.0)
    return forecast.select("company_id", yearly.alias("yearly_yield"), (yearly / 12).alias("monthly_yield"), hole.alias("hole"), F.when(F.col("break_from").isNotNull(), days).otherwise(0).cast("long").alias("gap_days"))


def scaled(series: DataFrame, pad: float = PADDING) -> DataFrame:
    """(id, month, value, position): values of a series on a scale from 0 to 1 that leaves some room at both ends; where
    all are equal, the span is 1."""
    w = Window.partitionBy("id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    return series.select("id", "month", "value", safe_div(F.col("value") - (lo - span * pad), span * (1 + 2 * pad)).alias("position"))


def export_rows(panel: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row per company for a page that needs no server: number of its first month among all, length, and each column
    as an array with three decimals (null for what isn't a number), as JSON."""
    month = panel.agg(F.min("month").alias("first"))
    rows = panel.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("month", *(F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), 3).alias(c) for c in columns)))).alias("p"), F.min("month").alias("m"))
    arrays = F.struct(*(F.col("p")[c].alias(c) for c in columns))
    return rows.join(F.broadcast(month), F.lit(True)).select("company_id", (F.year("m") * 12 + F.month("m") - F.year("first") * 12 - F.month("first")).cast("long").alias("m0"), F.size("p").cast("long").alias("n"), F.to_json(arrays, {"ignoreNullFields": "false"}).alias("data"))
