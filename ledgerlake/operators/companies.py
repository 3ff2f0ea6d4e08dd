"""What is served about one company or all of them: sheets, decisions, directory, history, comparisons, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import latest
from ledgerlake.operators.score import pillar_of

# Months that a projection and a sheet show, forms of inputs, open states of a lead.
COMPANY_ID, MONTH = r"^COMP_\d{4}$", r"^\d{4}-\d{2}(-\d{2})?$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TRENDS = {"improving": "up", "deteriorating": "down"}


@dataclass(frozen=True)
class Veto:
    """A fact that rules over the score: ``when`` is a condition over the columns of health and facts."""

    code: str
    label: str
    text: str
    blocks: bool
    liftable: bool
    when: Column


def decisions(health: DataFrame, facts: DataFrame, vetoes: list[Veto]) -> DataFrame:
    """One decision for each company and month of health(company_id, month, score, band): action, reason, vetoes.

    Every month with a score needs its row of facts: if one is missing, both don't come from the same run, an error.
    """
    keys = ["company_id", "month"]
    orphans = health.join(facts, keys, "left_anti").limit(1).count()
    if orphans:
        raise ValueError("there are months with a score but without facts")
    found = F.filter(F.array(*(F.when(v.when, F.struct(F.lit(v.code).alias("code"), F.lit(v.label).alias("label"), F.lit(v.text).alias("text"), F.lit(v.blocks).alias("blocks"), F.lit(v.liftable).alias("liftable"))) for v in vetoes)), lambda x: x.isNotNull())
    rows = health.join(facts.drop("score", "band"), keys).withColumn("vetoes", found)
    blocking = F.filter("vetoes", lambda x: x["blocks"])
    action = F.when(F.size(blocking) > 0, "decline").when(F.col("band") == "healthy", "lend").when(F.col("band") == "watch", "watch").otherwise("decline")
    reason = F.when(F.size(blocking) > 0, F.get(blocking, F.lit(0))["text"]).otherwise(F.concat(F.lit("band "), F.col("band")))
    return rows.select(*keys, "band", action.alias("action"), reason.alias("reason"), "vetoes")


def decision_at(decided: DataFrame, month: str | None = None) -> DataFrame:
    """Each company's decision of a month (its first day, or a date), or without one its latest."""
    return decided.where(F.col("month") == F.to_date(F.lit(month if month is None or len(month) > 7 else f"{month}-01"))) if month else latest(decided, ["company_id"], "month")


def of_version(drivers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Drivers of the version that was published last; versions of drivers live side by side."""
    version = catalogue.agg(F.max_by("score_version", "published_at").alias("score_version"))
    return drivers.join(F.broadcast(version), "score_version", "left_semi")


def sheet(series: DataFrame, drivers: DataFrame, decided: DataFrame, features: DataFrame, places: int = 2) -> DataFrame:
    """Signals of each company's last scored month, the one that adds least first, with its decision and what the
    catalogue features(feature, formula, weight) says. A signal that the catalogue lacks stays, with nulls."""
    last = latest(series, ["id"], "month").select(F.col("id").alias("company_id"), "month", F.col("value").alias("score"))
    signals = last.join(drivers.withColumnRenamed("id", "company_id"), ["company_id", "month"]).join(F.broadcast(features), "feature", "left")
    signals = signals.join(decided.select("company_id", "month", "action"), ["company_id", "month"], "left")
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("contribution").asc_nulls_last(), "feature"))
    return signals.select("company_id", "month", "score", "action", place.cast("long").alias("place"), "feature", pillar_of(F.col("feature")).alias("pillar"), F.round("contribution", places).alias("points"), "formula", "weight")


def ends_of_sheet(signals: DataFrame, n: int = 4) -> DataFrame:
    """(company_id, side, place, feature, points): the n signals that take most, and the n that add most, largest first."""
    w = Window.partitionBy("company_id")
    rows = signals.withColumn("back", F.count(F.lit(1)).over(w) - F.col("place") + 1)
    sides = F.explode(F.array(F.struct(F.lit("takes").alias("side"), F.col("place").alias("at")), F.struct(F.lit("adds").alias("side"), F.col("back").alias("at")))).alias("s")
    return rows.select("company_id", "feature", "points", sides).where(F.col("s.at") <= n).select("company_id", "s.side", F.col("s.at").alias("place"), "feature", "points")


def last_months(series: DataFrame, n: int = 12) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("id").orderBy(F.col("month").desc()))
    return series.withColumn("back", back).where(F.col("back") <= n).drop("back")


def first_changes(changes: DataFrame, n: int = 8) -> DataFrame:
    """The n largest changes of each month, with their place."""
    place = F.row_number().over(Window.partitionBy("id", "month").orderBy(F.abs("delta_points").desc(), "feature"))
    return changes.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def summaries(view: DataFrame, alert: Column, score_band: str | None = None) -> DataFrame:
    """The portfolio as it is listed: by score and id, of one band or all; dormant companies had no movement at all."""
    rows = view.where(F.col("band") == score_band) if score_band else view
    trend = F.when(F.col("delta3") >= 3, "up").when(F.col("delta3") <= -3, "down").otherwise("flat")
    return rows.select("company_id", "score", "band", "delta3", trend.alias("trend"), (F.col("n_tx") == 0).alias("dormant"), alert.alias("alert"), "currency", "n_months")


def trend_of(c: Column) -> Column:
    """Published words for the direction; whatever is unknown is flat."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TRENDS.items() for x in pair)), c), F.lit("flat"))


def directory(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    return companies.select("company_id", "group_id", "country", "currency", "erp").join(profiles.select("company_id", "top_sector"), "company_id", "left")


def featured_directory(featured: DataFrame, companies: DataFrame) -> DataFrame:
    """The curated companies, also those whose identity is unknown."""
    return featured.select("company_id", "display_name", F.col("sector").alias("top_sector"), "display_order").join(companies.select("company_id", "group_id", "country", "currency", "erp"), "company_id", "left")


def details(companies: DataFrame, panel: DataFrame, series: DataFrame, products: DataFrame, profiles: DataFrame, sector_stats: DataFrame) -> DataFrame:
    """Of each company how many months its panel, its scores and its sector have, and its accounts' currencies in order."""
    months = panel.groupBy("company_id").agg(F.count(F.lit(1)).alias("panel_months"), F.max("month").alias("last_month"))
    scored = series.groupBy(F.col("id").alias("company_id")).agg(F.count(F.lit(1)).alias("scored_months"))
    money = products.where("currency is not null").groupBy("company_id").agg(F.array_join(F.sort_array(F.collect_set("currency")), ",").alias("currencies"))
    sector = sector_stats.groupBy(F.col("sector").alias("top_sector")).agg(F.count(F.lit(1)).alias("sector_months"))
    out = companies.select("company_id").join(profiles.select("company_id", "top_sector"), "company_id", "left")
    for df in (months, scored, money):
        out = out.join(df, "company_id", "left")
    out = out.join(sector, "top_sector", "left")
    return out.select("company_id", "top_sector", "last_month", F.coalesce("currencies", F.lit("")).alias("currencies"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("panel_months", "scored_months", "sector_months")))


def monthly_stats(series: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(month, n, mean, median) of scores, of all companies or of those in scope(id)."""
    rows = series.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = rows.join(scope.select("id").distinct(), "id", "left_semi") if scope is not None else rows
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"))


def shared_months(series: DataFrame, a: str, b: str) -> DataFrame:
    """(month, a, b): two companies' scores in the months that both have."""
    of = lambda name, x: series.where(F.col("id") == x).select("month", F.col("value").alias(name))
    return of("a", a).join(of("b", b), "month")


def beside_scope(series: DataFrame, a: str, stats: DataFrame) -> DataFrame:
    """(month, value, mean): a company's scores beside the mean of its scope, in the months that both have."""
    return series.where(F.col("id") == a).select("month", "value").join(stats.select("month", "mean"), "month")


def ahead_with_peers(company: DataFrame, sectors: DataFrame, peers: DataFrame) -> DataFrame:
    """(id, month, value, peer): projections of companies with that of their sector, which stops for good at the first
    month that the sector lacks."""
    rows = company.join(sectors, "id").join(peers.select(F.col("id").alias("sector"), "month", F.col("value").alias("peer")), ["sector", "month"], "left")
    so_far = Window.partitionBy("id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.min(F.col("peer").isNotNull().cast("int")).over(so_far) == 1
    return rows.select("id", "month", "value", F.when(whole, F.col("peer")).alias("peer"))


def cash_bundle(companies: DataFrame, panel: DataFrame, categories: DataFrame, forecast: DataFrame, action: DataFrame) -> DataFrame:
    """Of each company: months of cash flow, months and categories of its breakdown, what the forecast says, the action."""
    flows = panel.groupBy("company_id").agg(F.count(F.lit(1)).alias("months"), F.max_by("cash_end", "month").alias("cash_end"))
    parts = categories.groupBy("company_id").agg(F.count_distinct("month").alias("category_months"), F.count_distinct("category").alias("categories"))
    out = companies.select("company_id", "currency").join(flows, "company_id", "left").join(parts, "company_id", "left").join(forecast.select("company_id", "low", "low_date", "break_from"), "company_id", "left").join(action.select("company_id", "action"), "company_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("months", "category_months", "categories")})


def client_books(companies: DataFrame, books: DataFrame, forecast: DataFrame) -> DataFrame:
    """Of each company its sales, clients and surety line, nought where it has none, and the surplus that is forecast."""
    out = companies.select("company_id").join(books.select("company_id", "sales_12m", "clients", "line"), "company_id", "left").join(forecast.select("company_id", "surplus"), "company_id", "left")
    return out.withColumns({"sales_12m": F.coalesce("sales_12m", F.lit(0)), "clients": F.coalesce("clients", F.lit(0))})


CATALOGUE = "score_version string, weights map<string,double>, features map<string,struct<label:string,pillar:string,formula:string>>, vetoes array<struct<code:string,label:string,text:string,blocks:boolean,liftable:boolean>>"


def catalogue_features(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """(score_version, feature, weight, label, pillar, formula) of a catalogue's JSON document; weights rule, meanings
    may be missing."""
    c = documents.select(F.from_json(payload, CATALOGUE).alias("c")).select("c.*")
    rows = c.select("score_version", "features", F.explode("weights").alias("feature", "weight"))
    return rows.select("score_version", "feature", "weight", *(F.try_element_at("features", F.col("feature"))[x].alias(x) for x in ("label", "pillar", "formula")))


def catalogue_vetoes(documents: DataFrame, payload: str = "payload") -> DataFrame:
    return documents.select(F.from_json(payload, CATALOGUE).alias("c")).select("c.score_version", F.inline("c.vetoes"))


def top_weights(features: DataFrame, n: int = 10) -> DataFrame:
    """(label, percent): the n largest weights in percent, one decimal; a feature without a label goes by its name."""
    return features.orderBy(F.col("weight").desc(), "feature").limit(n).select(F.coalesce("label", "feature").alias("label"), (F.floor(F.col("weight") * 1000 + 0.5) / 10).alias("percent"))


def valid(kind: str, c: Column) -> Column:
    """Whether an input of a kind is well-formed; null isn't."""
    rule = {"company": c.rlike(COMPANY_ID), "month": c.rlike(MONTH), "uuid": c.rlike(UUID), "band": c.isin("healthy", "watch", "risk"), "status": c.isin("new", "contacted", "meeting", "closed")}[kind]
    return F.coalesce(rule, F.lit(False))


def profiles(rows: DataFrame, as_of: str, version: str) -> DataFrame:
    """Operating profiles from text columns: sectors from a|b|c, numbers where they are numbers, empty text as null."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    sectors = F.filter(F.transform(F.split(F.coalesce("sector_set", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("company_id", "group_id", text("business_kind").alias("business_kind"), sectors.alias("sectors"), text("top_sector").alias("top_sector"), text("top_sector_score").cast("double").alias("top_sector_score"), text("regime_id").cast("int").alias("regime_id"), F.lit(as_of).cast("date").alias("as_of_month"), F.lit(version).alias("profile_version"))


def featured(curated: DataFrame, profile: DataFrame, health: DataFrame) -> DataFrame:
    """A curated list with each company's profile and its latest health; those without either drop out."""
    return curated.join(profile.select("company_id", "top_sector", "business_kind"), "company_id").join(latest(health, ["company_id"], "month"), "company_id")


def recordset(documents: DataFrame, c: str, schema: str) -> DataFrame:
    """The rows of JSON arrays of objects; members that are missing are null."""
    return documents.select(F.inline(F.from_json(c, f"array<struct<{schema}>>")))


def insert_missing(table: DataFrame, new: DataFrame, keys: list[str], among: Column | None = None) -> DataFrame:
    """table with the rows of new whose keys no row of it has (of those for which ``among`` holds)."""
    known = (table.where(among) if among is not None else table).select(*keys)
    return table.unionByName(new.join(known, keys, "left_anti"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule; an unknown result isn't a breach, as in a CHECK constraint."""
    return df.agg(F.array(*(F.struct(F.lit(k).alias("rule"), F.count_if(~v).alias("n")) for k, v in rules.items())).alias("x")).select(F.inline("x"))


def repeated_keys(df: DataFrame, keys: list[str], among: Column | None = None) -> DataFrame:
    """Keys that several rows have (of those for which ``among`` holds): what a unique index would refuse."""
    rows = df.where(among) if among is not None else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
