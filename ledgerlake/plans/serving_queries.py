"""Queries of scores and of the views that are served, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import score as S
from ledgerlake.operators import serving as V
from ledgerlake.operators import text as X
from ledgerlake.operators.panel import company_static
from ledgerlake.plans.bindings import HORIZON
from ledgerlake.plans.mapping_queries import mapped, mapped_ctes
from ledgerlake.plans.panel_queries import Domain, panel_ctes, rounded
from ledgerlake.plans.risk_queries import _CATS, _FC, Forecast, _categories


def scores(d: Domain) -> DataFrame:
    """A score of 0 to 100 for each month with three months of flows."""
    value = F.round(F.least(F.greatest(50 + 40 * F.col("margin_3m"), F.lit(0.0)), F.lit(100.0)), 1)
    return d.panel.where("margin_3m is not null").select("company_id", "month", value.alias("score"))


def series(d: Domain) -> DataFrame:
    return scores(d).select(F.col("company_id").alias("id"), "month", F.col("score").alias("value"))


def sectors(d: Domain) -> DataFrame:
    return d.companies.select(F.col("company_id").alias("id"), F.col("group_id").alias("sector"))


def drivers(d: Domain) -> DataFrame:
    """Contributions of four features, one of them in no pillar."""
    parts = {"runway": F.least("runway_m", F.lit(20.0)), "debt_burden": -10 * F.col("debt_service_ratio_3m"), "transfer_dep": F.col("transfer_net").cast("double") / 100000, "activity_trend": F.when(F.col("n_tx") % 7 != 0, F.col("n_tx") * 0.1), "house_rule": 5 * F.col("margin_3m")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.round(v, 3).alias("contribution")) for k, v in parts.items()))).alias("x")
    return d.panel.select(F.col("company_id").alias("id"), "month", each).select("id", "month", "x.*")


def _portfolio(d: Domain) -> DataFrame:
    return V.portfolio(d.full(), scores(d), company_static(d.companies, d.debt, d.invoices, d.rows, d.anchors, d.panel).withColumn("has_erp", F.col("erp").isNotNull()))


def _board(spark: SparkSession, sf_dir: str, d: Domain | None = None) -> DataFrame:
    d = d or Domain(spark, sf_dir)
    return V.board(_portfolio(d), Forecast(spark, sf_dir, d).result(), d.panel)


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped(spark, sf_dir, "invoices").where("amount > 0 and counterparty_id is not null")
    return rows.select("company_id", F.col("counterparty_id").alias("client"), F.trunc("issuance_date", "month").alias("month"), F.round("amount", 2).cast("decimal(20,2)").alias("amount"))


def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("message"), F.col("event_id").alias("seq"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("slot"), F.when(F.col("user_id") % 4 == 0, F.when(F.col("event_type") == "click", "table").otherwise("bars")).otherwise("bars").alias("kind"))


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return V.merged(orders, orders.where("o_orderkey % 3 = 0").withColumn("price", F.round(F.col("price") * 2, 2)), ["o_orderkey"])


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    team = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("employee_id"))
    leads = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 120).alias("assigned_to"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    return V.assign(leads, team)


def _uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids of customers: the first 16 bytes of a SHA-1 with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.col("c_name").cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", parts.alias("uuid"))


_D = lambda f: lambda spark, sf_dir: f(Domain(spark, sf_dir))
QUERIES = {
    "sc01_projection": _D(lambda d: S.project(series(d))), "sc02_trailing_run": _D(lambda d: S.trailing_run(series(d).where("month(month) <> 1 or year(month) < 2000"))), "sc04_smoothing": _D(lambda d: S.smoothed(series(d)).withColumn("ewma", F.round(F.col("ewma") + 1e-7, 4))),
    "sc05_pillars": _D(lambda d: S.pillars(drivers(d), ["id", "month"]).withColumn("contribution", F.round("contribution", 3)).withColumn("label", S.contribution_label(F.col("contribution")))),
    "sc07_aligned": _D(lambda d: rounded(S.aligned(series(d), sectors(d), S.sector_stats(series(d), sectors(d)), "median"), 4)), "sc09_features": _D(lambda d: rounded(S.features(d.panel), 4)),
    "sc09_client_features": lambda s, d: rounded(S.client_features(_sales(s, d), Domain(s, d).flows), 4), "ap07_attribution": _D(lambda d: S.attribution(drivers(d), series(d))), "ap08_summaries": _D(lambda d: S.summaries(S.attribution(drivers(d), series(d)), series(d))),
    "vw03_flows": _D(lambda d: rounded(_portfolio(d).select("company_id", F.inline("flows")))), "vw04_history": _D(lambda d: _portfolio(d).select("company_id", F.posexplode("history").alias("place", "score"))), "vw06_portfolio": _D(lambda d: rounded(_portfolio(d).drop("flows", "history"))),
    "vw13_sector_stats": _D(lambda d: rounded(S.sector_stats(series(d), sectors(d)), 4)), "ap02_alerts": _D(lambda d: _portfolio(d).select("company_id", V.alert(F.col("band"), F.col("delta3"), F.col("n_months") / 200.0).alias("alert"))),
    "ap12_board": lambda s, d: rounded(_board(s, d)), "ap16_status_counts": lambda s, d: V.counts_of(_board(s, d), "status", ("alert", "opportunity", "watch", "paused")),
    "ag05_search": _D(lambda d: V.search(_portfolio(d), d.companies.where("currency = 'EUR'"), "fall", 8)), "ag07_table_stats": _D(lambda d: V.table_stats(_portfolio(d))),
    "ag09_last_charts": lambda s, d: V.last_per_slot(_charts(s, d)), "ag10_sections": lambda s, d: V.sections(s.read.parquet(f"{d}/conversations.parquet")), "tx01_blocks": lambda s, d: X.blocks(s.read.parquet(f"{d}/documents.parquet"), "doc_id", "text"),
    "ui01_statement": _D(lambda d: rounded(V.statement(_categories(d), d.panel))), "snk03_upsert": _upsert, "cr02_uuid5": _uuid5, "cr04_assignment": _leads,
    "ch04_coverage": _D(lambda d: d.cash.groupBy("month").agg(F.count(F.lit(1)).alias("companies"), F.round(F.median("cash_end")).alias("median_cash"), F.count_if(F.col("cash_end") < 0).alias("negative"))),
}

_SCORES = "scores AS (SELECT company_id, month, round(least(greatest(50 + 40 * margin_3m, 0), 100), 1) AS score FROM panel WHERE margin_3m IS NOT NULL)"
_SERIES = "series AS (SELECT company_id AS id, month, score AS value, group_id AS sector FROM scores JOIN raw_companies USING (company_id))"
_DRIVERS = "drivers AS (" + " UNION ALL ".join(f"SELECT company_id AS id, month, '{k}' AS feature, round({v}, 3) AS contribution FROM panel" for k, v in {"runway": "CASE WHEN runway_m IS NULL THEN 20.0 ELSE least(runway_m, 20.0) END", "debt_burden": "-10 * debt_service_ratio_3m", "transfer_dep": "CAST(transfer_net AS DOUBLE) / 100000", "activity_trend": "CASE WHEN n_tx % 7 <> 0 THEN n_tx * CAST(0.1 AS DOUBLE) END", "house_rule": "5 * margin_3m"}.items()) + ")"
_P = f"{panel_ctes('panel')}, {_SCORES}, {_SERIES}, {_DRIVERS}"
_STEPS = "steps AS (SELECT * FROM (SELECT id, month, lag(month) OVER w AS before, round(CAST(value AS DECIMAL(20, 4)) - lag(CAST(value AS DECIMAL(20, 4))) OVER w, 2) AS delta FROM series WINDOW w AS (PARTITION BY id ORDER BY month)) s WHERE before IS NOT NULL)"
_MOVED = "moved AS (SELECT s.id, s.month, f.feature, round(coalesce(CAST(n.contribution AS DECIMAL(20, 4)), 0) - coalesce(CAST(t.contribution AS DECIMAL(20, 4)), 0), 2) AS delta_points FROM steps s JOIN (SELECT DISTINCT feature FROM drivers) f ON true LEFT JOIN drivers n ON n.id = s.id AND n.month = s.month AND n.feature = f.feature LEFT JOIN drivers t ON t.id = s.id AND t.month = s.before AND t.feature = f.feature)"
_CHANGES = "changes AS (SELECT * FROM (SELECT * FROM moved UNION ALL SELECT s.id, s.month, 'rules', round(s.delta - coalesce(sum(m.delta_points), 0), 2) FROM steps s LEFT JOIN moved m ON m.id = s.id AND m.month = s.month GROUP BY s.id, s.month, s.delta) c WHERE abs(delta_points) >= 0.05)"
_BAND = "CASE WHEN score >= 65 THEN 'healthy' WHEN score >= 35 THEN 'watch' WHEN score IS NOT NULL THEN 'risk' END"
_F = f"{panel_ctes('fullpanel', 'anchors')}, {_SCORES}"
_VIEW = f"""{_F},
static AS (SELECT c.company_id, group_id, currency, erp, debt_outstanding, debt_util FROM raw_companies c LEFT JOIN (SELECT company_id, sum(abs(outstanding)) AS debt_outstanding, least(greatest(sum(abs(outstanding)) / sum(abs(granted)), 0), 1) AS debt_util FROM raw_debt_products WHERE abs(granted) > 0 GROUP BY company_id) d ON d.company_id = c.company_id),
ranked AS (SELECT *, lag(runway_m, 3) OVER (PARTITION BY company_id ORDER BY month) AS runway_prev, lag(dso, 3) OVER (PARTITION BY company_id ORDER BY month) AS dso_prev, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM fullpanel),
health AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn, score - lag(score, 3) OVER (PARTITION BY company_id ORDER BY month) AS delta3, count(*) OVER (PARTITION BY company_id) AS n_months FROM scores),
view AS (SELECT h.company_id, h.month AS last_month, round(score, 1) AS score, {_BAND} AS band, round(delta3, 1) AS delta3, n_months, group_id, coalesce(currency, 'EUR') AS currency, erp IS NOT NULL AS has_erp, debt_outstanding, debt_util, cash_end, runway_m AS runway_now, runway_prev, dso AS dso_now, dso_prev, round(pct_overdue * 100, 1) AS overdue_share, margin_3m, debt_service_ratio_3m, coalesce(n_tx, 0) AS n_tx
  FROM health h LEFT JOIN static s ON s.company_id = h.company_id LEFT JOIN ranked p ON p.company_id = h.company_id AND p.rn = 1 WHERE h.rn = 1)"""
def _REPAIRED(source: str) -> str:  # noqa: N802
    """Common table expressions up to repaired(id, text) from source(id, x0)."""
    out = f"WITH r0 AS ({source})"
    marks = [*X.PAIRED, *X.SINGLE]
    for k, m in enumerate(marks):
        x, n = f"x{k}", len(m)
        at = f"(length({x}) - instr(reverse({x}), '{m}') - {n - 2})"
        before, after = f"substr({x}, 1, {at} - 1)", f"substr({x}, {at} + {n})"
        counted = x if n == 2 or m == "`" else f"replace({x}, '{m * 2}', '')"
        odd = f"((length({counted}) - length(replace({counted}, '{m}', ''))) // {n}) % 2 = 1 AND NOT contains({after}, chr(10))"
        alone = "" if m in X.PAIRED else f" AND NOT ends_with({before}, '{m}') AND NOT starts_with({after}, '{m}')"
        out += f", r{k + 1} AS (SELECT id, CASE WHEN {odd}{alone} THEN {before} || {after} ELSE {x} END AS x{k + 1} FROM r{k})"
    return out + f", repaired AS (SELECT id, x{len(marks)} AS text FROM r{len(marks)})"


_TWO = lambda cols: ", ".join(f"CAST(round({c}, 2) AS DOUBLE) + 0.0 AS {c}" for c in cols)
_BOARD = f"""{panel_ctes("panel", "invoices", "fullpanel", "anchors")}{_FC[len(panel_ctes("panel", "invoices")) :]}{_VIEW[len(panel_ctes("fullpanel", "anchors")) :]},
last AS (SELECT company_id, net_op FROM (SELECT company_id, net_op, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM panel) p WHERE rn = 1),
fc AS (SELECT l.company_id, CAST(l.level AS DOUBLE) AS low, l.day AS low_date, l.break_from IS NOT NULL AS has_break, coalesce(h.spend, 0) AS spend, l.break_from IS NULL AND spend > 0 AND CAST(level AS DOUBLE) - spend >= 25000 AS has_surplus FROM lows l LEFT JOIN habits h ON h.company_id = l.company_id),
bd AS (SELECT v.company_id, band, coalesce(has_break, false) AS has_break, coalesce(has_surplus, false) AS has_surplus, CASE WHEN runway_now >= 0 AND runway_now <= 36 THEN runway_now END AS runway, CAST(net_op AS DOUBLE) AS net_op, CAST(floor(low - spend + 0.5) AS BIGINT) AS impact, low_date, last_month, CAST(cash_end AS DOUBLE) AS cash FROM view v LEFT JOIN fc ON fc.company_id = v.company_id LEFT JOIN last l ON l.company_id = v.company_id),
boarded AS (SELECT company_id, band, CASE WHEN has_break THEN 'alert' WHEN runway < 1 THEN 'alert' WHEN net_op < 0 AND (runway IS NULL OR runway < 3) THEN 'alert' WHEN has_surplus AND band = 'healthy' THEN 'opportunity' ELSE 'watch' END AS status, impact, date_diff('day', last_day(last_month), low_date) AS urgency_days,
  CASE WHEN impact < 0 THEN 'finance' WHEN impact >= 25000 AND NOT coalesce(band = 'risk', false) THEN 'place' ELSE 'follow' END AS suggestion, CASE WHEN has_break THEN 'finance' WHEN has_surplus AND band <> 'risk' THEN 'place' END AS action, round(CASE WHEN abs(cash) <= 1e8 THEN cash END, 2) + 0.0 AS cash_end, round(runway, 2) + 0.0 AS runway_m FROM bd)"""
_FEAT = lambda c, n: f"CASE WHEN count({c}) OVER w{n} = {n} THEN avg({c}) OVER w{n} END"
_SUM3 = lambda c: f"CASE WHEN count({c}) OVER w3 = 3 THEN sum({c}) OVER w3 END"
_CASE = " ".join(f"WHEN '{c}' THEN '{g}|{line}'" for g, lines in V.LINES.items() for line, cats in lines.items() for c in cats)
_PILLAR = " ".join(f"WHEN '{f}' THEN '{p}'" for p, fs in S.PILLARS.items() for f in fs)
ORACLE_SQL = {
    "sc01_projection": f"""{_P}, n AS (SELECT id, month, value, row_number() OVER (PARTITION BY id ORDER BY month) AS i, count(*) OVER (PARTITION BY id) AS n, value - lag(value) OVER (PARTITION BY id ORDER BY month) AS dv, (year(month) * 12 + month(month)) - row_number() OVER (PARTITION BY id ORDER BY month) AS island FROM series),
run AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY month) AS j, count(*) OVER (PARTITION BY id) AS m FROM (SELECT *, max(island) OVER (PARTITION BY id) AS top FROM n) z WHERE island = top),
tr AS (SELECT id, max(month) AS top_month, arg_max(value, month) AS level, sum(CASE WHEN j = 2 THEN dv * pow(0.56, m - 2) WHEN j > 2 THEN 0.3 * dv * pow(0.56, m - j) ELSE 0 END) AS trend FROM run WHERE m >= 4 GROUP BY id)
SELECT id, CAST(top_month + INTERVAL (k) MONTH AS DATE) AS month, CAST(round(least(greatest(level + d * trend, 0), 100), 1) AS DOUBLE) AS value FROM tr, (SELECT 1 AS k, 0.8 AS d UNION ALL SELECT 2, 1.44 UNION ALL SELECT 3, 1.952) s""",
    "sc02_trailing_run": f"{_P}, n AS (SELECT id, month, value, (year(month) * 12 + month(month)) - row_number() OVER (PARTITION BY id ORDER BY month) AS island FROM series WHERE month(month) <> 1 OR year(month) < 2000) SELECT id, month, value FROM (SELECT *, max(island) OVER (PARTITION BY id) AS top FROM n) z WHERE island = top",
    "sc04_smoothing": f"{_P}, n AS (SELECT id, month, value, row_number() OVER (PARTITION BY id ORDER BY month) AS i FROM series) SELECT a.id, a.month, a.value, round((SELECT sum(b.value * CASE WHEN b.i = 1 THEN pow(0.5, a.i - 1) ELSE 0.5 * pow(0.5, a.i - b.i) END) FROM n b WHERE b.id = a.id AND b.i <= a.i) + 0.0000001, 4) AS ewma FROM n a",
    "sc05_pillars": f"{_P}, p AS (SELECT id, month, CASE feature {_PILLAR} ELSE 'additional' END AS pillar, count(*) AS n_drivers, CAST(round(CASE WHEN count(contribution) = count(*) THEN sum(contribution) END, 3) AS DOUBLE) AS contribution FROM drivers GROUP BY 1, 2, 3) SELECT *, CASE WHEN contribution IS NULL THEN 'no contribution' WHEN abs(contribution) < 0.05 THEN '0,0' ELSE CASE WHEN contribution > 0 THEN '+' ELSE '-' END || replace(printf('%.1f', round(abs(contribution), 1)), '.', ',') END AS label FROM p",
    "sc07_aligned": f"{_P}, st AS (SELECT sector, month, count(*) AS n, median(value) AS med FROM series GROUP BY 1, 2) SELECT id, s.month, value, round(med, 4) AS sector_value, n FROM series s JOIN st ON st.sector = s.sector AND st.month = s.month",
    "sc09_features": f"""{panel_ctes("panel")}, b AS (SELECT company_id, month, CAST(n_tx AS DOUBLE) AS n_tx, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("cash_end", "outflow_op", "inflow_op", "net_op", "debt_service", "out_fin_cost", "out_salary", "transfer_net"))} FROM panel),
c AS (SELECT *, pow(least(net_op, 0), 2) AS deficit2, debt_service + out_fin_cost AS owed, CASE WHEN out_salary > 0 THEN 1.0 ELSE 0.0 END AS paid_staff, CASE WHEN inflow_op >= 0.5 * CASE WHEN count(*) OVER w12 = 12 THEN median(inflow_op) OVER w12 END THEN 1.0 WHEN count(*) OVER w12 = 12 THEN 0.0 END AS persists FROM b WINDOW w12 AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, cash_end / nullif(greatest({_FEAT("outflow_op", 3)}, {_FEAT("outflow_op", 12)}), 0) AS months, {_FEAT("inflow_op", 3)} / nullif({_FEAT("inflow_op", 12)}, 0) AS growth, {_SUM3("owed")} / nullif({_SUM3("inflow_op")}, 0) AS debt_burden, {_FEAT("paid_staff", 6)} AS pc, {_FEAT("n_tx", 3)} / nullif({_FEAT("n_tx", 12)}, 0) AS atr, {_SUM3("transfer_net")} / nullif({_SUM3("inflow_op")}, 0) AS td, sqrt({_FEAT("deficit2", 6)}) / nullif({_FEAT("outflow_op", 6)}, 0) AS nv, {_FEAT("persists", 6)} AS op FROM c WINDOW w3 AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT company_id, month, round(sign(months) * ln(1 + abs(months)), 4) + 0.0 AS runway, round(ln(nullif(growth, 0)), 4) + 0.0 AS oper_growth_12m, round(debt_burden, 4) + 0.0 AS debt_burden, CAST(round(pc, 4) AS DOUBLE) AS payroll_continuity_6m, round(atr, 4) + 0.0 AS activity_trend, round(td, 4) + 0.0 AS transfer_dep, round(nv, 4) + 0.0 AS net_vol_6m, CAST(round(op, 4) AS DOUBLE) AS oper_persistence_6m FROM e""",
    "sc09_client_features": f"""{panel_ctes("flows", "invoices")}, sales AS (SELECT company_id, counterparty_id AS client, CAST(date_trunc('month', issuance_date) AS DATE) AS month, CAST(round(amount, 2) AS DECIMAL(20, 2)) AS amount FROM invoices_mapped WHERE amount > 0 AND counterparty_id IS NOT NULL),
w6 AS (SELECT f.company_id, f.month, client, CAST(sum(amount) AS DOUBLE) AS x FROM flows f JOIN sales s ON s.company_id = f.company_id AND s.month <= f.month AND s.month > f.month - INTERVAL 6 MONTH GROUP BY 1, 2, 3), hhi AS (SELECT company_id, month, sum(x * x) / nullif(sum(x) * sum(x), 0) AS h FROM w6 GROUP BY 1, 2),
c3 AS (SELECT f.company_id, f.month, count(DISTINCT client) AS c FROM flows f JOIN sales s ON s.company_id = f.company_id AND s.month <= f.month AND s.month > f.month - INTERVAL 3 MONTH GROUP BY 1, 2), c12 AS (SELECT f.company_id, f.month, count(DISTINCT client) AS c FROM flows f JOIN sales s ON s.company_id = f.company_id AND s.month <= f.month AND s.month > f.month - INTERVAL 12 MONTH GROUP BY 1, 2)
SELECT f.company_id, f.month, round(h, 4) AS hhi_ar_6m, round(ln(CAST(coalesce(c3.c, 0) + 1 AS DOUBLE) / (coalesce(c12.c, 0) + 1)), 4) + 0.0 AS cust_trend FROM flows f LEFT JOIN hhi ON hhi.company_id = f.company_id AND hhi.month = f.month LEFT JOIN c3 ON c3.company_id = f.company_id AND c3.month = f.month LEFT JOIN c12 ON c12.company_id = f.company_id AND c12.month = f.month""",
    "ap07_attribution": f"{_P}, {_STEPS}, {_MOVED}, {_CHANGES} SELECT id, month, feature, CAST(delta_points AS DOUBLE) AS delta_points FROM changes",
    "ap08_summaries": f"{_P}, {_STEPS}, {_MOVED}, {_CHANGES}, lead AS (SELECT s.id, s.month, c.feature, row_number() OVER (PARTITION BY s.id, s.month ORDER BY abs(delta_points) DESC, feature) AS rn FROM steps s JOIN changes c ON c.id = s.id AND c.month = s.month AND sign(delta_points) = sign(delta)) SELECT s.id, s.month, CAST(delta AS DOUBLE) AS delta, coalesce((SELECT string_agg(feature, ' and ' ORDER BY rn) FROM lead l WHERE l.id = s.id AND l.month = s.month AND rn <= 2), 'small changes') AS why FROM steps s",
    "vw03_flows": f"{_VIEW} SELECT r.company_id, r.month, CAST(round(coalesce(inflow_op, 0), 2) AS DOUBLE) + 0.0 AS \"in\", CAST(round(abs(coalesce(outflow_op, 0)), 2) AS DOUBLE) + 0.0 AS \"out\", CAST(round(coalesce(r.cash_end, 0), 2) AS DOUBLE) + 0.0 AS cash FROM ranked r JOIN view v ON v.company_id = r.company_id WHERE rn <= 12",
    "vw04_history": f"{_VIEW} SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY month) - 1 AS INT) AS place, round(score, 1) AS score FROM health WHERE rn <= 12",
    "vw06_portfolio": f"{_VIEW} SELECT company_id, last_month, {_TWO(['score', 'delta3', 'debt_outstanding', 'debt_util', 'cash_end', 'runway_now', 'runway_prev', 'dso_now', 'dso_prev', 'overdue_share', 'margin_3m', 'debt_service_ratio_3m'])}, band, n_months, group_id, currency, has_erp, n_tx FROM view",
    "vw13_sector_stats": f"{_P} SELECT sector, month, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM series GROUP BY 1, 2",
    "ap02_alerts": f"{_VIEW} SELECT company_id, CASE WHEN delta3 <= -10 THEN 'falls by ' || CAST(CAST(round(-delta3, 0) AS INT) AS VARCHAR) || ' points in 3 months' WHEN band = 'risk' THEN 'in the risk band' WHEN n_months / 200.0 < 0.4 THEN 'too little data' END AS alert FROM view",
    "ag05_search": f"{_VIEW}, r AS (SELECT v.* FROM view v JOIN raw_companies c ON c.company_id = v.company_id WHERE c.currency = 'EUR') SELECT company_id, score, delta3, band, (SELECT count(*) FROM r) AS total FROM r ORDER BY delta3 NULLS LAST, company_id LIMIT 8",
    "ag07_table_stats": f"{_VIEW} SELECT count(*) AS companies, round(avg(score), 1) AS mean_score, CAST(count(*) FILTER (WHERE band = 'risk') AS VARCHAR) || ' (' || CAST(CAST(floor(100.0 * count(*) FILTER (WHERE band = 'risk') / count(*) + 0.5) AS BIGINT) AS VARCHAR) || '%)' AS in_risk, CAST(count(*) FILTER (WHERE delta3 < 0) AS VARCHAR) || ' (' || CAST(CAST(floor(100.0 * count(*) FILTER (WHERE delta3 < 0) / count(*) + 0.5) AS BIGINT) AS VARCHAR) || '%)' AS falling FROM view",
    "ap12_board": f"{_BOARD} SELECT * FROM boarded",
    "ap16_status_counts": f"{_BOARD} SELECT s.status, count(b.company_id) AS n FROM (SELECT 'alert' AS status UNION ALL SELECT 'opportunity' UNION ALL SELECT 'watch' UNION ALL SELECT 'paused') s LEFT JOIN boarded b ON b.status = s.status GROUP BY s.status",
    "tx01_blocks": _REPAIRED("SELECT doc_id AS id, text AS x0 FROM documents") + r""", l AS (SELECT id, unnest(string_split(text, chr(10))) AS raw0, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM repaired),
b AS (SELECT id, line, regexp_replace(raw0, '\s+$', '') AS raw, regexp_replace(regexp_replace(raw0, '\s+$', ''), '^\s+', '') AS bare FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(bare, '^(-{3,}|[*]{3,}|_{3,})$') THEN 'rule' WHEN regexp_matches(bare, '^#{1,4}\s+.*$') THEN 'heading' WHEN regexp_matches(bare, '^>\s?.*$') THEN 'quote' WHEN regexp_matches(bare, '^\d+[.)]\s+.*$') THEN 'ordered' WHEN regexp_matches(bare, '^[-*•]\s+.*$') THEN 'item' ELSE 'paragraph' END AS kind FROM b WHERE bare <> '')
SELECT id, line, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(bare, '^(#{1,4})', 1)) - 1 WHEN kind IN ('ordered', 'item') THEN least(CAST(floor(length(replace(regexp_extract(raw, '^[ \t]*', 0), chr(9), '  ')) / 2) AS BIGINT), 3) END AS depth,
  CASE kind WHEN 'rule' THEN '' WHEN 'heading' THEN regexp_extract(bare, '^#{1,4}\s+(.*)$', 1) WHEN 'quote' THEN regexp_extract(bare, '^>\s?(.*)$', 1) WHEN 'ordered' THEN regexp_extract(bare, '^\d+[.)]\s+(.*)$', 1) WHEN 'item' THEN regexp_extract(bare, '^[-*•]\s+(.*)$', 1) ELSE bare END AS body FROM k""",
    "ag09_last_charts": "WITH c AS (SELECT user_id AS message, event_id AS seq, event_type || CAST(event_id % 3 AS VARCHAR) AS slot, CASE WHEN user_id % 4 = 0 AND event_type = 'click' THEN 'table' ELSE 'bars' END AS kind FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY message, slot ORDER BY seq DESC) AS rn FROM c), k AS (SELECT *, bool_or(kind = 'table') OVER (PARTITION BY message) AS t FROM l WHERE rn = 1) SELECT message, seq, slot, kind FROM k WHERE NOT t OR kind = 'table'",
    "ag10_sections": "SELECT conv_id, turn, coalesce((SELECT trim(q.text) FROM conversations q WHERE q.conv_id = c.conv_id AND q.role = 'user' AND q.turn < c.turn ORDER BY q.turn DESC LIMIT 1), '') AS question, text AS reply, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations c WHERE role <> 'user'",
    "ui01_statement": f"""{panel_ctes("panel")},{_CATS[len(mapped_ctes("transactions")) + 1 :]},
k AS (SELECT company_id, month, amount, CASE category {_CASE} ELSE 'uncategorised|uncategorised' END AS g FROM cats), li AS (SELECT company_id, month, split_part(g, '|', 1) AS line_group, split_part(g, '|', 2) AS line, amount FROM k),
cs AS (SELECT company_id, month, cash_end, CASE WHEN row_number() OVER (PARTITION BY company_id ORDER BY month) > 1 THEN lag(cash_end) OVER (PARTITION BY company_id ORDER BY month) ELSE cash_end - net_bank END AS start FROM panel), both_ AS (SELECT c.company_id, c.month, cash_end, start, total FROM cs c JOIN (SELECT company_id, month, sum(amount) AS total FROM cats GROUP BY 1, 2) t ON t.company_id = c.company_id AND t.month = c.month),
u AS (SELECT company_id, month, line_group, line, sum(amount) AS amount FROM li GROUP BY 1, 2, 3, 4 UNION ALL SELECT company_id, month, line_group, 'subtotal', sum(amount) FROM li GROUP BY 1, 2, 3 UNION ALL SELECT company_id, month, 'balance', 'opening', start FROM both_ UNION ALL SELECT company_id, month, 'balance', 'closing', cash_end FROM both_ UNION ALL SELECT company_id, month, 'balance', 'adjustment', cash_end - start - total FROM both_) SELECT company_id, month, line_group, line, CAST(round(amount, 2) AS DOUBLE) + 0.0 AS amount FROM u""",
    "snk03_upsert": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders",
    "cr02_uuid5": "WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer) SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h",
    "cr04_assignment": "WITH l AS (SELECT s_suppkey AS employee_id, (SELECT count(*) FROM orders WHERE o_custkey % 120 = s_suppkey AND o_orderstatus <> 'F') AS open_leads FROM supplier) SELECT *, row_number() OVER (ORDER BY open_leads, employee_id) = 1 AS is_next FROM l",
    "ch04_coverage": f"{panel_ctes('cash')} SELECT month, count(*) AS companies, CAST(round(median(CAST(cash_end AS DOUBLE)), 0) AS DOUBLE) AS median_cash, count(*) FILTER (WHERE cash_end < 0) AS negative FROM cash GROUP BY month",
}
