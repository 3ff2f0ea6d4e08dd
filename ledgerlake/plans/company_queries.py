"""Queries of sheets, decisions, directories, features, leads, charts and checks, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.columns import latest
from ledgerlake.operators import charts as G
from ledgerlake.operators import checks as H
from ledgerlake.operators import clients as C
from ledgerlake.operators import companies as Y
from ledgerlake.operators import crm as R
from ledgerlake.operators import forecast as W
from ledgerlake.operators import score as S
from ledgerlake.operators import serving as V
from ledgerlake.operators import text as X
from ledgerlake.plans.bindings import HORIZON, ctes, raw
from ledgerlake.plans.mapping_queries import mapped, mapped_ctes
from ledgerlake.plans.panel_queries import END, Domain, panel_ctes, rounded
from ledgerlake.plans.risk_queries import _CATS, _CL, _FC, DAYS, Clients, Forecast, _categories
from ledgerlake.plans.serving_queries import _BAND, _BOARD, _D, _P, _VIEW, _board, _portfolio, _sales, drivers, scores, sectors, series
from ledgerlake.plans.serving_queries import ORACLE_SQL as _SERVED
from ledgerlake.sources.staging import staged

NUMBER = "CAST(substr(company_id, 6) AS INT)"
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
MARGIN_MONTH, A, B = "1998-03", "COMP_0001", "COMP_0002"
COLUMNS = ("net_bank", "runway_m")

_MEANING = {f: {"label": f.replace("_", " "), "pillar": p, "formula": f"f({f})"} for p, fs in S.PILLARS.items() for f in fs if f != "lost_share"}
_RULES = (("negative_cash", "Negative cash", "the account is overdrawn", True, False), ("short_history", "Short history", "too few months", True, True), ("debt_load", "Debt load", "debt takes half of the receipts", False, True))
_HITS = ("cash_end < 0", "hist_months < 6", "debt_service_ratio_3m > 0.5")
CURATED = [(3, "COMP_0003", "Name three"), (1, "COMP_0007", "Name seven"), (2, "COMP_0011", "Name eleven"), (4, "COMP_9999", "Name none")]


def _catalogue(d: Domain) -> DataFrame:
    """The published document: a feature weighs what it contributes, of all contributions; rules that some month breaks."""
    points = F.sum(F.abs(F.col("contribution").cast("decimal(20,4)"))).cast("double")
    each = drivers(d).groupBy("feature").agg(points.alias("x"))
    total = each.agg(F.sum("x").alias("total"))
    meaning = F.from_json(F.lit(json.dumps(_MEANING)), "map<string,struct<label:string,pillar:string,formula:string>>")
    weights = each.join(total, F.lit(True)).where("x IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.round(F.col("x") / F.col("total"), 4)))).alias("weights"))
    broken = d.panel.agg(*(F.coalesce(F.bool_or(F.expr(h)), F.lit(False)).alias(f"b{k}") for k, h in enumerate(_HITS)))
    rules = F.filter(F.array(*(F.when(F.col(f"b{k}"), F.struct(*(F.lit(x).alias(n) for n, x in zip(("code", "label", "text", "blocks", "liftable"), r, strict=True)))) for k, r in enumerate(_RULES))), lambda x: x.isNotNull())
    document = F.struct(F.lit("v2").alias("score_version"), "weights", meaning.alias("features"), rules.alias("vetoes"))
    return weights.join(broken, F.lit(True)).select(F.to_json(document).alias("payload"))


def _vetoes() -> list[Y.Veto]:
    when = (F.col("cash_end") < 0, F.col("hist_months") < 6, F.col("debt_service_ratio_3m") > 0.5)
    return [Y.Veto(*r, w) for r, w in zip(_RULES, when, strict=True)]


def _decided(d: Domain) -> DataFrame:
    return Y.decisions(scores(d).withColumn("band", S.band(F.col("score"))), d.panel, _vetoes())


def _profiles(d: Domain) -> DataFrame:
    return d.companies.selectExpr("company_id", f"CASE WHEN {NUMBER} % 6 = 5 THEN NULL ELSE group_id END AS top_sector", f"'kind ' || CAST({NUMBER} % 3 AS STRING) AS business_kind")


def _featured(d: Domain) -> DataFrame:
    rows = d.companies.where(f"{NUMBER} % 3 = 0").selectExpr("company_id", f"'Name ' || CAST({NUMBER} AS STRING) AS display_name", "group_id AS sector", f"{NUMBER} AS display_order")
    return rows.unionByName(d.spark.sql("SELECT 'COMP_9999' AS company_id, 'Nobody' AS display_name, 'none' AS sector, 99 AS display_order"))


def _versions(d: Domain) -> DataFrame:
    both = drivers(d).withColumn("score_version", F.lit("v2")).unionByName(drivers(d).withColumns({"score_version": F.lit("v1"), "contribution": F.lit(1.0)}))
    published = d.spark.sql("SELECT 'v1' AS score_version, DATE '2001-01-01' AS published_at UNION ALL SELECT 'v2', DATE '2001-06-01'")
    return Y.of_version(both, published).select("id", "month", "feature", "contribution")


def _sheet(d: Domain) -> DataFrame:
    return Y.sheet(series(d), drivers(d), _decided(d), Y.catalogue_features(_catalogue(d)), 3)


def _stats(d: Domain) -> DataFrame:
    return S.sector_stats(series(d), sectors(d))


def _ahead(d: Domain) -> DataFrame:
    peers = S.project(_stats(d).select(F.col("sector").alias("id"), "month", F.col("median").alias("value")))
    return Y.ahead_with_peers(S.project(series(d)), sectors(d), peers)


def _peers(d: Domain) -> DataFrame:
    return _portfolio(d).select("company_id", F.col("group_id").alias("sector"), "score", "delta3", F.col("runway_now").alias("runway"), F.col("dso_now").alias("dso"), "history")


def _verdicts(d: Domain) -> DataFrame:
    rows = _peers(d)
    met = rows.join(G.benchmarks(rows), "sector")
    return met.select("company_id", "sector", "peers", "score_med", "delta3_med", "runway_med", "dso_med", G.verdict(F.col("score"), F.col("score_med")).alias("score_verdict"), G.verdict(F.col("dso"), F.col("dso_med"), True).alias("dso_verdict"))


_STATUS = "CASE c_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'contacted' WHEN 2 THEN 'meeting' ELSE 'closed' END"
_TREND = "CASE WHEN delta3 >= 2 THEN 'improving' WHEN delta3 <= -2 THEN 'deteriorating' WHEN delta3 = 0 THEN '?' WHEN delta3 IS NOT NULL THEN 'stable' END"
#: Columns whose values are taken for inputs of a kind.
_INPUTS = {
    "company": (("SELECT 'COMP_' || lpad(CAST(n_nationkey AS STRING), 4, '0') AS x FROM ", "nation"), ("SELECT 'COMP_' || CAST(c_nationkey AS STRING) AS x FROM ", "customer"), ("SELECT s_name AS x FROM ", "supplier")),
    "month": (("SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS x FROM ", "orders"), ("SELECT substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS x FROM ", "lineitem"), ("SELECT CAST(ts AS STRING) AS x FROM ", "events"), ("SELECT o_orderstatus AS x FROM ", "orders")),
    "uuid": (("SELECT c_name AS x FROM ", "customer"), ("SELECT substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) AS x FROM ", "customer")),
    "band": (("SELECT lang AS x FROM ", "documents"), ("SELECT CASE WHEN s_acctbal < 0 THEN 'risk' WHEN s_acctbal < 5000 THEN 'watch' ELSE 'Healthy' END AS x FROM ", "supplier")),
    "status": ((f"SELECT {_STATUS} AS x FROM ", "customer"), ("SELECT event_type AS x FROM ", "events")),
}


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of columns of the tables are well-formed inputs of a kind."""
    out = None
    for kind, sources in _INPUTS.items():
        for sql, table in sources:
            part = _of(spark, sf_dir, sql, table).select(F.lit(kind).alias("kind"), Y.valid(kind, F.col("x")).alias("ok"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "ok").agg(F.count(F.lit(1)).alias("n"))


_PROFILE_TEXT = f"""SELECT company_id, group_id, CASE {NUMBER} % 3 WHEN 0 THEN '' ELSE 'kind' END AS business_kind, CASE {NUMBER} % 4 WHEN 0 THEN NULL WHEN 1 THEN 'food| retail ||' WHEN 2 THEN '' ELSE ' energy ' END AS sector_set,
  CASE {NUMBER} % 4 WHEN 1 THEN 'food' ELSE '' END AS top_sector, CASE {NUMBER} % 2 WHEN 0 THEN '0.75' ELSE '' END AS top_sector_score, CASE {NUMBER} % 5 WHEN 0 THEN NULL ELSE '3' END AS regime_id FROM """
_LEADS = f"SELECT c_custkey AS lead_id, 'COMP_' || lpad(CAST(c_nationkey AS STRING), 4, '0') AS company_id, {_STATUS} AS status, c_custkey % 30 AS assigned_to, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE abs(c_acctbal) END AS wanted FROM "
_STAFF = "SELECT s_suppkey AS employee_id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'title ' || CAST(s_suppkey % 3 AS STRING) END AS title, CASE s_suppkey % 3 WHEN 0 THEN 'sales' ELSE 'success' END AS team FROM "
_ASKED = "SELECT 'COMP_' || lpad(CAST(n_nationkey AS STRING), 4, '0') AS company_id FROM {0} UNION ALL SELECT 'COMP_' || lpad(CAST(n_nationkey + 25 AS STRING), 4, '0') FROM {0} UNION ALL SELECT 'COMP_0030' FROM {0}"
_SOURCES = ("SELECT ' Name ' || CAST(s_suppkey % 60 AS STRING) AS person, s_suppkey AS line, s_name AS value FROM ", "SELECT CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 7 = 1 THEN NULL ELSE 'Name ' || CAST(c_custkey % 90 AS STRING) END AS person, c_custkey AS line, c_name AS value FROM ")
_RECORDS = """SELECT n_nationkey, '[{{"id":' || CAST(n_nationkey AS STRING) || ',"name":"' || n_name || '"}},{{"id":' || CAST(n_nationkey + 100 AS STRING) || '}}]' AS payload FROM """


def _of(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(f"{sql}{{{table}}}", **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, _LEADS, "customer")


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    leads = _leads(spark, sf_dir).withColumn("lead_id", F.col("lead_id").cast("string"))
    return R.open_leads(leads, _of(spark, sf_dir, _STAFF, "supplier"), spark.sql(_ASKED.format("{nation}"), nation=nation), "draft", NAMESPACE)


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = _leads(spark, sf_dir)
    return R.with_status(leads, leads.where("lead_id % 3 = 0").select("lead_id", F.when(F.col("lead_id") % 2 == 0, "closed").otherwise("lost").alias("status")))


#: Changes that can and that can't be made: unknown statuses and leads, two statuses for one lead.
_CHANGES_SQL = "SELECT lead_id + CASE WHEN lead_id % 11 = 0 THEN 1000000 ELSE 0 END AS lead_id, CASE WHEN lead_id % 7 = 0 THEN 'lost' WHEN lead_id % 2 = 0 THEN 'closed' ELSE 'meeting' END AS status FROM {0} UNION SELECT lead_id, 'contacted' FROM {0} WHERE lead_id % 13 = 0"


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = _leads(spark, sf_dir)
    return R.rejected(leads, spark.sql(_CHANGES_SQL.format("{leads}"), leads=leads))


def _hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return R.hydrated(_leads(spark, sf_dir), _of(spark, sf_dir, _STAFF, "supplier"), _featured(d), Forecast(spark, sf_dir, d).result())


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stages(_leads(spark, sf_dir).select("status", C.money_text(F.round("wanted", 0).cast("decimal(20,0)")).alias("reason_amount")))


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leads(spark, sf_dir).select("lead_id", "company_id", "status")
    new = _of(spark, sf_dir, "SELECT n_nationkey + 10000 AS lead_id, 'COMP_' || lpad(CAST(n_nationkey + 20 AS STRING), 4, '0') AS company_id, 'new' AS status FROM ", "nation")
    return Y.insert_missing(rows, new, ["company_id"], F.col("status").isin(*R.OPEN))


def _exported(d: Domain) -> DataFrame:
    """The arrays that are exported, one row for each place."""
    data = F.from_json("data", ", ".join(f"{c} array<double>" for c in COLUMNS))
    return G.export_rows(d.panel, COLUMNS).select("company_id", "m0", "n", F.posexplode(F.arrays_zip(*(data[c].alias(c) for c in COLUMNS))).alias("place", "x")).select("company_id", "m0", "n", "place", *(F.col(f"x.{c}").alias(c) for c in COLUMNS))


class Accounts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tx = raw(spark, sf_dir, "raw_transactions").select("company_id", "product_id", "date", "amount")
        self.anchors = H.account_anchors(raw(spark, sf_dir, "raw_balances"))
        self.panel = H.account_panel(self.tx, self.anchors)


def _gaps(d: Domain) -> DataFrame:
    products = d.banking.select("company_id", F.col("currency").alias("pcur")).join(d.companies.select("company_id", F.col("currency").alias("ccur")), "company_id")
    return H.rate_gaps(products, d.rates)


def _multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(n: int) -> dict[str, DataFrame]:
        d = Domain(spark, sf_dir, n)
        return {"ledger": d.rows, "levels": d.levels, "panel": d.panel, "full panel": d.full()}

    return H.multisets(build)


_A = lambda f: lambda spark, sf_dir: f(Accounts(spark, sf_dir))
QUERIES = {
    "ap01_summaries": _D(lambda d: Y.summaries(_portfolio(d), V.alert(F.col("band"), F.col("delta3"), F.col("n_months") / 200.0))), "ap01_band": _D(lambda d: Y.summaries(_portfolio(d), F.lit(None).cast("string"), "watch").select("company_id", "score", "dormant")),
    "ap03_trends": _D(lambda d: _portfolio(d).select("company_id", Y.trend_of(F.expr(_TREND)).alias("trend"))), "ap05_sheet": _D(_sheet), "ap06_decision_at": _D(lambda d: Y.decision_at(_decided(d), MARGIN_MONTH).select("company_id", "month", "action", "reason")),
    "ap06_latest_decision": _D(lambda d: Y.decision_at(_decided(d)).select("company_id", "month", "action", "reason")), "ap09_versions": _D(_versions), "ap10_directory": _D(lambda d: Y.directory(d.companies, _profiles(d))), "ap10_featured": _D(lambda d: Y.featured_directory(_featured(d), d.companies)),
    "ap11_details": _D(lambda d: Y.details(d.companies, d.panel, series(d), d.banking, _profiles(d), _stats(d))), "ap17_monthly_stats": _D(lambda d: rounded(Y.monthly_stats(series(d)), 4)), "ap17_featured_stats": _D(lambda d: rounded(Y.monthly_stats(series(d), _featured(d).select(F.col("company_id").alias("id"))), 4)),
    "ap19_cash_bundle": lambda s, d: rounded((x := Domain(s, d)) and Y.cash_bundle(x.companies, x.panel, _categories(x), (f := staged(Forecast(s, d, x).result(), 'forecast')), V.board(_portfolio(x), f, x.panel))),
    "ap20_client_books": lambda s, d: rounded((c := Clients(s, d)) and Y.client_books(raw(s, d, "raw_companies"), C.companies_book(c.offers, c.book, c.surety), Forecast(s, d).result())),
    "ap21_features": _D(lambda d: Y.catalogue_features(_catalogue(d))), "ap21_vetoes": _D(lambda d: Y.catalogue_vetoes(_catalogue(d))), "ap22_validation": _validated,
    "sc08_ahead": _D(_ahead), "sc09_invoice_features": _D(lambda d: rounded(S.invoice_features(d.invoices, d.panel), 4)), "sc09_payroll_cv": _D(lambda d: rounded(S.payroll_cv(d.panel), 4)), "sc09_credit_use": _D(lambda d: rounded(S.credit_use(d.debt), 4)),
    "sc09_refund_rate": _D(lambda d: rounded(S.refund_rate(d.rows, d.panel), 4)), "sc09_lost_share": lambda s, d: rounded(S.lost_share(_sales(s, d), Domain(s, d).flows), 4),
    "sc12_decisions": _D(lambda d: _decided(d).select("company_id", "month", "band", "action", "reason", F.array_join(F.transform("vetoes", lambda x: x["code"]), ",").alias("codes"))),
    "sc13_profiles": lambda s, d: Y.profiles(s.sql(_PROFILE_TEXT + "{c}", c=raw(s, d, "raw_companies")), "2001-08-01", "v1").withColumn("sectors", F.array_join("sectors", "|")),
    "vw07_latest": _D(lambda d: latest(scores(d), ["company_id"], "month")), "vw08_featured": _D(lambda d: Y.featured(d.spark.createDataFrame(CURATED, "display_order int, company_id string, display_name string"), _profiles(d), scores(d))),
    "vw10_recordset": lambda s, d: Y.recordset(_of(s, d, _RECORDS, "nation"), "payload", "id:int,name:string"), "vw11_insert_missing": _inserted,
    "vw12_violations": _D(lambda d: Y.violations(_portfolio(d), {"score": F.col("score").between(40, 60), "band": F.col("band").isin("healthy", "watch"), "delta3": F.col("delta3") > -5, "n_months": F.col("n_months") >= 0})),
    "snk09_repeated_keys": lambda s, d: Y.repeated_keys(_leads(s, d), ["company_id"], F.col("status").isin(*R.OPEN)),
    "cr01_merged_staff": lambda s, d: R.merge_sources([_of(s, d, _SOURCES[0], "supplier"), _of(s, d, _SOURCES[1], "customer")], "person", "line"), "cr03_ticked": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", R.ticked(F.concat(F.lit(" "), F.get_json_object("props", "$.k"))).alias("ok")),
    "cr05_open_leads": _opened, "cr06_status": _moved, "cr06_rejected": _rejected, "cr07_hydrated": _hydrated, "cr08_stages": _stages, "cr09_team_counts": lambda s, d: R.team_counts(_of(s, d, _STAFF, "supplier")),
    "ag01_sheet_ends": _D(lambda d: Y.ends_of_sheet(_sheet(d))), "ag01_last_months": _D(lambda d: Y.last_months(series(d))), "ag02_changes": _D(lambda d: Y.first_changes(S.attribution(drivers(d), series(d)))),
    "ag03_forecast_view": lambda s, d: rounded((f := Forecast(s, d)) and Y.last_months(W.monthly(f.events, f.opening).withColumnRenamed("company_id", "id"), 6).drop("back")), "ag04_decision_view": _D(lambda d: Y.decision_at(_decided(d)).select("company_id", "action", F.size(F.filter("vetoes", lambda x: x["blocks"])).cast("long").alias("blocking"), F.size(F.filter("vetoes", lambda x: ~x["blocks"])).cast("long").alias("notices"))),
    "ag06_model_view": _D(lambda d: Y.catalogue_features(_catalogue(d)).where("label is not null").select("feature", "label", "pillar", "formula")), "ag08_top_weights": _D(lambda d: Y.top_weights(Y.catalogue_features(_catalogue(d)))), "ag11_locale": lambda s, d: R.table_order(raw(s, d, "raw_companies").select("company_id", "country"), "country", True, "company_id"), "ag11_table_order": _D(lambda d: R.table_order(_portfolio(d).select("company_id", "delta3"), "delta3", False, "company_id")),
    "ui02_periods": _D(lambda d: G.periods(d.panel, _categories(d))), "ui03_lines": _D(lambda d: G.shown_lines(V.statement(_categories(d), d.panel), ["company_id", "line_group", "line"])),
    "ui04_shared_months": _D(lambda d: Y.shared_months(series(d), A, B)), "ui04_beside_scope": _D(lambda d: rounded(Y.beside_scope(series(d), A, Y.monthly_stats(series(d), sectors(d).where("sector = 'GROUP_0001'"))), 4)),
    "ui05_suggestions": _D(lambda d: G.suggestions(_featured(d), "display_name", " GROUP_0002 ", "COMP_0012")), "ui06_board": lambda s, d: G.by_impact(_board(s, d)).select("company_id", "impact", "place"), "ui07_benchmarks": _D(lambda d: rounded(_verdicts(d), 4)), "ui07_median_series": _D(lambda d: G.median_series(_peers(d))),
    "ui08_clients": lambda s, d: G.clients_by_state(Clients(s, d).offers, " 1"), "ui08_capacity": lambda s, d: rounded(Forecast(s, d).result().select("company_id", G.surety_capacity(F.col("surplus")).alias("capacity"))), "ui09_checklist": lambda s, d: G.checklist(Clients(s, d).book),
    "ui10_actions": lambda s, d: rounded(G.actions(Forecast(s, d).result())), "ui11_scaled": _D(lambda d: rounded(G.scaled(series(d)), 4)), "snk10_export": _D(_exported),
    "ch01_reconciled": _A(lambda a: H.reconciled(a.panel, a.anchors)), "ch02_left_out": lambda s, d: (a := Accounts(s, d)) and H.left_out(a.tx, a.anchors, Domain(s, d).panel), "ch03_rate_gaps": _D(_gaps), "ch05_diagnoses": _D(lambda d: rounded(H.diagnoses(d.panel))),
    "ch06_repeatable": lambda s, d: H.repeatable(lambda n: Domain(s, d, n).panel), "ch06_multisets": _multisets, "ch01_forwards": _A(lambda a: rounded(H.reconciled_forwards(a.panel, a.tx, a.anchors))), "ch07_account_panel": _A(lambda a: rounded(a.panel)), "tx04_tokens": lambda s, d: X.token_counts(s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.redacted(F.col("text")).alias("x")), "doc_id", "x"),
}

_Q = lambda x: "NULL" if x is None else f"'{x}'"
_REDACTED = "text"
for _token, _pattern in X.REDACTED:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_token}', 'g')"
_LATEST = lambda table, key="company_id": f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY month DESC) AS rn_ FROM {table}) z WHERE rn_ = 1)"
_TREND = "CASE WHEN delta3 >= 3 THEN 'up' WHEN delta3 <= -3 THEN 'down' ELSE 'flat' END"
_ALERT = "CASE WHEN delta3 <= -10 THEN 'falls by ' || CAST(CAST(round(-delta3, 0) AS INT) AS VARCHAR) || ' points in 3 months' WHEN band = 'risk' THEN 'in the risk band' WHEN n_months / 200.0 < 0.4 THEN 'too little data' END"
_DEC = f"""dec AS (SELECT s.company_id, s.month, {_BAND} AS band, coalesce(cash_end < 0, false) AS v1, coalesce(hist_months < 6, false) AS v2, coalesce(debt_service_ratio_3m > 0.5, false) AS v3 FROM scores s JOIN panel p ON p.company_id = s.company_id AND p.month = s.month),
decided AS (SELECT company_id, month, band, v1, v2, v3, CASE WHEN v1 OR v2 THEN 'decline' WHEN band = 'healthy' THEN 'lend' WHEN band = 'watch' THEN 'watch' ELSE 'decline' END AS action, CASE WHEN v1 THEN '{_RULES[0][2]}' WHEN v2 THEN '{_RULES[1][2]}' ELSE 'band ' || band END AS reason,
  concat_ws(',', CASE WHEN v1 THEN 'negative_cash' END, CASE WHEN v2 THEN 'short_history' END, CASE WHEN v3 THEN 'debt_load' END) AS codes FROM dec)"""
_PROF = f"prof AS (SELECT company_id, CASE WHEN {NUMBER} % 6 = 5 THEN NULL ELSE group_id END AS top_sector, 'kind ' || CAST({NUMBER} % 3 AS VARCHAR) AS business_kind FROM raw_companies)"
_FEATURED = f"featured AS (SELECT company_id, 'Name ' || CAST({NUMBER} AS VARCHAR) AS display_name, group_id AS sector, {NUMBER} AS display_order FROM raw_companies WHERE {NUMBER} % 3 = 0 UNION ALL SELECT 'COMP_9999', 'Nobody', 'none', 99)"
_FEATS = f"feats0 AS (SELECT feature, CAST(sum(abs(CAST(contribution AS DECIMAL(20, 4)))) AS DOUBLE) AS x FROM drivers GROUP BY 1), feats AS (SELECT 'v2' AS score_version, z.feature, round(x / (SELECT sum(x) FROM feats0), 4) AS weight, label, pillar, formula FROM feats0 z LEFT JOIN (VALUES " + ", ".join(f"('{f}', {', '.join(_Q(m[k]) for k in ('label', 'pillar', 'formula'))})" for f, m in _MEANING.items()) + ") v(feature, label, pillar, formula) ON v.feature = z.feature WHERE x IS NOT NULL)"
_PILLAR = " ".join(f"WHEN '{f}' THEN '{p}'" for p, fs in S.PILLARS.items() for f in fs)
_SHEET = f"{_P}, {_DEC}, {_FEATS}, sheet AS (SELECT l.id AS company_id, l.month, l.value AS score, action, row_number() OVER (PARTITION BY l.id ORDER BY contribution NULLS LAST, d.feature) AS place, d.feature, CASE d.feature {_PILLAR} ELSE 'additional' END AS pillar, round(contribution, 3) AS points, f.formula, f.weight FROM {_LATEST('series', 'id')} l JOIN drivers d ON d.id = l.id AND d.month = l.month LEFT JOIN feats f ON f.feature = d.feature LEFT JOIN decided c ON c.company_id = l.id AND c.month = l.month)"


def _projection(name: str, source: str) -> str:
    """Common table expressions up to ``name``(id, month, value), the projections of source(id, month, value)."""
    return f"""n_{name} AS (SELECT id, month, value, value - lag(value) OVER (PARTITION BY id ORDER BY month) AS dv, (year(month) * 12 + month(month)) - row_number() OVER (PARTITION BY id ORDER BY month) AS island FROM {source}),
run_{name} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY month) AS j, count(*) OVER (PARTITION BY id) AS m FROM (SELECT *, max(island) OVER (PARTITION BY id) AS top FROM n_{name}) z WHERE island = top),
tr_{name} AS (SELECT id, max(month) AS top_month, arg_max(value, month) AS level, sum(CASE WHEN j = 2 THEN dv * pow(0.56, m - 2) WHEN j > 2 THEN 0.3 * dv * pow(0.56, m - j) ELSE 0 END) AS trend FROM run_{name} WHERE m >= 4 GROUP BY id),
{name} AS (SELECT id, CAST(top_month + INTERVAL (k) MONTH AS DATE) AS month, CAST(round(least(greatest(level + d * trend, 0), 100), 1) AS DOUBLE) AS value FROM tr_{name}, (SELECT 1 AS k, 0.8 AS d UNION ALL SELECT 2, 1.44 UNION ALL SELECT 3, 1.952) s)"""


_SECTOR = "st AS (SELECT sector AS id, month, count(*) AS n, avg(value) AS mean, median(value) AS value FROM series GROUP BY 1, 2)"
_STEPS_TO_CHANGES = _SERVED["ap07_attribution"].rpartition(" SELECT id, month, feature")[0]
_FEATURES_ONLY = f"{_P}, {_FEATS}"
_STAFF_SQL, _LEADS_SQL = f"staff AS ({_STAFF}supplier)", f"leads AS ({_LEADS}customer)"
_OPEN = "('new', 'contacted', 'meeting')"
_FORECAST = """fc AS (SELECT l.company_id, level AS low, l.day AS low_date, break_from, CAST(back - 1 AS DATE) AS break_to, CASE WHEN r.company_id IS NOT NULL THEN back END AS rescue_date, CASE WHEN break_from IS NULL AND spend > 0 AND CAST(level AS DOUBLE) - spend >= 25000 THEN CAST(level AS DOUBLE) - spend END AS surplus
  FROM lows l LEFT JOIN rescue r ON r.company_id = l.company_id AND r.rn = 1 LEFT JOIN habits h ON h.company_id = l.company_id)"""
_UUID = lambda h: f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST('0x' || substr({h}, 17, 1) AS INT) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_BOOKED = f"{_FC}{_CL[len(mapped_ctes('invoices', 'debt_products')) :]}, {_FORECAST}"
_MONEY = lambda x: f"replace(format('{{:,}}', CAST(round(abs({x}), 0) AS BIGINT)), ',', '.') || ' €'"
_ACCOUNTS = f"""{mapped_ctes('transactions', 'balances')}, anch AS (SELECT company_id, product_id, max(CAST(round(balance, 4) AS DECIMAL(20, 4))) AS anchor FROM raw_balances GROUP BY 1, 2 HAVING max(balance) IS NOT NULL),
nets0 AS (SELECT product_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(CAST(round(amount, 4) AS DECIMAL(20, 4))) AS net FROM raw_transactions WHERE NOT coalesce(abs(amount) >= 1e8, false) GROUP BY 1, 2),
acc AS (SELECT a.company_id, n.product_id, n.month, anchor - coalesce(sum(net) OVER (PARTITION BY n.product_id ORDER BY n.month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cash FROM nets0 n JOIN anch a ON a.product_id = n.product_id WHERE abs(anchor) < 1e8)"""
_DIAG = "CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0 THEN 'negative' WHEN r < 1 THEN 'critical' WHEN r < 3 THEN 'tight' ELSE 'covered' END"
_TWO = lambda cols: ", ".join(f"CAST(round({c}, 2) AS DOUBLE) + 0.0 AS {c}" for c in cols)
_LATE = lambda side: f"CAST(count(*) FILTER (WHERE {side} AND age <= 2 AND gap > 15 AND (paid_day IS NULL OR paid_day - due > 15)) AS DOUBLE) / nullif(count(*) FILTER (WHERE {side} AND age <= 2 AND gap > 15), 0)"
ORACLE_SQL = {
    "ap01_summaries": f"{_VIEW} SELECT company_id, score, band, delta3, {_TREND} AS trend, n_tx = 0 AS dormant, {_ALERT} AS alert, currency, n_months FROM view", "ap01_band": f"{_VIEW} SELECT company_id, score, n_tx = 0 AS dormant FROM view WHERE band = 'watch'",
    "ap03_trends": f"{_VIEW} SELECT company_id, CASE {_TREND} WHEN 'improving' THEN 'up' WHEN 'deteriorating' THEN 'down' ELSE 'flat' END AS trend FROM view", "ap05_sheet": f"{_SHEET} SELECT * FROM sheet",
    "ap06_decision_at": f"{_P}, {_DEC} SELECT company_id, month, action, reason FROM decided WHERE month = DATE '{MARGIN_MONTH}-01'", "ap06_latest_decision": f"{_P}, {_DEC} SELECT company_id, month, action, reason FROM {_LATEST('decided')} l", "ap09_versions": f"{_P} SELECT id, month, feature, contribution FROM drivers",
    "ap10_directory": f"{panel_ctes('panel')}, {_PROF} SELECT c.company_id, group_id, country, currency, erp, top_sector FROM raw_companies c LEFT JOIN prof p ON p.company_id = c.company_id", "ap10_featured": f"{panel_ctes('panel')}, {_FEATURED} SELECT f.company_id, display_name, sector AS top_sector, display_order, group_id, country, currency, erp FROM featured f LEFT JOIN raw_companies c ON c.company_id = f.company_id",
    "ap11_details": f"""{_P}, {_PROF} SELECT c.company_id, top_sector, (SELECT max(month) FROM panel p WHERE p.company_id = c.company_id) AS last_month, coalesce((SELECT string_agg(currency, ',' ORDER BY currency) FROM (SELECT DISTINCT company_id, currency FROM raw_banking_products WHERE currency IS NOT NULL) b WHERE b.company_id = c.company_id), '') AS currencies,
  (SELECT count(*) FROM panel p WHERE p.company_id = c.company_id) AS panel_months, (SELECT count(*) FROM series s WHERE s.id = c.company_id) AS scored_months, (SELECT count(DISTINCT month) FROM series s WHERE s.sector = top_sector) AS sector_months FROM raw_companies c LEFT JOIN prof p ON p.company_id = c.company_id""",
    "ap17_monthly_stats": f"{_P} SELECT month, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM series GROUP BY month", "ap17_featured_stats": f"{_P}, {_FEATURED} SELECT month, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM series WHERE id IN (SELECT company_id FROM featured) GROUP BY month",
    "ap19_cash_bundle": f"""{_BOARD},{_CATS[len(mapped_ctes("transactions")) + 1 :]} SELECT c.company_id, c.currency, coalesce(months, 0) AS months, CAST(round(p.cash_end, 2) AS DOUBLE) + 0.0 AS cash_end, coalesce(category_months, 0) AS category_months, coalesce(categories, 0) AS categories, CAST(round(l.level, 2) AS DOUBLE) + 0.0 AS low, l.day AS low_date, l.break_from, b.action FROM raw_companies c
LEFT JOIN (SELECT company_id, count(*) AS months, arg_max(cash_end, month) AS cash_end FROM panel GROUP BY 1) p ON p.company_id = c.company_id LEFT JOIN (SELECT company_id, count(DISTINCT month) AS category_months, count(DISTINCT category) AS categories FROM cats GROUP BY 1) k ON k.company_id = c.company_id LEFT JOIN lows l ON l.company_id = c.company_id LEFT JOIN boarded b ON b.company_id = c.company_id""",
    "ap20_client_books": f"""{_BOOKED} SELECT c.company_id, CAST(round(coalesce(sales_12m, 0), 2) AS DOUBLE) + 0.0 AS sales_12m, coalesce(clients, 0) AS clients, CAST(round(line, 2) AS DOUBLE) + 0.0 AS line, CAST(round(surplus, 2) AS DOUBLE) + 0.0 AS surplus FROM raw_companies c LEFT JOIN (SELECT k.company_id, sum(sales_12m) AS sales_12m, count(*) AS clients FROM book k GROUP BY 1) t ON t.company_id = c.company_id LEFT JOIN bonds b ON b.company_id = c.company_id LEFT JOIN fc ON fc.company_id = c.company_id""",
    "ap21_features": f"{_FEATURES_ONLY} SELECT * FROM feats", "ap21_vetoes": f"{_P} " + " UNION ALL ".join(f"SELECT 'v2' AS score_version, '{c}' AS code, '{n}' AS label, '{t}' AS text, {b} AS blocks, {f} AS liftable WHERE EXISTS (SELECT 1 FROM panel WHERE {h})" for (c, n, t, b, f), h in zip(_RULES, _HITS, strict=True)),
    "ap22_validation": "SELECT kind, ok, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, coalesce({dict(company="regexp_full_match(x, 'COMP_[0-9]{4}')", month="regexp_full_match(x, '[0-9]{4}-[0-9]{2}(-[0-9]{2})?')", uuid="regexp_full_match(x, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')", band='x IN ($$healthy$$, $$watch$$, $$risk$$)', status='x IN ($$new$$, $$contacted$$, $$meeting$$, $$closed$$)')[k]}, false) AS ok FROM ({sql}{table}) z{j}" for k, sources in _INPUTS.items() for j, (sql, table) in enumerate(sources)) + ") u GROUP BY 1, 2",
    "sc08_ahead": f"{_P}, {_SECTOR}, {_projection('own', 'series')}, {_projection('peer', 'st')}, met AS (SELECT o.id, o.month, o.value, p.value AS peer FROM own o JOIN raw_companies c ON c.company_id = o.id LEFT JOIN peer p ON p.id = c.group_id AND p.month = o.month) SELECT id, month, value, CASE WHEN bool_and(peer IS NOT NULL) OVER (PARTITION BY id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN peer END AS peer FROM met",
    "sc09_invoice_features": f"""{panel_ctes("panel", "inv")}, j AS (SELECT p.company_id, p.month, i.amount, i.due, CASE WHEN paid THEN paid_on END AS paid_day, paid, date_diff('month', due, p.month) AS age, last_day(p.month) - due AS gap FROM panel p JOIN inv i ON i.company_id = p.company_id AND date_trunc('month', due) <= p.month AND date_trunc('month', due) > p.month - INTERVAL 12 MONTH WHERE amount <> 0),
sums AS (SELECT company_id, month, {_LATE("amount < 0")} AS aps, {_LATE("amount > 0")} AS ars, -sum(amount) FILTER (WHERE amount < 0 AND gap >= 0 AND (NOT paid OR paid_day > last_day(month))) AS ap, sum(amount) FILTER (WHERE amount > 0 AND age >= 2 AND (NOT paid OR paid_day > last_day(month))) AS ar FROM j GROUP BY 1, 2),
fl AS (SELECT company_id, month, CASE WHEN count(*) OVER w = 3 THEN avg(CAST(outflow_op AS DOUBLE)) OVER w END AS om, CASE WHEN count(*) OVER w = 3 THEN avg(CAST(inflow_op AS DOUBLE)) OVER w END AS im FROM panel WINDOW w AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT f.company_id, f.month, round(aps, 4) + 0.0 AS ap_late_share, round(ars, 4) + 0.0 AS ar_late_share, round(CAST(coalesce(ap, 0) AS DOUBLE) / nullif(om, 0), 4) + 0.0 AS ap_overdue_ratio, round(CAST(coalesce(ar, 0) AS DOUBLE) / nullif(im, 0), 4) + 0.0 AS ar_overdue_90_ratio FROM fl f LEFT JOIN sums s ON s.company_id = f.company_id AND s.month = f.month""",
    "sc09_payroll_cv": f"{panel_ctes('panel')}, x AS (SELECT company_id, month, CAST(out_salary AS DOUBLE) AS x, row_number() OVER (PARTITION BY company_id ORDER BY month) AS rn FROM panel), m AS (SELECT a.company_id, a.month, a.rn, count(*) AS n, avg(b.x) AS m FROM x a JOIN x b ON b.company_id = a.company_id AND b.rn BETWEEN a.rn - 5 AND a.rn GROUP BY 1, 2, 3) SELECT m.company_id, m.month, round(CASE WHEN n = 6 AND m > 0 THEN sqrt((SELECT sum(pow(least(b.x - m.m, 0), 2)) FROM x b WHERE b.company_id = m.company_id AND b.rn BETWEEN m.rn - 5 AND m.rn) / 6) / m END, 4) + 0.0 AS payroll_cv FROM m",
    "sc09_credit_use": f"{panel_ctes('panel')} SELECT company_id, round(sum(abs(outstanding)) / sum(abs(granted)), 4) + 0.0 AS lc_util FROM raw_debt_products WHERE type = 'lineofcredit' GROUP BY company_id HAVING sum(abs(granted)) > 0",
    "sc09_refund_rate": f"{panel_ctes('panel')}, b AS (SELECT company_id, month, -sum(amount) AS back FROM bank WHERE category = 'collection_refund' GROUP BY 1, 2), r AS (SELECT p.company_id, p.month, inflow_op, coalesce(back, 0) AS back FROM panel p LEFT JOIN b ON b.company_id = p.company_id AND b.month = p.month) SELECT company_id, month, round(CASE WHEN count(*) OVER w = 3 THEN CAST(sum(back) OVER w AS DOUBLE) / nullif(CAST(sum(inflow_op) OVER w AS DOUBLE), 0) END, 4) + 0.0 AS refund_rate FROM r WINDOW w AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "sc09_lost_share": _SERVED["sc09_client_features"][: _SERVED["sc09_client_features"].index("w6 AS")] + "cl AS (SELECT f.company_id, f.month, client, CAST(sum(amount) FILTER (WHERE s.month <= f.month - INTERVAL 3 MONTH) AS DOUBLE) AS prior, count(*) FILTER (WHERE s.month > f.month - INTERVAL 3 MONTH) AS recent FROM flows f JOIN sales s ON s.company_id = f.company_id AND s.month <= f.month AND s.month > f.month - INTERVAL 12 MONTH GROUP BY 1, 2, 3), per AS (SELECT company_id, month, count(*) AS n, coalesce(sum(prior) FILTER (WHERE recent = 0), 0) / nullif(sum(prior), 0) AS x FROM cl WHERE prior IS NOT NULL GROUP BY 1, 2) SELECT f.company_id, f.month, round(x, 4) + 0.0 AS lost_share FROM flows f LEFT JOIN per ON per.company_id = f.company_id AND per.month = f.month AND n >= 3",
    "sc12_decisions": f"{_P}, {_DEC} SELECT company_id, month, band, action, reason, codes FROM decided",
    "sc13_profiles": f"{panel_ctes('panel')}, t AS ({_PROFILE_TEXT}raw_companies) SELECT company_id, group_id, nullif(business_kind, '') AS business_kind, array_to_string(list_filter(list_transform(string_split(coalesce(sector_set, ''), '|'), lambda x: trim(x)), lambda x: x <> ''), '|') AS sectors, nullif(top_sector, '') AS top_sector, CAST(nullif(top_sector_score, '') AS DOUBLE) AS top_sector_score, CAST(nullif(regime_id, '') AS INT) AS regime_id, DATE '2001-08-01' AS as_of_month, 'v1' AS profile_version FROM t",
    "vw07_latest": f"{_P} SELECT company_id, month, score FROM {_LATEST('scores')} l", "vw08_featured": f"{_P}, {_PROF} SELECT c.company_id, display_order, display_name, top_sector, business_kind, month, score FROM (VALUES " + ", ".join(f"({o}, '{i}', '{n}')" for o, i, n in CURATED) + f") c(display_order, company_id, display_name) JOIN prof p ON p.company_id = c.company_id JOIN {_LATEST('scores')} l ON l.company_id = c.company_id",
    "vw10_recordset": "SELECT CAST(n_nationkey AS INT) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(n_nationkey + 100 AS INT), NULL FROM nation",
    "vw11_insert_missing": f"WITH {_LEADS_SQL}, new AS (SELECT n_nationkey + 10000 AS lead_id, 'COMP_' || lpad(CAST(n_nationkey + 20 AS VARCHAR), 4, '0') AS company_id, 'new' AS status FROM nation) SELECT lead_id, company_id, status FROM leads UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM leads l WHERE l.company_id = new.company_id AND l.status IN {_OPEN})",
    "vw12_violations": f"{_VIEW} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n FROM view WHERE NOT ({v})" for k, v in {"score": "score BETWEEN 40 AND 60", "band": "band IN ('healthy', 'watch')", "delta3": "delta3 > -5", "n_months": "n_months >= 0"}.items()),
    "snk09_repeated_keys": f"WITH {_LEADS_SQL} SELECT company_id, count(*) AS n FROM leads WHERE status IN {_OPEN} GROUP BY 1 HAVING count(*) > 1",
    "cr01_merged_staff": f"WITH u AS (SELECT trim(person) AS person, line, value, 0 AS source FROM ({_SOURCES[0]}supplier) a UNION ALL SELECT trim(person), line, value, 1 FROM ({_SOURCES[1]}customer) b), r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY source, line) AS rn, count(*) OVER (PARTITION BY person) - 1 AS n_repeats FROM u WHERE person <> '') SELECT person, line, value, source, n_repeats FROM r WHERE rn = 1",
    "cr03_ticked": "SELECT event_id, coalesce(regexp_extract(props, '[0-9]+') = '1', false) AS ok FROM events",
    "cr05_open_leads": f"""WITH {_LEADS_SQL}, {_STAFF_SQL}, asked AS (SELECT DISTINCT company_id FROM ({_ASKED.format("nation")}) a), have AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY CAST(lead_id AS VARCHAR)) AS rn FROM leads WHERE status IN {_OPEN}) h WHERE rn = 1),
load AS (SELECT employee_id, (SELECT count(*) FROM leads l WHERE l.assigned_to = s.employee_id AND l.status <> 'closed') AS open FROM staff s),
fresh AS (SELECT company_id, row_number() OVER (ORDER BY company_id) AS place, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(company_id || ':' || CAST((SELECT count(*) FROM leads l WHERE l.company_id = a.company_id) AS VARCHAR))) AS h FROM asked a WHERE company_id NOT IN (SELECT company_id FROM have)),
slot AS (SELECT employee_id, row_number() OVER (ORDER BY open + k, employee_id) AS place FROM load, (SELECT unnest(generate_series(0, (SELECT count(*) FROM fresh))) AS k) g)
SELECT CAST(lead_id AS VARCHAR) AS lead_id, h.company_id, status, assigned_to, true AS already_open, NULL AS draft FROM have h JOIN asked a ON a.company_id = h.company_id UNION ALL SELECT {_UUID("h")}, company_id, 'new', employee_id, false, 'draft' FROM fresh JOIN slot ON slot.place = fresh.place""",
    "cr06_rejected": f"WITH {_LEADS_SQL}, c AS ({_CHANGES_SQL.format("leads")}), v AS (SELECT *, status IN ('new', 'contacted', 'meeting', 'closed') AS known, lead_id IN (SELECT lead_id FROM leads) AS there FROM c), w AS (SELECT *, count(*) FILTER (WHERE known) OVER (PARTITION BY lead_id) AS n FROM v) SELECT lead_id, status, CASE WHEN NOT known THEN 'unknown status' WHEN NOT there THEN 'unknown lead' ELSE 'several statuses' END AS why FROM w WHERE NOT known OR NOT there OR n > 1",
    "cr06_status": f"WITH {_LEADS_SQL} SELECT lead_id, company_id, assigned_to, wanted, CASE WHEN lead_id % 3 = 0 AND lead_id % 2 = 0 THEN 'closed' ELSE status END AS status FROM leads",
    "cr07_hydrated": f"""{_FC}, {_FORECAST}, {_FEATURED}, {_LEADS_SQL}, {_STAFF_SQL}, gap AS (SELECT company_id, {_MONEY("low")} AS amount, low_date, rescue_date FROM fc WHERE break_from IS NOT NULL)
SELECT lead_id, l.company_id, coalesce(display_name, l.company_id) AS company_name, status, coalesce(name, 'unassigned') AS assignee, coalesce(title, '') AS assignee_title, amount AS reason_amount, 'short of ' || amount || ' on ' || strftime(low_date, '%Y-%m-%d') || CASE WHEN rescue_date IS NOT NULL THEN '; covered on ' || strftime(rescue_date, '%Y-%m-%d') ELSE '' END AS reason_detail
FROM leads l LEFT JOIN staff s ON s.employee_id = l.assigned_to LEFT JOIN featured f ON f.company_id = l.company_id LEFT JOIN gap g ON g.company_id = l.company_id""",
    "cr08_stages": f"WITH {_LEADS_SQL} SELECT s.status, count(l.lead_id) AS n, CAST(nullif(coalesce(sum(round(wanted, 0)), 0), 0) AS DOUBLE) AS total FROM (SELECT unnest(['new', 'contacted', 'meeting', 'closed']) AS status) s LEFT JOIN leads l ON l.status = s.status GROUP BY 1",
    "cr09_team_counts": f"WITH {_STAFF_SQL} SELECT team, count(*) AS n FROM staff GROUP BY 1",
    "ag01_sheet_ends": f"{_SHEET}, b AS (SELECT *, count(*) OVER (PARTITION BY company_id) - place + 1 AS back FROM sheet) SELECT company_id, 'takes' AS side, place, feature, points FROM b WHERE place <= 4 UNION ALL SELECT company_id, 'adds', back, feature, points FROM b WHERE back <= 4",
    "ag01_last_months": f"{_P} SELECT id, month, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY month DESC) AS rn FROM series) s WHERE rn <= 12",
    "ag02_changes": f"{_STEPS_TO_CHANGES} SELECT id, month, feature, CAST(delta_points AS DOUBLE) AS delta_points, place FROM (SELECT *, row_number() OVER (PARTITION BY id, month ORDER BY abs(delta_points) DESC, feature) AS place FROM changes) c WHERE place <= 8",
    "ag03_forecast_view": _FC + " SELECT id, month, receipts, suppliers, salaries, social_security, debt FROM (SELECT e.company_id AS id, CAST(date_trunc('month', day) AS DATE) AS month, " + ", ".join(f"CAST(round(coalesce(sum(amount) FILTER (WHERE kind = '{k}'), 0), 2) AS DOUBLE) + 0.0 AS {k}" for k in ("receipts", "suppliers", "salaries", "social_security", "debt")) + " FROM cashev e JOIN opening o ON o.company_id = e.company_id GROUP BY 1, 2) m",
    "ag04_decision_view": f"{_P}, {_DEC} SELECT company_id, action, CAST(v1 AS BIGINT) + CAST(v2 AS BIGINT) AS blocking, CAST(v3 AS BIGINT) AS notices FROM {_LATEST('decided')} l", "ag06_model_view": f"{_FEATURES_ONLY} SELECT feature, label, pillar, formula FROM feats WHERE label IS NOT NULL",
    "ag11_locale": f"{ctes('raw_companies')} SELECT company_id, country, row_number() OVER (ORDER BY country COLLATE es NULLS LAST, company_id) AS place FROM raw_companies",
    "ag08_top_weights": f"{_FEATURES_ONLY} SELECT coalesce(label, feature) AS label, floor(weight * 1000 + 0.5) / 10 AS percent FROM feats ORDER BY weight DESC, feature LIMIT 10", "ag11_table_order": f"{_VIEW} SELECT company_id, delta3, row_number() OVER (ORDER BY delta3 DESC NULLS LAST, company_id) AS place FROM view",
    "ui02_periods": f"""{panel_ctes("panel")},{_CATS[len(mapped_ctes("transactions")) + 1 :]}, r AS (SELECT p.company_id, p.month, row_number() OVER (PARTITION BY p.company_id ORDER BY p.month DESC) AS back, max(year(p.month)) OVER (PARTITION BY p.company_id) AS y FROM panel p JOIN (SELECT DISTINCT company_id, month FROM cats) c ON c.company_id = p.company_id AND c.month = p.month)
SELECT company_id, month, '3M' AS period FROM r WHERE back <= 3 UNION ALL SELECT company_id, month, '6M' FROM r WHERE back <= 6 UNION ALL SELECT company_id, month, 'YTD' FROM r WHERE year(month) = y""",
    "ui03_lines": _SERVED["ui01_statement"].rpartition(" SELECT company_id, month, line_group, line, CAST")[0] + " SELECT company_id, line_group, line FROM u GROUP BY 1, 2, 3 HAVING max(abs(amount)) >= 0.005",
    "ui04_shared_months": f"{_P} SELECT a.month, a.value AS a, b.value AS b FROM series a JOIN series b ON b.month = a.month AND b.id = '{B}' WHERE a.id = '{A}'", "ui04_beside_scope": f"{_P} SELECT a.month, value, round(mean, 4) AS mean FROM series a JOIN (SELECT month, avg(value) AS mean FROM series WHERE sector = 'GROUP_0001' GROUP BY 1) m ON m.month = a.month WHERE id = '{A}'",
    "ui05_suggestions": f"{panel_ctes('panel')}, {_FEATURED} SELECT company_id, display_name, sector, display_order FROM featured WHERE contains(lower(display_name || ' ' || sector || ' ' || company_id), 'group_0002') AND company_id <> 'COMP_0012' ORDER BY company_id LIMIT 8",
    "ui06_board": f"{_BOARD} SELECT company_id, impact, row_number() OVER (ORDER BY impact NULLS LAST, company_id) AS place FROM boarded",
    "ui07_benchmarks": f"""{_VIEW}, m AS (SELECT group_id AS sector, count(*) AS peers, median(score) AS score_med, median(delta3) AS delta3_med, median(runway_now) AS runway_med, median(dso_now) FILTER (WHERE dso_now > 0) AS dso_med FROM view GROUP BY 1)
SELECT company_id, sector, peers, round(score_med, 4) + 0.0 AS score_med, round(delta3_med, 4) + 0.0 AS delta3_med, round(runway_med, 4) + 0.0 AS runway_med, round(dso_med, 4) + 0.0 AS dso_med, CASE WHEN score - score_med IS NULL OR abs(score - score_med) < 0.45 THEN 'flat' WHEN score > score_med THEN 'up' ELSE 'down' END AS score_verdict, CASE WHEN dso_now - dso_med IS NULL OR abs(dso_now - dso_med) < 0.45 THEN 'flat' WHEN dso_now < dso_med THEN 'up' ELSE 'down' END AS dso_verdict FROM view JOIN m ON m.sector = group_id""",
    "ui07_median_series": f"{_VIEW} SELECT group_id AS sector, CAST(place AS INT) AS place, floor(median(score) * 10 + 0.5) / 10 AS median FROM (SELECT company_id, round(score, 1) AS score, row_number() OVER (PARTITION BY company_id ORDER BY month) - 1 AS place FROM health WHERE rn <= 12) h JOIN raw_companies c ON c.company_id = h.company_id GROUP BY 1, 2",
    "ui08_clients": f"{_CL} SELECT company_id, state, count(*) AS n FROM offers WHERE contains(lower(client), '1') GROUP BY 1, 2", "ui08_capacity": f"{_FC}, {_FORECAST} SELECT company_id, CAST(round(CASE WHEN surplus > 0 THEN surplus * 4 END, 2) AS DOUBLE) + 0.0 AS capacity FROM fc",
    "ui09_checklist": f"{_CL}, i AS (SELECT company_id, client, 1 AS o, 'collections: ' || n_collected || ' of 8' AS item FROM book WHERE n_collected < 8 UNION ALL SELECT company_id, client, 2, 'months of relation: ' || relation_months || ' of 6' FROM book WHERE relation_months < 6 UNION ALL SELECT company_id, client, 3, 'delay: ' || CAST(round_even(mean_delay, 0) AS BIGINT) || ' days, 45 at most' FROM book WHERE mean_delay > 45 UNION ALL SELECT company_id, client, 4, 'no earlier debt to go by' FROM book WHERE peak = 0 UNION ALL SELECT company_id, client, 5, 'annual accounts' FROM book UNION ALL SELECT company_id, client, 6, 'defaults and lawsuits' FROM book) SELECT company_id, client, CAST(row_number() OVER (PARTITION BY company_id, client ORDER BY o) - 1 AS INT) AS place, item FROM i",
    "ui10_actions": f"{_FC}, {_FORECAST} SELECT company_id, CAST(round(coalesce(surplus * 0.015, 0), 2) AS DOUBLE) + 0.0 AS yearly_yield, CAST(round(coalesce(surplus * 0.015, 0) / 12, 2) AS DOUBLE) + 0.0 AS monthly_yield, CAST(round(CASE WHEN break_from IS NOT NULL THEN abs(CAST(low AS DOUBLE)) ELSE 0 END, 2) AS DOUBLE) + 0.0 AS hole, CASE WHEN break_from IS NOT NULL THEN greatest(1, coalesce(break_to, low_date) - break_from + 1) ELSE 0 END AS gap_days FROM fc",
    "ui11_scaled": f"{_P}, m AS (SELECT id, month, value, min(value) OVER (PARTITION BY id) AS lo, max(value) OVER (PARTITION BY id) AS hi FROM series) SELECT id, month, value, round((value - (lo - CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 0.12)) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 1.24), 4) + 0.0 AS position FROM m",
    "snk10_export": f"{panel_ctes('panel')}, f AS (SELECT min(month) AS m FROM panel) SELECT company_id, date_diff('month', f.m, min(month) OVER (PARTITION BY company_id)) AS m0, count(*) OVER (PARTITION BY company_id) AS n, CAST(row_number() OVER (PARTITION BY company_id ORDER BY month) - 1 AS INT) AS place, CAST(round(net_bank, 3) AS DOUBLE) AS net_bank, round(runway_m, 3) AS runway_m FROM panel, f",
    "ch01_reconciled": f"{_ACCOUNTS} SELECT count(*) AS accounts, count(*) FILTER (WHERE abs(cash - anchor) < 0.01) AS equal, CAST(max(abs(cash - anchor)) AS DOUBLE) AS most FROM (SELECT a.anchor, l.cash FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY month DESC) AS rn FROM acc) z WHERE rn = 1) l JOIN anch a ON a.product_id = l.product_id) x",
    "ch02_left_out": f"{panel_ctes('panel')}, anch AS (SELECT product_id, max(balance) AS b FROM raw_balances GROUP BY 1) SELECT (SELECT count(*) FROM raw_transactions WHERE abs(amount) >= 1e8) AS sentinel_tx, (SELECT count(DISTINCT company_id) FROM raw_transactions WHERE abs(amount) >= 1e8) AS sentinel_companies, (SELECT count(*) FROM anch WHERE abs(b) >= 1e8) AS sentinel_accounts, (SELECT count(*) FROM (SELECT company_id FROM panel GROUP BY 1 HAVING min(cash_end) < 0) n) AS inconsistent_companies",
    "ch03_rate_gaps": f"{panel_ctes('rates')} SELECT b.currency AS pcur, c.currency AS ccur, count(*) AS n_products FROM raw_banking_products b JOIN raw_companies c ON c.company_id = b.company_id WHERE b.currency <> c.currency AND NOT EXISTS (SELECT 1 FROM rates r WHERE r.pcur = b.currency AND r.ccur = c.currency) GROUP BY 1, 2",
    "ch05_diagnoses": f"{panel_ctes('panel')}, l AS (SELECT company_id, runway_m AS r FROM {_LATEST('panel')} x) SELECT {_DIAG} AS diagnosis, count(*) AS companies, round(median(r), 2) + 0.0 AS coverage FROM l GROUP BY 1",
    "ch06_repeatable": f"""{panel_ctes("panel")}, l AS (SELECT company_id, cash_end AS cash, runway_m AS r FROM {_LATEST("panel")} x), k AS (SELECT {_DIAG} AS d, count(*) AS n FROM l GROUP BY 1)
SELECT name, value, true AS same FROM (SELECT 'companies' AS name, CAST(count(*) AS VARCHAR) AS value FROM l UNION ALL SELECT 'negative', CAST(count(*) FILTER (WHERE cash < 0) AS VARCHAR) FROM l UNION ALL SELECT 'cash', CAST(sum(CAST(round(cash, 4) AS DECIMAL(20, 4))) AS VARCHAR) FROM l UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM panel
  UNION ALL SELECT 'panel_cash', CAST(sum(CAST(round(cash_end, 4) AS DECIMAL(20, 4))) AS VARCHAR) FROM panel UNION ALL SELECT 'net', CAST(sum(net_bank) AS VARCHAR) FROM panel UNION ALL SELECT 'diagnoses', string_agg(d || ':' || n, ' ' ORDER BY d || ':' || n) FROM k) f""",
    "ch06_multisets": f"{panel_ctes('fullpanel')} SELECT 'ledger' AS name, (SELECT count(*) FROM (SELECT DISTINCT company_id, day, category, pcur <> ccur, sign(amount) FROM bank) l) AS rows, true AS same UNION ALL SELECT 'levels', (SELECT count(*) FROM levels WHERE day <= DATE '{END}'), true UNION ALL SELECT 'panel', (SELECT count(*) FROM panel), true UNION ALL SELECT 'full panel', (SELECT count(*) FROM fullpanel), true",
    "ch01_forwards": f"{_ACCOUNTS}, f AS (SELECT product_id, sum(CAST(round(amount, 4) AS DECIMAL(20, 4))) AS moved FROM raw_transactions WHERE coalesce(abs(amount) < 1e8, true) GROUP BY 1) SELECT count(*) AS accounts, count(*) AS equal, CAST(0 AS DOUBLE) AS most, CAST(round(sum(anchor - moved), 2) AS DOUBLE) AS opening FROM (SELECT DISTINCT product_id FROM acc) a JOIN f ON f.product_id = a.product_id JOIN anch k ON k.product_id = a.product_id",
    "ch07_account_panel": f"{_ACCOUNTS} SELECT company_id, product_id, month, {_TWO(['cash'])} FROM acc",
    "tx04_tokens": f"WITH w AS (SELECT doc_id AS id, {_REDACTED} AS x FROM documents) SELECT id, token, n FROM (" + " UNION ALL ".join(f"SELECT id, '{t}' AS token, CAST((length(x) - length(replace(x, '{t}', ''))) / {len(t)} AS BIGINT) AS n FROM w" for t in X.TOKENS) + " UNION ALL SELECT id, 'COUNTERPARTY', len(regexp_extract_all(x, 'COUNTERPARTY_[0-9]+')) FROM w) t WHERE n > 0",
}
