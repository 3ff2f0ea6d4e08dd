"""Queries of stress events, the cash forecast and the client book, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import clients as C
from ledgerlake.operators import events as E
from ledgerlake.operators import forecast as W
from ledgerlake.plans.bindings import HORIZON, raw
from ledgerlake.plans.mapping_queries import mapped, mapped_ctes
from ledgerlake.plans.panel_queries import Domain, panel_ctes, rounded

DAYS = W.Window3(HORIZON.snapshot, date(2001, 11, 2), date(2002, 1, 31), date(2001, 5, 1))
YEAR_START = date(2000, 11, 1)
_MONEY = ["outflow_op", "out_salary", "out_social_security", "out_tax", "out_fin_cost", "net_op_3m", "outflow_op_3m", "payables_overdue90_recent"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate(Domain(spark, sf_dir).full())


class Forecast:
    def __init__(self, spark: SparkSession, sf_dir: str, domain: Domain | None = None):
        """domain: that of the query, if it has one, so that ledger and panel are made once."""
        d = domain or Domain(spark, sf_dir)
        self.days = W.pay_days(d.moves, DAYS)
        self.habits = W.medians(d.panel, DAYS)
        self.invoices = W.open_invoices(d.bills, d.companies, DAYS)
        self.events = W.cash_events(self.invoices, self.habits, self.days, DAYS)
        self.opening = W.openings(d.panel, HORIZON.last)
        self.path = W.daily_path(self.events, self.opening, DAYS)
        self.banking = d.banking

    def result(self) -> DataFrame:
        return W.forecast(self.path, self.events, self.habits)


def _categories(d: Domain) -> DataFrame:
    return W.category_breakdown(d.rows, YEAR_START, HORIZON.snapshot)


class Clients:
    def __init__(self, spark: SparkSession, sf_dir: str):
        rows = C.base(mapped(spark, sf_dir, "invoices"), HORIZON.snapshot)
        self.facts = C.behaviour(rows, HORIZON.snapshot, YEAR_START)
        self.peaks = C.peaks(rows, YEAR_START, HORIZON.snapshot)
        self.book = C.book(self.facts, self.peaks)
        self.offers = C.offers(self.book)
        self.surety = C.surety(raw(spark, sf_dir, "raw_debt_products"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested maps, flattened again: company, month, category, amount."""
    maps = W.nested_categories(_categories(Domain(spark, sf_dir)))
    return maps.select("company_id", F.explode("categories").alias("month", "m")).select("company_id", "month", F.explode("m").alias("category", "amount"))


QUERIES = {
    "ev08_events": _events, "ev09_forward": lambda s, d: E.forward(_events(s, d), 3), "ev10_diagnosis": lambda s, d: E.diagnose(_events(s, d)), "ev11_cooccurrence": lambda s, d: E.cooccurrence(_events(s, d)), "ev12_any_event": lambda s, d: E.any_rates(_events(s, d)),
    "fc01_pay_days": lambda s, d: W.pay_days(Domain(s, d).moves, DAYS), "fc02_medians": lambda s, d: rounded(Forecast(s, d).habits), "fc03_open_invoices": lambda s, d: rounded(Forecast(s, d).invoices),
    "fc04_categories": lambda s, d: rounded(_categories(Domain(s, d))), "fc04_nested_categories": _nested, "fc07_monthly": lambda s, d: rounded((f := Forecast(s, d)) and W.monthly(f.events, f.opening)),
    "fc08_daily_path": lambda s, d: rounded(Forecast(s, d).path), "fc13_forecast": lambda s, d: rounded(Forecast(s, d).result()),
    "cl02_behaviour": lambda s, d: rounded(Clients(s, d).facts), "cl04_peak_exposure": lambda s, d: rounded(Clients(s, d).peaks), "cl06_client_book": lambda s, d: rounded(Clients(s, d).book), "cl12_offers": lambda s, d: Clients(s, d).offers,
    "cl13_company_book": lambda s, d: rounded((c := Clients(s, d)) and C.companies_book(c.offers, c.book, c.surety)), "cl14_states": lambda s, d: Clients(s, d).offers.groupBy("state").agg(F.count(F.lit(1)).alias("n")),
}

_OB = ("out_salary", "out_social_security", "out_tax")
_H = ", ".join(f"CASE WHEN count(*) OVER b = 6 THEN sum(CASE WHEN {o} > 0 THEN 1 ELSE 0 END) OVER b >= 5 END AS u_{o}" for o in _OB)
_EVENTS = f"""{panel_ctes("fullpanel")},
dbl AS (SELECT company_id, month, n_tx, days_negative, has_invoices, CAST(runway_m AS DOUBLE) AS runway_m, CAST(margin_3m AS DOUBLE) AS margin_3m, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY)} FROM fullpanel WHERE hist_months >= 6),
looked AS (SELECT *, {_H}, CASE WHEN count(*) OVER b = 6 THEN median(out_fin_cost) OVER b END AS fin_median FROM dbl WINDOW b AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
ev AS (SELECT company_id, month,
  CASE WHEN ({" OR ".join(f"coalesce(u_{o}, false)" for o in _OB)}) AND n_tx > 0 THEN CASE WHEN {" OR ".join(f"(coalesce(u_{o}, false) AND {o} <= 0)" for o in _OB)} THEN 1.0 ELSE 0.0 END END AS regular_payment_missing,
  CASE WHEN has_invoices AND outflow_op_3m > 0 THEN CASE WHEN payables_overdue90_recent >= 0.25 * (outflow_op_3m / 3) THEN 1.0 ELSE 0.0 END END AS bills_overdue,
  CASE WHEN days_negative IS NOT NULL THEN CASE WHEN days_negative >= 5 THEN 1.0 ELSE 0.0 END END AS negative_balance,
  CASE WHEN runway_m IS NOT NULL AND margin_3m IS NOT NULL THEN CASE WHEN net_op_3m < 0 AND runway_m < 1 THEN 1.0 ELSE 0.0 END END AS cash_running_out,
  CASE WHEN fin_median IS NOT NULL AND outflow_op > 0 THEN CASE WHEN out_fin_cost > 3 * fin_median AND out_fin_cost > 0.02 * outflow_op AND fin_median > 0 THEN 1.0 ELSE 0.0 END END AS financial_cost_jump FROM looked)
"""
_DBL = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in E.NAMES)
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT company_id, month, '{n}' AS event, {n} AS x FROM ev" for n in E.NAMES) + ")"
_ANY = lambda names: "greatest(" + ", ".join(names) + ")"
_FC = f"""{panel_ctes("panel", "invoices")},
recurring AS (SELECT company_id, category, day(date) AS d, abs(sum(CAST(round(amount, 4) AS DECIMAL(20, 4)))) AS total FROM transactions_mapped WHERE category IN ('salary', 'social_security', 'debt_repayment') AND CAST(date AS DATE) >= DATE '{DAYS.habits_from}' GROUP BY 1, 2, 3),
paydays AS (SELECT company_id, category, least(d, 28) AS pay_day FROM (SELECT *, row_number() OVER (PARTITION BY company_id, category ORDER BY total DESC, d) AS rn FROM recurring) r WHERE rn = 1),
habits AS (SELECT company_id, median(CAST(out_salary AS DOUBLE)) AS salary, median(CAST(out_social_security AS DOUBLE)) AS social_security, median(CAST(debt_service AS DOUBLE)) AS debt_repayment, median(CAST(outflow_op + debt_service AS DOUBLE)) AS spend FROM panel WHERE month >= DATE '{DAYS.habits_from}' GROUP BY company_id),
openinv AS (SELECT i.company_id, CAST(due_date AS DATE) AS day, CAST(round(CASE WHEN amount > 0 THEN abs(pending_amount) ELSE -abs(pending_amount) END, 4) AS DECIMAL(20, 4)) AS amount, CASE WHEN amount > 0 THEN 'receipts' ELSE 'suppliers' END AS kind, counterparty_id
  FROM invoices_mapped i JOIN raw_companies c ON c.company_id = i.company_id WHERE document_type IN ('invoice', 'invoiceGroup') AND status NOT IN ('cancelled', 'paid') AND abs(pending_amount) > 0 AND i.currency = c.currency
  AND CAST(issuance_date AS DATE) <= DATE '{DAYS.snapshot}' AND CAST(due_date AS DATE) BETWEEN DATE '{DAYS.start}' AND DATE '{DAYS.end}'),
usual AS (SELECT company_id, 'salary' AS category, 'salaries' AS kind, salary AS amount FROM habits UNION ALL SELECT company_id, 'social_security', 'social_security', social_security FROM habits UNION ALL SELECT company_id, 'debt_repayment', 'debt', debt_repayment FROM habits),
cashev AS (SELECT * FROM openinv UNION ALL SELECT u.company_id, CAST(m.month + CAST(coalesce(pay_day, 28) - 1 AS INT) AS DATE), CAST(round(-amount, 4) AS DECIMAL(20, 4)), kind, NULL FROM usual u LEFT JOIN paydays p ON p.company_id = u.company_id AND p.category = u.category, (SELECT DATE '2001-11-01' AS month UNION ALL SELECT DATE '2001-12-01' UNION ALL SELECT DATE '2002-01-01') m WHERE amount > 0),
opening AS (SELECT company_id, CAST(round(cash_end, 4) AS DECIMAL(20, 4)) AS cash FROM panel WHERE month = DATE '{HORIZON.last}' AND NOT inconsistent_balance AND cash_end > 0),
spine AS (SELECT CAST(unnest(generate_series(DATE '{DAYS.start}', DATE '{DAYS.end}', INTERVAL 1 DAY)) AS DATE) AS day),
path AS (SELECT o.company_id, s.day, cash, cash + (SELECT coalesce(sum(amount), 0) FROM cashev e WHERE e.company_id = o.company_id AND e.day BETWEEN DATE '{DAYS.start}' AND s.day) AS level FROM opening o, spine s),
breaks AS (SELECT company_id, min(day) AS break_from FROM path WHERE level < 0 GROUP BY company_id),
backs AS (SELECT p.company_id, min(p.day) AS back FROM path p JOIN breaks b ON b.company_id = p.company_id WHERE p.day > break_from AND level >= 0 GROUP BY p.company_id),
streak AS (SELECT p.company_id, p.cash, p.day, p.level, b.break_from, k.back FROM path p LEFT JOIN breaks b ON b.company_id = p.company_id LEFT JOIN backs k ON k.company_id = p.company_id WHERE b.break_from IS NULL OR (p.day >= b.break_from AND (k.back IS NULL OR p.day < k.back))),
lows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY level, day) AS rn FROM streak) x WHERE rn = 1),
paid AS (SELECT l.company_id, coalesce(sum(-amount), 0) AS paid_before, count(amount) AS n_paid_before FROM lows l LEFT JOIN cashev e ON e.company_id = l.company_id AND e.day <= l.break_from AND amount < 0 WHERE l.break_from IS NOT NULL GROUP BY l.company_id),
rescue AS (SELECT *, sum(amount) OVER (PARTITION BY company_id) AS total FROM (SELECT e.*, row_number() OVER (PARTITION BY e.company_id ORDER BY e.amount DESC, counterparty_id DESC NULLS LAST) AS rn FROM cashev e JOIN lows l ON l.company_id = e.company_id WHERE e.day = l.back AND kind = 'receipts') r)
"""
_CATS = f"""{mapped_ctes("transactions")},
t AS (SELECT t.company_id, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN category = 'uncategorized' THEN 'no_category' ELSE category END AS category, CASE WHEN exchange_rate > 0 THEN amount / exchange_rate ELSE amount END AS a FROM transactions_mapped t WHERE product_id IN (SELECT product_id FROM raw_banking_products)),
cats AS (SELECT company_id, month, category, sum(CAST(round(least(greatest(a, lo), hi), 4) AS DECIMAL(20, 4))) AS amount FROM t, (SELECT quantile_cont(a, 0.001) AS lo, quantile_cont(a, 0.999) AS hi FROM t) q WHERE month >= DATE '{YEAR_START}' AND month < DATE '{HORIZON.snapshot}' GROUP BY 1, 2, 3 HAVING abs(sum(CAST(round(least(greatest(a, lo), hi), 4) AS DECIMAL(20, 4)))) >= 0.005)
"""
_S = f"DATE '{HORIZON.snapshot}'"
_STEP = lambda v: f"CASE WHEN {v} > 0 THEN greatest(floor({v} / (CASE WHEN {v} < 5000 THEN 500 WHEN {v} < 50000 THEN 1000 WHEN {v} < 500000 THEN 5000 ELSE 25000 END)) * (CASE WHEN {v} < 5000 THEN 500 WHEN {v} < 50000 THEN 1000 WHEN {v} < 500000 THEN 5000 ELSE 25000 END), (CASE WHEN {v} < 5000 THEN 500 WHEN {v} < 50000 THEN 1000 WHEN {v} < 500000 THEN 5000 ELSE 25000 END)) ELSE 0 END"
_UNIT = lambda salt: f"CAST(CAST('0x' || substr(sha1(company_id || ':' || client || ':{salt}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
_CL = f"""{mapped_ctes("invoices", "debt_products")},
ar AS (SELECT *, coalesce(payment <= {_S} AND status = 'paid', false) AS collected FROM (SELECT company_id, counterparty_id AS client, CAST(round(amount, 4) AS DECIMAL(20, 4)) AS amount, CAST(round(abs(pending_amount), 4) AS DECIMAL(20, 4)) AS pending, status, CAST(issuance_date AS DATE) AS issuance, CAST(due_date AS DATE) AS due, CAST(payment_date AS DATE) AS payment
  FROM invoices_mapped WHERE amount > 0 AND document_type IN ('invoice', 'invoiceGroup') AND status <> 'cancelled' AND counterparty_id IS NOT NULL) z WHERE issuance <= {_S}),
facts AS (SELECT company_id, client, count(*) AS n_invoices, count(*) FILTER (WHERE collected) AS n_collected, coalesce(sum(amount) FILTER (WHERE issuance >= DATE '{YEAR_START}'), 0) AS sales_12m,
  coalesce(sum(pending) FILTER (WHERE status <> 'paid'), 0) AS exposure, coalesce(sum(pending) FILTER (WHERE status <> 'paid' AND due < {_S}), 0) AS overdue, coalesce(sum(pending) FILTER (WHERE status <> 'paid' AND due < {_S} - 90), 0) AS overdue_90,
  round(avg(payment - due) FILTER (WHERE collected), 1) AS mean_delay, 100.0 * count(*) FILTER (WHERE collected AND payment > due) / nullif(count(*) FILTER (WHERE collected), 0) AS late_pct,
  date_diff('month', min(issuance), {_S}) AS relation_months, max(payment) FILTER (WHERE collected) AS last_collection FROM ar GROUP BY 1, 2),
starts AS (SELECT CAST(unnest(generate_series(DATE '{YEAR_START}', {_S}, INTERVAL 1 MONTH)) AS DATE) AS m),
peaks AS (SELECT company_id, client, max(open) AS peak FROM (SELECT company_id, client, m, sum(amount) AS open FROM ar, starts WHERE issuance <= m AND (payment IS NULL OR payment > m) GROUP BY 1, 2, 3) o GROUP BY 1, 2),
ranked AS (SELECT f.*, coalesce(peak, 0) AS peak, row_number() OVER (PARTITION BY f.company_id ORDER BY sales_12m DESC, f.client) AS r0 FROM facts f LEFT JOIN peaks p ON p.company_id = f.company_id AND p.client = f.client WHERE sales_12m > 0),
book AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY sales_12m DESC, client) AS rank FROM ranked WHERE sales_12m >= 1000 OR r0 <= 12) b WHERE rank <= 25),
step1 AS (SELECT *, CAST(peak AS DOUBLE) AS pk, CAST(sales_12m AS DOUBLE) AS sales, {_STEP("CAST(peak AS DOUBLE)")} AS first_limit, CAST('0x' || substr(sha1(company_id || ':' || client), 1, 2) AS BIGINT) % 2 = 0 AS complete, least(floor({_UNIT("cover")} * 5) + CASE WHEN mean_delay <= 0 AND overdue_90 = 0 THEN 1 ELSE 0 END, 4) AS tier,
  concat_ws(', ', CASE WHEN n_collected < 8 THEN 'collected' END, CASE WHEN relation_months < 6 THEN 'relation' END, CASE WHEN mean_delay > 45 THEN 'delay' END) AS missing FROM book),
step2 AS (SELECT *, CASE WHEN overdue_90 > 0 OR coalesce(mean_delay > 60, false) THEN 'declined' WHEN missing <> '' OR first_limit <= 0 THEN 'study' ELSE 'preapproved' END AS state, first_limit * (0.8 + 0.5 * {_UNIT("limit")}) AS jittered, [0.75, 0.80, 0.85, 0.90, 0.95][CAST(tier AS INT) + 1] AS cover FROM step1),
step3 AS (SELECT *, {_STEP("jittered")} AS drawn, greatest(pk, sales / 6, 500.0) AS fallback FROM step2),
offers AS (SELECT company_id, client, rank, state, CASE WHEN complete THEN 'complete' ELSE 'incomplete' END AS file, CAST(cover AS DOUBLE) AS cover, CAST(CASE WHEN state = 'study' AND complete AND drawn <= 0 THEN {_STEP("fallback")} ELSE drawn END AS DOUBLE) AS credit_limit, round(sales * cover * 0.0035, 2) AS premium,
  CASE WHEN overdue_90 > 0 THEN replace(format('{{:,}}', CAST(round(overdue_90, 0) AS BIGINT)), ',', '.') || ' € overdue by more than 90 days' WHEN state = 'declined' THEN 'pays too late' WHEN state = 'study' THEN 'missing: ' || missing ELSE 'clean record' END AS reason FROM step3),
bonds AS (SELECT company_id, count(*) AS products, sum(CAST(round(abs(coalesce(granted, outstanding)), 4) AS DECIMAL(20, 4))) AS line, sum(CAST(round(abs(outstanding), 4) AS DECIMAL(20, 4))) AS bonded FROM raw_debt_products WHERE type = 'guarantee' GROUP BY 1)
"""
_R = lambda cols: ", ".join(f"CAST(round({c}, 2) AS DOUBLE) + 0.0 AS {c.split('.')[-1]}" for c in cols)
_FACTS = f"company_id, client, n_invoices, n_collected, {_R(['sales_12m', 'exposure', 'overdue', 'overdue_90', 'mean_delay', 'late_pct'])}, relation_months, last_collection"
ORACLE_SQL = {
    "ev08_events": f"{_EVENTS} SELECT company_id, month, {_DBL} FROM ev",
    "ev09_forward": f"{_EVENTS} SELECT company_id, month, {', '.join(f'CAST(CASE WHEN count({n}) OVER a = 3 THEN max({n}) OVER a END AS DOUBLE) AS {n}_y3' for n in E.NAMES)} FROM ev WINDOW a AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)",
    "ev10_diagnosis": f"""{_EVENTS}, {_LONG}, lagged AS (SELECT *, lag(x) OVER (PARTITION BY company_id, event ORDER BY month) AS before FROM long)
SELECT event, CAST(round(100.0 * count(x) / count(*), 1) AS DOUBLE) AS applicable_pct, CAST(round(100.0 * count(*) FILTER (WHERE x = 1) / nullif(count(x), 0), 2) AS DOUBLE) AS base_rate_pct, CAST(round(100.0 * count(*) FILTER (WHERE before = 1 AND x = 1) / nullif(count(*) FILTER (WHERE before = 1 AND x IS NOT NULL), 0), 1) AS DOUBLE) AS persistence_pct,
  (SELECT CAST(round(100.0 * count(*) FILTER (WHERE m = 1) / nullif(count(m), 0), 1) AS DOUBLE) FROM (SELECT company_id, max(x) AS m FROM long l WHERE l.event = lagged.event GROUP BY company_id) e) AS ever_pct FROM lagged GROUP BY event""",
    "ev11_cooccurrence": f"{_EVENTS}, {_LONG} SELECT a.event AS a, b.event AS b, CAST(round(CAST(count(*) FILTER (WHERE a.x = 1 AND b.x = 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE a.x = 1 OR b.x = 1), 1), 3) AS DOUBLE) AS jaccard FROM long a JOIN long b ON a.company_id = b.company_id AND a.month = b.month AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2",
    "ev12_any_event": f"{_EVENTS} " + " UNION ALL ".join(f"SELECT '{k}' AS left_out, count({_ANY(g)}) AS rows, CAST(round(100.0 * avg(CASE WHEN {_ANY(g)} IS NULL THEN NULL WHEN {_ANY(g)} = 1 THEN 1 ELSE 0 END), 1) AS DOUBLE) AS rate_pct FROM ev" for k, g in ({"": E.NAMES} | {n: [x for x in E.NAMES if x != n] for n in E.NAMES}).items()),
    "fc01_pay_days": f"{_FC} SELECT company_id, category, CAST(pay_day AS INT) AS pay_day FROM paydays", "fc02_medians": f"{_FC} SELECT company_id, {_R(['salary', 'social_security', 'debt_repayment', 'spend'])} FROM habits",
    "fc03_open_invoices": f"{_FC} SELECT company_id, day, {_R(['amount'])}, kind, counterparty_id FROM openinv",
    "fc04_categories": f"{_CATS} SELECT company_id, month, category, {_R(['amount'])} FROM cats", "fc04_nested_categories": f"{_CATS} SELECT company_id, strftime(month, '%Y-%m') AS month, category, {_R(['amount'])} FROM cats",
    "fc07_monthly": f"{_FC} SELECT e.company_id, CAST(date_trunc('month', day) AS DATE) AS month, " + ", ".join(f"CAST(round(coalesce(sum(amount) FILTER (WHERE kind = '{k}'), 0), 2) AS DOUBLE) + 0.0 AS {k}" for k in ("receipts", "suppliers", "salaries", "social_security", "debt")) + " FROM cashev e JOIN opening o ON o.company_id = e.company_id GROUP BY 1, 2",
    "fc08_daily_path": f"{_FC} SELECT company_id, day, {_R(['cash', 'level'])} FROM path",
    "fc13_forecast": f"""{_FC} SELECT l.company_id, {_R(["cash"])}, CAST(round(level, 2) AS DOUBLE) + 0.0 AS low, l.day AS low_date, break_from, CAST(back - 1 AS DATE) AS break_to, CAST(round(paid_before, 2) AS DOUBLE) + 0.0 AS paid_before, n_paid_before, CASE WHEN r.company_id IS NOT NULL THEN back END AS rescue_date,
  CAST(round(r.amount, 2) AS DOUBLE) + 0.0 AS rescue_amount, r.counterparty_id AS rescue_counterparty, CAST(round(r.total, 2) AS DOUBLE) + 0.0 AS rescue_day_total, CAST(round(CASE WHEN break_from IS NULL AND spend > 0 AND CAST(level AS DOUBLE) - spend >= 25000 THEN CAST(level AS DOUBLE) - spend END, 2) AS DOUBLE) + 0.0 AS surplus, CAST(round(coalesce(spend, 0), 2) AS DOUBLE) + 0.0 AS monthly_spend
FROM lows l LEFT JOIN paid p ON p.company_id = l.company_id LEFT JOIN rescue r ON r.company_id = l.company_id AND r.rn = 1 LEFT JOIN habits h ON h.company_id = l.company_id""",
    "cl02_behaviour": f"{_CL} SELECT {_FACTS} FROM facts", "cl04_peak_exposure": f"{_CL} SELECT company_id, client, {_R(['peak'])} FROM peaks",
    "cl06_client_book": f"{_CL} SELECT {_FACTS}, {_R(['peak'])}, CAST(rank AS INT) AS rank FROM book", "cl12_offers": f"{_CL} SELECT * REPLACE (CAST(rank AS INT) AS rank) FROM offers",
    "cl13_company_book": f"""{_CL} SELECT coalesce(t.company_id, b.company_id) AS company_id, CAST(round(sales_12m, 2) AS DOUBLE) + 0.0 AS sales_12m, clients, declined, study, preapproved, products, CAST(round(line, 2) AS DOUBLE) + 0.0 AS line, CAST(round(bonded, 2) AS DOUBLE) + 0.0 AS bonded
FROM (SELECT k.company_id, sum(sales_12m) AS sales_12m, count(*) AS clients, count(*) FILTER (WHERE state = 'declined') AS declined, count(*) FILTER (WHERE state = 'study') AS study, count(*) FILTER (WHERE state = 'preapproved') AS preapproved FROM book k JOIN offers o ON o.company_id = k.company_id AND o.client = k.client GROUP BY 1) t FULL JOIN bonds b ON b.company_id = t.company_id""",
    "cl14_states": f"{_CL} SELECT state, count(*) AS n FROM offers GROUP BY state",
}
