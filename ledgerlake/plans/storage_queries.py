"""Queries that write tables and read them back: row reader, versions, stream, buckets, cash history; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.constants import UNITS_PER_EUR
from ledgerlake.operators.history import CashHistory
from ledgerlake.plans.bindings import HORIZON, ctes, raw
from ledgerlake.plans.panel_queries import rounded
from ledgerlake.sources.layout import bucket_count, bucketed
from ledgerlake.sources.rows import read
from ledgerlake.sources.staging import scratch, staged
from ledgerlake.sources.versions import VersionedTable
from ledgerlake.streaming.upserts import run

#: What is asked of the row reader.
REQUEST = {"select": "o_orderkey,o_custkey,o_totalprice", "o_totalprice": "gte.150000", "o_orderstatus": "in.(F,O)", "o_custkey": "lt.1000", "order": "o_totalprice.desc,o_orderkey", "limit": "200"}


def src07_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, f"{sf_dir}/orders.parquet", "o_orderkey", REQUEST)


def snk05_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is refreshed, a refresh that loses rows fails, one that is wrong is taken back: (version, rows, total)."""
    table = VersionedTable(spark, scratch(spark, "orders-table"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).cast("decimal(20,2)").alias("price"))
    table.publish(orders.where("o_orderstatus <> 'O'"), F.col("o_orderstatus"))
    table.publish(orders, F.col("o_orderstatus"))
    try:
        table.publish(orders.where("o_orderkey % 2 = 0"), F.col("o_orderstatus"), expected=table.manifest().count)
    except ValueError:
        pass
    table.publish(orders.withColumn("price", F.lit(0).cast("decimal(20,2)")), F.col("o_orderstatus"))
    table.roll_back(2)
    out = None
    for n in table.numbers():
        one = table.read(n).agg(F.lit(n).cast("long").alias("version"), F.count(F.lit(1)).alias("rows"), F.sum("price").cast("double").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def snk03_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and changes of a third of them, in several batches of a stream; a run that starts anew repeats them all."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.lit(0).alias("seq"))
    changed = orders.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.round(F.col("price") * 2, 2).alias("price"), F.lit(1).alias("seq"))
    source, root = scratch(spark, "orders-stream"), scratch(spark, "orders-upserted")
    orders.repartition(3).write.parquet(source)
    changed.repartition(2).write.mode("append").parquet(source)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 2).parquet(source)
    for k in range(2):
        run(stream, root, f"{root}-checkpoint-{k}", ["o_orderkey"], "seq").awaitTermination()
    return VersionedTable(spark, root).read().drop("seq")


def snk09_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders, bucketed by order, joined and summed by order."""
    raw_lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    buckets = bucket_count(raw_lines.count())
    lines = bucketed(raw_lines.select("l_orderkey", F.round("l_extendedprice", 2).cast("decimal(20,2)").alias("price")), "lines", ["l_orderkey"], buckets)
    orders = bucketed(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "orders", ["o_orderkey"], buckets)
    return lines.join(orders.hint("merge"), lines["l_orderkey"] == orders["o_orderkey"]).groupBy("l_orderkey", "o_custkey").agg(F.sum("price").cast("double").alias("total"), F.count(F.lit(1)).alias("lines"))


def _history(spark: SparkSession, sf_dir: str) -> CashHistory:
    """The cash history of all transactions, of which some of 1997 come late. They are staged, so that the joins they come
    from run once, not once for each table and once more for the late ones."""
    late = F.col("transaction_id").endswith("7_1") & (F.year("date") <= 1997)
    tx = staged(raw(spark, sf_dir, "raw_transactions").select("company_id", "product_id", F.to_date("date").alias("date"), "amount", late.alias("late")), "history-movements")
    history = CashHistory(spark, scratch(spark, "cash-history"), HORIZON.last)
    history.build(tx.where("NOT late").drop("late"), raw(spark, sf_dir, "raw_balances"), raw(spark, sf_dir, "raw_banking_products"))
    history.add(tx.where("late").drop("late"))
    return history


_H = lambda name: lambda spark, sf_dir: rounded(_history(spark, sf_dir).table(name), 2)
#: What of each table is added up beside its rows.
_SUMS = {"panel_product": "cash", "panel_company": "cash_eur", "cash_metrics": "cash_eur", "cash_product": "anchor", "tx_flags": "movements", "sentinel_tx": "sentinels", "company_flags": "CAST(is_reliable AS INT)", "cash_summary": "CAST(has_drift AS INT)", "fx_gap": "n_products"}


def ch07_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, out = _history(spark, sf_dir), None
    for name, c in _SUMS.items():
        one = history.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.expr(c)).cast("double"), F.lit(0.0)).alias("total"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 2)


QUERIES = {"ch07_tables": ch07_tables, "ch07_metrics": _H("cash_metrics"), "ch07_summary": _H("cash_summary"), "src07_rows": src07_rows, "snk05_refresh": snk05_refresh, "snk03_stream": snk03_stream, "snk09_colocated": snk09_colocated}
_UNITS = "CASE upper(trim(currency)) " + " ".join(f"WHEN '{c}' THEN {u}" for c, u in UNITS_PER_EUR.items()) + " END"
_HISTORY = f"""{ctes("raw_transactions", "raw_balances", "raw_banking_products")},
acc AS (SELECT b.product_id, b.company_id, currency, max(CAST(round(balance, 4) AS DECIMAL(20, 4))) AS anchor FROM raw_balances b JOIN raw_banking_products p ON p.product_id = b.product_id GROUP BY 1, 2, 3 HAVING max(balance) IS NOT NULL),
t AS (SELECT company_id, product_id, CAST(date_trunc('month', date) AS DATE) AS month, amount, coalesce(abs(amount) >= 1e8, false) AS sentinel FROM raw_transactions),
n AS (SELECT product_id, month, sum(a) AS net, coalesce(sum(-a) FILTER (WHERE a < 0), 0) AS spent FROM (SELECT product_id, month, CAST(round(amount, 4) AS DECIMAL(20, 4)) AS a FROM t WHERE NOT sentinel AND product_id IN (SELECT product_id FROM acc WHERE abs(anchor) < 1e8)) x GROUP BY 1, 2),
g AS (SELECT product_id, CAST(unnest(generate_series(a, DATE '{HORIZON.last}', INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT product_id, min(month) AS a FROM n GROUP BY 1) s),
pp AS (SELECT company_id, g.product_id, g.month, anchor, anchor - coalesce((SELECT sum(net) FROM n WHERE n.product_id = g.product_id AND n.month > g.month), 0) AS cash, coalesce((SELECT sum(spent) FROM n WHERE n.product_id = g.product_id AND n.month = g.month), 0) AS spent, {_UNITS} AS units FROM g JOIN acc ON acc.product_id = g.product_id),
pc AS (SELECT company_id, month, sum(CAST(round(CAST(cash AS DOUBLE) / units, 4) AS DECIMAL(20, 4))) AS cash_eur, sum(CAST(round(CAST(spent AS DOUBLE) / units, 4) AS DECIMAL(20, 4))) AS spent_eur FROM pp WHERE units IS NOT NULL GROUP BY 1, 2),
m AS (SELECT company_id, month, cash_eur, CAST(cash_eur AS DOUBLE) / nullif(CASE WHEN count(*) OVER w = 3 THEN CAST(sum(spent_eur) OVER w AS DOUBLE) / 3 END, 0) AS coverage FROM pc WINDOW w AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
_TWO = lambda c: f"CAST(round({c}, 2) AS DOUBLE) + 0.0 AS {c}"
ORACLE_SQL = {
    "ch07_tables": f"""{_HISTORY}, l AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM m), s AS (SELECT EXISTS (SELECT 1 FROM pp WHERE pp.company_id = l.company_id AND anchor >= 0 AND cash < 0) AS has_drift FROM l WHERE rn = 1),
f AS (SELECT NOT (company_id IN (SELECT company_id FROM t WHERE sentinel) OR company_id IN (SELECT company_id FROM acc WHERE abs(anchor) >= 1e8)) AS is_reliable FROM (SELECT company_id FROM t UNION SELECT company_id FROM acc) c),
sent AS (SELECT company_id, count(*) AS k FROM t WHERE sentinel GROUP BY 1), gap AS (SELECT currency, count(*) AS k FROM acc WHERE {_UNITS} IS NULL GROUP BY 1)
SELECT name, rows, CAST(round(coalesce(total, 0), 2) AS DOUBLE) + 0.0 AS total FROM (""" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, CAST({v} AS DOUBLE) AS total FROM {t}" for n, t, v in (("panel_product", "pp", "sum(cash)"), ("panel_company", "pc", "sum(cash_eur)"), ("cash_metrics", "m", "sum(cash_eur)"), ("cash_product", "acc", "sum(anchor)"), ("tx_flags", "(SELECT company_id, count(*) AS k FROM t GROUP BY 1) z", "sum(k)"), ("sentinel_tx", "sent", "sum(k)"), ("company_flags", "f", "count(*) FILTER (WHERE is_reliable)"), ("cash_summary", "s", "count(*) FILTER (WHERE has_drift)"), ("fx_gap", "gap", "sum(k)"))) + ") u",
    "ch07_metrics": f"{_HISTORY} SELECT company_id, month, {_TWO('cash_eur')}, {_TWO('coverage')} FROM m",
    "ch07_summary": f"""{_HISTORY}, l AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM m)
SELECT company_id, month, {_TWO("cash_eur")}, {_TWO("coverage")}, CASE WHEN coverage IS NULL THEN 'unknown' WHEN coverage < 0 THEN 'negative' WHEN coverage < 1 THEN 'critical' WHEN coverage < 3 THEN 'tight' ELSE 'covered' END AS diagnosis, EXISTS (SELECT 1 FROM pp WHERE pp.company_id = l.company_id AND anchor >= 0 AND cash < 0) AS has_drift FROM l WHERE rn = 1""",
    "src07_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus IN ('F', 'O') AND o_custkey < 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 200",
    "snk05_refresh": "WITH o AS (SELECT o_orderstatus, CAST(round(o_totalprice, 2) AS DECIMAL(20, 2)) AS price FROM orders), a AS (SELECT count(*) AS rows, CAST(sum(price) AS DOUBLE) AS total FROM o) SELECT CAST(1 AS BIGINT) AS version, count(*) AS rows, CAST(sum(price) AS DOUBLE) AS total FROM o WHERE o_orderstatus <> 'O' UNION ALL SELECT 2, * FROM a UNION ALL SELECT 3, rows, 0.0 FROM a UNION ALL SELECT 4, * FROM a",
    "snk03_stream": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders",
    "snk09_colocated": "SELECT l_orderkey, o_custkey, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(20, 2))) AS DOUBLE) AS total, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
}
