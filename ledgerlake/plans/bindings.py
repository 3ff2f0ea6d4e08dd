"""The domain's raw tables over the star schema of the test data, in SQL that Spark and other engines read alike.

A nation is a company and a region a group; shipped lines are bank transactions, orders invoices. Every supplier is a
banking product, or a debt product if its key ends in 6 or 7. Some transactions and balances name products that no
catalogue has. Accounts in francs have no known rate, and some customers get refunds. Dirty values are made on purpose: every cleaning rule has rows that need it.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.constants import Horizon

#: The test data's months and snapshot.
HORIZON = Horizon(date(1995, 1, 1), date(2001, 10, 1), date(2001, 11, 1))
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
COMPANY = "'COMP_' || lpad(CAST({} AS STRING), 4, '0')"
PRODUCT = "'PRODUCT_' || lpad(CAST({} AS STRING), 5, '0')"

SQL = {
    "raw_groups": """
SELECT 'GROUP_' || lpad(CAST(r_regionkey AS STRING), 4, '0') AS group_id,
  CASE r_regionkey WHEN 0 THEN 'Microsoft Business Central' WHEN 1 THEN 'Infor M3 ' WHEN 2 THEN 'Unknown ERP' WHEN 3 THEN NULL ELSE 'sage200' END AS erp,
  CAST(r_regionkey AS INT) AS n_companies_in_sample
FROM {region}""",
    "raw_companies": f"""
SELECT {COMPANY.format("n_nationkey")} AS company_id, 'GROUP_' || lpad(CAST(n_regionkey AS STRING), 4, '0') AS group_id,
  CASE n_nationkey % 7 WHEN 0 THEN 'ESPAÑA' WHEN 1 THEN ' es ' WHEN 2 THEN 'Spain' WHEN 3 THEN n_name WHEN 4 THEN NULL WHEN 5 THEN 'Portugal' ELSE 'fr' END AS country,
  CASE n_nationkey % 5 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE n_nationkey % 6 WHEN 0 THEN 'businessCentral' WHEN 1 THEN 'Microsoft Dynamics - AX 2009' WHEN 2 THEN '' WHEN 3 THEN 'Other' WHEN 4 THEN 'MOVEX' ELSE 'holded' END AS erp,
  CAST(CAST('1994-11-20' AS DATE) + CAST(n_nationkey * 9 AS INT) AS TIMESTAMP) AS created_at
FROM {{nation}}""",
    "raw_banking_products": f"""
SELECT {PRODUCT.format("s_suppkey")} AS product_id, {COMPANY.format("s_nationkey")} AS company_id, s_name AS label,
  CASE s_suppkey % 8 WHEN 0 THEN 'checking' WHEN 1 THEN 'saving' WHEN 2 THEN 'wallet' WHEN 3 THEN 'expensesPlatform' WHEN 4 THEN 'card' WHEN 5 THEN 'tpv' WHEN 6 THEN 'barter' ELSE 'checking' END AS type,
  CASE s_suppkey % 5 WHEN 0 THEN 'Paypal' WHEN 1 THEN ' iberCaja ' WHEN 2 THEN 'Otros' WHEN 3 THEN NULL ELSE s_name END AS bank_name,
  CASE s_suppkey % 6 WHEN 0 THEN '_payhawk' WHEN 1 THEN '_others' WHEN 2 THEN 'insurance' WHEN 3 THEN 'ins_077' WHEN 4 THEN NULL ELSE '__x' END AS service,
  CASE WHEN s_suppkey % 25 = 3 THEN 'CHF' ELSE CASE s_suppkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'COP' ELSE 'EUR' END END AS currency,
  CAST(CAST('1994-11-20' AS DATE) + CAST(s_suppkey % 4000 AS INT) AS TIMESTAMP) AS created_at
FROM {{supplier}} WHERE s_suppkey % 10 NOT IN (6, 7)""",
    "raw_debt_products": f"""
SELECT {PRODUCT.format("s_suppkey")} AS product_id, {COMPANY.format("s_nationkey")} AS company_id, s_name AS label,
  CASE (s_suppkey - s_suppkey % 10) % 40 WHEN 0 THEN 'loan' WHEN 10 THEN 'lineofcredit' WHEN 20 THEN 'guarantee' ELSE 'leasing' END AS type,
  CASE s_suppkey % 3 WHEN 0 THEN 'Otros' ELSE s_name END AS bank_name, CASE s_suppkey % 3 WHEN 0 THEN '_others' WHEN 1 THEN 'ins_12' ELSE 'bbva' END AS service,
  CASE s_suppkey % 4 WHEN 2 THEN 'USD' ELSE 'EUR' END AS currency, CAST(CAST('1994-11-20' AS DATE) + CAST(s_suppkey % 4000 AS INT) AS TIMESTAMP) AS created_at,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 0.0 ELSE -1.5 * s_acctbal END AS granted,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_acctbal * CASE s_suppkey % 4 WHEN 2 THEN -2.0 ELSE -0.8 END END AS outstanding, 0.0 AS liquidity
FROM {{supplier}} WHERE s_suppkey % 10 IN (6, 7)""",
    "raw_debt_schedule_config": f"""
SELECT {PRODUCT.format("s_suppkey")} AS product_id, {COMPANY.format("s_nationkey")} AS company_id,
  CASE s_suppkey % 30 WHEN 6 THEN NULL WHEN 7 THEN 'PRODUCT_99' || lpad(CAST(s_suppkey AS STRING), 5, '0') ELSE {PRODUCT.format("s_suppkey - 5")} END AS settlement_product_id,
  'EUR' AS currency, CASE s_suppkey % 3 WHEN 0 THEN 'constant quote' WHEN 1 THEN ' bullet ' ELSE NULL END AS amortization_type, '30/360' AS interest_calc_method,
  CASE s_suppkey % 2 WHEN 0 THEN 'semiannually' ELSE 'monthly' END AS amortising_frequency,
  CASE WHEN s_suppkey % 3 = 0 THEN 1.5 * s_acctbal ELSE 100.0 END AS granted_balance, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 0.8 * s_acctbal END AS outstanding_balance,
  12 AS total_periods, CAST(CAST('2001-12-01' AS DATE) AS TIMESTAMP) AS next_payment_date, CAST(CAST('2001-10-01' AS DATE) AS TIMESTAMP) AS last_payment_date,
  0.035 AS annual_interest_rate_or_spread, 'fixed' AS interest_type
FROM {{supplier}} WHERE s_suppkey % 10 IN (6, 7)""",
    "raw_balances": f"""
SELECT CASE WHEN s_suppkey % 37 = 5 THEN 'PRODUCT_97' || lpad(CAST(s_suppkey AS STRING), 5, '0') ELSE {PRODUCT.format("s_suppkey")} END AS product_id, {COMPANY.format("s_nationkey")} AS company_id, CAST(CAST('2001-11-01' AS DATE) AS TIMESTAMP) AS date,
  CASE WHEN s_suppkey % 50 = 3 THEN s_acctbal * 1000000.0 WHEN s_suppkey % 17 = 0 THEN NULL ELSE s_acctbal * 100 END AS balance,
  s_acctbal AS available, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE NULL END AS granted, 0.0 AS liquidity, s_acctbal AS countable
FROM {{supplier}}""",
    "raw_transactions": f"""
SELECT 'TX_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS transaction_id,
  {COMPANY.format("c_nationkey")} AS company_id, CASE WHEN l_orderkey % 59 = 1 THEN 'PRODUCT_98' || lpad(CAST(l_suppkey AS STRING), 5, '0') ELSE {PRODUCT.format("l_suppkey")} END AS product_id, l_shipdate AS date,
  CASE l_partkey % 11 WHEN 0 THEN CAST(CAST('2099-12-31' AS DATE) AS TIMESTAMP) WHEN 1 THEN NULL WHEN 2 THEN CAST(CAST(l_shipdate AS DATE) + 45 AS TIMESTAMP)
    ELSE CAST(CAST(l_shipdate AS DATE) + CAST(l_partkey % 20 AS INT) AS TIMESTAMP) END AS value_date,
  CASE WHEN l_partkey % 8 IN (0, 7) THEN 3 * l_extendedprice ELSE -l_extendedprice END * CASE WHEN l_orderkey % 997 = 0 THEN 1000000.0 ELSE 1.0 END AS amount,
  CASE WHEN l_suppkey % 25 = 3 THEN NULL WHEN l_linenumber = 1 THEN 0.0 ELSE 1 + l_discount END AS exchange_rate, 'booked' AS status, CAST(NULL AS STRING) AS accounting_status,
  CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE CASE l_partkey % 16 WHEN 15 THEN '-' WHEN 0 THEN ' cash_settlements ' WHEN 14 THEN 'collection_refund' ELSE
    CASE l_partkey % 8 WHEN 0 THEN 'collection' WHEN 1 THEN 'payment' WHEN 2 THEN 'salary' WHEN 3 THEN 'social_security' WHEN 4 THEN 'tax' WHEN 5 THEN 'debt_repayment' WHEN 6 THEN 'fee' ELSE 'transfer' END END END AS category,
  'line ' || CAST(l_linenumber AS STRING) AS description,
  CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'CASH' WHEN 3 THEN 'CP 12345678' ELSE 'CP_' || CAST(o_custkey AS STRING) END AS counterparty_id
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey""",
    "raw_invoices": f"""
SELECT 'OP_' || CAST(o_orderkey AS STRING) AS operation_id, {COMPANY.format("c_nationkey")} AS company_id,
  CASE o_orderkey % 19 WHEN 0 THEN 'creditNote' WHEN 1 THEN 'invoiceGroup' ELSE 'invoice' END AS document_type, o_orderdate AS issuance_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 41 = 0 THEN -3 ELSE 60 + 45 * (o_orderkey % 3) END AS INT) AS TIMESTAMP) AS due_date,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN CAST(CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7) % 250 AS INT) AS TIMESTAMP)
    WHEN o_orderkey % 5 = 2 THEN CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 41 = 0 THEN -3 ELSE 60 + 45 * (o_orderkey % 3) END AS INT) AS TIMESTAMP) END AS payment_date,
  CASE WHEN o_orderkey % 4 = 0 THEN -o_totalprice WHEN o_orderkey % 101 = 0 THEN 0.0 WHEN o_orderkey % 499 = 0 THEN o_totalprice * 10000 ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN 0.0 WHEN o_orderkey % 29 = 0 THEN o_totalprice * 2 WHEN o_orderkey % 4 = 0 THEN -o_totalprice / 2 ELSE o_totalprice / 2 END AS pending_amount,
  CASE WHEN o_orderkey % 23 = 0 THEN 'COP' WHEN c_nationkey % 5 = 0 THEN 'USD' ELSE 'EUR' END AS currency, 'EUR' AS accounting_currency,
  CASE WHEN o_orderkey % 6 = 0 THEN -1.0 WHEN o_orderkey % 6 = 1 THEN NULL ELSE 1.1 END AS exchange_rate,
  CASE WHEN o_orderkey % 31 = 0 THEN 'cancel' WHEN o_orderkey % 5 IN (0, 1) THEN 'paid' WHEN o_orderkey % 5 = 2 THEN ' Overdue' ELSE 'pending' END AS status,
  'order' AS concept, CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'CP' || CAST(o_orderkey % 97 AS STRING) END AS counterparty_id
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table of SQL over the tables in sf_dir."""
    used = set(re.findall(r"\{(\w+)\}", SQL[name]))
    return spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def ctes(*names: str) -> str:
    """The raw tables as common table expressions, for an engine that has the tables by name."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in BASE})})" for n in names)
