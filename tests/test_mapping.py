"""Each cleaning rule on rows made for it: what goes in, and what has to come out."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import mapping as M

PRODUCT = "product_id, company_id, label, type, bank_name, service, currency, timestamp(created_at) AS created_at"


def one_column(df, key, c):
    return {r[key]: r[c] for r in df.collect()}


@pytest.fixture(scope="module")
def accounts(spark):
    """Account a is in euros, b in a currency of small units, c has untidy texts."""
    return spark.sql(f"""SELECT {PRODUCT} FROM VALUES
      ('a', 'k1', 'first', 'saving', 'iberCaja', 'ins_9', 'EUR', '2025-03-04'), ('b', 'k2', 'second', 'checking', 'Own bank', 'plain', 'IDR', '2025-03-04'),
      ('c', 'k2', 'third', 'barter', '  Own bank', '_plain', 'EUR', '2027-01-01'), ('d', 'k3', 'fourth', 'tpv', ' ', NULL, 'EUR', '2024-01-01')
      AS t(product_id, company_id, label, type, bank_name, service, currency, created_at)""")


@pytest.fixture(scope="module")
def loans(spark):
    return spark.sql(f"""SELECT {PRODUCT}, granted, outstanding, 0D AS liquidity FROM VALUES
      ('m', 'k1', 'owed', 'leasing', 'Otros', 'others', 'EUR', '2025-01-01', -70D, -20D), ('n', 'k1', 'odd', 'mortgage', 'x', 'y', 'EUR', '2025-01-01', 70D, -90D), ('o', 'k1', 'blank', 'risk', 'x', 'y', 'EUR', '2025-01-01', NULL, 5D)
      AS t(product_id, company_id, label, type, bank_name, service, currency, created_at, granted, outstanding)""")


@pytest.mark.parametrize(
    ("erp", "code", "label", "flag"),
    [("Odoo", "odoo", "Odoo", False), (" MOVEX", "m3Rosetta", "Infor M3", False), ("DATEV ", "datev", "DATEV", False), ("Some system", "_unmapped", "_unmapped", True), (None, None, None, None), ("  ", None, None, None)],
)
def test_erp_systems(spark, erp, code, label, flag):
    r = M.mapped_groups(spark.createDataFrame([("g", erp, 4)], "group_id string, erp string, n_companies_in_sample int")).first()
    assert (r.erp_code, r.erp_label, r.dq_erp_unmapped, r.n_companies_in_sample) == (code, label, flag, 4)


def test_account_texts(accounts):
    out = M.mapped_banking_products(accounts)
    assert one_column(out, "product_id", "type_family") == {"a": "cash_like", "b": "cash_like", "c": "_unmapped", "d": "operating"}
    assert one_column(out, "product_id", "bank_name") == {"a": "Ibercaja", "b": "Own bank", "c": "Own bank", "d": None}
    assert one_column(out, "product_id", "service") == {"a": "ins_9", "b": "plain", "c": "plain", "d": None}
    assert one_column(out, "product_id", "service_kind") == {"a": "connector_id", "b": "bank_service", "c": "bank_service", "d": None}
    assert one_column(out, "product_id", "connected_after_cutoff") == {"a": False, "b": False, "c": True, "d": False}


def test_loans_are_liabilities(loans):
    got = {r.product_id: r for r in M.mapped_debt_products(loans).collect()}
    assert [(got[k].granted_liability, got[k].outstanding_liability) for k in "mno"] == [(70, 20), (70, 90), (None, 5)]
    assert [got[k].dq_granted_outstanding_sign_mismatch for k in "mno"] == [False, True, False]
    assert [got[k].dq_outstanding_exceeds_granted for k in "mno"] == [False, True, False]
    assert [got[k].dq_positive_outstanding for k in "mno"] == [False, False, True] and got["m"].service == "custom"


def test_implausible_balances(spark, accounts, loans):
    """Over 1e8 in euros: only on accounts that hold cash, or that no catalogue knows."""
    rows = spark.sql("SELECT product_id, 'k1' AS company_id, TIMESTAMP '2026-09-01' AS date, balance, NULL AS available, NULL AS granted, NULL AS liquidity, NULL AS countable FROM VALUES ('a', 2e8), ('b', 2e9), ('m', -2e8), ('stranger', -2e8), ('d', NULL) AS t(product_id, balance)")
    out = M.mapped_balances(rows.withColumns({c: F.col(c).cast("double") for c in ("balance", "available", "granted", "liquidity", "countable")}), accounts, loans)
    assert one_column(out, "product_id", "balance_quality") == {"a": "suspect", "b": "ok", "m": "ok", "stranger": "suspect", "d": "ok"}


def test_invoice_rules(spark):
    base = "operation_id, 'k1' AS company_id, 'invoice' AS document_type, timestamp(i) AS issuance_date, timestamp(d) AS due_date, timestamp(p) AS payment_date, double(amount) AS amount, double(pending) AS pending_amount, currency, 'EUR' AS accounting_currency, double(rate) AS exchange_rate, status, 'c' AS concept, counterparty_id"
    df = spark.sql(f"""SELECT {base} FROM VALUES
      ('alias', '2025-04-02', '2025-05-02', '2025-05-02', 8, 8, 'EUR', ' Overdue', 0, 'CP77'), ('kept', '2025-04-02', '2025-05-02', '2025-04-20', 8, 0, 'EUR', 'paid', 2, 'Z'), ('early', '2025-04-02', '2025-03-02', '2025-03-30', 8, -9, 'EUR', 'cancel', -1, 'CP 1234567'),
      ('huge', '2026-12-02', '2027-01-02', NULL, 3e8, 0, 'GBP', 'paymentOrder', NULL, NULL), ('cheap', '2025-04-02', '2025-05-02', NULL, 3e8, 0, 'IDR', 'pending', NULL, '  '), ('zero', '2025-04-02', '2025-05-02', NULL, 0, 0, 'EUR', 'pending', NULL, 'x3')
      AS t(operation_id, i, d, p, amount, pending, currency, status, rate, counterparty_id)""")
    got = {r.operation_id: r for r in M.mapped_invoices(df).collect()}
    assert got["alias"].payment_date is None and got["alias"].payment_date_raw is not None and got["kept"].payment_date is not None
    assert {k: r.status for k, r in got.items() if k in ("early", "huge", "kept")} == {"early": "cancelled", "huge": "payment_order", "kept": "paid"}
    assert {k: r.counterparty_id for k, r in got.items()} == {"alias": "COUNTERPARTY_000077", "kept": "Z", "early": "COUNTERPARTY_123456", "huge": None, "cheap": None, "zero": "COUNTERPARTY_000003"}
    flagged = lambda c: {k for k, r in got.items() if r[c]}
    assert flagged("dq_due_before_issuance") == flagged("dq_paid_before_issuance") == flagged("dq_pending_exceeds_amount") == flagged("dq_pending_sign_mismatch") == {"early"}
    assert flagged("dq_amount_sentinel") == flagged("dq_issued_after_snapshot") == {"huge"} and flagged("dq_amount_zero") == {"zero"} and flagged("dq_counterparty_missing") == {"huge", "cheap"}
    assert {k: r.exchange_rate for k, r in got.items()} == {"alias": None, "kept": 2, "early": None, "huge": None, "cheap": None, "zero": None}


@pytest.mark.parametrize(("given", "kept"), [("2025-06-25", True), ("2025-07-20", False), (None, False), ("2091-01-01", False), ("2025-05-15", True)])
def test_value_dates(spark, accounts, loans, given, kept):
    """A value date is kept within thirty days of the booking; else the booking's day stands for it."""
    df = spark.sql("SELECT 't' AS transaction_id, 'k1' AS company_id, 'a' AS product_id, TIMESTAMP '2025-06-10' AS date, timestamp(:v) AS value_date, 1D AS amount, 0D AS exchange_rate, 'booked' AS status, string(NULL) AS accounting_status, '-' AS category, '' AS description, 'P5' AS counterparty_id", {"v": given})
    r = M.mapped_transactions(df, accounts, loans).first()
    assert str(r.value_date_clean.date()) == (given if kept else "2025-06-10") and (r.category, r.exchange_rate, r.counterparty_id) == ("uncategorized", None, "COUNTERPARTY_000005")


def test_transaction_amounts(spark, accounts, loans):
    rows = spark.sql("SELECT id AS transaction_id, 'k1' AS company_id, p AS product_id, TIMESTAMP '2025-06-10' AS date, timestamp(NULL) AS value_date, double(x) AS amount, 1D AS exchange_rate, 'booked' AS status, string(NULL) AS accounting_status, c AS category, '' AS description, string(NULL) AS counterparty_id FROM VALUES ('big', 'a', -4e8, 'tax'), ('small', 'b', -4e8, NULL), ('unknown', 'q', 4e8, ' cash_settlements ') AS t(id, p, x, c)")
    out = M.mapped_transactions(rows, accounts, loans)
    assert one_column(out, "transaction_id", "dq_amount_sentinel") == {"big": True, "small": False, "unknown": True}
    assert one_column(out, "transaction_id", "category") == {"big": "tax", "small": "uncategorized", "unknown": "cash_settlement"}
