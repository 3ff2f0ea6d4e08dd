"""Queries of every module against their SQL on the smallest tables; the driver runs them all on larger ones."""

import math

import duckdb
import pytest

from ledgerlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
SOME = ("mp12_companies", "mp16_invoices", "mp17_transactions", "pn09_daily_cash", "pn23_payables", "ev08_events", "fc13_forecast", "cl12_offers", "ap07_attribution", "ui01_statement", "tx01_blocks", "cr02_uuid5", "ap05_sheet", "ap20_client_books", "sc08_ahead", "sc09_invoice_features", "sc09_lost_share", "sc12_decisions", "cr05_open_leads", "cr07_hydrated", "ui02_periods", "ui09_checklist", "ch06_repeatable", "snk10_export", "sc10_sums", "sc10_calibration", "src07_rows", "snk05_refresh", "snk03_stream", "snk09_colocated", "ch07_metrics", "ch06_multisets", "ch01_forwards", "tx02_runs", "cr06_rejected", "ag11_locale", "pn05_pair_rates", "vw13_sector_stats", "ui07_benchmarks")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows(columns, data):
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_equal(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(list(want.columns), want.fetchall())


#: The fit of a model; tests/test_scorer.py holds it against the conditions of the optimum.
WITHOUT_SQL = {"sc10_scorer"}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) | WITHOUT_SQL
