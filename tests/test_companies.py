"""Operators that the queries' SQL doesn't reach: errors, edges, text mark-up, quantiles, staging."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import columns
from ledgerlake.operators import companies as Y
from ledgerlake.operators import crm as R
from ledgerlake.operators import text as X
from ledgerlake.operators.clients import money_text
from ledgerlake.operators.forecast import check_cases
from ledgerlake.operators.serving import alert
from ledgerlake.sources import staging


@pytest.mark.parametrize("few", [1 << 14, 5])
def test_exact_quantiles(spark, monkeypatch, few):
    """Ties, a long tail, both signs, null and NaN; intervals narrowed until they hold few values."""
    monkeypatch.setattr(columns, "FEW", few)
    monkeypatch.setattr(columns, "RANGES", 64 if few == 5 else 1 << 14)
    r = random.Random(1)
    values = [round(r.gauss(0, 1) * 10 ** r.randint(0, 7), 2) for _ in range(3000)] + [7.5] * 2000 + [0.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    got = columns.exact_quantiles(df, "x", (0.0, 0.001, 0.25, 0.5, 0.999, 1.0))
    assert np.allclose(got, np.quantile(values, [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]), rtol=1e-12)
    assert columns.exact_quantiles(df.where("x > 1e300"), "x", (0.5,)) == [None]
    assert columns.winsorised(df.where("false"), "x").count() == 0


def test_staged_tables_go(spark):
    df = staging.staged(spark.range(5), "some")
    assert df.count() == 5
    staging.drop_staged(spark, df)
    with pytest.raises(Exception, match="(?i)path|exist|no such"):
        spark.read.parquet(df.inputFiles()[0]).count() if df.inputFiles() else spark.read.parquet("/nowhere/at/all")


def test_decisions_need_facts(spark):
    health = spark.sql("SELECT 'a' AS company_id, DATE '2025-01-01' AS month, 70D AS score, 'healthy' AS band")
    rule = [Y.Veto("v", "label", "text", True, False, F.col("cash") < 0)]
    with pytest.raises(ValueError, match="without facts"):
        Y.decisions(health, spark.sql("SELECT 'b' AS company_id, DATE '2025-01-01' AS month, 1 AS cash"), rule)
    facts = spark.sql("SELECT 'a' AS company_id, DATE '2025-01-01' AS month, int(NULL) AS cash")
    assert Y.decisions(health, facts, rule).select("action", "reason").first() == ("lend", "band healthy")


def test_changes_that_cannot_be_made(spark):
    leads = spark.createDataFrame([(1, "new"), (2, "closed"), (4, "new")], "lead_id int, status string")
    changes = spark.createDataFrame([(1, "gone"), (2, "meeting"), (2, "meeting"), (3, "new"), (4, "closed"), (4, "contacted"), (5, None)], "lead_id int, status string")
    assert sorted(map(tuple, R.with_status(leads, changes).collect())) == [(1, "new"), (2, "meeting"), (4, "new")]
    got = {(r.lead_id, r.status): r.why for r in R.rejected(leads, changes).collect()}
    assert got == {(1, "gone"): "unknown status", (3, "new"): "unknown lead", (4, "closed"): "several statuses", (4, "contacted"): "several statuses", (5, None): "unknown status"}


@pytest.mark.parametrize("wide", [2, 64])
def test_leads_one_by_one(spark, monkeypatch, wide):
    """A batch is dealt as if its leads came one after another; ids differ from those of closed leads."""
    monkeypatch.setattr(R, "WIDE", wide)
    rng = random.Random(wide)
    for loads, n in (([0], 3), ([5, 0, 0, 9], 40), ([rng.randint(0, 30) for _ in range(12)], 57), ([100, 3], 1), ([2, 2, 2], 7)):
        team = [(f"e{k:02d}",) for k in range(len(loads))]
        old = [(f"o{k}-{j}", f"old {k} {j}", "meeting", f"e{k:02d}") for k, load in enumerate(loads) for j in range(load)]
        old += [("c1", "company 000", "closed", "e00"), ("c2", "company 000", "closed", "e00"), ("x", "company 999", "new", "e00")]
        asked = [(f"company {k:03d}",) for k in range(n)] + [("company 999",)]
        got = R.open_leads(spark.createDataFrame(old, "lead_id string, company_id string, status string, assigned_to string"), spark.createDataFrame(team, "employee_id string"), spark.createDataFrame(asked, "company_id string").repartition(3), "d", "6ba7b811-9dad-11d1-80b4-00c04fd430c8").collect()
        now = {e: sum(r[3] == e and r[2] != "closed" for r in old) for (e,) in team}
        want = {}
        for (c,) in sorted(asked)[:-1]:
            want[c] = min(now, key=lambda e: (now[e], e))
            now[want[c]] += 1
        assert {r.company_id: r.assigned_to for r in got if not r.already_open} == want
        assert [(r.lead_id, r.already_open) for r in got if r.company_id == "company 999"] == [("x", True)]
        import uuid

        ids = {r.company_id: r.lead_id for r in got}
        space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
        assert ids["company 000"] == str(uuid.uuid5(space, "company 000:2")) and len(set(ids.values())) == n + 1
    with pytest.raises(ValueError, match="no team"):
        R.open_leads(spark.createDataFrame([], "lead_id string, company_id string, status string, assigned_to string"), spark.createDataFrame([], "employee_id string"), spark.createDataFrame([("a",)], "company_id string"), "d", "6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def test_locale(spark):
    words = ["zorro", "Árbol", "arbol", "ñu", "nube", "Nz", None, "oso", "árbol", "eñe", "enf"]
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "w string, k int")
    up = [r.w for r in R.table_order(df, "w", True, "k").orderBy("place").collect()]
    down = [r.w for r in R.table_order(df, "w", False, "k").orderBy("place").collect()]
    assert up == ["arbol", "árbol", "Árbol", "enf", "eñe", "nube", "Nz", "ñu", "oso", "zorro", None]
    assert down == up[-2::-1] + [None]


@pytest.mark.parametrize("bins", [1, 1 << 12])
def test_quantiles_by_group(spark, monkeypatch, bins):
    monkeypatch.setattr(columns, "BINS", bins)
    r = random.Random(bins)
    values = [(g, round(r.gauss(0, 1) * 10 ** r.randint(-3, 6), 3), r.randint(0, 3)) for g in ["a"] * 900 + ["b"] * 40 + ["c"] + [None] * 7 for _ in range(1)]
    values += [("a", 1.5, 2)] * 300 + [("a", None, 1), ("a", float("nan"), 1), ("d", None, 1), ("e", -0.0, 1), ("e", 0.0, 1)]
    df = spark.createDataFrame(values, "g string, x double, w int").repartition(3)
    shares = {"lo": 0.01, "q": 0.25, "m": 0.5, "hi": 1.0}
    for weight in (None, "w"):
        got = {x.g: tuple(x)[1:] for x in columns.quantiles_by(df, ["g"], "x", shares, weight).collect()}
        for g in ("a", "b", "c", None, "e"):
            xs = [x for k, x, w in values if k == g and x is not None and x == x for _ in range(1 if weight is None else w)]
            if xs:
                assert np.allclose(got.pop(g), np.quantile(xs, list(shares.values())), rtol=1e-12)
        assert not got
    assert columns.quantiles_by(df.limit(0), ["g"], "x", shares).count() == 0


@pytest.mark.parametrize(("text", "want"), [("62.231 €", 62231.0), ("1.050,75 €", 1050.75), ("none", 0.0), (None, 0.0), ("1.2.3,4,5", 0.0)])
def test_parsed_money(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(R.parsed_money(F.col("x"))).first()[0] == want


def test_halves_of_money(spark):
    """halves go away from zero, as SQL rounds them, not to the even neighbour."""
    df = spark.sql("SELECT CAST(3767986.5 AS DECIMAL(28,4)) AS m, 10.5D AS d, CAST(0.4999 AS DECIMAL(28,4)) AS s")
    assert tuple(df.select(money_text(F.col("m")), money_text(F.col("d")), money_text(F.col("s"))).first()) == ("3.767.987 €", "11 €", "0 €")
    assert df.select(alert(F.lit("watch"), -F.col("d"), F.lit(1.0))).first()[0] == "falls by 11 points in 3 months"


@pytest.mark.parametrize(("text", "want"), [("a **b", "a b"), ("a **b**", "a **b**"), ("one `two", "one two"), ("*a", "a"), ("**a\nb", "**a\nb"), ("a ***", "a "), ("x_", "x"), ("", ""), (None, None), ("~~ok~~ ~~no", "~~ok~~ no")])
def test_repair(spark, text, want):
    assert X.repaired(spark.createDataFrame([(text,)], "x string"), "x").first()[0] == want


def runs_of(spark, texts):
    rows = {}
    for r in X.runs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").orderBy("id", "place").collect():
        rows.setdefault(r.id, []).append((r.text, r.marks))
    return rows


def test_runs(spark):
    rows = runs_of(spark, ["plain", "a **b *c* d** e", "`**x**` __y__", "2*3*4 and ~~old~~", "", None, "*a\nb*", "**a `b` c**", "***x** y*", "_a_b _c_", "é*a*", "`` `a`", "**a\nb** __c__d", "*a**b*", "~~a **b~~ c**"])
    assert rows[0] == [("plain", "")] and rows[1] == [("a ", ""), ("b ", "bold"), ("c", "bold,italic"), (" d", "bold"), (" e", "")]
    assert rows[2] == [("**x**", "code"), (" ", ""), ("y", "bold")] and rows[3] == [("2*3*4 and ", ""), ("old", "strike")]
    assert 4 not in rows and 5 not in rows and rows[6] == [("*a\nb*", "")]
    assert rows[7] == [("**a ", ""), ("b", "code"), (" c**", "")] and rows[8] == [("*x", "bold"), (" y*", "")]
    assert rows[9] == [("_a_b ", ""), ("c", "italic")] and rows[10] == [("é", ""), ("a", "italic")]
    assert rows[11] == [("``", ""), (" ", "code"), ("a`", "")] or rows[11] == [("`` ", ""), ("a", "code")] or rows[11] == [("`", ""), (" ", "code"), ("a`", "")]
    assert rows[12] == [("a\nb", "bold"), (" ", ""), ("c", "bold"), ("d", "")] and rows[13] == [("*a**b*", "")]
    assert rows[14] == [("~~a ", ""), ("b~~ c", "bold")]


def test_many_marks(spark):
    """Marks by the hundred thousand, next to each other and open."""
    rows = runs_of(spark, ["**a** `b` " * 50000, "**" * 100000, "*a " * 100000, "_" * 99999])
    assert len(rows[0]) == 200000 and rows[0][:4] == [("a", "bold"), (" ", ""), ("b", "code"), (" ", "")]
    assert "".join(t for t, _ in rows[2]).replace("*", "") == "a " * 100000


def test_blocks(spark):
    text = "# Title\n- one\n  2) two\n> said\n---\n#no\n-no\n12.no\n• dot\n  \nlast"
    got = [tuple(r)[1:] for r in X.blocks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("line").collect()]
    assert got == [
        (0, "heading", 0, "Title"), (1, "item", 0, "one"), (2, "ordered", 1, "two"), (3, "quote", None, "said"), (4, "rule", None, ""), (5, "paragraph", None, "#no"), (6, "paragraph", None, "-no"),
        (7, "paragraph", None, "12.no"), (8, "item", 0, "dot"), (10, "paragraph", None, "last"),
    ]


def test_blocks_of_long_lines(spark):
    """time is linear in a line's length and in its runs of blanks."""
    text = "word **x** " * 60000 + "\nend" + " " * 400000 + "z \t\x0c\r\n" + "y" * 600000
    start = time.time()
    got = [(r.line, len(r.body)) for r in X.blocks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("line").collect()]
    assert got == [(0, 659999), (1, 400004), (2, 600000)]
    assert time.time() - start < 30


def test_cases_are_checked(spark):
    found = spark.sql("SELECT * FROM VALUES ('a', DATE '2025-01-01', double(NULL)), ('b', date(NULL), 5D) AS t(company_id, break_from, surplus)")
    check_cases(found, ("a",), ("b",))
    with pytest.raises(ValueError, match="b, c, a"):
        check_cases(found, ("b", "c"), ("a",))
