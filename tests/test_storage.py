"""Row reader, versions, upserts of a stream, buckets and cash history: errors, replays, plans."""

from datetime import date, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import checks as H
from ledgerlake.operators import history as C
from ledgerlake.plans import storage_queries
from ledgerlake.plans.panel_queries import Domain
from ledgerlake.plans.storage_queries import QUERIES
from ledgerlake.sources import databases as D
from ledgerlake.sources import layout, staging
from ledgerlake.sources import rows as R
from ledgerlake.sources.layout import bucketed
from ledgerlake.sources.versions import Conflict, VersionedTable
from ledgerlake.streaming import upserts

ORDERS = "/root/testdata/sf0.001/orders.parquet"
REQUESTS = (
    {}, {"select": "o_orderkey"}, {"o_orderkey": "eq.7"}, {"o_totalprice": "lt.50000", "o_orderstatus": "in.(F,P)", "order": "o_totalprice.desc,o_orderkey.asc", "limit": "7", "offset": "2"},
    {"o_custkey": "gt.100", "o_orderkey": "lte.1000", "select": "o_custkey,o_orderkey"}, {"o_orderdate": "gte.1996-01-01", "order": "o_orderkey", "limit": 5}, {"o_orderpriority": "is.null"}, {"o_orderpriority": "not.is.null", "select": "o_orderpriority"},
)


@pytest.mark.parametrize("request_", REQUESTS)
def test_rows(spark, request_):
    got, want = R.read(spark, ORDERS, "o_orderkey", request_, 3), R.asked(spark.read.parquet(ORDERS), request_)
    assert got.columns == want.columns
    a, b = [tuple(r) for r in got.collect()], [tuple(r) for r in want.collect()]
    assert a == b if "order" in request_ else sorted(a, key=repr) == sorted(b, key=repr)


def test_rows_plan(spark, capsys):
    R.read(spark, ORDERS, "o_orderkey", {"select": "o_orderkey", "o_totalprice": "gte.100000", "o_orderstatus": "in.(F,O)"}).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "In(o_orderstatus, [F,O])" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan and "Filter" not in plan.replace("PushedFilters", "")


def test_rows_edges(spark, tmp_path):
    pq.write_table(pa.table({"k": pa.array([5, None, 1, None, 900], pa.int64()), "t": ["a", "b", None, "d", "e"]}), tmp_path / "a.parquet", row_group_size=2)
    assert sorted(map(tuple, R.read(spark, str(tmp_path), "k", {}, 4).collect()), key=repr) == sorted([(5, "a"), (None, "b"), (1, None), (None, "d"), (900, "e")], key=repr)
    assert [r.k for r in R.read(spark, str(tmp_path), "k", {"order": "k.desc.nullslast", "limit": 2}).collect()] == [900, 5]
    assert [r.k for r in R.read(spark, str(tmp_path), "t", {"t": "is.null"}).collect()] == [1]
    for bad in ({"x": "eq.1"}, {"k": "like.1"}, {"k": "in.1"}, {"order": "k.up"}, {"order": "x"}):
        with pytest.raises(ValueError, match="no "):
            R.read(spark, str(tmp_path), "k", bad).collect()
    assert R.local("file:/a/b") == R.local("file:///a/b") == R.local("/a/b") == "/a/b"
    pq.write_table(pa.table({"k": pa.array([], pa.int64())}), tmp_path / "none.pq")
    assert R.read(spark, str(tmp_path / "none.pq"), "k", {}).count() == 0


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no such version"):
        table.read()
    df = spark.range(10).withColumn("m", (F.col("id") % 3).cast("string"))
    assert table.publish(df, F.col("m")).number == 1
    old = table.read()
    with pytest.raises(ValueError, match="5 rows were written"):
        table.publish(df.where("id < 5"), expected=10)
    with pytest.raises(Exception, match="boom"):
        table.publish(df.withColumn("x", F.raise_error(F.lit("boom")).cast("int")))
    assert table.numbers() == [1] and len(list((tmp_path / "t" / "data").iterdir())) == 1
    table.publish(df.where("m = '1'").withColumn("id", -F.col("id")), F.col("m"), replaces={"1", "2"})
    assert sorted(r.id for r in table.read().collect()) == [-7, -4, -1, 0, 3, 6, 9] and table.manifest().rows == {"_part=0": 4, "_part=1": 3}
    assert sorted(r.id for r in old.collect()) == list(range(10)) == sorted(r.id for r in table.read(1).collect())
    assert table.manifest(1).folders["_part=0"] == table.manifest().folders["_part=0"]
    table.roll_back(1)
    assert table.numbers() == [1, 2, 3] and table.read().count() == 10
    table.publish(df.limit(0), F.col("m"))
    assert table.read().count() == 0 and table.read().columns == ["id", "m"]
    assert table.clear(2) == 1 and table.numbers() == [3, 4] and table.read(3).count() == 10


def test_two_writers(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(3))
    mine = table._commit
    monkeypatch.setattr(table, "_commit", lambda m: VersionedTable(spark, table.root).publish(spark.range(5)) and mine(m))
    with pytest.raises(Conflict):
        table.publish(spark.range(7))
    monkeypatch.undo()
    assert table.numbers() == [1, 2] and table.read().count() == 5
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_replayed_batches(spark, tmp_path):
    put = upserts.upserted(str(tmp_path / "t"), ["id"], "seq", 4)
    row = lambda *r: spark.createDataFrame(list(r), "id long, seq int, x string")
    put(row((1, 0, "a"), (2, 0, "b"), (2, 1, "c"), (3, 5, "d")), 0)
    put(row((1, 1, "e"), (3, 4, "late"), (9, 0, "new")), 1)
    table = VersionedTable(spark, str(tmp_path / "t"))
    want = [(1, 1, "e"), (2, 1, "c"), (3, 5, "d"), (9, 0, "new")]
    assert sorted(map(tuple, table.read().collect())) == want and table.manifest().batch == 1
    put(row((1, 9, "again")), 0)
    put(row((1, 9, "again")), 1)
    assert sorted(map(tuple, table.read().collect())) == want and table.numbers() == [1, 2]
    put(row((2, 3, "z")), 2)
    before, after = table.manifest(2).folders, table.manifest(3).folders
    assert sum(before[k] != after[k] for k in before) == 1
    put(row((2, 3, "z")).limit(0), 3)
    assert table.manifest().batch == 3 and table.read().count() == 4


def test_no_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = bucketed(spark.range(1000).withColumn("x", F.col("id") * 2), "left", ["id"], 4, str(tmp_path / "a"))
        b = bucketed(spark.range(500, 1500).withColumn("y", F.col("id") * 3), "right", ["id"], 4, str(tmp_path / "b"))
        got = a.join(b, "id").groupBy("id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert got.count() == 500 and got.where("x <> 2 * id or y <> 3 * id").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_history_joins_its_movements_once(spark, monkeypatch):
    """F5-F7: what the history's tables are made from is a table of its own, not joins that each of them repeats."""
    given = []
    monkeypatch.setattr(C.CashHistory, "build", lambda self, tx, *_: given.append(tx))
    monkeypatch.setattr(C.CashHistory, "add", lambda self, late: given.append(late))
    storage_queries._history(spark, ORDERS.rpartition("/")[0])
    assert len(given) == 2 and not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in given)
    n, late = (df.count() for df in given)
    assert late > 0 and n + late == spark.read.parquet(ORDERS.replace("orders", "lineitem")).count()


def test_buckets_grow_with_rows(spark, monkeypatch):
    """F8: a bucket holds a bounded number of rows, and the query's tables are bucketed by it."""
    assert [layout.bucket_count(n) for n in (0, 1, 8 << 20, (8 << 20) + 1, 36_000_000, 216_000_000)] == [8, 8, 8, 16, 64, 256]
    monkeypatch.setattr(layout, "BUCKET_ROWS", 300)
    df = QUERIES["snk09_colocated"](spark, ORDERS.rpartition("/")[0])
    assert "32 out of 32" in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.sum("lines")).first()[0] == spark.read.parquet(ORDERS.replace("orders", "lineitem")).count()


def test_builds_are_dealt_by_input_size(spark):
    """a build's partitions grow with the splits of the input, so none holds a fixed share of all rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        splits = spark.read.parquet(ORDERS.replace("orders", "lineitem")).rdd.getNumPartitions()
        assert splits > 4
        assert [Domain(spark, ORDERS.rpartition("/")[0], n)._dealt("transactions").rdd.getNumPartitions() for n in H.BUILDS] == [n * splits for n in H.BUILDS]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fingerprint_catches_float_sums(spark):
    values = [(k % 2, 0.1 * (k + 1) * 10 ** (k % 13)) for k in range(4000)]
    rows = spark.createDataFrame(values, "g int, x double")

    def build(n, kind):
        dealt = rows.orderBy(F.xxhash64("x", F.lit(n))).coalesce(n)
        return {"sums": dealt.groupBy("g").agg(F.sum(F.col("x").cast(kind)).alias("s"))}

    assert [r.same for r in H.multisets(lambda n: build(n, "decimal(38,4)")).collect()] == [True]
    assert [r.same for r in H.multisets(lambda n: build(n, "double")).collect()] == [False]
    one = H.multiset(spark.createDataFrame([(1,), (1,), (2,)], "x int")).first()
    assert one != H.multiset(spark.createDataFrame([(1,), (2,), (2,)], "x int")).first() and one == H.multiset(spark.createDataFrame([(2,), (1,), (1,)], "x int").repartition(3)).first()


def test_one_build_at_a_time_is_on_disk(spark, monkeypatch, tmp_path):
    """what a build stages is gone when the next one begins, and what is staged outside stays."""
    monkeypatch.setattr(staging, "shared_folder", lambda spark: str(tmp_path))
    kept, there = staging.staged(spark.range(3), "kept"), []

    def build(n):
        there.append(sorted(p.name.partition("-")[0] for p in tmp_path.iterdir()))
        return {"ids": staging.staged(spark.range(10).repartition(n), f"build{n}")}

    before = spark.conf.get(staging.CLEANUP, None)
    assert [tuple(r) for r in H.multisets(build).collect()] == [("ids", 10, True)]
    assert there == [["kept"]] * 3 and len(list(tmp_path.iterdir())) == 1 and kept.count() == 3
    assert spark.conf.get(staging.CLEANUP, None) == before


def test_database(spark):
    """A real write, to an embedded database: replaced as a whole or not at all."""
    url, how = "jdbc:derby:memory:ledger;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    read = lambda: sorted(map(tuple, spark.read.jdbc(url, "orders", properties=how).collect()), key=repr)
    df = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2.5).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("ñ"), "id")).alias("s")).repartition(3)
    assert not D.exists(spark, url, "orders", **how)
    assert D.replace_table(df, url, "orders", **how) == 900 and read() == sorted(map(tuple, df.collect()), key=repr)
    few = df.where("k < 7")
    assert D.replace_table(few, url, "orders", 3, **how) == 7
    with pytest.raises(Exception, match="boom"):
        D.replace_table(df.withColumn("x", F.when(F.col("k") < 800, F.col("x")).otherwise(F.raise_error(F.lit("boom")).cast("double"))), url, "orders", **how)
    assert read() == sorted(map(tuple, few.collect()), key=repr)
    assert D.replace_table(df.limit(0), url, "orders", **how) == 0 and read() == []
    assert D._rename("jdbc:postgresql://h/d", "a.t_next", "a.t") == "ALTER TABLE a.t_next RENAME TO t"


def test_forward_sums(spark):
    """A panel that loses a month's transactions no longer meets the forward sum."""
    tx = spark.createDataFrame([("c", "p", datetime(2024, m, d), a) for m, d, a in ((1, 5, 10.0), (2, 7, -4.0), (2, 9, 1.0), (4, 1, 3.0))] + [("c", "p", datetime(2024, 5, 1), 9e9)], "company_id string, product_id string, date timestamp, amount double")
    anchors = H.account_anchors(spark.createDataFrame([("c", "p", 100.0)], "company_id string, product_id string, balance double"))
    panel = H.account_panel(tx, anchors)
    assert tuple(H.reconciled_forwards(panel, tx, anchors).first()) == (1, 1, 0.0, 90.0)
    assert H.reconciled_forwards(panel.where("month < DATE '2024-04-01'"), tx, anchors).first().equal == 0


def test_late_transactions(spark, tmp_path):
    """After late rows all tables are those of a full rebuild, and months that don't change aren't written."""
    balances = spark.createDataFrame([("c1", "p1", 100.0), ("c1", "p2", 50.0), ("c2", "p3", -5.0), ("c2", "p4", 2e9)], "company_id string, product_id string, balance double")
    banking = spark.createDataFrame([("p1", "EUR"), ("p2", "USD"), ("p3", "XXX"), ("p4", "EUR")], "product_id string, currency string")
    tx = [("c1", "p1", datetime(2024, m, d), a) for m, d, a in ((1, 5, 10.0), (2, 7, -4.0), (4, 1, 3.0), (6, 30, -8.5), (9, 9, 1.0))]
    tx += [("c1", "p2", datetime(2024, 3, 3), 7.0), ("c2", "p3", datetime(2024, 2, 2), 1.0), ("c2", "p4", datetime(2024, 2, 2), 1.0), ("c2", "p3", datetime(2024, 5, 2), 5e9), ("c3", "p9", datetime(2024, 5, 2), 5.0)]
    late = [("c1", "p1", datetime(2024, 2, 20), -60.0), ("c1", "p2", datetime(2024, 3, 9), -1.0), ("c1", "p2", datetime(2024, 1, 9), -1.0), ("c2", "p3", datetime(2024, 2, 9), 3e9)]
    schema, last = "company_id string, product_id string, date timestamp, amount double", date(2024, 8, 1)
    kept = C.CashHistory(spark, str(tmp_path / "kept"), last)
    kept.build(spark.createDataFrame(tx, schema), balances, banking)
    untouched = dict(kept.tables["panel_product"].manifest().folders)
    written = kept.add(spark.createDataFrame(late, schema))
    whole = C.CashHistory(spark, str(tmp_path / "whole"), last)
    whole.build(spark.createDataFrame(tx + late, schema), balances, banking)
    for name in C.TABLES:
        assert sorted(map(tuple, kept.table(name).collect()), key=repr) == sorted(map(tuple, whole.table(name).collect()), key=repr), name
    now = kept.tables["panel_product"].manifest().folders
    assert [k for k in now if now[k] == untouched.get(k)] == [f"_part=2024-{m:02d}-01" for m in (4, 5, 6, 7, 8)]
    assert written == {"nets": 3, "panel_product": 3, "panel_company": 3, "cash_metrics": 5}
    assert kept.add(spark.createDataFrame([], schema)) == dict.fromkeys(C.MONTHLY, 0)
