from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.serving import merged
from ledgerlake.sources import tables
from ledgerlake.streaming.daily import daily_net


def test_csv_json_upsert(spark, tmp_path):
    (tmp_path / "groups.csv").write_text("group_id,erp,n_companies_in_sample\nG1,Odoo ,3\nG2,,1\n")
    groups = tables.read_csv(spark, str(tmp_path), "groups")
    assert [tuple(r) for r in groups.orderBy("group_id").collect()] == [("G1", "Odoo ", 3), ("G2", None, 1)]
    tables.write_json(spark.sql("SELECT 1 AS id, double('NaN') AS x"), str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j"), "id int, x double").first().x is None
    new = spark.createDataFrame([("G2", "SAP", 9)], groups.schema)
    assert {r.group_id: r.erp for r in merged(groups, new, ["group_id"]).collect()} == {"G1": "Odoo ", "G2": "SAP"}
    assert "group_id string NOT NULL" in tables.ddl("groups", groups.schema, ["group_id"])


def test_typed(spark):
    df = spark.createDataFrame([("3.0", "TRUE", "x"), ("", "0", "2.5"), (None, None, None)], "a string, b string, c string")
    got = [tuple(r) for r in df.select(tables.typed(F.col("a"), "int"), tables.typed(F.col("b"), "boolean"), tables.typed(F.col("c"), "double")).collect()]
    assert got == [(3, True, None), (None, False, 2.5), (None, None, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 5), 1.0), ("a", datetime(2024, 1, 1, 9), 2.0), ("a", datetime(2024, 1, 2), 4.0), ("b", datetime(2024, 1, 9), 8.0)], "company_id string, date timestamp, amount double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = daily_net(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM daily").collect())) == sorted(map(tuple, daily_net(rows).collect()))


def test_pages_and_marks(spark, tmp_path):
    (tmp_path / "staff.csv").write_text("\ufeffFull Name,Team\nAnn,x\nBo,\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_text_csv(spark, str(tmp_path / "staff.csv")).select("Full Name", "Team").collect()] == [("Ann", "x"), ("Bo", None)]
    df = spark.range(25)
    assert [[r.id for r in tables.page(df, ["id"], k, 10).collect()] for k in range(4)] == [list(range(10)), list(range(10, 20)), list(range(20, 25)), []]


def test_copies_are_counted(spark, tmp_path):
    path = str(tmp_path / "copy")
    assert tables.copied(spark.range(7), lambda df: df.write.parquet(path), lambda: spark.read.parquet(path)) == 7
    with pytest.raises(ValueError, match="7 rows were written, 3 arrived"):
        tables.copied(spark.range(7), lambda df: None, lambda: spark.range(3))
