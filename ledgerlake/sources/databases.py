"""Tables of a database that are replaced as a whole, through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that is sent at once.
BATCH = 400
#: How a table gets another name, where the database doesn't say it as most do.
RENAME = {"jdbc:derby:": "RENAME TABLE {old} TO {new}"}


def _rename(url: str, old: str, new: str) -> str:
    how = next((sql for prefix, sql in RENAME.items() if url.startswith(prefix)), "ALTER TABLE {old} RENAME TO {new}")
    return how.format(old=old, new=new.rpartition(".")[2])


def _run(spark: SparkSession, url: str, statements: list[str], **properties: str) -> None:
    """Statements in one transaction."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    if driver := properties.get("driver"):
        jvm.org.apache.spark.util.Utils.classForName(driver, True, False)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.execute(sql)
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def exists(spark: SparkSession, url: str, table: str, **properties: str) -> bool:
    try:
        spark.read.jdbc(url, f"(SELECT 1 AS x FROM {table} WHERE 1 = 0) t", properties=properties).schema
    except Exception as e:
        if "does not exist" in str(e) or "not exist" in str(e).lower():
            return False
        raise
    return True


def replace_table(df: DataFrame, url: str, table: str, batch: int = BATCH, **properties: str) -> int:
    """The database's table becomes df, all of it or not at all; returns its number of rows.

    Rows go to a table beside it, in batches. When as many have arrived as df has, one transaction puts it in the old one's
    place. If anything fails before, the old table is what it was, and what lies beside it is replaced by the next try.
    """
    spark, beside, former = df.sparkSession, f"{table}_next", f"{table}_former"
    if exists(spark, url, former, **properties):
        _run(spark, url, [f"DROP TABLE {former}"], **properties)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("batchsize", batch).jdbc(url, beside, properties=properties)
    n, there = seen.get["n"], spark.read.jdbc(url, beside, properties=properties).count()
    if there != n:
        raise ValueError(f"{n} rows were written, {there} arrived")
    swap = [_rename(url, beside, table)]
    if exists(spark, url, table, **properties):
        swap = [_rename(url, table, former), *swap, f"DROP TABLE {former}"]
    _run(spark, url, swap, **properties)
    return n
