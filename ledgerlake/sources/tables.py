"""Reading and writing the domain's tables: CSV with declared schemas, JSON, upserts, typed text, DDL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.operators.serving import merged

_PRODUCT = "product_id string, company_id string, label string, type string, bank_name string, service string, currency string, created_at timestamp"
SCHEMAS = {
    "groups": "group_id string, erp string, n_companies_in_sample int",
    "companies": "company_id string, group_id string, country string, currency string, erp string, created_at timestamp",
    "banking_products": _PRODUCT,
    "debt_products": f"{_PRODUCT}, granted double, outstanding double, liquidity double",
    "debt_schedule_config": "product_id string, company_id string, settlement_product_id string, currency string, amortization_type string, interest_calc_method string, amortising_frequency string, granted_balance double, outstanding_balance double, total_periods int, next_payment_date timestamp, last_payment_date timestamp, annual_interest_rate_or_spread double, interest_type string",
    "balances": "product_id string, company_id string, date timestamp, balance double, available double, granted double, liquidity double, countable double",
    "transactions": "transaction_id string, company_id string, product_id string, date timestamp, value_date timestamp, amount double, exchange_rate double, status string, accounting_status string, category string, description string, counterparty_id string",
    "invoices": "operation_id string, company_id string, document_type string, issuance_date timestamp, due_date timestamp, payment_date timestamp, amount double, pending_amount double, currency string, accounting_currency string, exchange_rate double, status string, concept string, counterparty_id string",
}


def read_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named raw table from <folder>/<name>.csv: declared types, so one pass; a missing file is an error."""
    return spark.read.csv(f"{folder}/{name}.csv", header=True, schema=SCHEMAS[name], encoding="UTF-8")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of text columns named by its header, which may begin with a byte order mark."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*(c.removeprefix("\ufeff").strip() for c in df.columns))


def page(df: DataFrame, order: list[str], number: int, size: int = 1000) -> DataFrame:
    """One page of rows in a fixed order; ``order`` has to tell all rows apart, or pages may overlap."""
    return df.orderBy(*order).offset(number * size).limit(size)


def copied(df: DataFrame, write: Callable[[DataFrame], None], read: Callable[[], DataFrame]) -> int:
    """Writes df in full and counts what arrived; other than df's own rows is an error."""
    n = df.count()
    write(df)
    if (there := read().count()) != n:
        raise ValueError(f"{n} rows were written, {there} arrived")
    return n


def to_jdbc(df: DataFrame, url: str, table: str, batch: int = 400, **properties: str) -> None:
    """Replaces a database table by df, in batches; the table's grants and indexes stay."""
    df.write.mode("overwrite").options(batchsize=batch, truncate=True, **properties).jdbc(url, table)


def read_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, folder, name) for name in SCHEMAS}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls written out; NaN becomes null."""
    clean = df.select(*(F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    clean.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], into: str) -> None:
    """Writes to ``into`` the parquet table at path with new's rows in place of those with the same keys."""
    merged(spark.read.parquet(path), new, keys).write.parquet(into)


def typed(c: Column, kind: str) -> Column:
    """Text to a type: empty is null, whole numbers may be written with decimals, several words mean true."""
    x = F.nullif(F.trim(c), F.lit(""))
    if kind == "boolean":
        return F.when(x.isNotNull(), F.lower(x).isin("true", "1", "t", "yes"))
    return x.try_cast("double").try_cast(kind) if kind in ("int", "bigint") else x.try_cast(kind)


def ddl(name: str, schema: T.StructType, keys: list[str]) -> str:
    columns = ",\n  ".join(f"{f.name} {f.dataType.simpleString()}{' NOT NULL' if f.name in keys else ''}" for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {name} (\n  {columns}\n) USING parquet"
