"""A table by rows: read(table, select, filter, order, limit) as a Spark data source.

    read(spark, path, "order_id", {"select": "order_id,total", "total": "gte.100", "order": "total.desc", "limit": "20"})

The reader deals a table of Parquet files into ranges of its key, leaves out files and row groups whose statistics rule a
filter out, and reads the selected columns only. Filters that Spark pushes down, and those of the request, end in the same
place; what the reader can't judge, Spark does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from datetime import UTC, datetime
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Key ranges of a table, where the request doesn't say; rows of a batch.
RANGES, BATCH = 8, 8192
# The words of a request that aren't columns; how a filter names its comparison.
WORDS = ("select", "order", "limit", "offset")
COMPARE = {"eq": "==", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
PUSHED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def conditions(request: Mapping[str, str | int], schema: StructType) -> list[tuple[str, str, list[str] | str | None]]:
    """(column, comparison, value) of each filter of a request; a filter that isn't understood is an error."""
    out = []
    for column, how in request.items():
        if column in WORDS:
            continue
        if column not in schema.names:
            raise ValueError(f"no column {column}")
        word, _, value = str(how).partition(".")
        if word in COMPARE:
            out.append((column, COMPARE[word], value))
        elif word == "in" and re.fullmatch(r"\(.*\)", value):
            out.append((column, "in", value[1:-1].split(",")))
        elif how in ("is.null", "not.is.null"):
            out.append((column, "null" if word == "is" else "not null", None))
        else:
            raise ValueError(f"no filter {how} of {column}")
    return out


def condition(column: str, how: str, value: list[str] | str | None, kind: str) -> Column:
    c = F.col(column)
    if how in ("null", "not null"):
        return c.isNull() if how == "null" else c.isNotNull()
    if how == "in":
        return c.isin(*(F.lit(v).cast(kind) for v in value))
    v = F.lit(value).cast(kind)
    return {"==": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[how]


def ordered(df: DataFrame, order: str) -> DataFrame:
    """By columns such as score.desc.nullslast,company_id; nulls come last upwards and first downwards, if it isn't said."""
    by = []
    for part in order.split(","):
        name, *words = part.split(".")
        if not set(words) <= {"asc", "desc", "nullsfirst", "nullslast"} or name not in df.columns:
            raise ValueError(f"no order {part}")
        down = "desc" in words
        last = "nullslast" in words or (not down and "nullsfirst" not in words)
        c = F.col(name)
        by.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if down else (c.asc_nulls_last() if last else c.asc_nulls_first()))
    return df.orderBy(*by)


def asked(df: DataFrame, request: Mapping[str, str | int]) -> DataFrame:
    """What a request asks of a table: filters, order, offset and limit, then the selected columns."""
    kinds = dict(df.dtypes)
    for column, how, value in conditions(request, df.schema):
        df = df.where(condition(column, how, value, kinds[column]))
    if order := request.get("order"):
        df = ordered(df, str(order))
    if (offset := int(request.get("offset", 0))) > 0:
        df = df.offset(offset)
    if "limit" in request:
        df = df.limit(int(request["limit"]))
    chosen = str(request.get("select", "*"))
    return df if chosen == "*" else df.select(*chosen.split(","))


def read(spark: SparkSession, path: str, key: str, request: Mapping[str, str | int], ranges: int = RANGES) -> DataFrame:
    """The rows that a request asks of the table at path, in ranges of key, read through RowSource; where the path isn't one
    of a file system that all executors have mounted, by Spark's own reader.

    Spark pushes filters into such a source only where it is told to, so the reader has a session of its own.
    """
    if urlparse(path).scheme not in ("", "file"):
        return asked(spark.read.parquet(path), request)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.dataSource.register(RowSource)
    chosen = str(request.get("select", "*"))
    needed = {key, *(c for c in request if c not in WORDS), *(p.split(".")[0] for p in str(request.get("order", "")).split(",") if p)}
    columns = "*" if chosen == "*" else ",".join(dict.fromkeys([*chosen.split(","), *sorted(needed)]))
    return asked(own.read.format(RowSource.name()).option("columns", columns).option("key", key).option("ranges", ranges).load(path), request)


def local(path: str) -> str:
    """A path as the reader's file system takes it."""
    return urlparse(path).path if path.startswith("file:") else path


class RowSource(DataSource):
    """Options: path, a Parquet file or folder that all executors see; key, a column whose values deal the rows; columns,
    those to read, or *; ranges, how many. Rows without a key are a range of their own."""

    @classmethod
    def name(cls) -> str:
        return "ledger_rows"

    def _dataset(self) -> ds.Dataset:
        return ds.dataset(local(self.options["path"]), format="parquet")

    def schema(self) -> StructType:
        chosen = self.options.get("columns", "*")
        whole = self._dataset().schema
        return from_arrow_schema(pa.schema([f for f in whole if chosen == "*" or f.name in chosen.split(",")]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return RowReader(self.options, schema)


class Range(InputPartition):
    def __init__(self, low: object, high: object, last: bool):
        self.low, self.high, self.last = low, high, last


def bounds(path: str, key: str) -> tuple[object, object] | None:
    """The least and the largest key by the statistics of row groups; None if one of them has none."""
    low = high = None
    for f in ds.dataset(path, format="parquet").files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().get_field_index(key)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            if s is None or not s.has_min_max:
                if s is not None and s.null_count == meta.row_group(g).num_rows:
                    continue
                return None
            low, high = (s.min, s.max) if low is None else (min(low, s.min), max(high, s.max))
    return None if low is None else (low, high)


def of(value: object, kind: pa.DataType) -> pa.Scalar:
    """A value of a filter in a column's own type; moments are compared as UTC."""
    if isinstance(value, datetime) and value.tzinfo and pa.types.is_timestamp(kind) and kind.tz is None:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return pa.scalar(value, kind)


class RowReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType):
        self.path, self.key, self.ranges = local(options["path"]), options.get("key"), int(options.get("ranges", RANGES))
        self.names, self.kinds = schema.names, ds.dataset(self.path, format="parquet").schema
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of columns with values; returns the rest."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column is None or isinstance(f, EqualNullSafe):
                yield f
            elif type(f) in PUSHED:
                self.filters.append((column, PUSHED[type(f)], f.value))
            elif isinstance(f, In):
                self.filters.append((column, "in", list(f.value)))
            elif isinstance(f, IsNull | IsNotNull):
                self.filters.append((column, "null" if isinstance(f, IsNull) else "not null", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Equal ranges of a key of whole numbers; else one for all, which row groups still prune."""
        found = bounds(self.path, self.key) if self.key else None
        if found is None or not isinstance(found[0], int):
            return [Range(None, None, True)]
        low, high = found
        step = max(1, -(-(high - low + 1) // self.ranges))
        cuts = list(range(low, high + 1, step))
        return [Range(a, a + step, k + 1 == len(cuts)) for k, a in enumerate(cuts)]

    def expression(self, part: Range) -> ds.Expression | None:
        out = None
        for column, how, value in self.filters:
            c, kind = ds.field(column), self.kinds.field(column).type
            if value is not None:
                value = [of(v, kind) for v in value] if isinstance(value, list) else of(value, kind)
            if how in ("null", "not null"):
                e = c.is_null() if how == "null" else c.is_valid()
            elif how == "in":
                e = c.isin(pa.array([v.as_py() for v in value], kind))
            else:
                e = {"==": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[how]
            out = e if out is None else out & e
        if part.low is not None:
            k = ds.field(self.key)
            e = (k >= part.low) & (k < part.high)
            e = e | k.is_null() if part.last else e
            out = e if out is None else out & e
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        table = ds.dataset(self.path, format="parquet")
        for batch in table.scanner(columns=self.names, filter=self.expression(partition), batch_size=BATCH).to_batches():
            if batch.num_rows:
                yield batch
