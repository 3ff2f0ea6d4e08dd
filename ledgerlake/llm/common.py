"""Helpers that the corpus operators share: tables, the shared folder, batch bounds, free column names."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch. A batch never holds more than this besides its last row.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one will do if
    the session is a single process (tests); on a cluster that is an error, as executors wouldn't see each other's files."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders that staged() has written in this process and released() hasn't removed.
_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later steps neither recompute it nor depend on one executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int) -> None:
    """Removes what staged() wrote after its first ``since`` tables, but for the last one, which holds the result."""
    sc = spark.sparkContext
    for path in _written[since:-1]:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since:-1]


def n_written() -> int:
    return len(_written)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that a Python worker's memory follows the longest text and not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(work: Callable) -> Callable:
    """A function of Arrow batches that hands freed memory back to the system when its task ends, since the worker lives
    on and the next task may need the executor's memory elsewhere."""

    @wraps(work)
    def run(*args, **how) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*args, **how)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a lookup table up to which it is broadcast whole, and keys that count as hot beyond that.
BROADCAST_ROWS, HOT_KEYS = 100_000, 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows left-joined to table, whose keys are unique, null-safely, by columns of the same names; weight: how many rows each key has.

    A table of up to BROADCAST_ROWS rows is broadcast. Of a larger one only the keys with over a HOT_KEYS-th of all rows
    are, which are fewer than HOT_KEYS; the rest shuffle, and none of their keys is large. The result drops weight.
    """
    extra = [c for c in table.columns if c not in (*keys, weight)]
    own = [fresh(rows, f"__k{i}") for i in range(len(keys))]
    heft = fresh(rows, "__weight")
    small = table.select(*(F.col(k).alias(x) for k, x in zip(keys, own, strict=True)), *extra, F.col(weight).alias(heft))

    def on(left: DataFrame) -> Column:
        return reduce(and_, (left[k].eqNullSafe(small[x]) for k, x in zip(keys, own, strict=True)))

    n, total = table.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on(rows), "left").select(*rows.columns, *extra)
    heavy = F.col(heft) > F.lit(total / HOT_KEYS)
    met = rows.join(F.broadcast(small.where(heavy)), on(rows), "left")
    hot = met.where(F.col(heft).isNotNull()).select(*rows.columns, *extra)
    cold = met.where(F.col(heft).isNull()).select(*rows.columns)
    return hot.unionByName(cold.join(small.where(~heavy), on(cold), "left").select(*rows.columns, *extra))
