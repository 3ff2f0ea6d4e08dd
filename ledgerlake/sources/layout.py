"""Physical design: tables bucketed by a key, so that joins and sums by it run without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ledgerlake.sources.staging import shared_folder


#: Rows of a bucket that a task sorts in one place, at most about as many, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 8


def bucket_count(rows: int) -> int:
    """Buckets for the larger of tables that are joined: a power of two, so that those of other sizes stay multiples."""
    return max(LEAST_BUCKETS, 1 << (max(rows - 1, 0) // BUCKET_ROWS).bit_length())


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """df as a table bucketed and sorted by keys, read back; ``path``: where it lies, by default in the shared folder.

    Tables with the same number of buckets, or one a multiple of the other, join by keys bucket by bucket. Rows are dealt to
    buckets before they are written, so a bucket is one file.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    at = path or f"{shared_folder(spark)}/{table}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", at).saveAsTable(table)
    return spark.table(table)
