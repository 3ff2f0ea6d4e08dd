"""Upserts from a stream: each batch is published once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.functions.columns import latest
from ledgerlake.sources.versions import VersionedTable

#: Buckets of a table by its keys. A batch rewrites those that it has rows for.
BUCKETS = 16


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def upserted(root: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: the batch's rows replace those of the same keys in the versioned table at root.

    Of rows with one key the last by order counts, in a batch; an older one in a later batch replaces nothing. The table's
    manifest has the number of its last batch, so a batch that comes again changes nothing. Only buckets that the batch
    touches are read and written.
    """

    def put(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, root)
        now = table.manifest()
        if now is not None and number <= now.batch:
            return
        new = latest(batch, keys, order)
        if now is None:
            table.publish(new, bucket(keys, buckets), batch=number)
            return
        touched = [str(r[0]) for r in new.select(bucket(keys, buckets)).distinct().collect()]
        old = table.read(parts=set(touched))
        table.publish(latest(old.unionByName(new), keys, order), bucket(keys, buckets), batch=number, replaces=set(touched))

    return put


def run(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Puts all that a stream has now into the table at root and ends."""
    return stream.writeStream.foreachBatch(upserted(root, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
