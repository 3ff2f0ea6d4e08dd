"""Substring deduplication by content-defined chunking (operator 7).

A gear hash rolls over the bytes of a text; where it meets a mask a chunk ends, so boundaries follow the content and an
insertion moves none but those next to it. Chunks are known by digest. Of equal chunks the first by document and
position stays. Each repeated chunk counts by its own digest, whatever its neighbours are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bloom
from ledgerlake.llm.common import bounded_batches, lookup, staged, table

#: Least and largest bytes of a chunk, and bits of the boundary mask: chunks of MIN + 2**BITS bytes on average.
MIN_BYTES, MAX_BYTES, BITS = 16, 256, 5
#: Bytes of neighbouring repeated chunks from which on they are a passage.
PASSAGE = 80
#: Bytes that a boundary depends on.
WINDOW = 16
#: Bytes that are hashed at once.
BLOCK = 4 << 20
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint64)


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Where chunks end: after a byte at which the gear hash of the last WINDOW bytes meets the mask, at least MIN_BYTES
    and at most MAX_BYTES from the last boundary; and at the end."""
    marks = []
    for k in range(0, len(raw), BLOCK):
        part = GEAR[raw[max(0, k - WINDOW + 1) : k + BLOCK]]
        h, width = part.copy(), 1
        while width < WINDOW:  # sums over twice as many bytes each time
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
        hit = np.flatnonzero((h >> np.uint64(WINDOW - 1 - BITS)) & np.uint64((1 << BITS) - 1) == 0)
        marks.append(hit[hit >= min(k, WINDOW - 1)] + max(0, k - WINDOW + 1) + 1)
    out, last = [], 0
    for at in (np.concatenate(marks) if marks else np.empty(0, np.int64)).tolist():
        while at - last > MAX_BYTES:
            last += MAX_BYTES
            out.append(last)
        if at - last >= MIN_BYTES:
            last = at
            out.append(last)
    while len(raw) - last > MAX_BYTES:
        last += MAX_BYTES
        out.append(last)
    if last < len(raw):
        out.append(len(raw))
    return np.array(out, np.int64)


def chunks(raw: bytes) -> tuple[np.ndarray, list[int]]:
    """Chunk ends and 128-bit digests."""
    ends = boundaries(np.frombuffer(raw, np.uint8))
    view, starts = memoryview(raw), [0, *ends[:-1].tolist()]
    return ends, [xxhash.xxh3_128_intdigest(view[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)] if len(ends) else []


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chunks(t or b"")[1] for t in batch.column("text").cast(pa.binary()).to_pylist()]
        edges = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        flat = [h for x in found for h in x]
        d1 = pa.array(np.array([h & (1 << 64) - 1 for h in flat], np.uint64).view(np.int64))
        d2 = pa.array(np.array([h >> 64 & (1 << 32) - 1 for h in flat], np.uint32).view(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.ListArray.from_arrays(edges, d1), pa.ListArray.from_arrays(edges, d2)], names=["doc_id", "rk", "d1", "d2"])


SPANS = "doc_id long, n_bytes long, n_chunks long, n_repeated long, spans array<struct<start:long,end:long>>, kept binary, n_passage long"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def removed(ends: np.ndarray, repeated: np.ndarray, later: np.ndarray) -> tuple[int, list[tuple[int, int]], int]:
    """Bytes in repeated chunks, the byte spans of the chunks among them that aren't first, and bytes in passages."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    runs = [int(ends[b - 1] - starts[a]) for a, b in _runs(repeated)]
    return sum(runs), [(int(starts[a]), int(ends[b - 1])) for a, b in _runs(repeated & later)], sum(n for n in runs if n >= PASSAGE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, firsts, laters): chunks that are repeated elsewhere, as the first or a later occurrence."""
    for batch in batches:
        out = []
        for doc_id, text, firsts, laters in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("firsts").to_pylist(), batch.column("laters").to_pylist(), strict=True):
            raw = text or b""
            ends = boundaries(np.frombuffer(raw, np.uint8))
            later, repeated = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
            later[laters or []] = True
            repeated[firsts or []] = True
            n, spans, n_passage = removed(ends, repeated | later, later)
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            out.append((doc_id, len(raw), len(ends), n, [{"start": a, "end": b} for a, b in spans], b"".join([*kept, raw[at:]]), n_passage))
        columns = zip(*out, strict=True) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), SPAN_TYPE, pa.binary(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "n_chunks", "n_repeated", "spans", "kept", "n_passage"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_chunks, n_repeated (bytes in repeated chunks), spans (removed
    bytes, maximal), kept (the other bytes) and n_passage (of n_repeated, what is in runs of PASSAGE bytes and more).

    Texts are UTF-8 bytes, null is empty. Of equal chunks that with the smallest id, then the smallest place stays, a
    null id coming last; rows that repeat id and text count as one document and lose the same bytes. Other columns
    don't matter; no rows give no rows. Only texts with a repeated chunk are shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).cast("string").alias("text"))
    per = staged(rows.mapInArrow(_profile, "doc_id long, rk long, d1 array<long>, d2 array<int>"), "chunk-profiles")
    placed = per.select("rk", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "x")).select("rk", "d", "at", "x.d1", "x.d2")
    first = F.min(F.struct("d", "rk", "at")).alias("first")
    again = staged(placed.groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2", "n", F.col("first.rk").alias("f_rk"), F.col("first.at").alias("f_at")), "chunk-repeats")
    blocks = bloom.blocks_for(again.count())
    near = bloom.probe(placed.select("rk", "at", "d1", "d2"), "d1", staged(bloom.member_filter(again, "d1", blocks), "chunk-bloom"), blocks, "maybe").where("maybe").drop("maybe")
    met = lookup(near, again, ["d1", "d2"], "n").where("f_rk is not null")
    is_first = (F.col("rk") == F.col("f_rk")) & (F.col("at") == F.col("f_at"))
    marks = met.groupBy("rk").agg(F.array_distinct(F.collect_list(F.when(is_first, F.col("at")))).alias("firsts"), F.array_distinct(F.collect_list(F.when(~is_first, F.col("at")))).alias("laters"))
    marks = staged(marks, "chunk-marks")
    blocks = bloom.blocks_for(marks.count())
    asked = bloom.probe(rows, "rk", staged(bloom.member_filter(marks, "rk", blocks), "chunk-mark-bloom"), blocks, "maybe")
    none = F.lit(None).cast("array<int>")
    alone = asked.where("not maybe").select("doc_id", "text", none.alias("firsts"), none.alias("laters"))
    shared = asked.where("maybe").drop("maybe").join(marks, "rk", "left").select("doc_id", "text", "firsts", "laters")
    return alone.unionByName(shared).mapInArrow(_cut, SPANS)


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("spans", lambda x: x["end"] - x["start"])
    out = deduplicate(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed")
    return out.select("doc_id", "n_bytes", "n_chunks", "n_repeated", n_removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage")
