"""Bloom filters as grouped bitmaps, in DataFrame functions only.

A filter is a table (block, bits): ``bits`` is a bitmap of 32,768 positions. Each hash picks one block and PROBES
positions in it, so a probe is one equi-join on the block number. ``max_blocks`` bounds the table (4 KiB a block),
which is what makes its broadcast safe: beyond it the filter gets less selective, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh

BITS, PROBES, BITS_PER_ROW = 32768, 3, 12
#: 64 MiB of bitmaps.
MAX_BLOCKS = 16384


def blocks_for(rows: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-rows * BITS_PER_ROW // BITS)))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 16), F.lit(blocks)).cast("int")


def _positions(h: Column) -> list[Column]:
    """Independent of the block: from a second hash of h."""
    g = F.xxhash64(h)
    return [F.shiftrightunsigned(g, 16 * i).bitwiseAND(F.lit(BITS - 1).cast("long")) for i in range(PROBES)]


def repeated_filter(hashes: DataFrame, col: str, blocks: int) -> DataFrame:
    """First pass: the positions that at least two rows set. A hash that occurs twice has all its positions here."""
    h = F.col(col)
    slots = hashes.select(_block(h, blocks).alias("block"), F.explode(F.array(*_positions(h))).alias("pos"))
    again = slots.groupBy("block", "pos").count().where("count >= 2")
    return again.groupBy("block").agg(F.expr("bitmap_construct_agg(pos)").alias("bits"))


def member_filter(hashes: DataFrame, col: str, blocks: int) -> DataFrame:
    """The positions that any row sets."""
    h = F.col(col)
    slots = hashes.select(_block(h, blocks).alias("block"), F.explode(F.array(*_positions(h))).alias("pos"))
    return slots.groupBy("block").agg(F.expr("bitmap_construct_agg(pos)").alias("bits"))


def probe(df: DataFrame, col: str, bitmaps: DataFrame, blocks: int, out: str) -> DataFrame:
    """Second pass: adds the boolean ``out``, true if all positions of the hash are set. False is certain."""
    h, block, bits = F.col(col), fresh(df, "__bloom_block"), fresh(df, "__bloom_bits")
    small = F.broadcast(bitmaps.select(F.col("block").alias(block), F.col("bits").alias(bits)))

    def bit(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, p.bitwiseAND(F.lit(7).cast("long")).cast("int")).bitwiseAND(F.lit(1)) == 1

    hit = F.col(bits).isNotNull()
    for p in _positions(h):
        hit = hit & bit(p)
    joined = df.withColumn(block, _block(h, blocks)).join(small, block, "left")
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop(block, bits)
