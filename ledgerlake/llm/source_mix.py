"""Mixing sources to target weights by a low-discrepancy schedule (operator 5), in DataFrame functions only.

Slots of BLOCK words are dealt to sources by golden-ratio points mapped through the cumulative weights, so that every
stretch of the schedule holds the sources in about their target shares. Slots are ranked within their source, and rank
r takes block r of the source's shuffled words, starting over after the last block. Ranks and offsets are sums of
small chunks first, so a source with a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, staged, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Words of a slot; documents of a source that are put in order together; slots that are ranked together.
BLOCK, BUCKET_ROWS, CHUNK = 512, 1024, 1 << 12
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
#: Golden-ratio points as integers: i * STEP modulo POINTS, moved by TURN each time all points were used.
POINTS, STEP, TURN, CELLS = 1 << 31, 1327217885, 886731088, 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source of sizes(source, size): its rank by code point (null last), size S, target and whole words T.

    Target = min(most * S, level * weight), the level at which the targets add up to share * all sizes: what resharing
    the excess by weight ends in. The table of sources is as small as a list of mixing weights.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("S"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    per = per.select("source", "n_rows", "S", F.row_number().over(order).alias("sid"), w.alias("w")).withColumn("cap", F.col("S") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    everything = Window.partitionBy()
    fixed = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("S").over(everything) * share - fixed) / rest)
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("level")))).over(everything)
    level = F.coalesce(fits["level"], F.max(F.col("cap") / F.col("w")).over(everything))
    per = per.withColumn("target", F.least(F.col("cap"), level * F.col("w")))
    return per.select("source", "sid", "n_rows", "S", "target", F.least(F.col("S") * most, F.floor(F.col("target") + 0.5)).cast("long").alias("T"))


def _blocks(s: Column) -> Column:
    return F.ceil(s / F.lit(float(BLOCK))).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """One row per slot of the mix: slot, sid, rank, block, words. sources: as targets() returns it."""
    spark = sources.sparkSession
    blocks = F.when(F.col("S") > 0, F.floor(F.col("T") / F.greatest("S", F.lit(1))) * _blocks(F.col("S")) + _blocks(F.col("T") % F.greatest("S", F.lit(1)))).otherwise(0)
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    plan = sources.select("sid", "S", "T", blocks.cast("long").alias("n_slots"))
    plan = plan.withColumn("upto", F.sum("n_slots").over(order)).withColumn("all", F.sum("n_slots").over(Window.partitionBy()))
    n = plan.agg(F.sum("n_slots")).first()[0] or 0
    edge = lambda c: F.floor(c / F.col("all") * F.lit(float(POINTS))).cast("long")
    plan = plan.where("n_slots > 0").withColumn("lo", edge(F.col("upto") - F.col("n_slots"))).withColumn("hi", edge(F.col("upto")))
    cell = POINTS // CELLS
    cells = plan.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    i = F.col("slot")
    points = spark.range(0, n).withColumnRenamed("id", "slot").withColumn("u", ((i % POINTS) * STEP + F.floor(i / POINTS) * TURN) % POINTS)
    dealt = points.withColumn("cell", F.floor(F.col("u") / cell)).join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.floor(i / CHUNK).alias("chunk"))
    before = dealt.groupBy("sid", "chunk").count().withColumn("before", F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))
    ranked = dealt.withColumn("r", within).join(before.select("sid", "chunk", "before"), ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("r") - 1).alias("rank"))
    # The points give each source its slots but for a few, which follow at the end; what they give too much falls off.
    got = before.groupBy("sid").agg(F.sum("count").alias("got"))
    missing = plan.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < n_slots")
    missing = missing.select("sid", F.explode(F.sequence(F.col("got"), F.col("n_slots") - 1)).alias("rank")).select((F.col("rank") + n).alias("slot"), "sid", "rank")
    slots = ranked.unionByName(missing).join(plan.select("sid", "S", "T", "n_slots", _blocks(F.col("S")).alias("nb")), "sid").where("rank < n_slots")
    slots = slots.withColumn("block", F.col("rank") % F.col("nb"))
    first = F.floor(F.col("rank") / F.col("nb")) * F.col("S") + F.col("block") * BLOCK
    words = F.least(F.lit(BLOCK), F.col("S") - F.col("block") * BLOCK, F.col("T") - first)
    return slots.select("slot", "sid", "rank", "block", words.cast("long").alias("words"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, h (hash of id and text), size, source_size, target, taken.

    taken: the words that the schedule's blocks take of the document, each at most MOST times. A null text has size 0;
    a null source is a source of its own; texts of size 0 take 0; repeated rows are rows of their own; no rows give
    no rows. The order of a source's documents is a hash of id and text, so reruns agree.
    """
    sized = staged(_sized(docs, id_col, source_col, text_col), "mix-sizes")
    sources = staged(targets(sized), "mix-sources")
    slots = schedule(sources)
    rows = sized.join(sources.withColumnRenamed("source", "src"), sized["source"].eqNullSafe(F.col("src"))).drop("src", "source")
    rows = rows.withColumn("bucket", F.pmod("h", F.ceil(F.col("n_rows") / BUCKET_ROWS).cast("long")))
    bucket = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    bucket = bucket.withColumn("offset", F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).drop("words")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("ord", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(bucket, ["sid", "bucket"]).withColumn("first", F.col("offset") + F.col("upto") - F.col("size"))
    last = F.greatest(F.col("first"), F.col("first") + F.col("size") - 1)
    pieces = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))))
    met = pieces.join(slots.select("sid", "block", "words"), ["sid", "block"], "left")
    at = F.col("block") * BLOCK
    # Blocks that no slot takes have no words; least() alone would skip the null.
    part = F.greatest(F.lit(0), F.least(F.col("first") + F.col("size"), at + F.coalesce("words", F.lit(0))) - F.greatest(F.col("first"), at))
    per = met.groupBy("sid", "bucket", "ord", "doc_id", "h", "size", F.col("S").alias("source_size"), "target").agg(F.sum(F.coalesce(part, F.lit(0))).cast("long").alias("taken"))
    return per.select("doc_id", "h", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs as the mix takes them, with all their columns: whole documents, each round(taken / size) times,
    0, 1 or MOST. Documents without words go. Rows that repeat id and text share their words evenly."""
    h, copies, key = (fresh(docs, c) for c in ("__h", "__copies", "__key"))
    share = F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))
    plan = taken(docs, id_col, source_col, text_col).groupBy(F.col("doc_id").alias(key), F.col("h").alias(h)).agg(F.floor(share + 0.5).cast("int").alias(copies)).where(F.col(copies) > 0)
    rows = docs.withColumns({h: F.xxhash64(F.col(id_col), F.col(text_col)), key: F.col(id_col).cast("long")})
    met = rows.join(plan, rows[h].eqNullSafe(plan[h]) & rows[key].eqNullSafe(plan[key])).select(*(rows[c] for c in docs.columns), copies)
    return met.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).drop("h")
