"""Exact deduplication by two-pass Bloom filtering (operator 8), in DataFrame functions only.

Pass one sets, for each text's digest, a few positions of a bitmap and keeps the positions that were set twice.
Pass two tests every row: a row with a position that was set once has no equal and goes straight through; only the
rest shuffle, meet by digest and choose who stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bloom
from ledgerlake.llm.common import fresh, lookup, staged, table

#: [\x20\x09-\x0D], the characters that don't count.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _split(df: DataFrame, sha: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df's rows that may have an equal, and those that have none. keys: the digests of the same rows."""
    hashes = keys.select(F.xxhash64(sha).alias("h"))
    blocks = bloom.blocks_for(hashes.count())
    again = staged(bloom.repeated_filter(hashes, "h", blocks), "dedup-bloom")
    h, maybe = fresh(df, "__h"), fresh(df, "__maybe")
    probed = bloom.probe(df.withColumn(h, F.xxhash64(sha)), h, again, blocks, maybe)
    return probed.where(F.col(maybe)).drop(h, maybe), probed.where(~F.col(maybe)).drop(h, maybe)


def _winners(maybe: DataFrame, sha: str, size: str, id_col: str, names: tuple[str, str, str]) -> DataFrame:
    """Of each digest: sha, its rows as n_rows, and as ``names`` the longest text's size, of those the smallest id
    (negated, as ~id reverses order) and the rows again."""
    best = F.max(F.struct(F.col(size).alias("size"), F.bitwise_not(F.col(id_col)).alias("neg"))).alias("best")
    best = maybe.groupBy(F.col(sha).alias("s")).agg(best, F.count(F.lit(1)).alias("n"))
    return staged(best.select(F.col("s").alias(sha), F.col("n").alias("n_rows"), *(F.col(c).alias(x) for c, x in zip(("best.size", "best.neg", "n"), names, strict=True))), "dedup-winners")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without BLANKS; null counts as empty. Of equal texts the one with the most code
    points in its original form stays, then the smallest id; a null id loses ties. Rows that repeat the winner's id and
    length are all marked kept. Other columns of docs don't matter; no rows give no rows.
    """
    keys = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        digest(F.col(text_col)).alias("text_sha256"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"),
    )
    keys = staged(keys, "dedup-keys")
    maybe, alone = _split(keys, "text_sha256", keys)
    met = lookup(maybe, _winners(maybe, "text_sha256", "n", "doc_id", ("k_size", "k_neg", "k_rows")), ["text_sha256"], "n_rows")
    kept = (F.col("n") == F.col("k_size")) & F.bitwise_not("doc_id").eqNullSafe(F.col("k_neg"))
    met = met.select("doc_id", F.bitwise_not("k_neg").alias("keep_id"), F.col("k_rows").alias("group_size"), kept.alias("kept"), "text_sha256")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return met.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each group of equal texts, chosen as in decisions().
    Of rows that repeat the winner's id and length one stays. Rows without an equal aren't shuffled."""
    sha, size = fresh(docs, "__sha"), fresh(docs, "__size")
    rows = docs.withColumn(sha, digest(F.col(text_col))).withColumn(size, F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))
    keys = staged(rows.select(F.col(sha).alias("s")), "dedup-keys")
    hashes_of = keys.select(F.col("s").alias(sha))
    maybe, alone = _split(rows, sha, hashes_of)
    names = tuple(fresh(rows, c) for c in ("__best_size", "__best_neg", "__best_rows"))
    met = lookup(maybe, _winners(maybe, sha, size, id_col, names), [sha], "n_rows")
    stays = (F.col(size) == F.col(names[0])) & F.bitwise_not(F.col(id_col)).eqNullSafe(F.col(names[1]))
    met = met.where(stays).dropDuplicates([sha]).select(*rows.columns)
    return met.unionByName(alone).select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, max(n) AS n FROM k GROUP BY text_sha256
), w AS (
  SELECT k.text_sha256, any_value(g.group_size) AS group_size, min(k.doc_id) AS keep_id
  FROM k JOIN g ON k.text_sha256 = g.text_sha256 AND k.n = g.n GROUP BY k.text_sha256
)
SELECT k.doc_id, w.keep_id, CAST(w.group_size AS BIGINT) AS group_size, k.doc_id = w.keep_id AS kept, k.text_sha256
FROM k JOIN w ON k.text_sha256 = w.text_sha256
"""
