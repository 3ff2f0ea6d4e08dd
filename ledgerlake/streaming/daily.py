"""Daily net flow of a stream of transactions, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_net(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """(company_id, day, net, n) of streaming or batch rows(company_id, date timestamp, amount)."""
    days = rows.withWatermark("date", late) if rows.isStreaming else rows
    return days.groupBy("company_id", F.window("date", "1 day").alias("w")).agg(F.sum("amount").alias("net"), F.count(F.lit(1)).alias("n")).select("company_id", F.to_date("w.start").alias("day"), "net", "n")
