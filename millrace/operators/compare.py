"""Comparison of two decision tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_decisions(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row an id: the last by ``order``, or, without an order, the greatest ``(status, reason)``; rows without id are left out."""
    rank = [F.col(order)] if order else []
    best = F.max(F.struct(*rank, F.coalesce("status", F.lit("")).alias("status"), F.coalesce("reason", F.lit("")).alias("reason")))
    return df.where(F.col("record_id").isNotNull() & (F.col("record_id") != "")).groupBy("record_id").agg(best.alias("_b")).select("record_id", "_b.status", "_b.reason")


def diff(base: DataFrame, curr: DataFrame, base_order: str | None = None, curr_order: str | None = None) -> DataFrame:
    """``id, type, base, curr, reason_base, reason_curr`` of the ids that differ.

    Types: ``extra_in_current``, ``missing_in_current``, ``status_mismatch`` (statuses
    in base and curr) and ``reason_mismatch`` (reasons in base and curr, the others null); a
    different status takes precedence. One shuffle of each side on the id, shared by the
    aggregation and the full outer join.
    """
    b = last_decisions(base, base_order).select("record_id", F.col("status").alias("bs"), F.col("reason").alias("br"))
    c = last_decisions(curr, curr_order).select("record_id", F.col("status").alias("cs"), F.col("reason").alias("cr"))
    both = b.join(c, "record_id", "full_outer")
    kind = F.when(F.col("bs").isNull(), F.lit("extra_in_current")).when(F.col("cs").isNull(), F.lit("missing_in_current")).when(F.col("bs") != F.col("cs"), F.lit("status_mismatch")).when(F.col("br") != F.col("cr"), F.lit("reason_mismatch"))
    null = F.lit(None).cast("string")
    status_row = F.col("type") == "status_mismatch"
    reason_row = F.col("type") == "reason_mismatch"
    return (
        both.withColumn("type", kind)
        .where(F.col("type").isNotNull())
        .select(
            F.col("record_id").alias("id"),
            "type",
            F.when(status_row, F.col("bs")).when(reason_row, F.col("br")).otherwise(null).alias("base"),
            F.when(status_row, F.col("cs")).when(reason_row, F.col("cr")).otherwise(null).alias("curr"),
            F.when(status_row, F.col("br")).otherwise(null).alias("reason_base"),
            F.when(status_row, F.col("cr")).otherwise(null).alias("reason_curr"),
        )
    )


def tally(differences: DataFrame) -> DataFrame:
    return differences.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
