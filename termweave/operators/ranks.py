"""Ranks over a whole table without gathering it: rows are dealt out by ranges of the order, numbered where they lie, and shifted by how many lie before.

A window without a key, or with a key of few values, sorts everything in one task. Here each task sorts one range. What is sent to all tasks is one
count for each range and one start for each key, so the key must have few values (conditions, domains).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import settled

_ROWS = (1 << 33) - 1  # rows of a partition, in the lower bits of a running id


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows with their number (from 1) in the order, for each value of the keys; rows equal in the order come in any order.

    The dealt rows are written to the checkpoint folder, so that counts and numbers are taken from the same ranges.
    """
    by = [F.col(k).asc() for k in keys] + order
    if not by:
        raise ValueError("ranks need an order")
    dealt = settled(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.select(*rows.columns, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit(_ROWS)).alias("_row"))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row for each range: as many as there are partitions.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    placed = dealt.join(starts, "_range").withColumn("_place", F.col("_before") + F.col("_row"))
    if not keys:
        return placed.select(*rows.columns, (F.col("_place") + 1).cast("int").alias(name))
    first = F.broadcast(placed.groupBy(*keys).agg(F.min("_place").alias("_first")))
    met = placed.alias("p").join(first.alias("f"), [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    return met.select(*[F.col(f"p.{c}") for c in rows.columns], (F.col("_place") - F.col("_first") + 1).cast("int").alias(name))
