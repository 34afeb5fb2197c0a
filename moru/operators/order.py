"""A total order over lines without a single-task window.

A running total is made of two passes: totals of blocks, whose running sums are few rows, and the running sum within
each block. Blocks are range partitions of the rows, so their sizes are alike however the key's values lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moru.session import checkpoint


def running_total(df: DataFrame, amount: Column, order: str, name: str, block_rows: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows before this one in the order of ``order`` (unique) among rows with the same ``by``.

    The rows are split into ranges of about ``block_rows`` rows, or into as many as a shuffle has partitions, and written once, as range bounds are sampled anew by
    every run of a plan; only the ranges' totals, a row each, are summed in order.
    """
    by = by or []
    parts = max(1, -(-df.count() // block_rows)) if block_rows else None
    ranged = df.repartitionByRange(*([parts] if parts else []), *by, order)
    rows = checkpoint(ranged.withColumn("__block", F.spark_partition_id()).withColumn("__amount", amount))
    totals = rows.groupBy(*by, "__block").agg(F.sum("__amount").alias("__sum"))  # one row a block
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__sum").over(before.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [*by, "__block"]).withColumn(name, F.col("__offset") + F.coalesce(F.sum("__amount").over(within), F.lit(0)))
    return out.drop("__block", "__amount", "__offset")


def with_line_order(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Lines of text files with ``file``, ``file_start`` and ``line``: the order of the lines in their files, whatever the splits."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("file_start"), F.monotonically_increasing_id().alias("line"))


def dense_index(df: DataFrame, *order: str, name: str = "idx", parts: int | None = None) -> DataFrame:
    """``df`` with a dense index from 0 in the order of ``order``: rows are numbered within range partitions, and the offsets of the
    partitions (one row each) broadcast. The numbered rows are written once: range bounds are sampled anew by every run of a
    plan, so counts and numbers must come from the same one."""
    ranged = df.repartitionByRange(*([parts] if parts else []), *order) if order else df
    ranged = ranged.sortWithinPartitions(*order) if order else ranged
    numbered = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_i", F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33))
    numbered = checkpoint(numbered)
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "__offset")
    return numbered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("__offset") + F.col("_i")).drop("_p", "_i", "__offset")
