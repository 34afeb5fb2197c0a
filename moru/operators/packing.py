"""Token budgets and fixed-length sequences over running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moru.operators.order import running_total


def token_budget(df: DataFrame, n_tokens: Column, order: str, budget: int, block_rows: int | None = None) -> DataFrame:
    """The rows in order up to the one that crosses ``budget``, that one included."""
    return running_total(df, n_tokens, order, "_before", block_rows).where(F.col("_before") < budget).drop("_before")


def pack(df: DataFrame, ids: str, order: str, length: int, eos: int | None = None, block_rows: int | None = None) -> DataFrame:
    """``seq_id, x, y``: all token arrays in order, one after the other, cut into sequences of ``length``; ``y`` is ``x`` shifted by one. What is
    left over at the end is dropped. Tokens are placed by the running offset of their row and go straight to their sequence,
    so no window runs over the whole table and a sequence may span rows."""
    toks = F.concat(F.col(ids), F.array(F.lit(eos))) if eos is not None else F.col(ids)
    rows = running_total(df.select(order, toks.alias("_t")).where(F.size("_t") > 0), F.size("_t").cast("long"), order, "_off", block_rows)
    # a row gives each sequence that it reaches one slice: positions [seq * length, (seq + 1) * length] for x and the token after it
    first, last = F.floor(F.greatest(F.col("_off") - 1, F.lit(0)) / length), F.floor((F.col("_off") + F.size("_t") - 1) / length)
    cut = rows.withColumn("seq_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("seq_id") * length - F.col("_off"), F.lit(0))
    stop = F.least((F.col("seq_id") + 1) * length + 1 - F.col("_off"), F.size("_t").cast("long"))
    cut = cut.where(stop > start).select("seq_id", (F.col("_off") + start).alias("_at"), F.slice("_t", (start + 1).cast("int"), (stop - start).cast("int")).alias("_s"))
    seqs = cut.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_l"))  # length + 1 tokens
    seqs = seqs.withColumn("_z", F.flatten(F.transform("_l", lambda p: p["_s"]))).where(F.size("_z") == length + 1)
    return seqs.select("seq_id", F.slice("_z", 1, length).alias("x"), F.slice("_z", 2, length).alias("y"))


def random_tokens(spark, rows: int, length: int, vocab: int, seed: int = 0) -> DataFrame:
    """``row_id, x, y``: uniform random tokens, the same for the same seed."""
    token = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(vocab)).cast("int")
    z = F.transform(F.sequence(F.lit(0), F.lit(length)), token)
    return spark.range(rows).select(F.col("id").alias("row_id"), z.alias("_z")).select("row_id", F.slice("_z", 1, length).alias("x"), F.slice("_z", 2, length).alias("y"))
