"""Decoding steps over a table of logits ``step, token, logit``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ban(logits: DataFrame, banned: list[int]) -> DataFrame:
    return logits.withColumn("logit", F.when(F.col("token").isin(banned), F.lit(float("-inf"))).otherwise(F.col("logit"))) if banned else logits


def hold_back_eos(logits: DataFrame, eos: int, least_new: int, new_tokens: Column) -> DataFrame:
    return logits.withColumn("logit", F.when((F.col("token") == eos) & (new_tokens < least_new), F.lit(float("-inf"))).otherwise(F.col("logit")))


def repetition_penalty(logits: DataFrame, history: DataFrame, penalty: float) -> DataFrame:
    """Divides (or multiplies, below zero) the logit of each token of ``history`` (``step, token``), once for each occurrence."""
    times = history.groupBy("step", "token").agg(F.count("*").alias("_k"))
    p = F.pow(F.lit(penalty), F.coalesce("_k", F.lit(0)))
    return logits.join(times, ["step", "token"], "left").withColumn("logit", F.when(F.col("logit") > 0, F.col("logit") / p).otherwise(F.col("logit") * p)).drop("_k")


def temperature(logits: DataFrame, t: float) -> DataFrame:
    return logits.withColumn("logit", F.col("logit") / t)


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest logits of each step; all that tie with the last of them are kept."""
    return logits.withColumn("_r", F.rank().over(Window.partitionBy("step").orderBy(F.desc("logit")))).where(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame, name: str = "p") -> DataFrame:
    w = Window.partitionBy("step")
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return logits.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """The tokens of each step, by falling logit, until their probability before the token exceeds ``p``."""
    w = Window.partitionBy("step").orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, 0)
    return softmax(logits, "_p").withColumn("_c", F.sum("_p").over(w) - F.col("_p")).where(F.col("_c") <= p).drop("_p", "_c")


def greedy(logits: DataFrame) -> DataFrame:
    """``step, token``: the largest logit, of equal ones the lowest token."""
    return logits.groupBy("step").agg(F.max_by("token", F.struct(F.col("logit"), -F.col("token"))).alias("token"))


def draw(logits: DataFrame, seed: int) -> DataFrame:
    """``step, token``: one draw from the softmax by the Gumbel trick; the noise is a hash of seed, step and token."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "step", "token"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    return logits.groupBy("step").agg(F.max_by("token", F.col("logit") - F.log(-F.log(u))).alias("token"))


def every_nth(df: DataFrame, index: str, n: int = 5) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(n)) == 0)


def rotated(index: Column, shift: int, n: int) -> Column:
    """The place of row ``index`` of ``n`` after the list is rotated to the left by ``shift``."""
    return F.pmod(index - shift, F.lit(max(n, 1)))
