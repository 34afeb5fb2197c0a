"""Filters and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moru.functions import text as T


def is_valid_item(question: str = "question", passage: str = "passage", least: float = 0.5) -> Column:
    """The question isn't blank and Hangul makes up ``least`` of passage and question together."""
    both = F.concat(F.coalesce(F.col(passage), F.lit("")), F.coalesce(F.col(question), F.lit("")))
    return T.not_blank(question) & (T.script_ratio(both) >= least)


def is_valid_question(question: str = "question", least: float = 0.5) -> Column:
    """The same of the question alone."""
    return T.not_blank(question) & (T.script_ratio(question) >= least)


def long_enough(c: str, least: int) -> Column:
    return F.coalesce(F.length(c) >= least, F.lit(False))


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each ``key`` (a string) in the order of ``order``; the rows with a null key are one group. Keys go by their hash. Catalyst turns the rank filter into a limit by group before the shuffle."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", F.unhex(F.md5(key))).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_key", "_rank")


def head(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in order; all of them if ``n`` is null or not positive."""
    return df.orderBy(*order).limit(n) if n and n > 0 else df


def not_used(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` isn't among ``used``."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def contains_any(c: str, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.col(c).contains(w)
    return F.coalesce(out, F.lit(False))


def recent_or_unknown(year: str, floor: int = 2019) -> Column:
    """Drops known years before ``floor``; 0 stands for an unknown year."""
    return ~((F.col(year) > 0) & (F.col(year) < floor))


def report(df: DataFrame, keep: Column) -> DataFrame:
    """One row: ``total_parsed, total_valid, filtered, alarm``; the alarm is set when under half of what was parsed is valid."""
    return df.agg(F.count("*").alias("total_parsed"), F.count_if(keep).alias("total_valid")).select(
        "total_parsed", "total_valid", (F.col("total_parsed") - F.col("total_valid")).alias("filtered"), (F.col("total_valid") < 0.5 * F.col("total_parsed")).alias("alarm")
    )


def band(ratio: Column) -> Column:
    """The quality band of a share of unknown tokens."""
    return F.when(ratio < 0.001, "excellent").when(ratio < 0.01, "good").when(ratio < 0.05, "marginal").otherwise("bad")


def refuse_removed(names: list[str], removed: set[str], known: set[str]) -> tuple[list[str], list[str]]:
    """The known names, and the unknown ones; raises if one is on the list of removed sources."""
    hit = [n for n in names if n in removed]
    if hit:
        raise ValueError(f"removed for their licence: {', '.join(hit)}")
    return [n for n in names if n in known], [n for n in names if n not in known]
