"""The exam item pipeline: parse, validate, drop repeated questions, limit, format, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.operators import quality, records


@dataclass
class Result:
    """The records and the reports of a run; all are plans, nothing has run yet."""

    records: DataFrame
    totals: DataFrame
    by_exam_type: DataFrame
    by_year: DataFrame


def run(items: DataFrame, *order: str, validate: bool = False, max_items: int | None = None, least: int = 50, plain: bool = False) -> Result:
    """``items`` in the schema of exam items, ``order`` the columns of their total order. The first of equal questions stays; the limit
    takes the first items before short texts are dropped, and the reports by type and year count what is left before that.
    ``plain`` keeps the question's text alone."""
    rows = items.where(quality.is_valid_item()) if validate else items
    first = quality.keep_first(rows, T.strip(F.coalesce("question", F.lit(""))), *order)
    kept = quality.head(first, max_items, *order)
    out = records.training_records(kept, least) if not plain else kept.select(F.col("question").alias("text")).where(F.length("text") >= least)
    saved = F.length(records.training_text()) >= least if not plain else F.length("question") >= least
    n = kept.agg(F.count("*").alias("total"), F.count_if(saved).alias("saved")).select("total", "saved", (F.col("total") - F.col("saved")).alias("filtered"))
    kinds = kept.groupBy(F.col("metadata.exam_type").alias("exam_type")).agg(F.count("*").alias("n"))
    years = kept.groupBy(F.col("metadata.year").alias("year")).agg(F.count("*").alias("n"))
    return Result(out, n, kinds, years)
