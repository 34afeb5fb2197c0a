"""Writers. Spark's commit protocol removes the parts of a write that failed."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.sources.readers import text_lines
from moru.sources.registry import up_weighted


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out, in place of what is there."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_texts(df: DataFrame, path: str, text: str = "text", repeat: int = 1, mode: str = "append") -> None:
    """The texts, ``repeat`` times. A text with line ends becomes several lines, as text files have it."""
    up_weighted(df.where(T.not_blank(text)), repeat).select(F.col(text).alias("value")).write.mode(mode).text(path)


def write_documents(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, a row a document."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    write_documents(df, path, "split")


def to_lines(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep, line_no, line``: the line view of documents."""
    return df.select(*keep, F.posexplode(T.lines(text)).alias("line_no", "line"))


def merge_runs(spark: SparkSession, run_dir: str, to: str, least_score: float | None = None) -> int:
    """Append the texts of a run's JSONL files, in the files' order, to a text directory; records that can't be read or lack a text are skipped. Returns how many were merged."""
    rows = text_lines(spark, os.path.join(run_dir, "*.jsonl")).where(T.not_blank("value"))
    rows = rows.select(F.from_json("value", "text string, score double").alias("r"), "file", "line").where(T.not_blank("r.text"))
    if least_score is not None:
        rows = rows.where(F.col("r.score") >= least_score)
    rows = rows.select(F.col("r.text").alias("text"), "file", "line")
    n = rows.count()
    rows.orderBy("file", "line").select(F.col("text").alias("value")).write.mode("append").text(to)
    return n


def next_run(names: list[str], day: str) -> str:
    """``run_day``, or with the first free number from 2 on."""
    taken = {n for n in names if re.fullmatch(rf"run_{day}(_\d+)?", n)}
    return next(n for k in range(1, len(taken) + 2) if (n := f"run_{day}" + (f"_{k}" if k > 1 else "")) not in taken)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``id, token``, in order of the ids."""
    vocab.orderBy("id").write.mode("overwrite").parquet(path)
