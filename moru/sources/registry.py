"""The registry of training sources and how each is turned into text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.operators import quality, records


def requested(registry: DataFrame, names: list[str], removed: set[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of the requested sources and the names that aren't registered; a removed one raises."""
    known = {r.name for r in registry.select("name").collect()}  # a registry has tens of rows
    good, unknown = quality.refuse_removed(names, removed or set(), known)
    return registry.where(F.col("name").isin(good)), unknown


def source_text(df: DataFrame, text_col: str, qa_mode: bool = False, chat_mode: bool = False, instruction_col: str | None = None, least: int = 20, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``text`` of a source's rows: conversations flattened, question and answer templated, or the column stripped; short ones dropped, then limited in order."""
    if chat_mode:
        text = records.chat_text(F.col(text_col))
    elif qa_mode and instruction_col:
        text = records.qa_text(F.col(instruction_col), F.col(text_col))
    else:
        text = T.strip(F.col(text_col).cast("string"))
    out = df.withColumn("text", text).where(F.length("text") >= least)
    return quality.head(out, most, *(order or [])).select("text")


def union_all(sources: list[DataFrame]) -> DataFrame:
    """All rows with ``source_ord``, the place of their source."""
    tagged = [s.withColumn("source_ord", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    return out


def up_weighted(df: DataFrame, repeat: int) -> DataFrame:
    """Every row ``repeat`` times, with the number of the repetition in ``rep``."""
    if repeat < 1:
        raise ValueError("repeat must be at least 1")
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
