"""Chat blocks and deterministic splits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from moru.functions import text as T
from moru.operators.order import running_total

# The marks that open a question and an answer in a chat corpus.
QUESTION_MARKS = ["질문:", "<usr>"]
ANSWER_MARKS = ["답변:", "<bot>"]


def starts_with_any(c: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | c.startswith(m)
    return out


def detect_mode(lines: DataFrame, *order: str, line: str = "line", first: int = 2000, least: int = 5) -> DataFrame:
    """One row ``mode, questions, answers`` over the first ``first`` lines that aren't blank: chat from ``least`` of either on."""
    probe = lines.where(T.not_blank(line)).orderBy(*order).limit(first).withColumn("_s", T.strip(line))
    n = probe.agg(F.count_if(starts_with_any(F.col("_s"), QUESTION_MARKS)).alias("questions"), F.count_if(starts_with_any(F.col("_s"), ANSWER_MARKS)).alias("answers"))
    return n.select(F.when((F.col("questions") >= least) & (F.col("answers") >= least), "chat").otherwise("line").alias("mode"), "questions", "answers")


def chat_blocks(lines: DataFrame, by: list[str], order: str, line: str = "line", block_rows: int | None = None) -> DataFrame:
    """``by, block, n_lines, text``: runs of lines from a question line on. Leading blank lines are dropped, inner ones kept; what comes before
    the first question is a block of its own. Windows run within ``by`` (a file, a document); for files too long for a task, ``block_rows``
    sets how many lines a task takes, and the totals of such stretches are summed first."""
    s = T.strip(line)
    rows = lines.select(*by, order, F.col(line).alias("_line"), T.not_blank(line).alias("_full"), starts_with_any(s, QUESTION_MARKS).alias("_q"))

    def before(df: DataFrame, flag: Column, name: str) -> DataFrame:
        if block_rows:
            return running_total(df, flag.cast("long"), order, name, block_rows, by)
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(flag.cast("long")).over(w), F.lit(0)))

    rows = before(rows, F.col("_full"), "_before").where((F.col("_before") > 0) | F.col("_full"))
    opens = F.col("_q") & (F.col("_before") > 0)
    rows = before(rows.withColumn("_opens", opens), F.col("_opens"), "_opened").withColumn("block", F.col("_opened") + F.col("_opens").cast("long"))
    got = rows.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct(order, "_line"))).alias("_ls"))  # the lines of one block
    return got.select(*by, "block", F.size("_ls").alias("n_lines"), F.array_join(F.transform("_ls", lambda x: x["_line"]), "\n").alias("text"))


@F.pandas_udf(DoubleType())
def blake2b_share(key: pd.Series) -> pd.Series:
    """The first eight bytes of blake2b of a key as a share of their range."""
    return key.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") / 2**64)


def md5_share(key: Column) -> Column:
    """The first four bytes of md5 as a share of their range; the variant that SQL can say."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def split_key(seed: int, block: Column, text: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), block.cast("string"), F.coalesce(T.first_line(text), F.lit("")))


def hash_split(df: DataFrame, key: Column, ratio: float, native: bool = False) -> DataFrame:
    """``df`` with ``split``: eval for the keys whose hash lies below ``ratio``, else train. The same key goes the same way in every run."""
    share = md5_share(key) if native else blake2b_share(key)
    return df.withColumn("split", F.when(share < ratio, "eval").otherwise("train"))


def split_stats(df: DataFrame, n_lines: str = "n_lines") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("blocks"), F.sum(n_lines).alias("lines"))


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """``df`` in a random order that depends on the seed and the key alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)
