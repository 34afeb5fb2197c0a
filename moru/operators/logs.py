"""Metrics from training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moru.functions import text as T

# The forms of the log lines.
STEP = r"step\s+(\d+)\s*\|\s*loss\s+([\d.]+|nan|inf)\s*\|\s*lr\s+([\d.eE+-]+)\s*\|\s*([\d,]+)\s*tok/s"
EVAL = r"eval\s+step=(\d+)\s+loss=([\d.]+)\s+ppl=([\d.]+)"
SAVED = r"Checkpoint saved → (\S+)"
ERROR = r"⚠|✗"


def parse(df: DataFrame, line: str = "line") -> DataFrame:
    """``kind, step, loss, lr, tok_s, ppl, path`` beside the columns of ``df``; lines of no form have a null kind."""
    c = F.col(line)
    part = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return df.withColumns({
        "kind": F.when(c.rlike(STEP), "train").when(c.rlike(EVAL), "eval").when(c.rlike(SAVED), "checkpoint").when(c.rlike(ERROR), "error"),
        "step": F.coalesce(part(STEP, 1), part(EVAL, 1)).try_cast("long"),
        "loss": F.coalesce(part(STEP, 2), part(EVAL, 2)).try_cast("double"),
        "lr": part(STEP, 3).try_cast("double"),
        "tok_s": F.replace(part(STEP, 4), F.lit(","), F.lit("")).try_cast("double"),
        "ppl": part(EVAL, 3).try_cast("double"),
        "path": part(SAVED, 1),
    })


def once_a_step(metrics: DataFrame, *order: str) -> DataFrame:
    """The first of the rows of each step."""
    w = Window.partitionBy("step").orderBy(*order)
    return metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def history(metrics: DataFrame, by: list[str] | None = None, last: int = 100, line: int = 20) -> DataFrame:
    """For each step the least, mean and latest loss of the ``last`` steps, their number, and a line of the last ``line``.

    Steps are ordered within each run ``by``; without it all rows are one run, whose steps go through one task."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = w.orderBy("step")
    back = w.rowsBetween(-(last - 1), 0)
    return metrics.select(
        *(by or []), "step", "loss", F.min("loss").over(back).alias("min_loss"), F.avg("loss").over(back).alias("avg_loss"), F.count("loss").over(back).alias("n_steps"),
        T.sparkline(F.collect_list("loss").over(w.rowsBetween(-(line - 1), 0))).alias("spark"),
    )


def running_best(metrics: DataFrame, by: list[str] | None = None, value: str = "loss") -> DataFrame:
    """``step, value, best, is_best``: the least value so far, and whether this step set it."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("step")
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return metrics.select(*(by or []), "step", value, F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"), (before.isNull() | (F.col(value) < before)).alias("is_best"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row over all steps."""
    return metrics.agg(F.count("loss").alias("n"), F.min("loss").alias("min_loss"), F.avg("loss").alias("avg_loss"), F.max_by("loss", "step").alias("last_loss"), F.max("step").alias("last_step"))


def perplexity(mean_loss: Column) -> Column:
    return F.exp(F.least(mean_loss, F.lit(20.0)))


def eval_mean(losses: DataFrame, rank: str = "rank", loss: str = "loss") -> DataFrame:
    """One row ``loss, ppl, weighted_loss``: the mean of the ranks' means, as the ranks report it, and the mean over all batches."""
    means = losses.groupBy(rank).agg(F.avg(loss).alias("m"), F.sum(loss).alias("s"), F.count(loss).alias("k"))
    out = means.agg(F.avg("m").alias("loss"), (F.sum("s") / F.sum("k")).alias("weighted_loss"))
    return out.select("loss", perplexity(F.col("loss")).alias("ppl"), "weighted_loss")


def expired_checkpoints(names: DataFrame, keep: int, name: str = "name") -> DataFrame:
    """The ``step-n`` names to delete so that the newest ``keep`` stay; other names are never deleted."""
    steps = names.withColumn("step", F.regexp_extract(name, r"\Astep-(\d+)\z", 1).try_cast("long")).where("step is not null")
    return steps.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("step")))).where(F.col("_r") > keep).drop("_r")  # a directory's names


def latest_checkpoint(names: DataFrame, name: str = "name") -> DataFrame:
    s = F.regexp_extract(name, r"\Astep-(\d+)\z", 1).try_cast("long")
    return names.agg(F.max_by(name, s).alias("latest"))


def learning_rate(step: Column, warmup: int, total: int, high: float, low: float) -> Column:
    """Linear warm-up, then a cosine down to ``low``."""
    done = F.least((step - warmup) / float(max(1, total - warmup)), F.lit(1.0))
    return F.when(step < warmup, high * (step + 1) / float(warmup)).otherwise(low + 0.5 * (high - low) * (1 + F.cos(F.lit(3.141592653589793) * done)))


def scaled_rate(base: float, batch: int, reference: int, how: str = "linear") -> float:
    return base * {"linear": batch / reference, "sqrt": (batch / reference) ** 0.5, "none": 1.0}[how]


def tail(lines: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows in order."""
    return lines.orderBy(*[F.desc(c) for c in order]).limit(n)


def throughput(steps: DataFrame, tokens_per_step: int, at: str, by: list[str]) -> DataFrame:
    """``by, tokens_seen, tok_s`` of rows that are a step each, with the time ``at``; a run of under a second counts as one."""
    seconds = F.greatest(F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp")), F.lit(1_000_000)) / 1e6
    return steps.groupBy(*by).agg((F.count("*") * tokens_per_step).alias("tokens_seen"), seconds.alias("_s")).select(*by, "tokens_seen", (F.col("tokens_seen") / F.col("_s")).alias("tok_s"))
