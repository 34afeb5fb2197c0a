"""Mixing sources to target shares of tokens (problem 7) by hash-threshold histograms.

Each document has one fixed hash. A source that must give ``budget`` tokens gives every document ``rounds`` times and
once more those whose hash lies below a threshold. The threshold comes from a histogram of tokens by source and hash
bucket; only the bucket in which the budget ends is split further. Nothing is sorted, and the documents of a smaller
budget are a part of those of a larger one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moru.session import checkpoint

from . import bpe

#: Bits of the hash that a level of the histogram splits; the histogram has at most 2 ** BITS rows a source.
BITS = 10
LEVELS = 6
#: Sources that a table of targets may name; it and the histograms of its sources come to the driver.
MAX_SOURCES = 1_000


@dataclass
class Share:
    """What one source gives: ``rounds`` whole uses, and one more of the documents whose hash is below ``threshold``."""

    source: str
    target: float
    most: int
    tokens: int
    budget: float
    rounds: int
    rest: float
    threshold: int = 0


def budgets(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: float | None = None, give_up: float = 0.0) -> list[Share]:
    """The budget of each source. Without ``total`` it is the largest size at which every source that has tokens can hold its
    share, but for the scarcest ones, which may fall short as long as their shares together are at most ``give_up``."""
    live = [(s, t, m) for s, t, m in targets if t > 0 and m > 0 and tokens.get(s, 0) > 0]
    whole = sum(t for _, t, _ in live)
    if total is None:
        sizes, short = sorted((m * tokens[s] * whole / t, t) for s, t, m in live), 0.0
        while len(sizes) > 1 and (short := short + sizes[0][1] / whole) <= give_up + 1e-12:
            sizes.pop(0)
        total = sizes[0][0] if sizes else 0.0
    out = []
    for s, t, m in targets:
        n = tokens.get(s, 0)
        budget = min(total * t / whole, float(m * n)) if t > 0 and m > 0 and n > 0 else 0.0
        rounds = min(int(budget // n), m) if n else 0
        out.append(Share(s, t, m, n, budget, rounds, budget - rounds * n if rounds < m else 0.0))
    return out


def _levels(tokens: DataFrame, shares: list[Share]) -> None:
    """Set the thresholds: one histogram of all buckets, then one of the boundary buckets alone, level by level."""
    spark, width = tokens.sparkSession, BITS * LEVELS
    open_ = {s.source: (0, s.rest) for s in shares if s.rest > 0}
    for level in range(LEVELS):
        if not open_:
            return
        shift = width - BITS * (level + 1)
        prefixes = spark.createDataFrame([(s, p) for s, (p, _) in open_.items()], "source string, prefix long")
        rows = (
            tokens.join(F.broadcast(prefixes), "source")  # at most MAX_SOURCES rows
            .where(F.shiftright("h", shift + BITS) == F.col("prefix"))
            .groupBy("source", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
            .collect()  # at most 2 ** BITS rows a source
        )
        left = {}
        for share in shares:
            if share.source not in open_:
                continue
            prefix, rest = open_[share.source]
            for r in sorted((r for r in rows if r.source == share.source), key=lambda r: r.bucket):
                if r.n <= rest:
                    rest -= r.n
                    share.threshold = (r.bucket + 1) << shift
                    continue
                if r.docs > 1 and level + 1 < LEVELS:
                    left[share.source] = (r.bucket, rest)
                elif r.n - rest < rest:  # the one document that crosses the budget: take it if that is nearer
                    share.threshold = (r.bucket + 1) << shift
                break
        open_ = left


def mix(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 7,
    give_up: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    directory: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(training set, shares)``.

    training set: ``doc_id, source, n_tokens, copies``, a row for each document used at least once; ``copies`` is at
    most the source's ``max_repeats``. shares: ``source, target_share, max_repeats, available_tokens, used_tokens,
    documents, actual_share``, a row for each row of ``targets``.

    Without ``total_tokens`` the set is as large as it can be with every source on its share; a source without tokens is
    reported with 0 and the other shares keep their proportions. ``give_up`` is the sum of target shares that scarce sources may
    miss for the sake of a larger set. With a larger total, sources whose repeats don't
    suffice fall short, which ``actual_share`` shows. Documents of other sources and documents without tokens aren't
    used; repeated rows count as documents of their own; of repeated targets of a source the first in order of share counts.
    """
    spark = docs.sparkSession
    wanted: dict[str, tuple[str, float, int]] = {}
    for r in targets.select("source", "target_share", "max_repeats").where("source is not null").orderBy("source", F.desc("target_share"), F.desc("max_repeats")).limit(MAX_SOURCES + 1).collect():
        wanted.setdefault(r.source, (r.source, float(r.target_share or 0), int(r.max_repeats or 0)))
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"targets name more than {MAX_SOURCES} sources")
    names = spark.createDataFrame([(s,) for s in wanted] or [("",)], "source string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    src = src.join(F.broadcast(names), "source")  # at most MAX_SOURCES rows
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - BITS * LEVELS)
    tokens = checkpoint(bpe.count_tokens(src.withColumn("h", h), "text", "doc_id", "source", "h", directory=directory).where("n_tokens > 0"))
    held = {r.source: int(r.n) for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    shares = budgets(list(wanted.values()), held, total_tokens, give_up)
    _levels(tokens, shares)
    plan = spark.createDataFrame(
        [(s.source, s.target, s.most, s.tokens, s.rounds, s.threshold) for s in shares],
        "source string, target_share double, max_repeats int, available_tokens long, rounds int, threshold long",
    )
    chosen = (
        tokens.join(F.broadcast(plan), "source")
        .withColumn("copies", F.col("rounds") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    used = {r.source: r for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"), F.count("*").alias("docs")).collect()}
    whole = sum(r.n for r in used.values())
    rows = []
    for s in shares:  # a row for each source of the targets
        n, docs_used = (int(used[s.source].n), int(used[s.source].docs)) if s.source in used else (0, 0)
        rows.append((s.source, s.target, s.most, s.tokens, n, docs_used, round(n / whole, 9) if whole else 0.0))
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, used_tokens long, documents long, actual_share double")
    return chosen, report
