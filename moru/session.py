"""Session helpers: tables, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast. The sides it is asked for are narrow (ids, hashes, short words).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; where it is unset, a local one in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "moru-checkpoints")
    sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` when its counted ``rows`` are at most ``limit``; otherwise leave it to a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def drop_extra(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed to the keywords: extra columns, also ones with clashing names, have no effect."""
    return df.select(*[F.col(f"`{c}`" if "." not in c else c).alias(k) for k, c in columns.items()])
