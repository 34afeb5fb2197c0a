"""Compare a query with its SQL: the same columns and the same rows in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings exam_items eval_items scan_pages local_raw synth_records dataset_registry mix_targets".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v) if abs(v) < 1 << 52 else v
    if hasattr(v, "is_finite") and not isinstance(v, float):  # Decimal
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


def differences(spark: SparkSession, query, sql: str, sf_dir: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs, or ''."""
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != got_cols:
        return f"columns {got_cols} and {sorted(cols)}"
    order = [cols.index(c) for c in got_cols]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    if ours == theirs:
        return ""
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only in Spark {sum(a.values())}: {list(a)[:2]}; only in SQL {sum(b.values())}: {list(b)[:2]}"
