"""Readers of raw sources. Every scan keeps the order of the lines in their files and can be split by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moru.functions import text as T

# The endings that a local directory is searched for, the columns that may hold a text in order of preference.
LOCAL_SUFFIXES = (".jsonl", ".json", ".csv", ".txt")
TEXT_COLUMNS = ["text", "content", "review", "comment"]


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, file, file_start, line``: lines with their order; gzip files are read whole by one task each and spread afterwards."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("file_start"), F.monotonically_increasing_id().alias("line"))


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One record a line by ``schema`` (all strings), with ``file`` and ``line``; blank lines are skipped, broken ones are kept with ``_bad`` set."""
    rows = text_lines(spark, path).where(T.not_blank("value"))
    parsed = rows.withColumn("r", F.from_json(F.col("value"), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("r.*", "file", "file_start", "line").withColumn("_bad", F.col("_corrupt").isNotNull()).drop("_corrupt")


def parse_counts(rows: DataFrame) -> DataFrame:
    """``file, parsed, skipped`` of what ``jsonl`` read."""
    return rows.groupBy("file").agg(F.count_if(~F.col("_bad")).alias("parsed"), F.count_if("_bad").alias("skipped"))


def json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record variant, file, at``: the elements of a file that is a list, of the list under ``data`` of one that is an object, or the object itself."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file")).where("v is not null")
    kind = F.schema_of_variant("v")
    listed = F.when(kind.startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')")).when(
        F.expr("try_variant_get(v, '$.data', 'array<variant>')").isNotNull(), F.expr("try_variant_get(v, '$.data', 'array<variant>')")
    ).when(kind.startswith("OBJECT"), F.array("v"))
    return whole.select("file", F.posexplode(listed).alias("at", "record")).where(F.schema_of_variant("record").startswith("OBJECT"))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV file with a header; all columns strings, quoted fields may hold line ends."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def text_blocks(c: Column) -> Column:
    """The blocks of a text between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n\n"), T.strip), lambda b: b != "")


def txt_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, at, block``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(text_blocks(F.col("value"))).alias("at", "block"))


def json_map(variant: str = "record") -> Column:
    """A record as a map of strings, arrays and objects as JSON: what the local parser takes."""
    value = F.expr(f"transform_values(map_filter(cast({variant} as map<string, variant>), (k, v) -> v is not null and schema_of_variant(v) <> 'VOID'), (k, v) -> if(schema_of_variant(v) like 'ARRAY%' or schema_of_variant(v) like 'OBJECT%', to_json(v), try_variant_get(v, '$', 'string')))")
    return value


def files_of(spark: SparkSession, path: str) -> dict[str, int]:
    """The files at or below ``path``, in order, with their sizes, on any file system that Spark reads; none if nothing is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, int] = {}
    found = fs.listFiles(p, True) if fs.exists(p) else None
    while found is not None and found.hasNext():
        f = found.next()
        out[f.getPath().toString()] = f.getLen()
    return dict(sorted(out.items()))


def local_records(spark: SparkSession, path: str) -> DataFrame:
    """``record map<string,string>, file, ord`` of a file or directory of the four known formats; others raise. Null or missing paths give no rows."""
    empty = spark.createDataFrame([], "record map<string,string>, file string, ord bigint")
    files = [*files_of(spark, path)] if path else []
    of = {s: [f for f in files if f.lower().endswith(s)] for s in LOCAL_SUFFIXES}
    if len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1] and not any(of.values()):
        raise ValueError(f"not one of {', '.join(LOCAL_SUFFIXES)}: {path}")
    out = empty
    if of[".jsonl"]:
        rows = text_lines(spark, of[".jsonl"]).withColumn("record", F.try_parse_json("value")).where(F.schema_of_variant("record").startswith("OBJECT"))
        out = out.unionByName(rows.select(json_map().alias("record"), "file", F.col("line").alias("ord")))
    if of[".json"]:
        out = out.unionByName(json_documents(spark, of[".json"]).select(json_map().alias("record"), "file", F.col("at").cast("long").alias("ord")))
    for f in of[".csv"]:  # each may have other columns
        rows = csv_records(spark, f)
        pairs = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]
        out = out.unionByName(rows.select(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("record"), F.lit(f).alias("file"), F.monotonically_increasing_id().alias("ord")))
    if of[".txt"]:
        out = out.unionByName(txt_blocks(spark, of[".txt"]).select(F.create_map(F.lit("question"), F.col("block")).alias("record"), "file", F.col("at").cast("long").alias("ord")))
    return out


def tsv_column(lines: DataFrame, at: int = 1, skip_header: bool = True) -> DataFrame:
    """``text``: field ``at`` of tab-separated lines that have it; the first line of a file is its header."""
    fields = F.split("value", "\t")
    rows = lines.where(F.size(fields) > at)
    if skip_header:
        rows = rows.where(~((F.col("file_start") == 0) & fields.getItem(0).isin("id", "ID")))
    return rows.select(fields.getItem(at).alias("text")).where(T.not_blank("text"))


def auto_text(df: DataFrame) -> DataFrame:
    """``text``: the first of the known text columns that ``df`` has, rows that aren't blank."""
    column = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    if column is None:
        raise ValueError(f"none of {', '.join(TEXT_COLUMNS)} among {', '.join(df.columns)}")
    return df.select(F.col(column).cast("string").alias("text")).where(T.not_blank("text"))


def joined_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``text``: arrays of tokens with spaces between."""
    return df.select(F.array_join(tokens, " ").alias("text")).where(T.not_blank("text"))


def content_or_text(line: Column) -> Column:
    """The value of ``content`` if a JSON line has that key, else of ``text``."""
    return F.when(F.array_contains(F.json_object_keys(line), "content"), F.get_json_object(line, "$.content")).otherwise(F.get_json_object(line, "$.text"))


def filtered(df: DataFrame, equal: dict[str, str]) -> DataFrame:
    """The rows with the given values; a column that is missing equals nothing. The equalities reach the scan."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v) if k in df.columns else df.where(F.lit(False))
    return df


def landed(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON files that a collector put into its landing zone, one after the other."""
    return jsonl(spark, [p for p in paths if cached(spark, p)], schema)


def cached(spark: SparkSession, path: str) -> bool:
    """The file is there and not empty."""
    return sum(files_of(spark, path).values()) > 0


def category_of(path: Column | str) -> Column:
    """The second and third segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 2, 2), "/")


def probe_lines(df: DataFrame, index: str, rows: int, n: int, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``n`` lines from each of the given places of ``rows`` lines with a dense ``index``."""
    keep = F.lit(False)
    for f in at:
        start = int(f * rows)
        keep = keep | ((F.col(index) >= start) & (F.col(index) < start + n))
    return df.where(keep)


def env_values(lines: list[str]) -> dict[str, str]:
    """``KEY=value`` lines; comments, blank lines and lines without = are skipped, quotes around values removed."""
    pairs = (x.strip().split("=", 1) for x in lines if "=" in x and not x.strip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs if k.strip()}
