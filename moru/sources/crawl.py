"""Links of exam papers in listing pages ``url, html``; fetching them is no matter of this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.operators import quality

# Of each site the words of which a title needs one, the exam's name in file names, the first year kept.
SITES = {
    "csat": {"words": ["국어", "언어"], "name": "csat", "floor": 0},
    "mock": {"words": ["국어", "언어"], "name": "mock", "floor": 0},
    "teacher": {"words": ["국어"], "name": "teacher", "floor": 2019},
    "leet": {"words": ["언어이해", "언어", "이해"], "name": "leet", "floor": 0},
    "district": {"words": ["국어"], "name": "district", "floor": 0},
}


def absolute(url: Column, href: Column) -> Column:
    """``href`` seen from the page ``url``."""
    root = F.regexp_extract(url, r"\A(https?://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(url, r"[?#].*\z", ""), r"(?<=[^/:])/[^/]*\z", "")
    return F.when(href.rlike(r"\Ahttps?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(url, r"\A(https?:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))


def links(pages: DataFrame, site: str) -> DataFrame:
    """``url, at, title, link, year, month, file_name`` of the anchors whose title names the subject and whose year isn't too old; an unknown year is 0."""
    if site not in SITES:
        return pages.sparkSession.createDataFrame([], "url string, at int, title string, link string, year int, month int, file_name string")
    s = SITES[site]
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))
    a = pages.select("url", F.posexplode(anchors).alias("at", "a"))
    a = a.select("url", "at", T.collapse(F.regexp_replace("a", r"(?s)<[^>]*>", " ")).alias("title"), F.regexp_extract("a", r"(?i)href\s*=\s*[\"']([^\"']+)[\"']", 1).alias("href"))
    a = a.where(quality.contains_any("title", s["words"]))
    year = F.coalesce(F.regexp_extract("title", r"((?:19|20)[0-9]{2})", 1).try_cast("int"), F.lit(0))
    month = F.regexp_extract("title", r"([0-9]{1,2})월", 1).try_cast("int")
    out = a.select("url", "at", "title", absolute(F.col("url"), F.col("href")).alias("link"), year.alias("year"), month.alias("month"))
    if s["floor"]:
        out = out.where(quality.recent_or_unknown("year", s["floor"]))
    return out.withColumn("file_name", F.concat_ws("_", F.lit(s["name"]), F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"), F.concat(F.col("at").cast("string"), F.lit(".pdf"))))


def all_links(pages: DataFrame, exams: list[str]) -> DataFrame:
    """The links of several sites, with ``exam``; ``all`` stands for every site, unknown names give none."""
    names = list(SITES) if "all" in exams else [e for e in exams if e in SITES]
    out = links(pages, "").withColumn("exam", F.lit(None).cast("string"))
    for e in names:
        out = out.unionByName(links(pages, e).withColumn("exam", F.lit(e)))
    return out


def crawl_counts(results: DataFrame) -> DataFrame:
    """``status, files, bytes`` of fetched files ``status, size``."""
    return results.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
