"""Items from the text of exam pages: noise lines, blocks, choices, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.operators.records import item, metadata

# Lines of a page that are no text of an item, the name of an exam in a path, words that mark a question.
NOISE_LINES = [
    r"^\s*\d+\s*$",
    r"대학수학능력시험.*홀수형",
    r"대학수학능력시험.*짝수형",
    r"이 문제지에 관한.*",
    r"^\s*-\s*\d+\s*-\s*$",
    r"^\s*제\s*\d+\s*교시\s*$",
    r"성명\s*수험\s*번호",
]
PATH_EXAMS = ["csat", "mock", "teacher", "leet", "district"]
#: The start of a numbered question and all of its block, up to the next one or the end.
BLOCK = r"(?msd)(^\d{1,2}\.\s*[^\n]+.*?)(?=^\d{1,2}\.\s*[^\n]|\z)"
PASSAGE_BLOCK = r"(?msd)(\[지문\s*\d+\].*?)(?=\[지문\s*\d+\]|\z)"


def without_noise(c: Column | str) -> Column:
    """``c`` without its noise lines."""
    return F.array_join(F.filter(T.lines(c), lambda x: ~x.rlike("(?Ud)" + "|".join(NOISE_LINES))), "\n")


def exam_of_path(path: Column | str) -> Column:
    """``struct<exam_type, year>`` from the last segment that is the name of an exam and the last of four digits."""
    parts = F.split(path, "/")
    kind = F.try_element_at(F.filter(parts, lambda p: p.isin(PATH_EXAMS)), F.lit(-1))
    year = F.try_element_at(F.filter(parts, lambda p: p.rlike(r"\A[0-9]{4}\z")), F.lit(-1))
    return F.struct(F.coalesce(kind, F.lit("csat")).alias("exam_type"), F.coalesce(year.try_cast("int"), F.lit(0)).alias("year"))


def reader_of_path(path: Column | str) -> Column:
    """Which of the three page readers a path takes."""
    p = F.lower(path)
    return F.when(p.contains("teacher") | p.contains("임용"), "teacher").when(p.contains("leet") | p.contains("언어이해"), "leet").otherwise("csat")


def blocks(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(BLOCK), F.lit(1))


def passage_blocks(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(PASSAGE_BLOCK), F.lit(1))


def block_number(c: Column) -> Column:
    return F.regexp_extract(c, r"\A(\d{1,2})\.", 1).try_cast("int")


def choice_list(c: Column, n: int) -> Column:
    """The texts after each of the first ``n`` circled numbers, or null unless all are there in order of their places.

    The last of four ends at a fifth number or a blank line, the last of five at the end.
    """
    at = [F.locate(T.CIRCLES[i], c) if i == 0 else F.instr(c, T.CIRCLES[i]) for i in range(n)]
    if n == 4:
        rest = F.substr(c, at[3] + F.lit(1))
        fifth, gap = F.instr(rest, T.CIRCLES[4]), F.instr(rest, "\n\n")
        length = F.when(fifth > 0, fifth - 1).when(gap > 1, gap - 1).otherwise(F.length(rest))
        last = F.substr(rest, F.lit(1), length)
    else:
        last = F.substr(c, at[n - 1] + F.lit(1))
    pieces = [F.substr(c, a + F.lit(1), F.greatest(b - a - F.lit(1), F.lit(0))) for a, b in zip(at, at[1:])] + [last]
    ok = F.lit(True)
    for a in at:
        ok = ok & (a > 0)
    return F.when(ok, F.array(*[T.collapse(p) for p in pieces]))


def split_question(c: Column, markers: list[str]) -> Column:
    """``struct<passage, question>``: the question starts at the last line with a marker, or is the last line; at the first line there is no passage."""
    ls = T.lines(c)
    marked = lambda x: x.rlike("|".join(markers))
    at = F.coalesce(F.array_max(F.filter(F.transform(ls, lambda x, i: F.when(marked(x), i)), lambda i: i.isNotNull())), F.size(ls) - 1)
    part = lambda start, n: T.strip(F.array_join(F.slice(ls, start, n), "\n"))
    return F.when(at <= 0, F.struct(F.lit("").alias("passage"), T.strip(c).alias("question"))).otherwise(F.struct(part(F.lit(1), at).alias("passage"), part(at + 1, F.size(ls)).alias("question")))


CSAT_MARKERS = [r"\?", r"시오\."]
TEACHER_MARKERS = [r"\?", r"시오\.", "것은"]


def _body(b: Column) -> Column:
    """A block's text before its first choice, without its number."""
    t = F.regexp_replace(b, r"\A\d{1,2}\.\s*", "")
    at = F.instr(t, T.CIRCLES[0])
    return T.strip(F.when(at > 0, F.substr(t, F.lit(1), at - 1)).otherwise(t))


def _starts(parts: Column, first: Column) -> Column:
    """Where each of ``parts`` starts, the first of them at ``first``; one more place for the end."""
    return F.aggregate(parts, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))


def _after(whole: Column, parts: Column) -> Column:
    """The length of ``whole`` before ``parts``, which go on to its end."""
    return F.length(whole) - F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))


def file_texts(pages: DataFrame, path: str = "path", page: str = "page_no", text: str = "text") -> DataFrame:
    """``path, file, starts array<struct<start, page_no>>, t``: the pages of each file in their order as one text, without noise lines and blank pages.

    A file is one document of a bounded number of pages. Pages without a path are each a file of their own; ``file`` tells them apart.
    """
    src = pages.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(page).alias("page_no"), without_noise(text).alias("t")).where(T.not_blank("t"))
    src = src.withColumn("file", F.when(F.col("path").isNull(), F.monotonically_increasing_id()))
    files = src.groupBy("path", "file").agg(F.array_sort(F.collect_list(F.struct("page_no", "t"))).alias("ps"))  # the pages of one file
    at = files.withColumn("from", _starts(F.transform("ps", lambda x: F.concat(x["t"], F.lit("\n"))), F.lit(0)))
    starts = F.transform("ps", lambda x, i: F.struct(F.get("from", i).alias("start"), x["page_no"].alias("page_no")))
    return at.select("path", "file", starts.alias("starts"), F.array_join(F.col("ps.t"), "\n").alias("t"))


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with the page on which each block starts and its place among the blocks that start there."""
    on = df.withColumn("page_no", F.element_at(F.filter("starts", lambda x: x["start"] <= F.col("start")), -1)["page_no"]).drop("starts")
    return on.withColumn("at", F.row_number().over(Window.partitionBy("path", "file", "page_no").orderBy("start")) - 1)


def failed_pages(pages: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, pages, failed``: how many pages each file has and how many of them gave no text."""
    return pages.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("pages"), F.count_if(F.col(text).isNull()).alias("failed"))


def file_blocks(pages: DataFrame, path: str = "path", page: str = "page_no", text: str = "text") -> DataFrame:
    """``path, page_no, at, reader, shared, b``: the numbered blocks of each file, whatever page breaks they go over, by the page on which they start.

    In files of the reader ``leet`` that have passage marks the blocks are those of each passage, which ends at the next mark.
    """
    src = file_texts(pages, path, page, text).withColumn("reader", reader_of_path("path"))
    keys = ["path", "file", "reader", "starts"]
    src = src.withColumn("marks", F.when(F.col("reader") == "leet", passage_blocks("t")).otherwise(F.array().cast("array<string>")))
    single = src.where(F.size("marks") == 0).withColumn("bs", blocks("t")).withColumn("ss", _starts(F.col("bs"), _after(F.col("t"), F.col("bs"))))
    single = single.select(*keys, F.when(F.col("reader") == "leet", "").alias("shared"), "bs", "ss")
    leet = src.where(F.col("reader") == "leet").withColumn("froms", _starts(F.col("marks"), _after(F.col("t"), F.col("marks"))))
    leet = leet.select(*keys, "froms", F.posexplode("marks").alias("nth", "p")).withColumn("u", F.regexp_replace("p", r"\A\[지문\s*\d+\]\s*", "")).withColumn("bs", blocks("u"))
    leet = leet.withColumn("ss", _starts(F.col("bs"), F.get("froms", F.col("nth")) + _after(F.col("p"), F.col("bs"))))
    leet = leet.select(*keys, T.strip(F.regexp_replace("u", r"(?msd)^\d{1,2}\.\s*[^\n].*\z", "")).alias("shared"), "bs", "ss")
    each = lambda x: x.select(*keys, "shared", F.explode(F.transform("bs", lambda b, i: F.struct(b.alias("b"), F.get("ss", i).alias("start")))).alias("x"))
    parts = [_numbered(each(x).select(*keys, "shared", "x.b", "x.start")) for x in (single, leet)]
    return parts[0].unionByName(parts[1]).select("path", "page_no", "at", "reader", "shared", "b")


def items_of_pages(pages: DataFrame, path: str = "path", page: str = "page_no", text: str = "text") -> DataFrame:
    """The items of ``path, page_no, text``, file by file; each reader has its own choices and passages. Null pages have none; an item counts to the page on which it starts."""
    every = file_blocks(pages, path, page, text).withColumn("e", exam_of_path("path")).withColumn("body", _body(F.col("b"))).where(T.not_blank("body"))
    q = F.when(F.col("reader") == "teacher", split_question(F.col("body"), TEACHER_MARKERS)).when(F.col("reader") == "leet", F.struct(F.col("shared").alias("passage"), F.col("body").alias("question"))).otherwise(split_question(F.col("body"), CSAT_MARKERS))
    choices = F.when(F.col("reader") == "teacher", choice_list(F.col("b"), 4)).otherwise(choice_list(F.col("b"), 5))
    meta = metadata(exam_type=F.col("e.exam_type"), year=F.col("e.year"), question_number=block_number(F.col("b")), subject=F.when(F.col("reader") == "leet", "언어이해").otherwise("국어"), source_file=F.col("path"))
    return every.withColumn("q", q).select("path", "page_no", "at", *item(F.col("q.passage"), F.col("q.question"), choices, F.lit(None), F.lit(None).cast("string"), meta))
