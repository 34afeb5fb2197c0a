"""Column functions on text, with the reference's string semantics; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: every sign that counts as white space when text is stripped, as a regular expression class for both engines.
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The signs of SPACE inside a class.
SPACE_IN = SPACE[1:-1]
HANGUL = "가-힣"
CIRCLES = "①②③④⑤"


def strip(c: Column | str) -> Column:
    """``c`` without white space, in the sense of Unicode, at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def not_blank(c: Column | str) -> Column:
    """``c`` holds a sign that isn't white space; false for null."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.when(not_blank(c), c if isinstance(c, Column) else F.col(c))


def script_ratio(c: Column | str, letters: str = HANGUL) -> Column:
    """Share of the signs of ``c`` in the class ``letters``; 0 for null and empty texts. Spaces and digits count below the line."""
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, f"[^{letters}]", "")) / n).otherwise(F.lit(0.0))


def collapse(c: Column | str) -> Column:
    """Stretches of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def whole_number(c: Column | str) -> Column:
    """An int where ``c`` is one in digits, with a sign and spaces around at most; else null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.cast("string").rlike(rf"\A{SPACE}*[+-]?[0-9]+{SPACE}*\z"), strip(col.cast("string"))).try_cast("int")


def lines(c: Column | str) -> Column:
    return F.split(c, "\n")


def first_line(c: Column | str) -> Column:
    """The first line that isn't blank, stripped; null if there is none."""
    return F.try_element_at(F.filter(F.transform(lines(c), strip), lambda x: F.length(x) > 0), F.lit(1))


def human_size(n: Column | str) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1024 * 1024, F.format_string("%.1fKB", n / 1024.0)).otherwise(F.format_string("%.1fMB", n / (1024.0 * 1024.0)))


def sparkline(values: Column) -> Column:
    """An array of numbers as a line of eight levels; an array without a positive value is a line of the lowest."""
    top = F.greatest(F.array_max(values), F.lit(0.0))
    level = lambda v: F.when(top > 0, F.floor(F.greatest(v, F.lit(0.0)) / top * 7)).otherwise(F.lit(0)).cast("int")
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit("▁▂▃▄▅▆▇█"), level(v) + F.lit(1), F.lit(1))), "")


def format_eta(done: Column, limit: Column, seconds: Column) -> Column:
    """Seconds left at the rate so far."""
    return F.try_divide(limit - done, F.try_divide(done, seconds))
