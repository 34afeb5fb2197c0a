"""Queries of the operators on training text, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moru.session import table

from . import bpe, leakage, lookalike, mixing, neardup, pairs, scans


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "exam_items"), table(spark, d, "scan_pages"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "exam_items"), table(spark, d, "scan_pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), table(spark, d, "exam_items"))


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"), table(spark, d, "exam_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "exam_items"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_classes(table(spark, d, "exam_items"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "exam_items"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_training_set(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_shares_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), give_up=0.1)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents")).select("doc_id", "canonical", "form")


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_cleaned, p3_found, p3_classes, p4_found, p6_ids, p7_training_set, p7_shares, p7_shares_relaxed, p8_found, p8_canonical)}

_FULL = "".join(map(chr, [*range(0xFF01, 0xFF5F)]))
_HALF = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
#: Letters and the Latin letters they can't be told from, written apart from the operator's own table.
_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABESIJKMHOPCTXYaesijopcxyhdqwABEZHIKMNOPTYXoj", strict=True))
_FOLDED = f"translate(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[{lookalike.NO_WIDTH}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g'), '{_FULL}{lookalike.SPACES}{lookalike.HYPHENS}', '{_HALF}{' ' * len(lookalike.SPACES)}--')"
for _from, _to in lookalike.LIGATURES.items():
    _FOLDED = f"replace({_FOLDED}, '{_from}', '{_to}')"
_READS = f"nfc_normalize(translate({_FOLDED}, '{''.join(_ALIKE)}', '{''.join(_ALIKE.values())}'))"
_READS = f"translate({_READS}, '{''.join(map(chr, lookalike.JAMO))}', '{''.join(lookalike.JAMO.values())}')"



def _near(table: str, least: str) -> str:
    """The pairs ``x <= y`` of the texts ``id, s`` of ``table`` that share at least ``least`` of their runs of three."""
    return f"""(with g as (select distinct id, substr(s, i, 3) as g from {table}, unnest(range(1, length(s) - 1)) u(i)), n as (select id, count(*) as n from g group by 1),
    k as (select a.id as x, b.id as y, count(*) as k from g a join g b on a.g = b.g and a.id < b.id group by 1, 2)
    select x, y from k join n a on a.id = x join n b on b.id = y where k >= {least} * (a.n + b.n - k) union all select id, id from {table})"""


P3 = rf"""with items as (select distinct item_id, passage, coalesce(question, '') as question from exam_items where item_id is not null and regexp_matches(passage, '[\p{{L}}\p{{N}}]')),
  p as (select row_number() over () as id, passage, regexp_replace(passage, '[^\p{{L}}\p{{N}}]', '', 'g') as s from (select distinct passage from items)),
  q as (select row_number() over () as id, s from (select distinct regexp_replace(question, '[^\p{{L}}\p{{N}}]', '', 'g') as s from items)),
  m as (select distinct item_id, p.id as p, q.id as q from items join p using (passage) join q on q.s = regexp_replace(question, '[^\p{{L}}\p{{N}}]', '', 'g')),
  ab as (select a.item_id as a, b.item_id as b, least(a.q, b.q) as x, greatest(a.q, b.q) as y from {_near("p", "0.7")} e join m a on a.p = e.x join m b on b.p = e.y where a.item_id <> b.item_id)
  select distinct least(a, b) as item_a, greatest(a, b) as item_b from ab join {_near("q", "0.5")} using (x, y)"""
#: The pairs of equal skeletons, and those of near passages and questions by all shared runs. The other operators can't be
#: said in SQL, or not fast enough; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "p3_found": P3,
    "p8_found": rf"""with t as (select doc_id, text, {_READS} as reads from documents where text is not null),
  v as (select * from t where regexp_matches(reads, '[^\p{{Z}}\p{{C}}\p{{M}}\s]'))
  select a.doc_id as doc_a, b.doc_id as doc_b from v a join v b on a.reads = b.reads and a.doc_id < b.doc_id and a.text <> b.text"""
}
#: Of items with one delivery text each: the smallest id of the equal ones, and the number of pairs that an item is in.
ORACLES["p3_classes"] = rf"""with pairs as ({P3}), t as (select distinct item_id, passage, coalesce(question, '') as question from exam_items where item_id is not null and regexp_matches(passage, '[\p{{L}}\p{{N}}]'))
  select t.item_id, min(t.item_id) over (partition by passage, question) as class_id, (select count(*) from pairs where item_a = t.item_id or item_b = t.item_id) as links from t"""
