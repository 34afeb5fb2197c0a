"""Queries of the schema drift operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moru.operators import schema_drift
from moru.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "local_raw"))


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent(table(spark, d, "local_raw"))


def p5_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.alternatives(table(spark, d, "local_raw"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.report(table(spark, d, "local_raw"))


QUERIES = {f.__name__: f for f in (p5_found, p5_consistent, p5_alternatives, p5_report)}

#: Names of the fields without case, spaces, '_' and '-', written apart from the operator's own table.
_FIELDS = {
    "question": "question 문제 문제내용 q questiontext 질문 발문 물음 문항", "passage": "passage 지문 context paragraph 본문 읽기자료 passagetext 제시문", "choices": "choices 선지 options 선택지 보기",
    "answer": "answer 정답 gold ans 정답번호 answerno 답", "explanation": "explanation 해설 설명 풀이 rationale", "exam_type": "examtype 시험종류 시험유형", "year": "year 연도 시행연도 년도", "subject": "subject 과목 교과",
}
_NAMES = ", ".join(f"('{k}', '{f}')" for f, ks in _FIELDS.items() for k in ks.split())
_TYPE = "case when t.type = 'VARCHAR' then 'string' when t.type = 'BOOLEAN' then 'boolean' when t.type = 'ARRAY' then 'array' when t.type = 'OBJECT' then 'object' else 'number' end"
_PATHS = rf"""(select feed, file_no, path, type, count(*) as n from
  (select r.feed, r.file_no, regexp_replace(regexp_replace(replace(t.fullkey, '"', ''), '^\$\.', ''), '\[\d+\]', '[]', 'g') as path, {_TYPE} as type
   from (select * from local_raw where json_valid(payload) and json_type(payload) = 'OBJECT') r, json_tree(r.payload) t where t.type <> 'NULL' and t.fullkey <> '$') group by all)"""
_FIRST = f"(select feed, path, type, min(file_no) as file_no, arg_min(n, file_no) as n from {_PATHS} group by all)"
#: Keys of unknown names, which the operator judges by their content, are fields of their own here.
ORACLES: dict[str, str] = {
    "p5_found": rf"""
with v as (select feed, file_no, e.key, case when e.type = 'VARCHAR' then 'string' when e.type = 'BOOLEAN' then 'boolean' when e.type = 'ARRAY' then 'array' when e.type = 'OBJECT' then 'object' else 'number' end as type
  from (select * from local_raw where json_valid(payload) and json_type(payload) = 'OBJECT') r, json_each(r.payload) e where e.type <> 'NULL'),
n as (select feed, file_no, key, type, count(*) as n from v group by all),
names as (select * from (values {_NAMES}) t(name, field)),
k as (select n.feed, n.file_no, n.key, n.type, coalesce(field, key) as field from (select *, row_number() over (partition by feed, file_no, key order by n desc, type) as r from n) n
  left join names on name = lower(regexp_replace(key, '[\s_\-]+', '', 'g')) where r = 1),
f as (select distinct feed, file_no from k),
steps as (select b.feed, b.file_no from f b join f a on a.feed = b.feed and a.file_no = b.file_no - 1),
gone as (select b.feed, b.file_no, k.key, k.type, k.field, row_number() over (partition by b.feed, b.file_no, k.field order by k.key) as nth from steps b join k on k.feed = b.feed and k.file_no = b.file_no - 1
  where not exists (select 1 from k x where x.feed = b.feed and x.file_no = b.file_no and x.key = k.key)),
come as (select b.feed, b.file_no, k.key, k.type, k.field, row_number() over (partition by b.feed, b.file_no, k.field order by k.key) as nth from steps b join k on k.feed = b.feed and k.file_no = b.file_no
  where not exists (select 1 from k x where x.feed = b.feed and x.file_no = b.file_no - 1 and x.key = k.key)),
pairs as (select g.feed, g.file_no, g.key as old_key, c.key as new_key, g.type as old_type, c.type as new_type from gone g join come c using (feed, file_no, field, nth)),
kept as (select b.feed, b.file_no, x.key as old_key, y.key as new_key, x.type as old_type, y.type as new_type from steps b join k y on y.feed = b.feed and y.file_no = b.file_no join k x on x.feed = b.feed and x.file_no = b.file_no - 1 and x.key = y.key)
select feed, file_no, 'renamed' as change, old_key, new_key from pairs
union all select feed, file_no, 'removed', key, '' from gone g where not exists (select 1 from pairs p where p.feed = g.feed and p.file_no = g.file_no and p.old_key = g.key)
union all select feed, file_no, 'added', '', key from come c where not exists (select 1 from pairs p where p.feed = c.feed and p.file_no = c.file_no and p.new_key = c.key)
union all select feed, file_no, 'retyped', old_key, new_key from (select * from pairs union all select * from kept) where old_type <> new_type""",
    "p5_alternatives": f"select feed, file_no, path, type, n from {_FIRST}",
}
ORACLES["p5_report"] = f"""{ORACLES["p5_found"]}
union all select feed, file_no, 'alternative', path, type from (select *, min(file_no) over (partition by feed, path) as start from {_FIRST}) where file_no > start"""
