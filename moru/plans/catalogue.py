"""Queries of the engine's own operators, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.operators import logs, packing, pages, quality, records, sampling, split, tokenizers, vocab
from moru.operators.order import dense_index
from moru.plans import pipeline
from moru.session import checkpoint, table
from moru.sources import crawl, readers, registry
from moru.sources.sinks import to_lines
from moru.streaming.logs import event_windows, streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
S = T.SPACE


def query(sql: str | None = None):
    """Register a query under the name of its function, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{S}+|{S}+\z', '', 'g')"


def nonblank(c: str) -> str:
    return f"coalesce(length({strip(c)}) > 0, false)"


def ratio(c: str, letters: str = "가-힣") -> str:
    return f"case when length({c}) > 0 then length(regexp_replace({c}, '[^{letters}]', '', 'g')) / length({c})::double else 0.0 end"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{S}+'), lambda w: w <> '')"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exam_items")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# --- filters -------------------------------------------------------------------------------------------------------


@query("select doc_id, n_chars from documents where length(text) >= 20")
def doc_min_length(spark, d):  # D5
    return docs(spark, d).where(quality.long_enough("text", 20)).select("doc_id", "n_chars")


@query(f"select doc_id from documents where {nonblank('text')}")
def doc_nonblank(spark, d):  # D6
    return docs(spark, d).where(T.not_blank("text")).select("doc_id")


@query(f"select doc_id, round({ratio('text')}, 9) as hangul, round({ratio('text', 'A-Za-z')}, 9) as latin from documents")
def doc_script_ratio(spark, d):  # D1
    return docs(spark, d).select("doc_id", F.round(T.script_ratio("text"), 9).alias("hangul"), F.round(T.script_ratio("text", "A-Za-z"), 9).alias("latin"))


_BOTH = "coalesce(passage, '') || coalesce(question, '')"
VALID = f"({nonblank('question')} and {ratio(_BOTH)} >= 0.5)"


@query(f"select item_id, landed_at from exam_items where {VALID}")
def item_validate(spark, d):  # D2
    return items(spark, d).where(quality.is_valid_item()).select("item_id", "landed_at")


@query(f"select item_id, landed_at from exam_items where {nonblank('question')} and {ratio('question')} >= 0.5")
def item_is_valid(spark, d):  # D3
    return items(spark, d).where(quality.is_valid_question()).select("item_id", "landed_at")


@query("select item_id, metadata.year as year from exam_items where not (metadata.year > 0 and metadata.year < 2019)")
def year_floor(spark, d):  # D9
    return items(spark, d).where(quality.recent_or_unknown("metadata.year")).select("item_id", F.col("metadata.year").alias("year"))


@query("select item_id from exam_items where coalesce(contains(question, '알맞은') or contains(question, '서술'), false)")
def keyword_any(spark, d):  # D8
    return items(spark, d).where(quality.contains_any("question", ["알맞은", "서술"])).select("item_id")


@query("select item_id, question from exam_items where question like '다음 중%' or question like '윗글%'")
def marker_prefix(spark, d):  # D10
    return items(spark, d).where(split.starts_with_any(F.col("question"), ["다음 중", "윗글"])).select("item_id", "question")


@query("select event_id, value from events where value is not null and not isnan(value) and abs(value) < 'infinity'::double")
def finite_loss(spark, d):  # D14
    return table(spark, d, "events").where(quality.finite("value")).select("event_id", "value")


@query("select distinct name from dataset_registry where name not in (select source from documents) ")
def registry_without_documents(spark, d):  # D7, E4
    return quality.not_used(table(spark, d, "dataset_registry"), docs(spark, d).select(F.col("source").alias("name")), "name").select("name").distinct()


@query("select count(*) as fresh from (select prompt from synth_records where prompt is not null and prompt not in (select prompt from synth_records where score >= 0.8 and prompt is not null))")
def fresh_prompts(spark, d):  # D13, I3
    r = table(spark, d, "synth_records").where("prompt is not null")
    return quality.not_used(r, r.where("score >= 0.8"), "prompt").agg(F.count("*").alias("fresh"))


@query("select record_id, score from synth_records where score >= 0.7 and length(trim(text)) > 0")
def score_floor(spark, d):  # Q16
    return table(spark, d, "synth_records").where((F.col("score") >= 0.7) & (F.length(F.trim("text")) > 0)).select("record_id", "score")


# --- keep first, limits, reports --------------------------------------------------------------------------------------

FIRST = f"(select * from (select *, row_number() over (partition by {strip('text')} order by doc_id) as rn from documents where text is not null) where rn = 1)"


@query(f"select doc_id, source from {FIRST}")
def doc_dedup_first(spark, d):  # G1
    return quality.keep_first(docs(spark, d).where("text is not null"), T.strip("text"), "doc_id").select("doc_id", "source")


@query(f"select (select count(*) from documents where text is not null) as before, count(*) as after, sum(doc_id)::bigint as ids from {FIRST}")
def dedup_stats(spark, d):  # G1, F16
    all_ = docs(spark, d).where("text is not null").withColumn("k", F.md5(T.strip("text")))
    groups = all_.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return groups.agg(F.sum("n").alias("before"), F.count("*").alias("after"), F.sum("first").alias("ids"))


@query(f"select doc_id from {FIRST} order by doc_id limit 100")
def limit_after_dedup(spark, d):  # H1
    return quality.head(quality.keep_first(docs(spark, d).where("text is not null"), T.strip("text"), "doc_id"), 100, "doc_id").select("doc_id")


@query(f"select count(*) as total_parsed, count(*) filter (where {VALID}) as total_valid, count(*) - count(*) filter (where {VALID}) as filtered, count(*) filter (where {VALID}) < 0.5 * count(*) as alarm from exam_items")
def quality_report(spark, d):  # F3, F4
    return quality.report(items(spark, d), quality.is_valid_item())


PIPE = f"(select * from (select *, row_number() over (partition by {strip(chr(99) + 'oalesce(question, ' + chr(39) * 2 + ')')} order by item_id, landed_at) as rn from exam_items where {VALID}) where rn = 1)"
MARKED = "array_to_string(list_transform(choices, lambda x, i: (case when i <= 5 then substr('①②③④⑤', i, 1) || ' ' else '' end) || coalesce(x, '')), chr(10))"
TEXT = f"""concat_ws(chr(10) || chr(10),
  case when passage <> '' then '[지문]' || chr(10) || passage end, '[문제]' || chr(10) || coalesce(question, ''),
  case when len(choices) > 0 then {MARKED} end, case when explanation <> '' then '[해설]' || chr(10) || explanation end)"""


def _pipe(spark, d):
    return pipeline.run(items(spark, d), "item_id", "landed_at", validate=True)


@query(f"select metadata.exam_type as exam_type, count(*) as n from {PIPE} group by 1")
def dist_exam_type(spark, d):  # F1
    return _pipe(spark, d).by_exam_type


@query(f"select metadata.year as year, count(*) as n from {PIPE} group by 1")
def dist_year(spark, d):  # F2
    return _pipe(spark, d).by_year


@query(f"select count(*) as total, count(*) filter (where length({TEXT}) >= 50) as saved, count(*) - count(*) filter (where length({TEXT}) >= 50) as filtered from {PIPE}")
def pipeline_totals(spark, d):  # F3
    return _pipe(spark, d).totals


PIPE_RECORDS = f"""select md5(text) as text_md5, 'korean_exam' as source, exam_type, year, subject, question_number from
  (select {TEXT} as text, metadata.exam_type as exam_type, metadata.year as year, metadata.subject as subject, metadata.question_number as question_number from {PIPE}) where length(text) >= 50"""


@query(PIPE_RECORDS)
def flagship_pipeline(spark, d):  # 3.1
    return flagship(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The corpus pipeline over the exam items: validate, keep first, format, drop short texts."""
    out = _pipe(spark, d).records
    return out.select(F.md5("text").alias("text_md5"), "source", "exam_type", "year", "subject", "question_number")


@query("select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by all")
def dist_by_lang_source(spark, d):  # F1
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select teacher, count(*) as records, count(*) filter (where score >= 0.5) as success, count(*) filter (where score < 0.5) as failed, sum(length(text))::bigint as total_chars from synth_records group by 1")
def teacher_stats(spark, d):  # F15
    return table(spark, d, "synth_records").groupBy("teacher").agg(F.count("*").alias("records"), F.count_if(F.col("score") >= 0.5).alias("success"), F.count_if(F.col("score") < 0.5).alias("failed"), F.sum(F.length("text")).alias("total_chars"))


# --- templates and record parsers ---------------------------------------------------------------------------------------


@query(f"select item_id, landed_at, md5({TEXT}) as text_md5, length({TEXT}) as n from exam_items")
def training_text_build(spark, d):  # C16
    return items(spark, d).select("item_id", "landed_at", F.md5(records.training_text()).alias("text_md5"), F.length(records.training_text()).alias("n"))


@query(f"select count(*) as n, sum(length(text))::bigint as chars, count(question_number) as numbered from (select {TEXT} as text, metadata.question_number as question_number from exam_items) where length(text) >= 50")
def training_record(spark, d):  # C17, D4
    return records.training_records(items(spark, d)).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count("question_number").alias("numbered"))


@query(f"select record_id, '질문: ' || {strip('question')} || chr(10) || '답변: ' || {strip('answer')} as text from synth_records where {nonblank('question')} and {nonblank('answer')}")
def qa_template(spark, d):  # C13
    return table(spark, d, "synth_records").select("record_id", records.qa_text(F.col("question"), F.col("answer")).alias("text")).where("text is not null")


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), chr(10)) as text from documents where text_col = 'conversations' and text is not null")
def chat_flatten(spark, d):  # C12
    # every other line is a message of the form role and content, or of the form from and value
    messages = F.transform(T.lines("text"), lambda x, i: F.struct(F.when(i % 2 == 0, x).otherwise("").alias("content"), F.when(i % 2 == 1, x).alias("value")))
    return docs(spark, d).where("text_col = 'conversations' and text is not null").select("doc_id", records.chat_text(messages, ("content", "value")).alias("text"))


@query(f"select doc_id, {strip('text')} as text from documents where text is not null")
def plain_text(spark, d):  # C14
    return docs(spark, d).where("text is not null").select("doc_id", T.strip(F.col("text").cast("string")).alias("text"))


TITLES = [
    "2022년 2023 대학수학능력시험 국어  홀수형", "2022년 6월 모의고사 국어", "2023년 9월 모의고사 국어", "2020년 기타 시험", "시험", "", "2024 대학수학능력시험 6월 모의고사", "제9월 모의고사 2019",
]


@query(rf"""select title, case when regexp_matches(title, '[0-9]{{4}}\s*대학수학능력시험') then 'csat' when regexp_matches(title, '[0-9]{{4}}.*6월.*모의고사') then 'mock_june'
  when regexp_matches(title, '[0-9]{{4}}.*9월.*모의고사') then 'mock_sept' else 'csat' end as exam_type,
  coalesce(try_cast(case when regexp_matches(title, '[0-9]{{4}}\s*대학수학능력시험') then regexp_extract(title, '([0-9]{{4}})\s*대학수학능력시험', 1)
  when regexp_matches(title, '[0-9]{{4}}.*6월.*모의고사') then regexp_extract(title, '([0-9]{{4}}).*6월.*모의고사', 1)
  when regexp_matches(title, '[0-9]{{4}}.*9월.*모의고사') then regexp_extract(title, '([0-9]{{4}}).*9월.*모의고사', 1) else regexp_extract(title, '([0-9]{{4}})', 1) end as int), 0) as year,
  case when regexp_matches(title, '[0-9]{{4}}\s*대학수학능력시험') then 11 when regexp_matches(title, '[0-9]{{4}}.*6월.*모의고사') then 6 when regexp_matches(title, '[0-9]{{4}}.*9월.*모의고사') then 9 end as month
  from (values {', '.join(f"('{t}')" for t in TITLES)}) v(title)""")
def title_cascade(spark, d):  # C2
    t = spark.createDataFrame([(x,) for x in TITLES], "title string")
    return t.withColumn("t", records.exam_title("title")).select("title", "t.exam_type", "t.year", "t.month")


def _options(names: list[str]) -> list:
    return [F.get("choices", F.lit(i)).alias(n) for i, n in enumerate(names)]


_FIVE = "array_to_string([coalesce(choices[1], ''), coalesce(choices[2], ''), coalesce(choices[3], ''), coalesce(choices[4], ''), coalesce(choices[5], '')], '|')"
_TAKEN = ["item_id", "passage", "question", "choices", "answer", "metadata.exam_type", "metadata.year", "metadata.month", "metadata.question_number", "metadata.source_dataset"]


@query(f"""select item_id, coalesce(passage, '') as passage, question, {_FIVE} as choices, answer, case when metadata.month = 6 then 'mock_june' when metadata.month = 9 then 'mock_sept' else 'csat' end as exam_type,
  metadata.year as year, case when metadata.month = 6 then 6 when metadata.month = 9 then 9 else 11 end as month, null::int as question_number, 'csatqa' as source_dataset from exam_items where {nonblank('question')} and metadata.year between 1000 and 9999""")
def csatqa_items(spark, d):  # C1, C2: raw records of that form made from the items
    y, m = F.col("metadata.year").cast("string"), F.col("metadata.month")
    title = F.when(m.isin(6, 9), F.concat(y, F.lit("년 "), m.cast("string"), F.lit("월 모의고사 국어"))).otherwise(F.concat(y, F.lit(" 대학수학능력시험 국어")))
    raw = items(spark, d).where("metadata.year between 1000 and 9999").select("item_id", title.alias("test_name"), F.col("passage").alias("context"), "question", F.col("answer").cast("string").alias("gold"), *_options([f"option#{i}" for i in range(1, 6)]))
    return _with_id(raw, records.parse_csatqa)


@query(f"""select item_id, coalesce(passage, '') as passage, question || case when {nonblank('explanation')} then chr(10) || explanation else '' end as question, {_FIVE} as choices, answer, 'csat' as exam_type, 2025 as year, 11 as month,
  metadata.question_number as question_number, 'csat_2025' as source_dataset from exam_items where {nonblank('question')}""")
def csat_2025_items(spark, d):  # C3
    raw = items(spark, d).select("item_id", F.col("metadata.question_number").cast("string").alias("idx"), F.col("passage").alias("paragraph"), "question", F.col("explanation").alias("question_plus"), *_options(list("ABCDE")), F.col("answer").cast("string").alias("answer"))
    return _with_id(raw, records.parse_csat_2025)


@query(f"""select item_id, '' as passage, question, array_to_string([coalesce(choices[1], ''), coalesce(choices[2], ''), coalesce(choices[3], ''), coalesce(choices[4], '')], '|') as choices, case when item_id % 4 = 0 and answer < 0 then null else answer end as answer,
  case when item_id % 2 = 0 then 'civil_national' else 'civil_local' end as exam_type, metadata.year as year, null::int as month, metadata.question_number as question_number, case when item_id % 2 = 0 then 'civil_national' else 'civil_local' end as source_dataset
  from exam_items where {nonblank('question')}""")
def civil_items(spark, d):  # C7, C8
    raw = items(spark, d).select(
        "item_id", F.col("metadata.question_number").cast("string").alias("문제 번호"), F.col("question").alias("문제 내용"), *_options([f"선택지 {i}" for i in range(1, 5)]), F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("["), F.col("answer"), F.lit("]"))).otherwise(F.col("answer").cast("string")).alias("정답"),
        F.col("metadata.year").cast("string").alias("year"), F.when(F.col("item_id") % 2 == 0, "국가직 9급").when(F.col("item_id") % 3 == 0, "지방직").alias("source"),
    )
    return _with_id(raw, records.parse_civil)


def _with_id(raw: DataFrame, parse) -> DataFrame:
    """What ``parse`` gives, with the id of the raw record, which goes through it as the name of the file."""
    out = parse(raw, F.col("item_id").cast("string"))
    return out.withColumns({"item_id": F.col("metadata.source_file").cast("long"), "choices": F.array_join("choices", "|")}).select(*_TAKEN)


JSONS = "(select feed, file_no, line_no, payload from local_raw where json_valid(payload))"


@query(rf"""select feed, file_no, line_no, g as gold, try_cast(regexp_extract({strip('g')}, '\A\[?([0-9]+)\]?\z', 1) as int) as answer
  from (select feed, file_no, line_no, json_extract_string(payload, '$.gold') as g from {JSONS}) where g is not null""")
def civil_answer_norm(spark, d):  # C8
    r = table(spark, d, "local_raw").where(F.try_parse_json("payload").isNotNull()).select("feed", "file_no", "line_no", F.get_json_object("payload", "$.gold").alias("gold")).where("gold is not null")
    return r.withColumn("answer", records.civil_answer("gold"))


LOCAL = {"question": ["question", "문제", "문제 내용", "q"], "passage": ["passage", "지문", "context", "paragraph"], "explanation": ["explanation", "해설", "설명"], "exam_type": ["exam_type", "시험종류"], "subject": ["subject", "과목"]}


def _first(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"""nullif(json_extract_string(payload, '$."{k}"'), '')""" for k in keys) + ")"


@query(f"""select feed, file_no, line_no, question, coalesce(passage, '') as passage, explanation, coalesce(exam_type, 'local') as exam_type, coalesce(subject, '국어') as subject from
  (select feed, file_no, line_no, {', '.join(f'{_first(k)} as {f}' for f, k in LOCAL.items())} from {JSONS}
   where coalesce(json_type(payload, '$.question'), 'VARCHAR') <> 'OBJECT' and coalesce(json_type(payload, '$."문제"'), 'VARCHAR') <> 'OBJECT' and coalesce(json_type(payload, '$."문제 내용"'), 'VARCHAR') <> 'OBJECT' and coalesce(json_type(payload, '$.q'), 'VARCHAR') <> 'OBJECT'
   and coalesce(json_type(payload, '$.passage'), 'VARCHAR') in ('VARCHAR', 'NULL') and coalesce(json_type(payload, '$."지문"'), 'VARCHAR') in ('VARCHAR', 'NULL') and coalesce(json_type(payload, '$.context'), 'VARCHAR') in ('VARCHAR', 'NULL') and coalesce(json_type(payload, '$.paragraph'), 'VARCHAR') in ('VARCHAR', 'NULL'))
  where {nonblank('question')}""")
def alias_coalesce(spark, d):  # C9, over the records whose question and passage are strings
    m = readers.json_map("v")
    r = table(spark, d, "local_raw").select("feed", "file_no", "line_no", F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    for k in LOCAL["question"]:
        r = r.where(F.coalesce(~F.schema_of_variant(F.expr(f"try_variant_get(v, '$[\"{k}\"]', 'variant')")).startswith("OBJECT"), F.lit(True)))
    for k in LOCAL["passage"]:
        kind = F.schema_of_variant(F.expr(f"try_variant_get(v, '$[\"{k}\"]', 'variant')"))
        r = r.where(F.coalesce(kind.isin("STRING", "VOID"), F.lit(True)))
    return _coalesced(r.withColumn("record", m))


def _coalesced(r: DataFrame) -> DataFrame:
    out = r.select("feed", "file_no", "line_no", *[records.first_of("record", k).alias(f) for f, k in LOCAL.items()])
    return out.where(T.not_blank("question")).select("feed", "file_no", "line_no", "question", F.coalesce("passage", F.lit("")).alias("passage"), "explanation", F.coalesce("exam_type", F.lit("local")).alias("exam_type"), F.coalesce("subject", F.lit("국어")).alias("subject"))


@query(None)
def alias_coalesce_all(spark, d):  # C9, over all readable records: arrays and objects count as their JSON, empty ones as no value
    v = F.try_parse_json("payload")
    r = table(spark, d, "local_raw").select("feed", "file_no", "line_no", F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("v"))
    full = F.map_filter(F.expr("cast(v as map<string, variant>)"), lambda _, x: ~F.coalesce(F.to_json(x), F.lit("")).isin("[]", "{}"))
    return _coalesced(r.select("feed", "file_no", "line_no", full.alias("v")).withColumn("record", readers.json_map("v")))


@query(None)
def local_items(spark, d):  # C9, C10 with choices and answers
    r = table(spark, d, "local_raw").withColumn("v", F.try_parse_json("payload")).where(F.schema_of_variant("v").startswith("OBJECT")).withColumn("record", readers.json_map("v"))
    return records.parse_local(r)


@query(r"""select item_id, f as source_file, coalesce(list_filter(string_split(f, '/'), lambda p: p in ('csat','mock','teacher','leet','district'))[-1], 'csat') as exam_type,
  coalesce(try_cast(list_filter(string_split(f, '/'), lambda p: regexp_matches(p, '\A[0-9]{4}\z'))[-1] as int), 0) as year,
  case when contains(lower(f), 'teacher') or contains(lower(f), '임용') then 'teacher' when contains(lower(f), 'leet') or contains(lower(f), '언어이해') then 'leet' else 'csat' end as reader
  from (select item_id, metadata.source_file as f from exam_items) where lower(f) like '%.pdf'""")
def path_metadata(spark, d):  # C19, C20
    r = items(spark, d).select("item_id", F.col("metadata.source_file").alias("source_file")).where(F.lower("source_file").endswith(".pdf"))
    return r.withColumn("e", pages.exam_of_path("source_file")).select("item_id", "source_file", "e.exam_type", "e.year", pages.reader_of_path("source_file").alias("reader"))


@query("""select item_id, case when regexp_extract(f, '(?:^|/)huggingface/([^/]+)/', 1) <> '' then regexp_extract(f, '(?:^|/)huggingface/([^/]+)/', 1) else coalesce(string_split(f, '/')[-2], '') end as dataset
  from (select item_id, metadata.source_file as f from exam_items) where f is not null""")
def dataset_dispatch(spark, d):  # C11
    r = items(spark, d).select("item_id", F.col("metadata.source_file").alias("f")).where("f is not null")
    return r.select("item_id", records.dataset_of("f").alias("dataset"))


@query("select item_id, array_to_string(list_slice(string_split(metadata.source_file, '/'), 2, 3), '/') as category from exam_items where metadata.source_file is not null")
def category_from_path(spark, d):  # C33
    return items(spark, d).where("metadata.source_file is not null").select("item_id", readers.category_of(F.col("metadata.source_file")).alias("category"))


#: The noise lines of the pages, said apart from the operator.
_S, _D = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]*", r"\p{Nd}+"
_NOISE = " or ".join(
    f"regexp_matches(l, '{p}')" for p in (f"^{_S}{_D}{_S}$", "대학수학능력시험.*홀수형", "대학수학능력시험.*짝수형", "이 문제지에 관한", f"^{_S}-{_S}{_D}{_S}-{_S}$", f"^{_S}제{_S}{_D}{_S}교시{_S}$", f"성명{_S}수험{_S}번호")
)


@query(f"select source_file, page_no, array_to_string(list_filter(string_split(text, chr(10)), lambda l: not ({_NOISE})), chr(10)) as text from scan_pages where text is not null")
def noise_lines_removed(spark, d):  # C18
    return table(spark, d, "scan_pages").where("text is not null").select("source_file", "page_no", pages.without_noise("text").alias("text"))


@query("select source_file as path, count(*) as pages, count(*) filter (where text is null) as failed from scan_pages group by 1")
def failed_pages(spark, d):  # A15
    return pages.failed_pages(table(spark, d, "scan_pages"), path="source_file")


@query(None)
def page_items(spark, d):  # C19-C28
    return pages.items_of_pages(table(spark, d, "scan_pages"), path="source_file")


@query(None)
def page_blocks(spark, d):  # C21
    return pages.file_blocks(table(spark, d, "scan_pages"), path="source_file").select(F.col("path").alias("source_file"), "page_no", "at", F.col("b").alias("block"))


def _piece(a: str, b: str | None) -> str:
    body = f"substr(text, {a} + 1, greatest({b} - {a} - 1, 0))" if b else f"substr(text, {a} + 1)"
    inner = f"regexp_replace({body}, '{S}+', ' ', 'g')"
    return strip(inner)


_AT = [f"instr(text, '{c}')" for c in "①②③④⑤"]


@query(f"""select doc_id, {' || chr(1) || '.join(_piece(a, b) for a, b in zip(_AT, [*_AT[1:], None]))} as choices from documents where {' and '.join(f'{a} > 0' for a in _AT)}""")
def five_choices(spark, d):  # C23
    return docs(spark, d).withColumn("c", pages.choice_list(F.col("text"), 5)).where("c is not null").select("doc_id", F.array_join("c", "\u0001").alias("choices"))


_R4 = f"substr(text, {_AT[3]} + 1)"
_LAST4 = f"case when instr({_R4}, '⑤') > 0 then substr({_R4}, 1, instr({_R4}, '⑤') - 1) when instr({_R4}, chr(10) || chr(10)) > 1 then substr({_R4}, 1, instr({_R4}, chr(10) || chr(10)) - 1) else {_R4} end"
_LAST4 = strip(f"regexp_replace({_LAST4}, '{S}+', ' ', 'g')")


@query(f"""select doc_id, {' || chr(1) || '.join([*[_piece(a, b) for a, b in zip(_AT[:3], _AT[1:4])], _LAST4])} as choices from documents where {' and '.join(f'{a} > 0' for a in _AT[:4])}""")
def four_choices(spark, d):  # C24
    return docs(spark, d).withColumn("c", pages.choice_list(F.col("text"), 4)).where("c is not null").select("doc_id", F.array_join("c", "\u0001").alias("choices"))


LINES = "string_split(text, chr(10))"
QAT = f"coalesce(list_max(list_filter(list_transform({LINES}, lambda l, i: case when l like '%?%' or l like '%시오.%' then i - 1 end), lambda z: z is not null)), len({LINES}) - 1)"


def _question_split(at: str) -> str:
    return f"""select doc_id, case when q <= 0 then '' else {strip(f"array_to_string(list_slice({LINES}, 1, q), chr(10))")} end as passage,
  case when q <= 0 then {strip('text')} else {strip(f"array_to_string(list_slice({LINES}, q + 1, len({LINES})), chr(10))")} end as question
  from (select doc_id, text, {at} as q from documents where text is not null)"""


@query(_question_split(QAT))
def passage_question_split(spark, d):  # C25
    return docs(spark, d).where("text is not null").withColumn("s", pages.split_question(F.col("text"), pages.CSAT_MARKERS)).select("doc_id", "s.passage", "s.question")


@query(_question_split(QAT.replace("l like '%시오.%'", "l like '%시오.%' or l like '%것은%'")))
def passage_question_split_teacher(spark, d):  # C26
    return docs(spark, d).where("text is not null").withColumn("s", pages.split_question(F.col("text"), pages.TEACHER_MARKERS)).select("doc_id", "s.passage", "s.question")


_SL = f"list_transform({LINES}, lambda x: {strip('x')})"
_SC = "regexp_matches(x, '[①②③④⑤]') or regexp_matches(x, '\\A[1-5]\\)')"
_BODY = "regexp_replace(regexp_replace(array_to_string(list_slice(ls, c + 1, len(ls)), chr(10)), '[①②③④⑤]', chr(1), 'g'), '(?m)^[1-5]\\)', chr(1), 'g')"
_SQUASHED = strip(f"regexp_replace(x, '{S}+', ' ', 'g')")


@query(f"""with a as (select doc_id, text, {_SL} as ls, list_min(list_filter(list_transform({_SL}, lambda x, i: case when {_SC} then i - 1 end), lambda z: z is not null)) as c from documents where {nonblank('text')}),
  b as (select *, list_max(list_filter(list_transform(list_slice(ls, 1, c), lambda x, i: case when x <> '' then i - 1 end), lambda z: z is not null)) as q from a)
  select doc_id, case when c is null or q < 1 then '' when q is null then {strip("array_to_string(list_slice(ls, 1, 0), chr(10))")} else {strip("array_to_string(list_slice(ls, 1, q), chr(10))")} end as passage,
  case when c is null then {strip('text')} else ls[q + 1] end as question,
  case when c is null then null else nullif(array_to_string(list_filter(list_transform(string_split({_BODY}, chr(1)), lambda x: {_SQUASHED}), lambda x: x <> ''), '|'), '') end as choices from b""")
def sft_split(spark, d):  # C5, over all texts
    s = docs(spark, d).where(T.not_blank("text")).select("doc_id", records.split_sft(F.col("text")).alias("s"))
    return s.select("doc_id", F.coalesce("s.passage", F.lit("")).alias("passage"), "s.question", F.array_join("s.choices", "|").alias("choices"))


@query(f"""select doc_id, 'csat_sft' as exam_type, {strip("'풀이 ' || doc_id")} as explanation from documents where {nonblank('text')}""")
def sft_items(spark, d):  # C4: the last message of each role counts
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    m = F.array(say("user", F.lit("먼저 묻는다")), say("user", F.col("text")), say("assistant", F.lit("앞선 답")), say("assistant", F.concat(F.lit("풀이 "), "doc_id")))
    return records.parse_sft(docs(spark, d).select(m.alias("messages"))).select(F.expr("cast(substring(explanation, 4) as bigint)").alias("doc_id"), "metadata.exam_type", "explanation")


@query(None)
def choice_fold(spark, d):  # C6 as the accumulator has it
    return docs(spark, d).where("text is not null").select("doc_id", F.array_join(records.fold_choices(F.col("text")), "|").alias("choices"))


@query("""select record_id, case when s is null then 0.5 else s end as score, case when s is null then 'Scoring failed' else coalesce(r, '') end as reason from
  (select record_id, score as s, reason as r from synth_records)""")
def judge_json(spark, d):  # C30
    r = table(spark, d, "synth_records").withColumn("j", records.judged(F.when(F.col("score").isNotNull(), F.to_json(F.struct("score", "reason"))).otherwise("not json")))
    return r.select("record_id", "j.score", "j.reason")


@query(f"select doc_id, len(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), 1, 3)) as n, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), 1, 3), '|') as prompts from documents where text is not null")
def prompt_lines(spark, d):  # C31
    return docs(spark, d).where("text is not null").withColumn("p", records.prompt_list("text", 3)).select("doc_id", F.size("p").alias("n"), F.array_join("p", "|").alias("prompts"))


@query("select doc_id, case when b < 1024 then printf('%dB', b) when b < 1048576 then printf('%.1fKB', b / 1024.0::double) else printf('%.1fMB', b / 1048576.0::double) end as size from (select doc_id, n_chars * 7 as b from documents)")
def human_sizes(spark, d):  # C32
    return docs(spark, d).select("doc_id", T.human_size(F.col("n_chars") * 7).alias("size"))


@query("select feed, file_no, line_no, coalesce(json_extract_string(payload, '$.text'), '') as text from (select * from local_raw where json_valid(payload))")
def content_or_text(spark, d):  # C15
    r = table(spark, d, "local_raw").where(F.try_parse_json("payload").isNotNull())
    return r.select("feed", "file_no", "line_no", F.coalesce(readers.content_or_text(F.col("payload")), F.lit("")).alias("text"))


# --- scans and lines ----------------------------------------------------------------------------------------------------


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_props(spark, d):  # A1
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select doc_id, (i - 1)::int as line_no, string_split(text, chr(10))[i] as line from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i) where text is not null")
def lines_view(spark, d):  # A26, B4
    return to_lines(docs(spark, d).where("text is not null"), "doc_id")


BLOCKS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: {strip('b')}), lambda b: b <> '')"


@query(f"select doc_id, (i - 1)::int as at, {BLOCKS}[i] as block from documents, unnest(range(1, len({BLOCKS}) + 1)) t(i) where text is not null")
def txt_blocks(spark, d):  # A4
    return docs(spark, d).where("text is not null").select("doc_id", F.posexplode(readers.text_blocks(F.col("text"))).alias("at", "block"))


@query("select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: " + strip("x") + "), lambda x: x <> '')[1] as line from documents")
def first_nonempty_line(spark, d):  # H11
    return docs(spark, d).select("doc_id", T.first_line("text").alias("line"))


@query("select doc_id, source from documents where source = 'wiki_narae' and text_col = 'text'")
def equality_pushdown(spark, d):  # A8
    return readers.filtered(docs(spark, d), {"source": "wiki_narae", "text_col": "text"}).select("doc_id", "source")


@query("select count(*) as n, count(text) as texts from documents where " + nonblank("text"))
def auto_text_column(spark, d):  # A13
    return readers.auto_text(docs(spark, d)).agg(F.count("*").alias("n"), F.count("text").alias("texts"))


@query(f"select doc_id, array_to_string({words('text')}, ' ') as text from documents where length(array_to_string({words('text')}, ' ')) > 0")
def token_arrays(spark, d):  # A14
    return docs(spark, d).withColumn("tokens", vocab.words("text")).select("doc_id", F.array_join("tokens", " ").alias("text")).where(F.length("text") > 0)


@query("""with r as (select event_id, row_number() over (order by event_id) - 1 as idx, count(*) over () as n from events)
  select event_id, idx::bigint as idx from r where exists (select 1 from (values (0.0), (0.25), (0.5), (0.75), (0.95)) f(x) where idx >= floor(x * n) and idx < floor(x * n) + 20)""")
def probe_lines(spark, d):  # A20
    e = table(spark, d, "events").select("event_id")
    return readers.probe_lines(dense_index(e, "event_id"), "idx", e.count(), 20)


PAGES = [
    ("https://a.kr/board/list.do?p=1", '<a href="/f/1.pdf">2023학년도 국어 <b>6월</b></a> <a class="x" href=\'2.pdf\'>2018년 수학</a><a href="https://b.kr/3.pdf">언어 영역</a>'),
    ("https://a.kr/x/", '<A HREF="y/4.pdf">2018 국어 11월</A>'), ("https://a.kr/z", "no links"),
]


@query("""select * from (values ('https://a.kr/board/list.do?p=1', 0, '2023학년도 국어 6월', 'https://a.kr/f/1.pdf', 2023, 6, 'csat_2023_06_0.pdf'), ('https://a.kr/board/list.do?p=1', 2, '언어 영역', 'https://b.kr/3.pdf', 0, null, 'csat_0_2.pdf'),
  ('https://a.kr/x/', 0, '2018 국어 11월', 'https://a.kr/x/y/4.pdf', 2018, 11, 'csat_2018_11_0.pdf')) v(url, "at", title, link, year, month, file_name)""")
def page_links(spark, d):  # A16
    return crawl.links(spark.createDataFrame(PAGES, "url string, html string"), "csat")


SITE_PAGES = [
    ("https://a.kr/l/", '<a href="1.pdf">2020 국어</a><a href="2.pdf">2018학년도 언어이해</a><a href="3.pdf">2021 전공 일반</a><a href="4.pdf">독서 이해력 3월 2022</a><a href="5.pdf">2018 국어 9월</a><a href="6.pdf">수학</a>'),
]


@query("""select 'https://a.kr/l/' as url, "at", title, 'https://a.kr/l/' || ("at" + 1) || '.pdf' as link, year, month, exam || '_' || year || coalesce('_' || lpad(month::varchar, 2, '0'), '') || '_' || "at" || '.pdf' as file_name, exam
  from (values (0, '2020 국어', 2020, null), (1, '2018학년도 언어이해', 2018, null), (2, '2021 전공 일반', 2021, null), (3, '독서 이해력 3월 2022', 2022, 3), (4, '2018 국어 9월', 2018, 9), (5, '수학', 0, null)) t("at", title, year, month),
  (values ('csat'), ('mock'), ('teacher'), ('leet'), ('district')) e(exam)
  where case when exam in ('csat', 'mock') then title like '%국어%' or title like '%언어%' when exam = 'leet' then title like '%언어%' or title like '%이해%' else title like '%국어%' end and not (exam = 'teacher' and year > 0 and year < 2019)""")
def page_links_all(spark, d):  # A16 of every site
    return crawl.all_links(spark.createDataFrame(SITE_PAGES, "url string, html string"), ["all"])


# --- sources and unions --------------------------------------------------------------------------------------------------


@query("select name, case when chat_mode then 'chat' when qa_mode then 'qa' else 'text' end as how, max_default from dataset_registry")
def registry_modes(spark, d):  # E3, A9
    return table(spark, d, "dataset_registry").select("name", F.when(F.col("chat_mode"), "chat").when(F.col("qa_mode"), "qa").otherwise("text").alias("how"), "max_default")


@query(f"""select text, source_ord from (select *, row_number() over (order by source_ord, doc_id) as rn from
  (select {strip('text')} as text, doc_id, 0 as source_ord from documents where source = 'news_garam' and length({strip('text')}) >= 20 union all
   select {strip('text')} as text, doc_id, 1 as source_ord from documents where source = 'web_hangil' and length({strip('text')}) >= 20)) where rn <= 500""")
def union_sources_limit(spark, d):  # I1, H2, H3
    parts = []
    for s in ("news_garam", "web_hangil"):
        r = docs(spark, d).where(F.col("source") == s)
        parts.append(r.withColumn("text", T.strip("text")).where(F.length("text") >= 20).select("text", "doc_id"))
    return quality.head(registry.union_all(parts), 500, "source_ord", "doc_id").select("text", "source_ord")


_STEXT = strip("text")


@query(f"""select name, text from (select source as name, {_STEXT} as text, row_number() over (partition by source order by doc_id) as rn from documents where source in (select name from dataset_registry) and length({_STEXT}) >= 20) where rn <= 40""")
def source_limits(spark, d):  # A10, H2: of each registered source the first texts that pass the filters
    names = sorted(r.name for r in table(spark, d, "dataset_registry").select("name").collect())  # a registry has tens of rows
    parts = [registry.source_text(readers.filtered(docs(spark, d), {"source": n}), "text", most=40, order=["doc_id"]).withColumn("name", F.lit(n)) for n in names]
    return registry.union_all(parts).select("name", "text")


@query("select doc_id, r::int as rep from documents, unnest(range(1, 4)) t(r) where source = 'essay_mulgyeol'")
def repeat_upweight(spark, d):  # B2, I5
    return registry.up_weighted(docs(spark, d).where("source = 'essay_mulgyeol'"), 3).select("doc_id", "rep")


# --- chat blocks and splits -----------------------------------------------------------------------------------------------

LV = "(select doc_id, (i - 1)::int as line_no, string_split(text, chr(10))[i] as line from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i) where text is not null)"
Q = f"({strip('line')} like '질문:%' or {strip('line')} like '<usr>%')"
CHAT = f"""(with a as (select doc_id, line_no, line, {nonblank('line')} as nb, {Q} as q from {LV}),
  b as (select *, coalesce(sum(nb::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as p from a),
  c as (select *, sum((q and p > 0)::int) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as blk from b where p > 0 or nb)
  select doc_id, blk::bigint as block, count(*)::int as n_lines, string_agg(line, chr(10) order by line_no) as text from c group by doc_id, blk)"""


def _blocks(spark, d):
    return split.chat_blocks(to_lines(docs(spark, d).where("text is not null"), "doc_id"), ["doc_id"], "line_no")


@query(f"select doc_id, block, n_lines, md5(text) as text_md5 from {CHAT}")
def chat_blocks(spark, d):  # G2, G3
    return _blocks(spark, d).select("doc_id", "block", "n_lines", F.md5("text").alias("text_md5"))


@query(f"""with p as (select {strip('line')} as s from {LV} where {nonblank('line')} order by doc_id, line_no limit 2000), n as
  (select count(*) filter (where s like '질문:%' or s like '<usr>%') as q, count(*) filter (where s like '답변:%' or s like '<bot>%') as a from p)
  select case when q >= 5 and a >= 5 then 'chat' else 'line' end as mode, q as questions, a as answers from n""")
def mode_detect(spark, d):  # D11
    return split.detect_mode(to_lines(docs(spark, d).where("text is not null"), "doc_id"), "doc_id", "line_no")


FIRSTL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: " + strip("x") + "), lambda x: x <> '')[1]"
SHARE = f"(('0x' || substr(md5(concat_ws('|', '42', block::varchar, coalesce({FIRSTL}, ''))), 1, 8))::bigint / 4294967296.0::double)"


def _split(spark, d):
    b = _blocks(spark, d)
    return split.hash_split(b, split.split_key(42, F.col("block"), F.col("text")), 0.1, native=True)


@query(f"select doc_id, block, case when {SHARE} < 0.1 then 'eval' else 'train' end as split from {CHAT}")
def hash_split_md5(spark, d):  # L1
    return _split(spark, d).select("doc_id", "block", "split")


@query(f"select split, count(*) as blocks, sum(n_lines)::bigint as lines from (select n_lines, case when {SHARE} < 0.1 then 'eval' else 'train' end as split from {CHAT}) group by 1")
def split_stats(spark, d):  # F9, B8
    return split.split_stats(_split(spark, d))


@query(None)
def hash_split_blake2b(spark, d):  # L1
    b = _blocks(spark, d)
    return split.hash_split(b, split.split_key(42, F.col("block"), F.col("text")), 0.1).select("doc_id", "block", "split")


@query("select count(*) as n, sum(doc_id)::bigint as ids from documents")
def shuffle_keeps_rows(spark, d):  # L3
    return split.shuffled(docs(spark, d), 7, "doc_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("select record_id, landed_at from synth_records where record_id % 5 = 0")
def every_fifth(spark, d):  # L4: the operator that scores every fifth record
    return sampling.every_nth(table(spark, d, "synth_records"), "record_id").select("record_id", "landed_at")


# --- vocabulary -----------------------------------------------------------------------------------------------------------

PIECES = f"(select doc_id, '▁' || unnest({words('text')}) as piece from documents where text is not null)"


@query(f"select piece, count(*) as n from {PIECES} group by 1")
def vocab_counts(spark, d):  # F5, K1
    return vocab.piece_counts(docs(spark, d))


@query(f"select rn as rank, piece, n from (select piece, n, row_number() over (order by n desc, piece) as rn from (select piece, count(*) as n from {PIECES} group by 1)) where rn <= 500")
def vocab_topn(spark, d):  # H4
    return vocab.top_pieces(docs(spark, d), 500)


@query(f"select ch, count(*) as n from (select unnest(string_split(regexp_replace(text, '[{T.SPACE_IN}가-힣]', '', 'g'), '')) as ch from documents) where ch <> '' group by 1")
def char_counts(spark, d):  # F5, D15, H5
    return vocab.char_counts(docs(spark, d))


KNOWN = f"(select piece from (select piece, count(*) as n from {PIECES} group by 1) order by n desc, piece limit 2000)"


@query(f"select piece, count(*) as n from {PIECES} where piece not in (select piece from {KNOWN}) group by 1")
def missing_pieces(spark, d):  # E5
    known = vocab.top_pieces(docs(spark, d), 2000).select(F.col("piece").alias("token"))
    return vocab.missing_pieces(docs(spark, d), known)


def _small_vocab(spark, d):
    top = vocab.top_pieces(docs(spark, d), 2000)
    rows = top.select((F.col("rank") + 3).cast("int").alias("id"), F.col("piece").alias("token"))
    return spark.createDataFrame([(i, t) for i, t in enumerate(vocab.SPECIALS)], "id int, token string").unionByName(rows)


@query(f"""with k as ({KNOWN[1:-1]}), e as (select p.piece, k.piece as hit from {PIECES} p left join k using (piece)),
  n as (select sum(case when hit is not null then 1 else length(piece) - 1 end)::bigint as tokens, sum(case when hit is null then length(piece) - 1 else 0 end)::bigint as unknown from e)
  select tokens, unknown, round(unknown / tokens::double, 9) as ratio, case when unknown / tokens::double < 0.001 then 'excellent' when unknown / tokens::double < 0.01 then 'good' when unknown / tokens::double < 0.05 then 'marginal' else 'bad' end as band from n""")
def unk_audit(spark, d):  # E1, K2, F7, K8
    e = vocab.encode(docs(spark, d).where("text is not null"), _small_vocab(spark, d), "doc_id")
    return vocab.unknown_audit(e).select("tokens", "unknown", F.round("ratio", 9).alias("ratio"), "band")


@query(f"""with k as ({KNOWN[1:-1]}) select doc_id, substr(text, 1, 200) as line from documents where doc_id in (select doc_id from {PIECES} where piece not in (select piece from k)) order by doc_id limit 5""")
def unk_examples(spark, d):  # H9
    e = vocab.encode(docs(spark, d).where("text is not null"), _small_vocab(spark, d), "doc_id").where(F.array_contains("ids", vocab.UNK))
    return quality.head(docs(spark, d).join(e.select("doc_id"), "doc_id", "left_semi"), 5, "doc_id").select("doc_id", F.substring("text", 1, 200).alias("line"))


@query(f"""with k as (select piece, row_number() over (order by n desc, piece) + 3 as id from (select piece, count(*) as n from {PIECES} group by 1) order by n desc, piece limit 2000),
  w as (select doc_id, {words('text')} as ws from documents where text is not null), e as (select doc_id, i, '▁' || ws[i] as piece from w, unnest(range(1, len(ws) + 1)) t(i))
  select d.doc_id, coalesce(string_agg(case when k.id is not null then k.id::varchar else rtrim(repeat('1,', length(e.piece) - 1), ',') end, ',' order by e.i), '') as ids
  from documents d left join e using (doc_id) left join k using (piece) group by d.doc_id""")
def encode_lookup(spark, d):  # E1, K2
    return vocab.encode(docs(spark, d), _small_vocab(spark, d), "doc_id").select("doc_id", F.array_join("ids", ",").alias("ids"))


@query("select doc_id, text from documents where false")
def decode_known(spark, d):  # K3, E2: decoding gives every text back, with its unknown signs as <unk>, so this has no rows
    src = docs(spark, d).where("text is not null")
    return round_trip(src, checkpoint(vocab.train(docs(spark, d), 30_000))).where("want <> back").select("doc_id", "text")


def round_trip(src: DataFrame, v: DataFrame) -> DataFrame:
    """``doc_id, text, want, back`` of all of ``src``: what encoding and decoding with ``v`` must give and what it gives."""
    back = vocab.decode(vocab.encode(src, v, "doc_id"), v, "doc_id").withColumnRenamed("text", "back")
    return src.join(back, "doc_id").select("doc_id", "text", vocab.decoded_form("text", v).alias("want"), "back")


#: The specials, the syllables and printable signs with and without the word mark, the 4,000 most frequent other signs, then the most frequent words.
TRAINED = f"""with signs as (select 1 as section, c - 44032 as rank, chr(c::int) as token from range(44032, 55204) r(c) union all select 1, c + 20000, chr(c::int) from range(33, 127) r(c) union all
    select 2, row_number() over (order by n desc, ch), ch from (select ch, count(*) as n from (select unnest(string_split(regexp_replace(text, '[{T.SPACE_IN}가-힣]', '', 'g'), '')) as ch from documents)
      where ch <> '' and not regexp_matches(ch, '[\\x21-\\x7e]') group by 1 order by n desc, ch limit 4000)),
  t as (select 0 as section, i::bigint as rank, s as token from (values (0, '<pad>'), (1, '<unk>'), (2, '<bos>'), (3, '<eos>')) v(i, s) union all
    select section, rank * 2, '<c:' || token || '>' from signs union all select section, rank * 2 + 1, '<c:▁' || token || '>' from signs union all
    select 3, row_number() over (order by n desc, piece), piece from (select piece, count(*) as n from {PIECES} group by 1 order by n desc, piece limit 30000 - 4 - 2 * 11266))
  select id, token from (select (row_number() over (order by section, rank) - 1)::int as id, token from t) where id < greatest(30000, 4 + 2 * (11266 + 4000))"""


@query(TRAINED)
def vocab_train(spark, d):  # K5, I4
    return vocab.train(docs(spark, d), 30_000)


@query(None)
def heavy_hitters(spark, d):  # F6
    return vocab.approx_heavy_hitters(docs(spark, d), 100)


@query(None)
def rank_ids(spark, d):  # K6
    return tokenizers.encode(docs(spark, d), tokenizers.Ranks, tokenizers.file_bytes("byte_bpe_multi_50k.tiktoken"), "doc_id", bos=True, eos=True)


@query(None)
def sentencepiece_ids(spark, d):  # K7
    return tokenizers.encode(docs(spark, d), tokenizers.Pieces, tokenizers.file_bytes("piece_bpe_32k.model"), "doc_id", eos=True)


@query("select count(text) as texts, count(text) as same from documents")
def rank_round_trip(spark, d):  # K6, K8: every text comes back
    return tokenizers.round_trips(docs(spark, d), tokenizers.Ranks, tokenizers.file_bytes("byte_bpe_50k.tiktoken"), "doc_id")


# --- budgets, packing, padding --------------------------------------------------------------------------------------------


@query("select doc_id, n_chars from (select *, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as p from documents) where p < 100000")
def token_budget(spark, d):  # G4, B6
    return packing.token_budget(docs(spark, d), F.col("n_chars"), "doc_id", 100_000).select("doc_id", "n_chars")


@query(f"""with w as (select doc_id, {words('text')} as ws from documents where text is not null), e as (select doc_id, i, case when i <= len(ws) then length(ws[i]) else 3 end as tok from w, unnest(range(1, len(ws) + 2)) t(i)),
  o as (select tok, row_number() over (order by doc_id, i) - 1 as p, lead(tok) over (order by doc_id, i) as nx, count(*) over () as tot from e)
  select (p // 64)::bigint as seq_id, count(*) as n, sum(tok * (p % 64 + 1))::bigint as x_sum, sum(nx * (p % 64 + 1))::bigint as y_sum from o where p // 64 < (tot - 1) // 64 group by 1""")
def pack_sequences(spark, d):  # G5, A22
    ids = docs(spark, d).where("text is not null").select("doc_id", F.transform(vocab.words("text"), F.length).alias("ids"))
    p = packing.pack(ids, "ids", "doc_id", 64, eos=vocab.EOS)
    weighted = lambda c: F.aggregate(F.transform(c, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return p.select("seq_id", F.size("x").cast("long").alias("n"), weighted("x").alias("x_sum"), weighted("y").alias("y_sum"))


@query(f"""with w as (select doc_id, source, list_slice(list_transform({words('text')}, lambda x: length(x)), 1, 32) as ids from documents where text is not null), m as (select source, max(len(ids)) as n from w group by 1)
  select doc_id, array_to_string(list_concat(ids, list_transform(range(0, n - len(ids)), lambda x: 0)), ',') as input_ids, len(ids)::bigint as mask_sum, n::bigint as padded from w join m using (source)""")
def pad_truncate_mask(spark, d):  # K4
    ids = docs(spark, d).where("text is not null").select("doc_id", "source", F.transform(vocab.words("text"), F.length).alias("ids"))
    b = vocab.batch_encode(ids, "doc_id", 32, batch=F.col("source"))
    return b.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"), F.size("input_ids").cast("long").alias("padded"))


# --- logs -----------------------------------------------------------------------------------------------------------------


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.format_string("step %6d | loss %.4f | lr 7.50e-05 | 453,%03d tok/s", F.col("event_id"), F.abs("value"), F.pmod("user_id", F.lit(1000))).alias("line"))


@query("""select event_id, case event_id % 10 when 1 then 'eval' when 2 then 'checkpoint' when 3 then 'error' when 4 then 'error' when 5 then null else 'train' end as kind,
  case when event_id % 10 in (2, 3, 4, 5) then null else event_id end as step, case when event_id % 10 in (2, 3, 4, 5) then null else round(abs(value), 4) end as loss,
  case when event_id % 10 not in (1, 2, 3, 4, 5) then 7.5e-05::double end as lr, case when event_id % 10 not in (1, 2, 3, 4, 5) then (453000 + user_id % 1000)::double end as tok_s,
  case when event_id % 10 = 1 then 12.5::double end as ppl, case when event_id % 10 = 2 then 'checkpoints/step-' || event_id end as path from events""")
def log_parse(spark, d):  # C29, lines of every form
    k = F.col("event_id") % 10
    e = table(spark, d, "events")
    other = F.when(k == 1, F.format_string("eval  step=%d  loss=%.4f  ppl=12.50", F.col("event_id"), F.abs("value"))).when(k == 2, F.concat(F.lit("Checkpoint saved → checkpoints/step-"), F.col("event_id")))
    other = other.when(k == 3, "⚠ gradient overflow").when(k == 4, F.lit("  ✗ worker lost")).when(k == 5, "error: no sign, so no line of a form")
    lines = _log(spark, d).join(e.select("event_id", other.alias("other")), "event_id").withColumn("line", F.coalesce("other", "line"))
    return logs.parse(lines).select("event_id", "kind", "step", "loss", "lr", "tok_s", "ppl", "path")


METRICS = "(select user_id, event_id as step, round(abs(value), 4) as loss from events)"


def _metrics(spark, d):
    return logs.parse(_log(spark, d)).select("user_id", "step", "loss")


@query(f"""select user_id, step, loss, min(loss) over w as min_loss, round(avg(loss) over w, 9) as avg_loss, count(loss) over w as n_steps from {METRICS} window w as (partition by user_id order by step rows between 99 preceding and current row)""")
def log_history(spark, d):  # G6, F10
    h = logs.history(_metrics(spark, d), ["user_id"])
    return h.select("user_id", "step", "loss", "min_loss", F.round("avg_loss", 9).alias("avg_loss"), "n_steps")


@query(f"""select user_id, step, array_to_string(list_transform(l, lambda v: substr('▁▂▃▄▅▆▇█', case when list_max(l) > 0 then floor(v / list_max(l) * 7)::int else 0 end + 1, 1)), '') as spark from
  (select user_id, step, list(loss) over (partition by user_id order by step rows between 19 preceding and current row) as l from {METRICS})""")
def sparkline(spark, d):  # G7
    return logs.history(_metrics(spark, d), ["user_id"]).select("user_id", "step", "spark")


@query(f"""select user_id, step, loss, min(loss) over (partition by user_id order by step) as best, coalesce(loss < min(loss) over (partition by user_id order by step rows between unbounded preceding and 1 preceding), true) as is_best from {METRICS}""")
def running_best(spark, d):  # F17
    return logs.running_best(_metrics(spark, d), ["user_id"])


@query(f"select count(loss) as n, min(loss) as min_loss, round(avg(loss), 6) as avg_loss, max_by(loss, step) as last_loss, max(step) as last_step from {METRICS}")
def log_summary(spark, d):  # F10, A21
    return logs.summary(_metrics(spark, d)).withColumn("avg_loss", F.round("avg_loss", 6))


@query("select step, event_id from (select event_id // 7 as step, event_id, row_number() over (partition by event_id // 7 order by event_id) as r from events) where r = 1")
def once_a_step(spark, d):  # D12, M2
    return logs.once_a_step(table(spark, d, "events").select(F.floor(F.col("event_id") / 7).alias("step"), "event_id"), "event_id")


@query("""select round(avg(m), 6) as loss, round(exp(least(avg(m), 20.0)), 3) as ppl, round(sum(s) / sum(k), 6) as weighted_loss from (select avg(value / 100) as m, sum(value / 100) as s, count(value) as k from events group by user_id)""")
def eval_mean(spark, d):  # F11
    m = logs.eval_mean(table(spark, d, "events").select(F.col("user_id").alias("rank"), (F.col("value") / 100).alias("loss")))
    return m.select(F.round("loss", 6).alias("loss"), F.round("ppl", 3).alias("ppl"), F.round("weighted_loss", 6).alias("weighted_loss"))


@query("select 'step-' || v as name, v as step from (values (100::bigint), (200::bigint)) t(v)")
def expired_checkpoints(spark, d):  # B13
    names = spark.createDataFrame([(f"step-{i}00",) for i in range(1, 6)] + [("best",), ("final",), ("step-x",)], "name string")
    return logs.expired_checkpoints(names, 3)


@query("select event_type, count(*) as files, sum(user_id)::bigint as bytes from events group by 1")
def status_counts(spark, d):  # F12
    return crawl.crawl_counts(table(spark, d, "events").select(F.col("event_type").alias("status"), F.col("user_id").alias("size"))).withColumnRenamed("status", "event_type")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_windows(spark, d):  # M1, an extension
    return event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def stream_event_windows(spark, d):  # M1: the same windows from a stream that reads what is there and stops
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return streamed(event_windows(events), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select feed, file_no, count(*) filter (where json_valid(payload)) as parsed, count(*) filter (where not json_valid(payload)) as skipped from local_raw group by all")
def parsed_per_file(spark, d):  # F13
    bad = F.try_parse_json("payload").isNull()
    return table(spark, d, "local_raw").groupBy("feed", "file_no").agg(F.count_if(~bad).alias("parsed"), F.count_if(bad).alias("skipped"))


@query("select event_id, event_type from events order by event_id desc limit 100")
def log_tail(spark, d):  # A21
    return logs.tail(table(spark, d, "events").select("event_id", "event_type"), 100, "event_id")


@query("select user_id, count(*) * 32768 as tokens_seen, round(count(*) * 32768 / greatest(epoch(max(ts)) - epoch(min(ts)), 1.0), 3) as tok_s from events group by 1")
def tokens_seen(spark, d):  # F14
    e = table(spark, d, "events")
    return logs.throughput(e, 32_768, "ts", ["user_id"]).withColumn("tok_s", F.round("tok_s", 3))


@query(f"select case when n_ko >= 3 then 'coherent' else 'broken' end as verdict, count(*) as texts from (select doc_id, len(list_filter(list_slice({words('text')}, 1, 10), lambda w: regexp_matches(w, '[가-힣]'))) as n_ko from documents where text is not null) group by 1")
def health_tally(spark, d):  # F18
    return vocab.health(docs(spark, d).where("text is not null").select("doc_id", F.slice(vocab.words("text"), 1, 10).alias("top")), "top").groupBy("verdict").agg(F.count("*").alias("texts"))


@query("with p as (select name, row_number() over (order by name) - 1 as idx, count(*) over () as n from dataset_registry) select name, ((idx - (n // 3) + n) % n)::bigint as place from p")
def rotated_list(spark, d):  # G9
    r = dense_index(table(spark, d, "dataset_registry").select("name"), "name")
    n = r.count()
    return r.select("name", sampling.rotated(F.col("idx"), n // 3, n).alias("place"))


# --- decoding -------------------------------------------------------------------------------------------------------------

LOGITS = "(select vec_id as step, (i - 1)::int as token, embedding[i]::double * 10 as logit from embeddings, unnest(range(1, len(embedding) + 1)) t(i))"


def _logits(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("step"), F.posexplode("embedding").alias("token", "v")).select("step", "token", (F.col("v").cast("double") * 10).alias("logit"))


@query(f"select step, token from (select *, rank() over (partition by step order by logit desc) as r from {LOGITS}) where r <= 10")
def topk_mask(spark, d):  # H6, H7
    return sampling.top_k(_logits(spark, d), 10).select("step", "token")


@query(f"""with m as (select *, max(logit) over (partition by step) as mx from {LOGITS}), e as (select step, token, logit, exp(logit - mx) / sum(exp(logit - mx)) over (partition by step) as p from m),
  c as (select *, sum(p) over (partition by step order by logit desc, token rows between unbounded preceding and current row) - p as before from e) select step, token from c where before <= 0.9""")
def topp_mask(spark, d):  # G8
    return sampling.top_p(_logits(spark, d), 0.9).select("step", "token")


@query(f"select step, max_by(token, logit) as token from {LOGITS} group by 1")
def greedy_argmax(spark, d):  # H8
    return sampling.greedy(_logits(spark, d))


@query(f"""with h as (select vec_id as step, (vec_id % 7)::int as token, 1 as k from embeddings union all select vec_id, (vec_id % 3)::int, 1 from embeddings), n as (select step, token, count(*) as k from h group by 1, 2)
  select l.step, l.token, round((case when logit > 0 then logit / power(1.2, coalesce(k, 0)) else logit * power(1.2, coalesce(k, 0)) end) / 0.8, 6) as logit from {LOGITS} l left join n on l.step = n.step and l.token = n.token""")
def repetition_penalty(spark, d):  # the logit chain
    e = table(spark, d, "embeddings")
    h = e.select(F.col("vec_id").alias("step"), (F.col("vec_id") % 7).cast("int").alias("token")).unionByName(e.select(F.col("vec_id").alias("step"), (F.col("vec_id") % 3).cast("int").alias("token")))
    return sampling.temperature(sampling.repetition_penalty(_logits(spark, d), h, 1.2), 0.8).withColumn("logit", F.round("logit", 6))


@query(None)
def gumbel_draw(spark, d):  # L5
    return sampling.draw(_logits(spark, d), 3)


@query(None)
def random_tokens(spark, d):  # A23
    return packing.random_tokens(spark, 100, 16, 32_000)
