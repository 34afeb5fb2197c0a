"""Parsers of raw records onto the exam item schema, and templates of training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moru.functions import text as T

ITEM = (
    "passage string, question string, choices array<string>, answer int, explanation string, "
    "metadata struct<exam_type string, year int, month int, question_number int, subject string, source_dataset string, source_file string>"
)


def metadata(**given: Column | str | int | None) -> Column:
    """A metadata struct; what isn't given has the schema's default."""
    kinds = {"exam_type": "string", "year": "int", "month": "int", "question_number": "int", "subject": "string", "source_dataset": "string", "source_file": "string"}
    default = {"subject": "국어", "year": 0}
    value = {k: given.get(k, default.get(k)) for k in kinds}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds[k]).alias(k) for k, v in value.items()])


def item(passage: Column, question: Column, choices: Column, answer: Column, explanation: Column, meta: Column) -> list[Column]:
    return [passage.alias("passage"), question.alias("question"), choices.alias("choices"), answer.cast("int").alias("answer"), explanation.alias("explanation"), meta.alias("metadata")]


def empty_if_null(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def exam_title(c: Column | str) -> Column:
    """``struct<exam_type, year, month>`` of an exam's title. The forms of the titles."""
    def year(pattern: str) -> Column:
        return F.regexp_extract(c, pattern, 1).try_cast("int")

    csat, june, sept = r"([0-9]{4})\s*대학수학능력시험", r"([0-9]{4}).*6월.*모의고사", r"([0-9]{4}).*9월.*모의고사"
    out = lambda kind, y, month: F.struct(F.lit(kind).alias("exam_type"), y.alias("year"), F.lit(month).cast("int").alias("month"))
    col = F.col(c) if isinstance(c, str) else c
    return (
        F.when(col.rlike(csat), out("csat", year(csat), 11)).when(col.rlike(june), out("mock_june", year(june), 6)).when(col.rlike(sept), out("mock_sept", year(sept), 9))
        .otherwise(out("csat", F.coalesce(year(r"([0-9]{4})"), F.lit(0)), None))
    )


def parse_csatqa(raw: DataFrame, source_file: Column | None = None) -> DataFrame:
    """``test_name, context, question, gold, option#1..5``; rows with a blank question are rejected, missing options are ''."""
    t = exam_title("test_name")
    return raw.where(T.not_blank("question")).select(*item(
        empty_if_null("context"), F.col("question"), F.array(*[empty_if_null(f"`option#{i}`") for i in range(1, 6)]), T.whole_number("gold"), F.lit(None).cast("string"),
        metadata(exam_type=t["exam_type"], year=t["year"], month=t["month"], source_dataset="csatqa", source_file=source_file),
    ))


def parse_csat_2025(raw: DataFrame, source_file: Column | None = None) -> DataFrame:
    """``idx, paragraph, question, question_plus, A..E, answer``; a further question text that isn't blank is added below."""
    question = F.when(T.not_blank("question_plus"), F.concat("question", F.lit("\n"), "question_plus")).otherwise(F.col("question"))
    return raw.where(T.not_blank("question")).select(*item(
        empty_if_null("paragraph"), question, F.array(*[empty_if_null(x) for x in "ABCDE"]), T.whole_number("answer"), F.lit(None).cast("string"),
        metadata(exam_type="csat", year=2025, month=11, question_number=T.whole_number("idx"), source_dataset="csat_2025", source_file=source_file),
    ))


def civil_answer(c: Column | str) -> Column:
    """2, '2' and '[2]' are 2, '-1' is -1; null, '', '<NA>', '[-1]' and words are null."""
    col = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.regexp_extract(T.strip(col), r"\A\[?([0-9]+)\]?\z", 1).try_cast("int"), T.whole_number(col))


def parse_civil(raw: DataFrame, source_file: Column | None = None) -> DataFrame:
    """``문제 번호, 문제 내용, 선택지 1..4, 정답, year, source``; a source of the state's offices makes a national exam."""
    kind = F.when(F.coalesce(F.col("source").contains("국가직"), F.lit(False)), "civil_national").otherwise("civil_local")
    return raw.where(T.not_blank("`문제 내용`")).select(*item(
        F.lit(""), F.col("`문제 내용`"), F.array(*[empty_if_null(f"`선택지 {i}`") for i in range(1, 5)]), civil_answer("`정답`"), F.lit(None).cast("string"),
        metadata(exam_type=kind, year=F.coalesce(T.whole_number("year"), F.lit(0)), question_number=T.whole_number("`문제 번호`"), source_dataset=kind, source_file=source_file),
    ))


def last_message(messages: str, role: str) -> Column:
    return F.try_element_at(F.filter(F.col(messages), lambda m: m["role"] == role), F.lit(-1))["content"]


def split_sft(c: Column) -> Column:
    """``struct<passage, question, choices>`` of a message: choices start at the first line with a circled number or ``n)``,
    the question is the last line before them that isn't blank, the passage what comes before it. Each choice is its own."""
    ls = F.transform(T.lines(c), T.strip)
    is_choice = lambda x: x.rlike(f"[{T.CIRCLES}]") | x.rlike(r"\A[1-5]\)")
    at = F.array_min(F.filter(F.transform(ls, lambda x, i: F.when(is_choice(x), i)), lambda i: i.isNotNull()))
    head = F.when(at.isNull(), ls).otherwise(F.slice(ls, 1, at))
    q = F.array_max(F.filter(F.transform(head, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull()))
    question = F.when(at.isNull(), T.strip(c)).otherwise(F.get(head, q))
    passage = F.when(at.isNull() | (q < 1), F.lit("")).otherwise(T.strip(F.array_join(F.slice(head, 1, q), "\n")))
    body = F.when(at.isNotNull(), F.array_join(F.slice(ls, at + 1, F.size(ls)), "\n"))
    marks = F.regexp_replace(body, rf"(?m)[{T.CIRCLES}]|^[1-5]\)", "\u0001")
    choices = F.filter(F.transform(F.split(marks, "\u0001"), T.collapse), lambda x: x != "")
    return F.struct(passage.alias("passage"), question.alias("question"), F.when(F.size(choices) > 0, choices).alias("choices"))


def fold_choices(c: Column) -> Column:
    """The choices as the line-by-line accumulation gives them: a line with a circled number starts a choice, any other continues it."""
    ls = F.filter(F.transform(T.lines(c), T.strip), lambda x: x != "")
    start = lambda x: x.rlike(f"[{T.CIRCLES}]")
    number = lambda x: F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.when(F.instr(x, F.substring(F.lit(T.CIRCLES), k, F.lit(1))) > 0, k)), lambda z: z.isNotNull()))
    text = lambda x: T.strip(F.replace(x, F.substring(F.lit(T.CIRCLES), number(x), F.lit(1)), F.lit("")))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    step = lambda s, x: F.struct(
        F.when(start(x) & s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
        F.when(start(x), text(x)).when(s["open"].isNotNull(), F.concat(s["open"], F.lit(" "), x)).alias("open"),
    )
    return F.aggregate(ls, state, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def parse_sft(raw: DataFrame, source_file: Column | None = None) -> DataFrame:
    """``messages array<struct<role,content>>``: the last user message is the item, the last assistant message its explanation."""
    rows = raw.withColumn("_user", last_message("messages", "user")).where(T.not_blank("_user")).withColumn("_s", split_sft(F.col("_user")))
    return rows.select(*item(
        F.col("_s.passage"), F.col("_s.question"), F.col("_s.choices"), F.lit(None), last_message("messages", "assistant"), metadata(exam_type="csat_sft", source_dataset="csat_sft", source_file=source_file),
    ))


# The keys of local records, in the order in which they count.
LOCAL_KEYS = {
    "question": ["question", "문제", "문제 내용", "q"],
    "passage": ["passage", "지문", "context", "paragraph"],
    "answer": ["answer", "정답", "gold"],
    "explanation": ["explanation", "해설", "설명"],
}


def first_of(m: str, keys: list[str]) -> Column:
    """The first value of the map ``m`` under ``keys`` that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(F.col(m), F.lit(k)), F.lit("")) for k in keys])


def parse_local(raw: DataFrame, source_file: Column | None = None) -> DataFrame:
    """``record map<string,string>`` (arrays as JSON): every logical field under any of its known keys; no question, no item."""
    rows = raw.withColumn("_q", first_of("record", LOCAL_KEYS["question"])).where(T.not_blank("_q"))
    listed = F.from_json(first_of("record", ["choices", "선지", "options"]), "array<string>")
    numbered = [F.array(*[F.nullif(F.try_element_at("record", F.lit(k)), F.lit("")) for k in ks]) for ks in ([f"선택지 {i}" for i in range(1, 6)], [f"choice_{i}" for i in range(1, 6)], list("ABCDE"))]
    full = lambda a: F.nullif(F.filter(a, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
    choices = F.coalesce(full(listed), *[full(a) for a in numbered])
    return rows.select(*item(
        F.coalesce(first_of("record", LOCAL_KEYS["passage"]), F.lit("")), F.col("_q"), choices, civil_answer(first_of("record", LOCAL_KEYS["answer"])), first_of("record", LOCAL_KEYS["explanation"]),
        metadata(exam_type=F.coalesce(first_of("record", ["exam_type", "시험종류"]), F.lit("local")), year=F.coalesce(T.whole_number(first_of("record", ["year", "연도"])), F.lit(0)),
                 subject=F.coalesce(first_of("record", ["subject", "과목"]), F.lit("국어")), source_file=source_file),
    ))


#: Parsers by the directory that a file lies in below ``huggingface``; others are read like the first.
PARSERS = {"csatqa": parse_csatqa, "csat_2025": parse_csat_2025, "csat_sft": parse_sft, "civil_local": parse_civil, "civil_national": parse_civil}


def dataset_of(path: Column | str) -> Column:
    """The segment after ``huggingface`` in a path, else the directory of the file."""
    p = F.col(path) if isinstance(path, str) else path
    named = F.regexp_extract(p, r"(?:^|/)huggingface/([^/]+)/", 1)
    return F.when(named != "", named).otherwise(F.coalesce(F.try_element_at(F.split(p, "/"), F.lit(-2)), F.lit("")))


def training_text(passage: str = "passage", question: str = "question", choices: str = "choices", explanation: str = "explanation") -> Column:
    """Passage, question, choices and explanation under their headings, with a blank line between; parts that are empty are left out."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    mark = lambda x, i: F.concat(F.when(i < 5, F.concat(F.substring(F.lit(T.CIRCLES), i + F.lit(1), F.lit(1)), F.lit(" "))).otherwise(F.lit("")), F.coalesce(x, F.lit("")))
    return F.concat_ws(
        "\n\n",
        F.when(has(passage), F.concat(F.lit("[지문]\n"), F.col(passage))),
        F.concat(F.lit("[문제]\n"), F.coalesce(F.col(question), F.lit(""))),
        F.when(F.coalesce(F.size(choices) > 0, F.lit(False)), F.array_join(F.transform(F.col(choices), mark), "\n")),
        F.when(has(explanation), F.concat(F.lit("[해설]\n"), F.col(explanation))),
    )


def training_records(items: DataFrame, least: int = 50) -> DataFrame:
    """``text, source, exam_type, year, subject, question_number``; texts under ``least`` signs are dropped."""
    out = items.select(training_text().alias("text"), F.lit("korean_exam").alias("source"), *[F.col(f"metadata.{c}") for c in ("exam_type", "year", "subject", "question_number")])
    return out.where(F.length("text") >= least)


def qa_text(instruction: Column, answer: Column) -> Column:
    """The question and answer template; null unless both say something."""
    return F.when(T.not_blank(instruction) & T.not_blank(answer), F.concat(F.lit("질문: "), T.strip(instruction), F.lit("\n답변: "), T.strip(answer)))


def chat_text(messages: Column, keys: tuple[str, ...] = ("content",)) -> Column:
    """The messages' contents, stripped, without blank ones, line by line; of several ``keys`` the first that isn't empty, as ``content`` or ``value``."""
    said = lambda m: F.coalesce(*[F.nullif(m[k], F.lit("")) for k in keys], F.lit(""))
    return F.array_join(F.filter(F.transform(messages, lambda m: T.strip(said(m))), lambda x: x != ""), "\n")


def judged(c: Column | str) -> Column:
    """``struct<score, reason>`` of a judge's JSON; what can't be read scores 0.5."""
    got = F.from_json(c, "score double, reason string", {"mode": "PERMISSIVE"})
    return F.struct(F.coalesce(got["score"], F.lit(0.5)).alias("score"), F.when(got["score"].isNull(), "Scoring failed").otherwise(F.coalesce(got["reason"], F.lit(""))).alias("reason"))


def prompt_list(c: Column | str, most: int, numbered: bool = False) -> Column:
    """The lines of a text that aren't blank, the first ``most`` of them, without their numbers if ``numbered``."""
    ls = F.transform(T.lines(c), T.strip)
    if numbered:
        ls = F.transform(ls, lambda x: F.regexp_replace(x, r"\A[0-9.\-) ]+", ""))
    return F.slice(F.filter(ls, lambda x: x != ""), 1, most)


def parse_dataset(raw: DataFrame, name: str, source_file: Column | None = None) -> DataFrame:
    """The items of raw records by the parser of their dataset; unknown names are read like the first."""
    return PARSERS.get(name, parse_csatqa)(raw, source_file)


def parse_all(raw: dict[str, DataFrame]) -> DataFrame:
    """The items of several datasets, one after the other, with ``dataset``."""
    parts = [parse_dataset(df, name).withColumn("dataset", F.lit(name)) for name, df in raw.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
