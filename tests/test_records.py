"""Parsers, filters and templates on inline rows."""

import json

import pytest
from pyspark.sql import functions as F

from moru.functions import text as T
from moru.operators import pages, quality, records, vocab
from moru.plans import catalogue, pipeline


def one(df):
    return df.collect()[0]


def test_strip_knows_all_white_space(spark):
    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    df = spark.createDataFrame([(spaces + "가 나" + spaces,), (spaces,), ("",), (None,)], "t string").select(T.strip("t").alias("s"), T.not_blank("t").alias("n"))
    assert [tuple(r) for r in df.collect()] == [("가 나", True), ("", False), ("", False), (None, False)]
    assert ("x" + spaces).strip() == "x"


@pytest.mark.parametrize(("question", "passage", "good"), [("가나다라abcd", "", True), ("가나다abcde", "", False), ("abc", "가나다라마바사", True), ("가나", "abcdefgh", False), ("   \t\n  ", "가나다", False), (None, "가나다", False), ("가", None, True)])
def test_validity(spark, question, passage, good):
    df = spark.createDataFrame([(question, passage)], "question string, passage string")
    assert one(df.select(quality.is_valid_item().alias("v"))).v is good


@pytest.mark.parametrize(("n", "kept"), [(49, 0), (50, 1)])
def test_short_texts_are_dropped(spark, n, kept):
    q = "가" * (n - len("[문제]\n"))
    df = spark.createDataFrame([("", q, None, None, None, ("csat", 2023, None, None, "국어", None, None))], records.ITEM)
    assert records.training_records(df).count() == kept


def test_training_text(spark):
    row = ("지문", "문제?", ["하나", "둘", None], 2, "풀이", ("csat", 2023, 11, 1, "국어", None, None))
    df = spark.createDataFrame([row], records.ITEM)
    assert one(df.select(records.training_text().alias("t"))).t == "[지문]\n지문\n\n[문제]\n문제?\n\n① 하나\n② 둘\n③ \n\n[해설]\n풀이"
    six = spark.createDataFrame([("", "q", list("abcdef"), None, None, None)], records.ITEM)
    assert one(six.select(records.training_text().alias("t"))).t.endswith("⑤ e\nf")


def test_csatqa(spark):
    schema = "test_name string, context string, question string, gold string, `option#1` string, `option#2` string, `option#3` string, `option#4` string, `option#5` string"
    rows = [("2022년 2023 대학수학능력시험 국어", "글", "윗글은?", "3", "가", "나", "다", "라", None), ("", "", " ", "1", "", "", "", "", "")]
    r = one(records.parse_csatqa(spark.createDataFrame(rows, schema)))
    assert (r.answer, r.choices, r.metadata.year, r.metadata.exam_type, r.metadata.month) == (3, ["가", "나", "다", "라", ""], 2023, "csat", 11)
    assert records.parse_csatqa(spark.createDataFrame(rows, schema)).count() == 1


def test_csat_2025_and_civil(spark):
    r = one(records.parse_csat_2025(spark.createDataFrame([(7, "p", "q", "더", "a", "b", "c", "d", "e", "4")], "idx int, paragraph string, question string, question_plus string, A string, B string, C string, D string, E string, answer string")))
    assert (r.question, r.metadata.question_number, r.metadata.year, r.answer) == ("q\n더", 7, 2025, 4)
    civil = spark.createDataFrame([("1", "문", "가", "나", "다", "라", a, None, s) for a, s in [("2", "2020 국가직"), ("[1]", "지방직"), ("<NA>", None), ("사", ""), (None, "")]], "`문제 번호` string, `문제 내용` string, `선택지 1` string, `선택지 2` string, `선택지 3` string, `선택지 4` string, `정답` string, year string, source string")
    got = [(r.answer, r.metadata.exam_type, r.metadata.year) for r in records.parse_civil(civil).collect()]
    assert got == [(2, "civil_national", 0), (1, "civil_local", 0), (None, "civil_local", 0), (None, "civil_local", 0), (None, "civil_local", 0)]


def test_sft(spark):
    text = "지문이다.\n\n무엇인가?\n①첫째\n②둘째\n③셋째\n④넷째\n⑤다섯째"
    rows = [([("system", "s"), ("user", text), ("assistant", "풀이")],), ([("user", "  ")],), ([],), ([("user", "그냥 묻는다")],)]
    got = records.parse_sft(spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>")).collect()
    assert len(got) == 2
    assert (got[0].passage, got[0].question, got[0].choices, got[0].explanation) == ("지문이다.", "무엇인가?", ["첫째", "둘째", "셋째", "넷째", "다섯째"], "풀이")
    assert (got[1].question, got[1].choices, got[1].explanation) == ("그냥 묻는다", None, None)
    folded = spark.createDataFrame([("q\n① 가\n더\n② 나",), ("x",)], "t string").select(records.fold_choices(F.col("t")).alias("c")).collect()
    assert [r.c for r in folded] == [["가 더", "나"], []]


def test_local(spark):
    rows = [({"문제": "문", "지문": "글", "선택지 1": "가", "선택지 2": "", "정답": "[2]", "연도": "2020"},), ({"q": "", "문제 내용": "내용", "choices": '["a","b"]', "answer": "", "gold": "3"},), ({"passage": "글"},)]
    got = records.parse_local(spark.createDataFrame(rows, "record map<string,string>")).collect()
    assert [(r.question, r.passage, r.choices, r.answer, r.metadata.year, r.metadata.exam_type) for r in got] == [("문", "글", ["가"], 2, 2020, "local"), ("내용", "", ["a", "b"], 3, 0, "local")]


def test_aliases_of_all_records(spark, tmp_path):
    rows = [
        {"question": {"text": "가?"}, "지문": ["글", "둘"]}, {"question": {}, "문제": "나?", "passage": [], "context": {"body": "글"}}, {"question": "", "q": ["다?"], "시험종류": "leet", "해설": {"a": 1}},
        {"question": "라?", "passage": "[]"}, {"question": None, "passage": "글"}, {"q": []}, ["목록"],
    ]
    data = [("f", 1, i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)] + [("f", 1, 99, "bad {"), ("f", 1, 98, None)]
    spark.createDataFrame(data, "feed string, file_no int, line_no int, payload string").write.parquet(f"{tmp_path}/local_raw.parquet")
    got = {r.line_no: tuple(r)[3:] for r in catalogue.alias_coalesce_all(spark, str(tmp_path)).collect()}
    assert got == {
        0: ('{"text":"가?"}', '["글","둘"]', None, "local", "국어"), 1: ("나?", '{"body":"글"}', None, "local", "국어"), 2: ('["다?"]', "", '{"a":1}', "leet", "국어"), 3: ("라?", "[]", None, "local", "국어"),
    }


def test_aliases_against_a_plain_loop(spark, sf):
    def first(r, keys):
        return next((r[k] for k in keys if r.get(k) is not None and r[k] != "" and r[k] != [] and r[k] != {}), None)

    want = {}
    for x in spark.read.parquet(f"{sf}/local_raw.parquet").collect():
        try:
            r = json.loads(x.payload)
        except (TypeError, ValueError):
            continue
        if isinstance(r, dict) and (q := first(r, catalogue.LOCAL["question"])) is not None and not (isinstance(q, str) and not q.strip()):
            want[x.feed, x.file_no, x.line_no] = (q, first(r, catalogue.LOCAL["passage"]) or "")
    rows = catalogue.alias_coalesce_all(spark, sf).collect()
    plain = lambda v, s: json.loads(s) if isinstance(v, (dict, list)) else s
    got = {(r.feed, r.file_no, r.line_no): tuple(plain(v, s) for v, s in zip(want[r.feed, r.file_no, r.line_no], (r.question, r.passage))) for r in rows}
    assert got == want and any(isinstance(x, (dict, list)) for qp in want.values() for x in qp)


PAGE = "1. 다음 글을 읽고 물음에 답하시오.\n지문 내용입니다.\n윗글의 내용과 일치하는 것은?\n①첫째 ②둘째 ③셋째 ④넷째 ⑤다섯째\n- 3 -\n2. 홀로?"


def test_pages(spark):
    leet = "[지문 1]\n공통 글\n1. 하나?\n①가 ②나 ③다 ④라 ⑤마\n2. 둘?\n①가 ②나"
    teacher = "1. 고르면 옳은 것은\n①가 ②나 ③다 ④라\n\n남은 글"
    rows = [("pdf/csat/2024/t.pdf", 1, PAGE), ("pdf/leet/2024/t.pdf", 1, leet), ("pdf/teacher/2023/t.pdf", 1, teacher), ("pdf/csat/2024/t.pdf", 2, None), ("x.pdf", 1, "")]
    got = {(r.path, r.metadata.question_number): r for r in pages.items_of_pages(spark.createDataFrame(rows, "path string, page_no int, text string")).collect()}
    assert len(got) == 5
    a = got["pdf/csat/2024/t.pdf", 1]
    assert (a.passage, a.question, a.choices) == ("다음 글을 읽고 물음에 답하시오.\n지문 내용입니다.", "윗글의 내용과 일치하는 것은?", ["첫째", "둘째", "셋째", "넷째", "다섯째"])
    assert got["pdf/csat/2024/t.pdf", 2].choices is None
    assert got["pdf/leet/2024/t.pdf", 1].passage == got["pdf/leet/2024/t.pdf", 2].passage == "공통 글"
    assert got["pdf/leet/2024/t.pdf", 2].choices is None and got["pdf/leet/2024/t.pdf", 1].metadata.subject == "언어이해"
    t = got["pdf/teacher/2023/t.pdf", 1]
    assert (t.choices, t.metadata.exam_type, t.metadata.year) == (["가", "나", "다", "라"], "teacher", 2023)


def test_pages_go_on_over_page_breaks(spark):
    rows = [
        ("pdf/csat/a.pdf", 2, "②나 ③다\n- 2 -"), ("pdf/csat/a.pdf", 1, "머리\n1. 하나?\n첫 줄\n2. 둘은?\n①가\n- 1 -"), ("pdf/csat/a.pdf", 3, " \n3"), ("pdf/csat/a.pdf", 10, "④라 ⑤마\n3. 셋?\n4."), ("pdf/csat/a.pdf", 11, "넷?"),
        ("pdf/leet/a.pdf", 1, "앞\n[지문 1]\n글 하나"), ("pdf/leet/a.pdf", 2, "이어진 글\n1. 하나?"), ("pdf/leet/a.pdf", 3, "2. 둘?\n①가 ②나 ③다\n[지문 2]\n글 둘\n3. 셋?"), ("pdf/leet/b.pdf", 1, "앞\n1. 하나?"),
        (None, 1, "1. 하나?"), (None, 2, "뒤\n2. 둘?"),
    ]
    df = spark.createDataFrame(rows, "path string, page_no int, text string")
    got = {(r.path, r.metadata.question_number): r for r in pages.items_of_pages(df).collect()}
    a = {n: got["pdf/csat/a.pdf", n] for n in (1, 2, 3, 4)}
    assert a[2].choices == ["가", "나", "다", "라", "마"] and a[2].question == "둘은?" and a[4].question == "넷?"
    assert [(a[n].page_no, a[n].at) for n in (1, 2, 3, 4)] == [(1, 0), (1, 1), (10, 0), (10, 1)]
    assert {k: (r.passage, r.page_no, r.at) for k, r in got.items() if "leet" in (k[0] or "")} == {
        ("pdf/leet/a.pdf", 1): ("글 하나\n이어진 글", 2, 0), ("pdf/leet/a.pdf", 2): ("글 하나\n이어진 글", 3, 0), ("pdf/leet/a.pdf", 3): ("글 둘", 3, 1), ("pdf/leet/b.pdf", 1): ("", 1, 0),
    }
    assert got[None, 1].question == "하나?" and len(got) == 10
    assert "1. 하나?\n첫 줄\n" in {r.b for r in pages.file_blocks(df).collect()} and pages.items_of_pages(df.limit(0)).count() == 0


def test_decoding_takes_every_text(spark):
    texts = ["가나 다라", "é가é나 ☃", "Aé☂☂b x", "가나☄ 가나☄ ☄가", " \n", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    v = vocab.train(df.where("doc_id < 3"), 4 + 2 * (11172 + 94) + 2 * 1, chars=1)
    rows = {r.doc_id: r for r in catalogue.round_trip(df, v).collect()}
    assert len(rows) == len(texts) and all(r.want == r.back for r in rows.values())
    assert rows[0].back == "가나 다라" and "<unk>" in rows[2].back and "<unk>" in rows[3].back and rows[5].back == ""


def test_keep_first_is_stable(spark):
    df = spark.createDataFrame([(i, f" q{i % 3}\n") for i in range(20)], "id int, question string")
    once = quality.keep_first(df, T.strip("question"), "id")
    assert sorted(r.id for r in once.collect()) == [0, 1, 2]
    assert sorted(r.id for r in quality.keep_first(once, T.strip("question"), "id").collect()) == [0, 1, 2]


def test_pipeline_limit_and_alarm(spark):
    meta = ("csat", 2023, 11, 1, "국어", None, None)
    rows = [("", f"질문 {i} " + "가" * 60, None, None, None, meta, i) for i in range(10)]
    df = spark.createDataFrame(rows, records.ITEM + ", ord int")
    r = pipeline.run(df, "ord", max_items=3)
    assert one(r.totals).asDict() == {"total": 3, "saved": 3, "filtered": 0}
    assert r.records.count() == 3
    mixed = spark.createDataFrame([("", "english only", None, None, None, meta)] * 8 + [("", "한국어 질문", None, None, None, meta)], records.ITEM)
    assert one(quality.report(mixed, quality.is_valid_item())).alarm is True


def test_removed_sources_raise():
    with pytest.raises(ValueError):
        quality.refuse_removed(["a", "bad"], {"bad"}, {"a"})
    assert quality.refuse_removed(["a", "x"], set(), {"a"}) == (["a"], ["x"])


def test_noise_lines(spark):
    noise = [" 12 ", "2024학년도 대학수학능력시험 국어 홀수형", "대학수학능력시험 문제지 짝수형", "※ 이 문제지에 관한 저작권은", " - 3 - ", "제 1 교시", "제1교시", "성명 수험 번호", "성명\u3000수험번호"]
    text = ["저작권을 다룬 글이다.", "3/10", "-3", "1교시 종이 울렸다.", "대학수학능력시험", "", "12번"]
    df = spark.createDataFrame([("\n".join(x for pair in zip(noise, text + ["끝"] * 2) for x in pair),)], "t string")
    assert one(df.select(pages.without_noise("t").alias("x"))).x.split("\n") == text + ["끝"] * 2


def test_messages_under_either_key(spark):
    df = spark.createDataFrame([([("", "하나 "), (None, None), (" 둘", "셋")],)], "m array<struct<content:string,value:string>>")
    assert one(df.select(records.chat_text(F.col("m"), ("content", "value")).alias("t"))).t == "하나\n둘"


def test_health_asks_for_a_sure_first_piece(spark):
    df = spark.createDataFrame([(["가", "나", "다"], 0.5), (["가", "나", "다"], 0.02), (["가", "b", "c"], 0.9)], "p array<string>, top double")
    assert [r.verdict for r in vocab.health(df, "p", top="top").collect()] == ["coherent", "broken", "broken"]
    assert [r.verdict for r in vocab.health(df, "p").collect()] == ["coherent", "coherent", "broken"]


@pytest.mark.parametrize(("value", "want"), [("2", 2), ("[2]", 2), (" 3 ", 3), ("-1", -1), ("[-1]", None), ("<NA>", None), ("", None), (None, None), ("사", None)])
def test_civil_answers(spark, value, want):
    assert one(spark.createDataFrame([(value,)], "v string").select(records.civil_answer("v").alias("a"))).a == want
