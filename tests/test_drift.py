"""Schema drift on a small feed and against a plain count."""

import json
import random

from pyspark.sql import functions as F

from moru.operators import schema_drift as D

SCHEMA = "feed string, file_no int, line_no int, payload string, file_no2 int"


def feed(spark, *files, name="f", extra=()):
    rows = [(name, i + 1, k, json.dumps(r, ensure_ascii=False) if not isinstance(r, str) else r, 0) for i, f in enumerate(files) for k, r in enumerate(f)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def test_changes(spark):
    df = feed(
        spark,
        [{"question": "가?", "정답": "1", "배점": 2}, {"question": "나?", "정답": None, "배점": 3}, "broken {", '["list"]', {"question": "나?", "정답": "2", "배점": 3}],
        [{"문제": "가?", "정답": 1, "메모": "m"}],
        [{"문제": {"text": "가?"}, "정답": 2, "메모": None}],
        extra=[(None, 1, 1, "{}", 0), ("f", None, 1, '{"a": 1}', 0), ("f", 9, 1, None, 0), ("g", 2, 1, '{"a": 1}', 0)],
    )
    got = {tuple(r) for r in D.changes(df).collect()}
    assert got == {
        ("f", 2, "renamed", "question", "문제"), ("f", 2, "retyped", "정답", "정답"), ("f", 2, "removed", "배점", ""), ("f", 2, "added", "", "메모"),
        ("f", 3, "retyped", "문제", "문제"), ("f", 3, "removed", "메모", ""),
    }


def test_unknown_names_go_by_content(spark):
    text = "강물은 흐른다. 바람은 분다. 그래서 들판은 늘 푸르게 보인다."
    df = feed(spark, [{"passage": text, "year": "2020년"}] * 3, [{"읽을거리": text, "치른해": 2021}] * 3)
    assert {tuple(r)[2:] for r in D.changes(df).collect()} == {("renamed", "passage", "읽을거리"), ("renamed", "year", "치른해"), ("retyped", "year", "치른해")}


def test_consistent_table(spark):
    df = feed(spark, [{"문제 내용": {"text": "가?"}, "gold": "[2]", "연도": "2020년", "지문": ["a", "b"], "options": {"1": "x", "2": "y"}, "태그": ["t"]}, {"q": "나?", "ans": "<NA>", "choices": "x\ny"}, "bad"])
    rows = D.consistent(df).orderBy("line_no").collect()
    a, b, c = rows
    assert (a.question, a.answer, a.year, a.passage, a.passage_parts, a.choices, json.loads(a.extra)) == ("가?", 2, 2020, "a\nb", ["a", "b"], ["x", "y"], {"태그": ["t"]})
    assert {(r.field, r.type) for r in a.branches} == {("question", "object"), ("passage", "array"), ("choices", "object"), ("answer", "string"), ("year", "string")}
    assert (b.question, b.answer, b.answer_text, b.choices, b.choices_text) == ("나?", None, "<NA>", ["x", "y"], "x\ny")
    assert (c.readable, c.question) == (False, None)
    assert D.consistent(df.limit(0)).count() == D.changes(df.limit(0)).count() == 0


def test_consistent_table_loses_no_key(spark):
    text = "강물은 흐른다. 바람은 분다. 그래서 들판은 늘 푸르게 보인다."
    df = feed(
        spark,
        [{"QUESTION": "가?", "exam-type": "leet", "Question Text": "둘째?", "년 도": "2019/2020", "선지": 3}, {"question": "나?", "문제": "다?", "정답": None, "ANSWER": "[3]", "answer no": {"a": 1}}],
        [{"읽을거리": text, "치른해": 2021, "모름": 1}, {"읽을거리": text, "passage": "본디 글", "치른해": "2022년"}],
        extra=[(None, 1, 7, json.dumps({"question": "라?", "읽을거리": text}), 0)],
    )
    a, b, c, d, e = D.consistent(df).orderBy(F.col("feed").isNull(), "file_no", "line_no").collect()
    assert (a.question, a.exam_type, a.year, a.choices, json.loads(a.extra)) == ("가?", "leet", None, None, {"Question Text": "둘째?", "년 도": "2019/2020", "선지": 3})
    assert (b.question, b.answer, json.loads(b.extra)) == ("나?", 3, {"문제": "다?", "answer no": {"a": 1}})
    assert (c.passage, c.year, json.loads(c.extra)) == (text, 2021, {"모름": 1})
    assert (d.passage, d.year, json.loads(d.extra)) == ("본디 글", 2022, {"읽을거리": text})
    assert (e.question, e.passage, e.extra) == ("라?", text, "{}")


def test_alternatives(spark):
    df = feed(spark, [{"a": 1, "o": {"x": [1, {"y": None}]}}], [{"a": 1}, {"a": "x", "o": {"x": ["z"]}}], [{"a": True}, {"a": "y"}])
    assert {(r.file_no, r.path, r.type, r.n) for r in D.alternatives(df).collect()} == {
        (1, "a", "number", 1), (2, "a", "string", 1), (3, "a", "boolean", 1), (1, "o", "object", 1), (1, "o.x", "array", 1), (1, "o.x[]", "number", 1), (1, "o.x[]", "object", 1), (2, "o.x[]", "string", 1),
    }
    assert {tuple(r)[1:] for r in D.report(df).where("change = 'alternative'").collect()} == {(2, "alternative", "a", "string"), (3, "alternative", "a", "boolean"), (2, "alternative", "o.x[]", "string")}


def test_a_key_beside_a_field_is_no_other_name_of_it(spark):
    df = feed(spark, [{"정답": "3번", "점": "2번"}] * 3, [{"q": "가?", "점": "2번"}] * 3)
    assert {(r.file_no, r.key, r.field) for r in D.file_schemas(df).collect()} == {(1, "정답", "answer"), (1, "점", "점"), (2, "q", "question"), (2, "점", "점")}


def leaves(v):
    if isinstance(v, dict):
        return [x for w in v.values() for x in leaves(w)]
    return [x for w in v for x in leaves(w)] if isinstance(v, list) else [] if v is None else [v]


def test_every_leaf_is_kept(spark):
    """Of random payloads every non-null leaf is in a column or in ``extra``."""
    draw, rows = random.Random(4), []
    keys = [k for ks in D.ALIASES.values() for k in ks] + ["QUESTION", "exam-type", "모름", "읽을거리", "metadata"]
    serial = iter(range(10_000, 10**6))

    def value(depth=0):
        kind = draw.randrange(9 if depth < 3 else 4)
        if kind < 4:
            return [f"글{next(serial)}", next(serial), None, f"{next(serial)}번"][kind]
        if kind < 6:
            return [value(depth + 1) for _ in range(draw.randrange(4))]
        return {k: value(depth + 1) for k in draw.sample(["text", "body", "lang", "A", "B"], draw.randrange(4))}

    for i in range(400):
        rows.append(("f", i // 20, i, json.dumps({k: value() for k in draw.sample(keys, 7)}, ensure_ascii=False), 0))
    for r, raw in zip(D.consistent(spark.createDataFrame(rows, SCHEMA)).orderBy("line_no").collect(), rows):
        held = json.dumps({k: v for k, v in r.asDict().items() if k != "branches"}, ensure_ascii=False)
        lost = [x for x in leaves(json.loads(raw[3])) if str(x).removesuffix("번") not in held]
        assert not lost, (raw[3], held)
