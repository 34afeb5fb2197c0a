"""Defects of question-response pairs."""

import random
import time

import pytest

P = pytest.importorskip("moru.llm.pairs")
Q = "이 글의 중심 생각을 가장 잘 간추린 것은?"
C = ["강물의 흐름", "바람과 들판", "사람의 길", "오늘의 빛", "내일의 꿈"]
GOOD = "강물은 바람과 함께 흐른다. 그래서 들판은 푸르다."
CASES = [
    (Q, None, None, None, "empty"), (Q, C, 0, " ", "empty"), (Q, C, 6, "해설 없음", "empty"), (Q, ["​"] * 5, 2, "-", "empty"), (Q, None, None, "&nbsp;", "empty"), (Q, C, None, "N/A", "empty"),
    (Q, C, 3, None, None), (Q, C, 3, "해설:", None), (Q, None, None, "정답 ④", None), (Q, C, 2, "답: ② (바람)", None),
    (Q, C, 1, GOOD, None), (Q, C, 1, GOOD[:-1], None), (Q, C, 1, GOOD + " 그러므로 ①이 적절함", None), (Q, C, 1, "강물은 바람과 함께 흐른다. 그래서 들판은", "truncated"), (Q, C, 1, "강물은 바람과 함께 흐른다. 그래서 책임", "truncated"),
    (Q, C, 1, "강물은 흐른다. 들판은…", "truncated"), (Q, C, 1, "강물은 흐른다. (들판은 푸르다.", "truncated"), (Q, C, 1, '강물은 "흐른다.', "truncated"), (Q, C, 1, "다음과 같다.\n- 강물의 깊이\n- 들판의 넓이", None),
    ("Choose the word that fits the blank.", C, 1, "The hidden river follows the", "truncated"), ("Choose the word that fits the blank.", C, 1, "The hidden river follows the market.", None),
    (Q, C, 1, Q, "copied"), (Q, C, 1, f"문제: {Q}", "copied"), (Q, C, 1, f"{Q}\n{Q}", "copied"), (Q, C, 1, Q.replace("것은?", "것은 무엇인가요?"), "copied"), (Q, C, 1, Q + "\n" + "\n".join(f"{m} {c}" for m, c in zip("①②③④⑤", C)), "copied"), (Q, C, 1, f"{Q} {GOOD}", None),
    (Q, C, 1, "죄송하지만 이 문항에 대한 답변을 드릴 수 없습니다.", "refusal"), (Q, C, 1, "저로서는 답을 골라 드리기가 곤란합니다. 다른 질문을 해 주세요.", "refusal"), (Q, C, 1, "이 물음에는 응하지 않겠습니다.", "refusal"), (Q, C, 1, "I'm sorry, but I cannot answer this question.", "refusal"),
    (Q, C, 1, "'미안하지만 도와줄 수 없네.'라는 인물의 말은 강물의 방향을 드러낸다.", None), (Q, C, 1, "죄송하다는 답장은 강물을 거절하는 화자의 태도를 보여 준다.", None), (Q, C, 1, "글쓴이는 강물을 함부로 말할 수 없다고 본다.", None),
    (Q, C, 1, "The hidden river follows the market because a bridge limits it.", "wrong_language"), (Q, C, 1, "窗户与地图之间的联系，通过实验改变了流动的方向。", "wrong_language"), (Q, C, 1, "窓と信号の関係は、制度を通して波の意味を示す。", "wrong_language"),
    (Q, C, 1, 'The hidden river follows the market (정답 ④).', "wrong_language"), (Q, C, 1, GOOD + ' 영어 표현 "The hidden river follows the market although a bridge limits it." 역시 같은 뜻을 나타낸다.', None), ("Which statement does the author reject?", C, 1, GOOD, "wrong_language"),
    (None, C, 1, GOOD, None), ("", None, None, GOOD, None),
]


@pytest.mark.parametrize(("q", "c", "a", "x", "want"), CASES)
def test_case(q, c, a, x, want):
    assert P.defect(q, c, a, x) == want


def test_operator(spark):
    rows = [(i, q, c, a, x, "extra") for i, (q, c, a, x, _) in enumerate(CASES)] + [(0, *CASES[0][:4], "again"), (None, Q, C, 1, Q, "null id"), (999, Q, C, 1, GOOD * 5000 + " 들판은", "long")]
    df = spark.createDataFrame(rows, "item_id long, question string, choices array<string>, answer int, explanation string, defect string")
    got = {(r.item_id, r.defect) for r in P.defects(df).collect()}
    assert got == {(i, w) for i, (*_, w) in enumerate(CASES) if w} | {(None, "copied"), (999, "truncated")}
    assert P.defects(df).count() == len(got) and P.defects(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "이 인물은 도와 달라는 요청을 거절합니다.", "저는 이 글이 이해하기 어렵습니다라고 쓴 학생의 반응은 적절하다.", "I'm sorry for the farmer, because the rain destroyed his field.", "구간 [0, 1)에서 함수는 증가한다.",
        "높이는 5' 10\"이다.", "좌표는 (-1, 3)이고 구간은 (a, b]이다.", "식은 $$x = (1$$ 로 쓴다고 보면 된다.", "코드는 ```print('(')``` 와 같다.", "1. 앞의 말은 옳다.\n2. 뒤의 말은 그르다.",
    ],
)
def test_sound(text):
    assert P.defect("What does the writer say of the farmer?" if text.isascii() and "farmer" in text else "다음 중 알맞은 것을 고르시오.", ["가", "나"], 1, text) is None


@pytest.mark.parametrize("text", ["앞의 말은 (옳다고 볼 수 있다.", "그는 \"맞다고 말했다.", "코드는 ```print(1) 이다.", "식은 $$x = 1 이다.", "까닭은 이렇다.\n1. 앞의 말은 옳다.\n2.", "그 뜻은 <b>이렇다.", "「봄의 노래를 보면 알 수 있다."])
def test_left_open(text):
    assert P.defect("다음 중 알맞은 것을 고르시오.", ["가", "나"], 1, text) == "truncated"


@pytest.mark.parametrize("text", ["죄송하지만 이 문제의 풀이는 제공해 드릴 수 없습니다.", "I'm sorry, but I can't help with that.", "I am unable to answer this question.", "저는 이 질문에 답변을 드릴 수 없습니다."])
def test_declined(text):
    assert P.defect("What is the main idea?" if text.isascii() else "중심 생각은 무엇인가?", ["가", "나"], 1, text) == "refusal"


def slow_tiling(text, sources, least=4):
    """By rounds over all common stretches, the longest first, with marks on the text."""
    marks = [False] * len(text)
    while True:
        best = (0, 0)
        for i in range(len(text)):
            for s in sources:
                for j in range(len(s)):
                    n = 0
                    while i + n < len(text) and j + n < len(s) and not marks[i + n] and text[i + n] == s[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i)
        if best[0] < least:
            return "".join(c for c, m in zip(text, marks) if not m)
        marks[best[1] : best[1] + best[0]] = [True] * best[0]


def test_tiles_as_by_rounds():
    draw = random.Random(2)
    for _ in range(150):
        text, sources = "".join(draw.choice("abc") for _ in range(draw.randrange(30))), ["".join(draw.choice("abc") for _ in range(draw.randrange(1, 25))) for _ in range(2)]
        assert P.tile(text, sources)[0] == slow_tiling(text, sources)


def test_tiling_of_equal_signs_is_quick():
    start = time.time()
    rest, covered = P.tile("가" * 20_000, ["가" * 20_000])
    assert rest == "" and all(covered) and time.time() - start < 2
