"""Held-out texts in documents."""

import pytest

L = pytest.importorskip("moru.llm.leakage")
S = [
    "아노루 산성의 강물은 바람을 살피는 과정에서 들판의 깊이를 바꾼다.", "그러나 미다코 학파에 남은 촉매는 여론을 감추는 대신 지도의 폭을 넓힌다.",
    "이후 라소추 강의 독점은 위성으로 말미암아 화폐의 기준을 제한한다.", "빈노루 효과에서 곤충은 장단을 넘어서 암석의 전통을 새로 정한다.",
]
ASK = "근육이 나코카 마을 밖으로 퍼지면서 꿈의 효과가 달라진 이유는 무엇인가?"
ITEMS = [(1, " ".join(S), ASK), (2, " ".join(S), "윗글의 서술 방식을 알맞게 말한 것은?"), (3, "Another text is here. It has two sentences of its own.", "윗글의 서술 방식을 알맞게 말한 것은?"), (4, None, None), (None, S[0], "x")]
DOCS = [
    (0, "앞글. " + S[1] + "\n" + S[2] + " 뒷글.", {1, 2}), (1, S[1].replace(" ", "") + S[2].upper().replace("지도", "지도"), {1, 2}), (2, S[1] + " 다른 문장이 사이에 꽤 길게 끼어들어 있어서 이어지지 않는다. " + S[2], set()), (3, S[1], set()),
    (4, S[1] + " " + S[2][:20], set()), (5, S[0].replace("들판의", "기차를") + " " + S[1].replace("촉매는", "문장을"), {1, 2}), (6, "질문: " + ASK.replace(" ", "\n") + " 답변", {1}), (7, ASK[:-12], set()), (8, "윗글의 서술 방식을 알맞게 말한 것은?", set()),
    (9, S[2] + " " + S[1], set()), (10, None, set()), (11, "", set()), (12, "ANOTHER text is hеre. It has two\nsentences of its own", {3}), (13, "x " * 20_000 + S[0] + " " + S[1], {1, 2}),
]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in DOCS], "doc_id long, text string, item_id int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, passage string, question string")


def test_leaks(tables):
    docs, items = tables
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == {(i, k) for i, _, w in DOCS for k in w}
    assert L.leaks(docs.limit(0), items).count() == L.leaks(docs, items.limit(0)).count() == 0


def test_blocks_give_the_same(tables, monkeypatch):
    docs, items = tables
    want = {tuple(r) for r in L.leaks(docs, items).collect()}
    monkeypatch.setattr(L, "BLOCK_LETTERS", 10)
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == want


def test_stock_wordings_of_other_items(tables, spark):
    docs, items = tables
    others = spark.createDataFrame([(100 + i, f"지문 {i}", ASK) for i in range(9)], "item_id long, passage string, question string")
    assert (6, 1) not in {tuple(r) for r in L.leaks(docs, items, others).collect()}


def test_cleaned(tables):
    docs, items = tables
    got = {r.doc_id: r for r in L.cleaned(docs, items).collect()}
    assert 0 not in got  # of 70 letters 4 are left
    assert got[3].text == S[1] and got[10].text is None
    assert 12 not in got and got[13].cut_letters > 0 and S[0] not in got[13].text


def test_blocks_clean_the_same(tables, monkeypatch):
    docs, items = tables
    want = {tuple(r) for r in L.cleaned(docs, items).collect()}
    monkeypatch.setattr(L, "BLOCK_LETTERS", 10)
    assert {tuple(r) for r in L.cleaned(docs, items).collect()} == want


def test_sentences():
    cut = [*map(L.letters, ["Dr. Kim went to No. 5 with J. Smith.", "He ran. ", "왜?"])]
    assert L.sentences("Dr. Kim went to No. 5 with J. Smith. He ran. 왜?") == cut
    assert L.sentences("들판의 깊이를 바꾼다.그러나 3.5배는 아니다. “왜?” 그는 물었다.") == [*map(L.letters, ["들판의 깊이를 바꾼다", "그러나 3.5배는 아니다", "왜", "그는 물었다"])]


@pytest.mark.parametrize("seed", range(3))
def test_sentences_of_every_length(spark, seed):
    """Against a plain search: documents with two consecutive sentences of 1 to 60 letters, or with one of them alone."""
    import random

    draw = random.Random(seed)
    letters = "가나다라마바사아자차카타파하거너더러머버서어저처" if seed < 2 else "abcdefghijklmnopqrstuvwxyz"

    def sentence():
        left, words = draw.randint(1, 60), []
        while left > 0:
            words.append("".join(draw.choice(letters) for _ in range(min(left, draw.randint(1, 6)))))
            left -= len(words[-1])
        return " ".join(words) + "."

    items = [(i, [sentence() for _ in range(5)]) for i in range(40)]
    docs = []
    for k in range(300):
        i, ss = draw.choice(items)
        at = draw.randrange(4)
        docs.append((k, " ".join([sentence(), *(ss[at : at + 2] if k % 3 else ss[at : at + 1]), sentence()])))
    plain = lambda t: L.letters(t)
    want = {(k, i) for k, t in docs for i, ss in items for a, b in zip(ss, ss[1:]) if plain(a + b) in plain(t)}
    got = {tuple(r) for r in L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(ss), None) for i, ss in items], "item_id long, passage string, question string")).collect()}
    assert want <= got and len(want) > 190
    # beyond exact pairs only pairs with a replaced word: one sentence whole, the other short of a few letters
    assert len(got - want) <= 0.02 * len(docs)
