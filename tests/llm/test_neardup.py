"""Pigeonring filtering against all pairs."""

import random

import numpy as np
import pytest

N = pytest.importorskip("moru.llm.neardup")


def similar(a, b):
    ga, gb = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (x for x in ("".join(c for c in s if c.isalnum()) for s in (a, b))))
    return len(ga & gb) / len(ga | gb) if ga | gb else 1.0


def edited(rng, words, vocab, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[rng.choice(vocab)], [], [out[i], rng.choice(vocab)]])
    return " ".join(out)


def corpus(seed, size=60, alphabet="가나다라마바사아자차"):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 4))) for _ in range(300)]
    rows = []
    for k in range(size // 4):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 25, 60]))]
        q = " ".join(rng.choice(vocab) for _ in range(6))
        for _ in range(4):
            rows.append((len(rows), edited(rng, base, vocab, rng.randint(0, max(1, len(base) // 8))), q if rng.random() < 0.8 else "다른 질문은 무엇인가"))
    return rows


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "가나다라마바사아자차"), (2, "abcdefghij"), (3, "가나다abc")])
def test_all_pairs(spark, seed, alphabet):
    rows = corpus(seed, alphabet=alphabet)
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if similar(a[1], b[1]) >= 0.7 and similar(a[2], b[2]) >= 0.5}
    got = {tuple(r) for r in N.near_pairs(spark.createDataFrame(rows, "item_id long, passage string, question string")).collect()}
    assert got - want == set()
    assert len(want & got) >= 0.99 * len(want) and len(want) > 10


def test_edges(spark):
    p = "강물은 흐르고 바람은 불며 들판은 푸르다. 오늘도 사람들은 길을 걷는다."
    rows = [(1, p, "무엇인가?"), (2, p, "무엇인가?"), (2, p, "무엇인가?"), (3, p, "전혀 다른 질문을 고르시오"), (4, None, "무엇인가?"), (5, " ", "무엇인가?"), (None, p, "무엇인가?"), (6, p + " ", None), (7, p, None), (8, "가", "나"), (9, "가", "나?"), (10, "가!", "나")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "item_id long, passage string, question string, pid string")
    assert {tuple(r) for r in N.near_pairs(df).collect()} == {(1, 2), (6, 7), (8, 9)}
    assert N.near_pairs(df.limit(0)).count() == 0


def test_hot_passage_and_segments(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARED", 8)
    monkeypatch.setattr(N, "QUESTIONS", 8)
    rng = random.Random(5)
    common = "모든 글의 앞에 붙어 있는 똑같은 안내문은 길고도 길어서 누구나 외울 수 있다 "
    rows = corpus(7)
    rows = [(i, common + p, q) for i, p, q in rows]
    hot = "한 지문에 아주 많은 질문이 붙는다 그래서 지문이 같은 문항이 많다 참으로 많다"
    rows += [(1000 + k, hot, " ".join(rng.choice("가나다라마바사") * 3 for _ in range(4)) + str(k % 20)) for k in range(60)]
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if similar(a[1], b[1]) >= 0.7 and similar(a[2], b[2]) >= 0.5}
    got = {tuple(r) for r in N.near_pairs(spark.createDataFrame(rows, "item_id long, passage string, question string")).collect()}
    assert got == want


def test_ring_prunes_nothing_within_the_budget():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 60, 120, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.85], rng.integers(0, 1 << 60, 15, dtype=np.uint64)])
        far = len(np.setxor1d(a, b))
        x, y = N.ring_words(N.mixed(a))[None], N.ring_words(N.mixed(b))[None]
        assert N.on_ring(x, y, np.array([far]))[0]


def test_edits_all_over_a_long_text(spark):
    import random

    draw = random.Random(5)
    a = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900))
    b = "".join("Q" if i % 30 == 15 else c for i, c in enumerate(a))
    texts = spark.createDataFrame([(1, a), (2, b), (3, a[::-1])], "pid long, text string")
    assert [tuple(r) for r in N.passage_pairs(texts, 0.7).collect()] == [(1, 2)]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "".join(chr(0xAC00 + 13 * i) for i in range(800))])
def test_recall_at_every_similarity(spark, letters):
    """Edits at regular steps, insertions and moved blocks: of each band of similarity at least 99 in 100 pairs are found."""
    draw, rows, want = random.Random(11), [], {}
    for k in range(1200):
        a = [draw.choice(letters) for _ in range(400)]
        b, step = list(a), draw.randint(16, 80)
        for i in range(draw.randrange(step), len(b), step):
            b[i] = draw.choice(letters) if k % 3 else b[i] + draw.choice(letters)
        if k % 5 == 0:
            b = b[200:] + b[:200]
        a, b = "".join(a), "".join(b)
        rows += [(2 * k, a), (2 * k + 1, b)]
        if (s := similar(a, b)) >= 0.7:
            want[2 * k, 2 * k + 1] = s
    got = {tuple(r) for r in N.passage_pairs(spark.createDataFrame(rows, "pid long, text string"), 0.7).collect()}
    assert got <= set(want)
    for low in (0.7, 0.75, 0.8, 0.85, 0.9):
        band = [p for p, s in want.items() if low <= s < low + 0.05]
        assert len(band) > 30 and sum(p in got for p in band) >= 0.99 * len(band), low


def test_hot_group_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARED", 2)
    draw = random.Random(3)
    base = [draw.choice("가나다라마바사아자차카타파하") for _ in range(200)]
    rows = []
    for k in range(90):
        t = list(base)
        for _ in range(3):
            t[draw.randrange(200)] = draw.choice("xyz")
        rows.append((k, "".join(t)))
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t and similar(s, t) >= 0.7}
    got = {tuple(r) for r in N.passage_pairs(spark.createDataFrame(rows, "pid long, text string"), 0.7).collect()}
    assert want == {p for p in got if rows[p[0]][1] != rows[p[1]][1]} and len(want) > 3500


def test_classes(spark):
    p, near = "강물은 흐르고 바람은 불며 들판은 푸르다. 오늘도 사람들은 길을 걷는다.", "강물은 흐르고 바람은 불며 들판은 푸르다. 오늘도 아이들은 길을 걷는다."
    rows = [(i, p, "무엇인가?") for i in range(50)] + [(100, near, "무엇인가?"), (101, near, "전혀 다른 것을 묻는다"), (102, "아주 다른 글이다 그래서 닮지 않았다", None), (103, None, "x"), (None, p, "무엇인가?")]
    df = spark.createDataFrame(rows + rows[:3], "item_id long, passage string, question string")
    got = {r.item_id: (r.class_id, r.links) for r in N.near_classes(df).collect()}
    assert got == {i: (0, 50) for i in range(50)} | {100: (100, 50), 101: (101, 0), 102: (102, 0)}
    assert N.near_classes(df.limit(0)).count() == 0
