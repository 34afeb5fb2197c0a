"""Noise of scanned pages."""

import pytest

S = pytest.importorskip("moru.llm.scans")
WORDS = "바람은 강물과 함께 들판의 깊이를 바꾼다 그러나 오늘날 사람은 길을 걸으며 노래를 부른다 먼 산에는 눈이 내리고 마을의 아이들은 웃는다 시장에서 곡식을 팔고 저녁에는 등불을 켠다".split()
NAMES = [a + b + c for a in "노바산" for b in "산노바" for c in "바노산"]
HEAD = "2023학년도 다올 모의평가 국어"


@pytest.fixture(scope="module")
def tables(spark):
    clean = [(i, " ".join(WORDS[(i + k) % len(WORDS)] for k in range(20)) + f" {NAMES[i % 27]} 섬 the river follows the market", "무엇인가", ("x.jsonl",)) for i in range(400)]
    a = "바람은 강물과 함께"
    rows = [
        (1000, f"{a} 들판의 깊-\n이를 바꾼다.", None), (1001, f"{a} 들판와 깊이를 바꾼다.", "무엇인가"), (1002, f"{a}\n- 3 -\n{HEAD}  (홀수형)\n들판의 깊이를 바꾼다.", None), (1003, f"{a}\n{HEAD}   12\n들판의 깊이를", None),
        (1004, f"{a} 들판의\n깊이를 바꾼다.", None), (1005, f"{a} 바노산노 섬 길을 걸으며", None), (1006, f"{a} 들판의 깊o|를 바꾼다.", None), (1007, f"{a} 들�의 깊이를", None), (1008, f"{a} ㄱㅣㅍ이를", None), (1009, "tbe river fol1ows the rnarket", None),
        (1010, None, None), (1011, "", " "), (1012, f"1\n{a}\n2\n{a}\n3\n{a}", None), (1013, f"{a} 그러¬\n2 / 9\n나 오늘날", None), (1013, f"{a} 그러¬\n2 / 9\n나 오늘날", None), (1014, f"{a} " * 3000 + "들판외", None),
    ]
    items = clean + [(i, p, q, ("pdf/a.PDF",)) for i, p, q in rows] + [(2000, "들판외 깊-\n이를", None, (None,))]
    df = spark.createDataFrame(items, "item_id long, passage string, question string, metadata struct<source_file:string>")
    pages = spark.createDataFrame([("pdf/a.PDF", i, f"{HEAD}\n글 {i}\n- {i} -") for i in range(8)] + [("pdf/a.PDF", 9, None), (None, 1, "x")], "source_file string, page_no int, text string")
    return df, pages


def test_noise(tables):
    df, pages = tables
    got = {tuple(r) for r in S.noise(df, pages).collect()}
    assert got == {
        (1000, "passage", "hyphen"), (1001, "passage", "misread"), (1002, "passage", "header"), (1002, "passage", "pageno"), (1003, "passage", "header"), (1003, "passage", "pageno"), (1006, "passage", "misread"), (1007, "passage", "misread"),
        (1008, "passage", "misread"), (1009, "passage", "misread"), (1013, "passage", "hyphen"), (1013, "passage", "pageno"), (1014, "passage", "misread"),
    }
    assert S.noise(df.limit(0), pages).count() == 0
    assert (1002, "passage", "pageno") in {tuple(r) for r in S.noise(df, pages.limit(0)).collect()}


def test_repair(tables):
    df, pages = tables
    got = {r.item_id: r.passage for r in S.repaired(df, pages).where("item_id < 1013").collect()}
    whole = "바람은 강물과 함께 들판의 깊이를 바꾼다."
    assert {got[i] for i in (1000, 1001, 1002, 1004, 1006)} == {whole}
    assert got[1007] == whole[:-5] and got[1009] == "the river follows the market" and 1010 not in got and got[1011] == ""


def test_every_word_counts(spark):
    words = [f"w{i}" for i in range(100_010)]
    rows = [(i, " ".join(words), None, ("x.jsonl",)) for i in range(5)] + [(9, "쀓" * 50 + " 드문말", None, ("x.jsonl",))]
    model = S.model_of(spark.createDataFrame(rows, "item_id long, passage string, question string, metadata struct<source_file:string>"))
    assert len(model.words) == 100_010 and model.total == 5 * 100_010 + 2
    assert model.letters["쀓"] == 50 and model.letters["드"] == 1


def test_hyphens_and_tables():
    model = S.Model({"well": 9, "known": 9, "wellknit": 9, "깊이를": 9, "long": 9, "term": 9}, 100, {})
    assert S.divided("a well-", "known b", model) == "a well-known b" and S.divided("well-", "knit", model) == "wellknit"
    assert S.divided("깊-", "이를", model) == "깊이를" and S.divided("un-", "seen", model) == "unseen"
    assert S.furniture(["값", "12", "3.5 | 8", "글"], []) == [set()] * 4
    assert S.furniture(["글", "12", "글"], []) == [set(), {"pageno"}, set()]


def test_confusions_are_learned(spark):
    """A confusion that no prior favours is corrected once the scanned texts show it in several words; names aren't."""
    words = [a + b for a in "강산들물길밤빛숲섬별" for b in "까투"]
    clean = [(i, " ".join(words[(i + k) % 20] for k in range(20)) + f" {NAMES[i % 27]}", None, ("x.jsonl",)) for i in range(400)]
    scans = [(1000 + i, f"{words[i % 20]} {words[(i + 1) % 20].replace('까', '뵤')} {words[(i + 4) % 20]} {NAMES[i % 27]}", None, ("a.pdf",)) for i in range(200)]
    df = spark.createDataFrame(clean + scans, "item_id long, passage string, question string, metadata struct<source_file:string>")
    pages = spark.createDataFrame([], "source_file string, page_no int, text string")
    assert {r.item_id for r in S.noise(df, pages).collect()} == {i for i, p, _, _ in scans if "뵤" in p}
    assert all("뵤" not in r.passage for r in S.repaired(df, pages).collect())
