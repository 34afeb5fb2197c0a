"""Texts that look the same."""

import unicodedata
from itertools import combinations

import pytest

lookalike = pytest.importorskip("moru.llm.lookalike")
L = lookalike

GROUPS = [
    ["NAPO 도시", "ΝΑΡΟ 도시", "NАPО 도시", "ＮＡＰＯ　도시", "NA​PO 도시", unicodedata.normalize("NFD", "NAPO 도시")],
    ["Lorénat", "Lorénat", "Lоrénаt", "Ｌｏｒｅ́ｎａｔ"],
    ["金屬", "金屬"],
    ["Салмор", "Cалмop"],
    ["KEM", "KEM"],
    ["ﬁn a‑b", "fin a-b"],
]
APART = ["Lorenat", "m²", "m2", "½", "1/2", "①", "1", "Señova", "Senova", "Σ", "S", "a b", "ab", "a\nb", "Салмон", "ㄱ", "가"]


@pytest.fixture
def table(spark):
    texts = [t for g in GROUPS for t in g] + APART + [None, "", " ​", "　", "NAPO 도시"]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, canonical string")


def test_pairs_are_the_groups(table):
    texts, df = table
    want = set()
    for g in GROUPS:
        ids = [i for i, t in enumerate(texts) if t in g]
        want |= {(a, b) for a, b in combinations(ids, 2) if texts[a] != texts[b]}
    assert {tuple(r) for r in L.lookalike_pairs(df).collect()} == want


def test_canonical_form(table, spark):
    texts, df = table
    rows = L.canonical_texts(df).collect()
    got = {r.doc_id: r.canonical for r in rows}
    assert len(got) == len(rows) == len(texts)
    canonical = {t: got[i] for i, t in enumerate(texts)}
    form = {texts[r.doc_id]: r.form for r in rows}
    for g in GROUPS:
        assert len({form[t] for t in g}) == 1
    assert canonical["Cалмop"] == canonical["Салмор"] == "Салмор" and canonical["NАPО 도시"] == "NAPO 도시"
    assert canonical["ΝΑΡΟ 도시"] == "ΝΑΡΟ 도시" and form["ΝΑΡΟ 도시"] == form["NAPO 도시"]  # one script, so its own word
    assert len({form[t] for t in APART}) == len(APART)
    again = spark.createDataFrame(list(got.items()), "doc_id long, text string")
    assert {r.doc_id: r.canonical for r in L.canonical_texts(again).collect()} == got
    assert form[None] is None and L.canonical_texts(df.limit(0)).count() == L.lookalike_pairs(df.limit(0)).count() == 0


def test_null_ids_are_in_no_pair(spark):
    df = spark.createDataFrame([(None, "ab c"), (None, "ab c"), (1, "x" * 50_000 + "​"), (2, "x" * 50_000), (2, "x" * 50_000)], "doc_id long, text string")
    assert [tuple(r) for r in L.lookalike_pairs(df).collect()] == [(1, 2)]


def test_only_tokens_of_mixed_scripts_are_repaired(spark):
    texts = ["выбросить сор из избы", *["a cop and a cop"] * 5, "the paper, an alpha", "ραper", "αlpha", "Ρаper", "wоnk", "сорt", "օne", "one ՏԼ"]
    got = [r.canonical for r in L.canonical_texts(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == texts[0] and got[7:] == ["paper", "alpha", "Paper", "wоnk", "сорt", "one", "one ՏԼ"]
    assert L.spellings("cалмop") == ["салмор"] and L.spellings("paper") == L.spellings("сор") == [] and L.spellings("Жz") == []
