"""Encoding against a public library; mixing against its own arithmetic."""

import base64

import pytest

bpe = pytest.importorskip("moru.llm.bpe")
tiktoken = pytest.importorskip("tiktoken")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from moru.llm import mixing  # noqa: E402

RANKS = bpe.read_ranks(bpe.rank_bytes())
OURS = bpe.RankBPE(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.count(text) == len(OURS.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde  가나", min_size=1, max_size=60))
def test_both_mergers_agree(text):
    word = text.encode()
    assert bpe.merge_short(word, RANKS) == bpe.merge_long(word, RANKS)


@pytest.mark.parametrize("text", ["가" * 5000, "a" * 20_000, "ab" * 3000, " " * 500 + "x", "<|endoftext|>", "\n\n\t", "한국어 text 世界 🙂"])
def test_long_and_odd_texts(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    back = {v: k for k, v in RANKS.items()}
    assert b"".join(back[i] for i in ids).decode() == text


def test_documents(spark):
    rows = [(1, "안녕 world", "x"), (2, "", "y"), (3, None, "z"), (None, "a", None), (1, "안녕 world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()]
    assert sorted(got, key=str) == sorted([(1, THEIRS.encode_ordinary("안녕 world"))] * 2 + [(2, []), (3, []), (None, THEIRS.encode_ordinary("a"))], key=str)
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert base64.b64decode("YQ==") in RANKS


def docs(spark):
    rows = [(i, "word " * (1 + i % 7), "a" if i % 3 else "b", 0) for i in range(900)] + [(1000, None, "a", 0), (1001, "x", "other", 0), (1002, "x", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


def test_shares(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs(spark), targets)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"a", "b", "none"}
    assert got["none"].used_tokens == 0
    assert abs(got["a"].actual_share - 5 / 9) < 0.005 and abs(got["b"].actual_share - 4 / 9) < 0.005
    rows = chosen.collect()
    assert all(1 <= r.copies <= (1 if r.source == "a" else 3) for r in rows)
    assert {s: sum(r.n_tokens * r.copies for r in rows if r.source == s) for s in "ab"} == {s: got[s].used_tokens for s in "ab"}
    assert len({r.doc_id for r in rows}) == len(rows)


def test_budgets_are_nested_and_capped(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    small = {(r.doc_id) for r in mixing.mix(docs(spark), targets, 500)[0].collect()}
    large = {(r.doc_id) for r in mixing.mix(docs(spark), targets, 1500)[0].collect()}
    assert small < large
    over = {r.source: r for r in mixing.mix(docs(spark), targets, 10**9)[1].collect()}
    assert all(r.used_tokens == r.available_tokens for r in over.values())
    empty = mixing.mix(docs(spark).limit(0), targets)
    assert empty[0].count() == 0 and {r.actual_share for r in empty[1].collect()} == {0.0}


def test_scarce_sources_may_be_given_up():
    targets = [("a", 0.6, 1), ("b", 0.35, 2), ("c", 0.05, 1)]
    tokens = {"a": 6000, "b": 3500, "c": 5}
    assert sum(s.budget for s in mixing.budgets(targets, tokens)) == pytest.approx(100)
    relaxed = {s.source: s.budget for s in mixing.budgets(targets, tokens, give_up=0.05)}
    assert relaxed == pytest.approx({"a": 6000, "b": 3500, "c": 5})
    assert mixing.budgets(targets, tokens, give_up=0.04)[0].budget == pytest.approx(60) and mixing.budgets([], {}, give_up=1) == []
