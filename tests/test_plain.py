"""The queries that SQL can't say, on the smallest tables against plain Python."""

import hashlib
import json
import re
from collections import Counter

import pytest

from moru.operators import split
from moru.plans import catalogue, drift

NO_SQL = sorted(set(catalogue.QUERIES | drift.QUERIES) - set(catalogue.ORACLES | drift.ORACLES))


def texts(spark, sf):
    return {r.doc_id: r.text for r in catalogue.docs(spark, sf).select("doc_id", "text").collect()}


def run(spark, sf, name):
    return (catalogue.QUERIES | drift.QUERIES)[name](spark, sf).collect()


def first_line(text):
    return next((x.strip() for x in text.split("\n") if x.strip()), "")


def hash_split_blake2b(spark, sf):
    blocks = {(r.doc_id, r.block): r.text for r in catalogue._blocks(spark, sf).collect()}
    want = {}
    for (i, b), t in blocks.items():
        share = int.from_bytes(hashlib.blake2b(f"42|{b}|{first_line(t)}".encode(), digest_size=8).digest(), "big") / 2**64
        want[i, b] = "eval" if share < 0.1 else "train"
    assert {(r.doc_id, r.block): r.split for r in run(spark, sf, "hash_split_blake2b")} == want and set(want.values()) == {"eval", "train"}


def choice_fold(spark, sf):
    for r in run(spark, sf, "choice_fold"):
        done, current = [], None
        for x in filter(None, map(str.strip, texts(spark, sf)[r.doc_id].split("\n"))) if re.search("[①-⑤]", texts(spark, sf)[r.doc_id]) else []:
            if found := [c for c in "①②③④⑤" if c in x]:
                if current is not None:
                    done.append(current)
                current = x.replace(found[0], "").strip()
            elif current is not None:
                current += " " + x
        assert r.choices == "|".join(done + ([current] if current is not None else []))


def heavy_hitters(spark, sf):
    c = Counter("▁" + w for t in texts(spark, sf).values() if t for w in t.split())
    got = {r.piece: r.n for r in run(spark, sf, "heavy_hitters")}
    assert len(got) == 100 and all(abs(c[p] - n) <= 0.01 * c.total() for p, n in got.items())
    assert len(set(got) & {p for p, _ in c.most_common(20)}) >= 19


def random_tokens(spark, sf):
    rows = run(spark, sf, "random_tokens")
    assert len(rows) == 100 and all(len(r.x) == len(r.y) == 16 and r.x[1:] == r.y[:-1] and all(0 <= t < 32_000 for t in r.x) for r in rows)
    assert len({t for r in rows for t in r.x}) > 1500 and [tuple(r) for r in rows] == [tuple(r) for r in run(spark, sf, "random_tokens")]


def gumbel_draw(spark, sf):
    logits = {}
    for r in catalogue._logits(spark, sf).collect():
        logits.setdefault(r.step, {})[r.token] = r.logit
    got = {r.step: r.token for r in run(spark, sf, "gumbel_draw")}
    assert got == {r.step: r.token for r in run(spark, sf, "gumbel_draw")} and set(got) == set(logits)
    likely = [t for s, x in logits.items() for t in (max(x, key=x.get),) if got[s] == t]
    assert len(likely) > 2 * len(logits) / max(len(x) for x in logits.values())  # the largest logit more often than by chance


def rank_ids(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    from moru.operators import tokenizers

    t = tokenizers.Ranks(tokenizers.file_bytes("byte_bpe_multi_50k.tiktoken"))
    ranks = {v: k for k, v in _ranks("byte_bpe_multi_50k.tiktoken").items()}
    assert tiktoken and len(ranks) > 40_000
    for r in run(spark, sf, "rank_ids"):
        assert r.ids[0] == t.bos and r.ids[-1] == t.eos
        assert b"".join(ranks[i] for i in r.ids[1:-1]).decode() == (texts_of(spark, sf)[r.doc_id] or "")


def _ranks(name):
    import base64

    from moru.operators import tokenizers

    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in tokenizers.file_bytes(name).splitlines() if x)}


_TEXTS = {}


def texts_of(spark, sf):
    if sf not in _TEXTS:
        _TEXTS[sf] = texts(spark, sf)
    return _TEXTS[sf]


def sentencepiece_ids(spark, sf):
    sentencepiece = pytest.importorskip("sentencepiece")
    from moru.operators import tokenizers

    model = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.file_bytes("piece_bpe_32k.model"))
    for r in run(spark, sf, "sentencepiece_ids"):
        assert r.ids == model.encode(texts_of(spark, sf)[r.doc_id] or "") + [model.eos_id()]


NOISE = [re.compile(p) for p in (r"^\s*\d+\s*$", "대학수학능력시험.*홀수형", "대학수학능력시험.*짝수형", "이 문제지에 관한.*", r"^\s*-\s*\d+\s*-\s*$", r"^\s*제\s*\d+\s*교시\s*$", r"성명\s*수험\s*번호")]


def files(spark, sf):
    pages = {}
    for r in spark.read.parquet(f"{sf}/scan_pages.parquet").collect():
        pages.setdefault(r.source_file, []).append((r.page_no, "\n".join(x for x in (r.text or "").split("\n") if not any(p.search(x) for p in NOISE))))
    return {f: "\n".join(t for _, t in sorted(ps) if t.strip()) for f, ps in pages.items()}


def page_blocks(spark, sf):
    got = Counter((r.source_file, r.block) for r in run(spark, sf, "page_blocks"))
    want = Counter((f, b) for f, t in files(spark, sf).items() if "[지문" not in t for b in re.findall(r"(?ms)(^\d{1,2}\.[^\S\n]*[^\n]+.*?)(?=^\d{1,2}\.\s*[^\n]|\Z)", t))
    marked = {f for f, t in files(spark, sf).items() if "[지문" in t}
    assert {k: n for k, n in got.items() if k[0] not in marked} == want and sum(want.values()) > 20


def page_items(spark, sf):
    rows = run(spark, sf, "page_items")
    blocks = run(spark, sf, "page_blocks")
    number = {(r.source_file, r.page_no, r["at"]): int(re.match(r"\d+", r.block).group()) for r in blocks}
    assert all(number[r.metadata.source_file, r.page_no, r["at"]] == r.metadata.question_number and r.question.strip() for r in rows)
    for r in rows:
        n = 4 if "teacher" in r.metadata.source_file.lower() or "임용" in r.metadata.source_file else 5
        b = next(x.block for x in blocks if (x.source_file, x.page_no, x["at"]) == (r.metadata.source_file, r.page_no, r["at"]))
        assert (r.choices is not None) == all(c in b for c in "①②③④⑤"[:n]) and (r.choices is None or len(r.choices) == n)
    assert len(rows) > 20


def records_of(spark, sf):
    out = {}
    for r in spark.read.parquet(f"{sf}/local_raw.parquet").collect():
        try:
            v = json.loads(r.payload)
        except ValueError:
            continue
        if isinstance(v, dict):
            out.setdefault((r.feed, r.file_no, r.line_no), v)
    return out


def said(v):
    return v if isinstance(v, str) else None if v is None else json.dumps(v, ensure_ascii=False)


def alias_coalesce_all(spark, sf):
    keys = {"question": ["question", "문제", "문제 내용", "q"], "subject": ["subject", "과목"]}
    first = lambda v, ks: next((said(v[k]) for k in ks if v.get(k) not in (None, "", [], {})), None)
    want = {k: first(v, keys["subject"]) or "국어" for k, v in records_of(spark, sf).items() if (first(v, keys["question"]) or "").strip()}
    assert {(r.feed, r.file_no, r.line_no): r.subject for r in run(spark, sf, "alias_coalesce_all")} == want


def local_items(spark, sf):
    rows = run(spark, sf, "local_items")
    want = [v for v in records_of(spark, sf).values() if any(v.get(k) not in (None, "", [], {}) for k in ("question", "문제", "문제 내용", "q"))]
    assert len(rows) == len(want)
    lists = Counter(tuple(v[k]) for v in want for k in ("choices", "선지", "options") if isinstance(v.get(k), list) and sum(isinstance(v.get(x), list) for x in ("choices", "선지", "options")) == 1)
    assert not lists - Counter(tuple(r.choices or ()) for r in rows)


def p5_consistent(spark, sf):
    rows = {(r.feed, r.file_no, r.line_no): r for r in run(spark, sf, "p5_consistent") if r.readable}
    want = records_of(spark, sf)
    assert set(rows) == set(want)
    for k, v in want.items():
        held = json.dumps({c: x for c, x in rows[k].asDict().items() if c != "branches"}, ensure_ascii=False)
        leaves = [x for w in v.values() for x in (w if isinstance(w, list) else w.values() if isinstance(w, dict) else [w]) if x is not None]
        for x in leaves:
            assert json.dumps(str(x).strip(), ensure_ascii=False)[1:-1] in held or re.fullmatch(r"\s*\[?(\d+)\s*[번년]?\]?\s*", str(x)) and re.search(r"\d+", str(x)).group() in held or str(x).lower() in held, (x, held)


@pytest.mark.parametrize("name", NO_SQL)
def test_query(spark, sf, name):
    globals()[name](spark, sf)  # each has its check above


def test_shuffle(spark):
    df = spark.range(200)
    once = [r.id for r in split.shuffled(df, 7, "id").collect()]
    assert once == [r.id for r in split.shuffled(df.orderBy("id", ascending=False), 7, "id").collect()] != [r.id for r in split.shuffled(df, 8, "id").collect()]
    assert sorted(once) == list(range(200)) and abs(sum(i < x for i, x in enumerate(once)) - 100) < 30
