"""Readers, sinks and streams on temporary files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from moru.operators import logs, packing, sampling, split, vocab
from moru.operators.order import dense_index, running_total
from moru.sources import crawl, readers, registry, sinks
from moru.streaming import logs as stream


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_local_directory(spark, tmp_path):
    write(tmp_path / "a" / "1.json", '[{"question": "가"}, {"question": "나"}, {"x": 1}]')
    write(tmp_path / "b.json", '{"data": [{"question": "다"}]}')
    write(tmp_path / "c.json", '{"question": "라", "choices": ["1", "2"]}')
    write(tmp_path / "d.jsonl", '{"question": "마"}\n\nbroken\n{"문제": "바"}\n')
    write(tmp_path / "e.csv", 'question,answer\n"사\n아",1\n')
    write(tmp_path / "f.txt", "첫 번째 문제입니다.\n\n두 번째 문제입니다.\n\n \n")
    write(tmp_path / "g.pdf", "x")
    write(tmp_path / "h.json", "not json")
    got = readers.local_records(spark, str(tmp_path))
    from moru.operators.records import parse_local

    assert sorted(r.question for r in parse_local(got).collect()) == sorted(["가", "나", "다", "라", "마", "바", "사\n아", "첫 번째 문제입니다.", "두 번째 문제입니다."])
    assert readers.local_records(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        readers.local_records(spark, write(tmp_path / "x.xml", "<a/>"))


def test_jsonl_counts_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"a": "1"}\nbad\n\n{"a": "2"}\n')
    rows = readers.jsonl(spark, str(tmp_path / "a.jsonl.gz"), "a string")
    assert readers.parse_counts(rows).select("parsed", "skipped").collect()[0].asDict() == {"parsed": 2, "skipped": 1}
    lines = spark.createDataFrame([('{"content": null, "text": "t"}',), ('{"text": "t"}',), ('{"content": "c", "text": "t"}',)], "l string")
    assert [r.v for r in lines.select(readers.content_or_text(F.col("l")).alias("v")).collect()] == [None, "t", "c"]


def test_tsv(spark, tmp_path):
    p = write(tmp_path / "n.txt", "id\tdocument\tlabel\n1\t좋다\t1\n2\n3\t \t0\n")
    lines = readers.text_lines(spark, p)
    assert [r.text for r in readers.tsv_column(lines).collect()] == ["좋다"]
    assert readers.tsv_column(lines, skip_header=False).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("가\n나",), ("다",), (" ",)], "text string")
    sinks.write_texts(df, str(tmp_path / "t"), repeat=2)
    sinks.write_texts(df, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == sorted(["가", "나", "다"] * 3)
    sinks.write_jsonl(spark.createDataFrame([("a", None)], "a string, b string"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))) == {"a": "a", "b": None}
    with pytest.raises(ValueError):
        registry.up_weighted(df, 0)
    write(tmp_path / "run" / "1.jsonl", '{"text": "하나", "score": 0.9}\nbad\n{"prompt": "x"}\n{"text": "둘", "score": 0.1}\n')
    assert sinks.merge_runs(spark, str(tmp_path / "run"), str(tmp_path / "m")) == 2
    assert sinks.merge_runs(spark, str(tmp_path / "run"), str(tmp_path / "m"), 0.5) == 1
    assert sinks.next_run(["run_20250101", "run_20250101_2", "x"], "20250101") == "run_20250101_3"
    assert sinks.next_run([], "20250101") == "run_20250101"


def test_running_total_and_index(spark):
    df = spark.range(0, 1000, 3).repartition(7)
    got = running_total(df, F.col("id"), "id", "before", block_rows=50).orderBy("id").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.id
    assert [r.idx for r in dense_index(df, "id", parts=5).orderBy("id").collect()] == list(range(334))


@pytest.mark.parametrize("rows", [3, 50])
def test_packing_conserves_tokens(spark, rows):
    docs = [(i, [i * 100 + k for k in range(i % 9)]) for i in range(rows)]
    flat = [t for _, ids in docs for t in [*ids, 3]]
    docs.append((rows, None))
    got = packing.pack(spark.createDataFrame(docs, "d long, ids array<int>"), "ids", "d", 8, eos=3, block_rows=4).orderBy("seq_id").collect()
    n = (len(flat) - 1) // 8
    assert [(r.x, r.y) for r in got] == [(flat[i * 8 : i * 8 + 8], flat[i * 8 + 1 : i * 8 + 9]) for i in range(n)]


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(1, "가나 다라 가나"), (2, ""), (3, None), (4, "가나 ab☃")], "id int, text string")
    v = vocab.train(df, 23_000)
    assert v.count() == v.select("token").distinct().count()
    assert [r.id for r in v.orderBy("id").collect()] == list(range(v.count()))
    assert {r.token: r.id for r in v.collect()} == {r.token: r.id for r in vocab.train(df.repartition(5), 23_000).collect()}
    assert [r.token for r in v.where("id < 4").orderBy("id").collect()] == vocab.SPECIALS
    e = vocab.encode(df, v, "id")
    joined = vocab.encode(df, v, "id", broadcast_rows=10)
    assert {r.id: r.ids for r in joined.collect()} == {r.id: r.ids for r in e.collect()}
    back = {r.id: r.text for r in vocab.decode(e, v, "id").collect()}
    assert back == {1: "가나 다라 가나", 2: "", 3: "", 4: "가나 ab☃"}
    assert vocab.unknown_audit(e).collect()[0].unknown == 0
    assert vocab.unknown_audit(e.where("false")).collect()[0].asDict() == {"tokens": 0, "unknown": 0, "ratio": 0.0, "band": "excellent"}
    padded = vocab.batch_encode(e, "id", 3).collect()
    assert {len(r.input_ids) for r in padded} == {3} and {r.id: sum(r.attention_mask) for r in padded}[2] == 0


def test_blake2b_split(spark):
    import hashlib

    key = "42|0|첫 줄"
    want = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big") / 2**64
    got = spark.createDataFrame([(0, "\n 첫 줄 \n둘째")], "block long, text string").select(split.blake2b_share(split.split_key(42, F.col("block"), F.col("text"))).alias("s")).collect()[0].s
    assert got == want


def test_log_stream(spark, tmp_path):
    line = "step    {0} | loss {1:.4f} | lr 7.50e-05 | 453,986 tok/s"
    write(tmp_path / "in" / "1.log", "\n".join(line.format(i, 9 - i / 10) for i in range(12)))
    write(tmp_path / "in" / "2.log", "\n".join([*(line.format(i, 9 - i / 10) for i in range(10, 22)), "eval  step=20  loss=7.1338  ppl=1253.63", "Checkpoint saved → checkpoints/step-500", "noise"]))
    stream.run_available(stream.metrics(spark, str(tmp_path / "in")), str(tmp_path / "cp"), "metrics")
    got = spark.table("metrics")
    assert got.where("kind = 'train'").count() == 22
    assert got.where("kind = 'eval'").collect()[0].ppl == 1253.63
    assert got.where("kind = 'checkpoint'").collect()[0].path == "checkpoints/step-500"
    assert logs.summary(got.where("kind = 'train'")).collect()[0].last_step == 21


def test_sampling_ties_and_rates(spark):
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate([3.0, 2.0, 2.0, 1.0])], "step int, token int, logit double")
    assert sorted(r.token for r in sampling.top_k(df, 2).collect()) == [0, 1, 2]
    assert sampling.greedy(df).collect()[0].token == 0
    assert sampling.draw(df, 1).collect() == sampling.draw(df, 1).collect()
    banned = sampling.hold_back_eos(sampling.ban(df, [0]), 1, 5, F.lit(2))
    assert sampling.greedy(banned).collect()[0].token == 2
    assert logs.scaled_rate(1.0, 64, 16, "sqrt") == 2.0


def test_links(spark):
    pages = spark.createDataFrame([("https://a.kr/x/", '<a href="y.pdf">2018 국어</a><a href="z.pdf">2020 전공 국어</a>')], "url string, html string")
    assert [r.year for r in crawl.links(pages, "teacher").collect()] == [2020]
    assert crawl.links(pages, "none").count() == 0
    assert crawl.all_links(pages, ["csat", "teacher", "what"]).count() == 3
    assert readers.env_values(["A=1", "# c", "", "B='x y'", "nothing"]) == {"A": "1", "B": "x y"}


def test_chat_blocks_in_stretches(spark):
    from moru.sources.sinks import to_lines

    text = "\n\n앞말\n질문: 하나\n답변: 둘\n\n 질문: 셋\n<usr> 넷\n끝\n"
    lines = to_lines(spark.createDataFrame([(1, text), (2, ""), (3, "질문: 홀로"), (4, None)], "d int, text string"), "d")
    whole = sorted(map(tuple, split.chat_blocks(lines, ["d"], "line_no").collect()))
    assert whole == [(1, 0, 1, "앞말"), (1, 1, 3, "질문: 하나\n답변: 둘\n"), (1, 2, 1, " 질문: 셋"), (1, 3, 3, "<usr> 넷\n끝\n"), (3, 0, 1, "질문: 홀로")]
    assert sorted(map(tuple, split.chat_blocks(lines, ["d"], "line_no", block_rows=2).collect())) == whole


def test_datasets_in_one_table(spark):
    from moru.operators.records import parse_all

    civil = spark.createDataFrame([("1", "문", "가", "나", "다", "라", "2", "2020", "국가직")], "`문제 번호` string, `문제 내용` string, `선택지 1` string, `선택지 2` string, `선택지 3` string, `선택지 4` string, `정답` string, year string, source string")
    sft = spark.createDataFrame([([("user", "묻는다")],)], "messages array<struct<role:string,content:string>>")
    assert sorted(r.dataset for r in parse_all({"civil_local": civil, "csat_sft": sft}).collect()) == ["civil_local", "csat_sft"]


def test_public_tokenizers(spark):
    from moru.operators import tokenizers

    df = spark.createDataFrame([(1, "안녕 hello", 5), (2, "", 6), (None, None, 7)], "id int, text string, ids int")
    for make, name in ((tokenizers.Ranks, "byte_bpe_50k.tiktoken"), (tokenizers.Pieces, "piece_bpe_32k.model")):
        data = tokenizers.file_bytes(name)
        t = make(data)
        e = tokenizers.encode(df, make, data, "id", bos=True, eos=True)
        got = {r.id: r.ids for r in e.collect()}
        assert got == {1: [t.bos, *t.encode(["안녕 hello"])[0], t.eos], 2: [t.bos, t.eos], None: [t.bos, t.eos]}
        assert {r.id: r.text for r in tokenizers.decode(e, make, data, "id").collect()}[1] == "안녕 hello"
        assert tokenizers.encode(df.limit(0), make, data, "id").count() == 0
