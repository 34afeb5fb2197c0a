"""Schemas that drift between the files of a feed: one consistent table and a list of the changes.

Every payload is parsed to a VARIANT, so a value keeps the type it has. The schema of a file is a tagged union: for each
key the alternatives (JSON types) seen, with their counts. Parallel files fuse by adding counts, so the inference is one
aggregation with partial results before the shuffle. A conflict is split into typed branches beside the canonical
conversion of the field; comparing each file with the one before it gives the keys that are added, removed, renamed or
retyped and the alternatives that appear.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moru.session import broadcast_if_small, checkpoint

# The keys under which each logical field is known.
ALIASES = {
    "question": ["question", "문제", "문제 내용", "q", "question_text", "질문", "발문", "물음", "문항"],
    "passage": ["passage", "지문", "context", "paragraph", "본문", "읽기자료", "passage_text", "제시문"],
    "choices": ["choices", "선지", "options", "선택지", "보기"],
    "answer": ["answer", "정답", "gold", "ans", "정답번호", "answer_no", "답"],
    "explanation": ["explanation", "해설", "설명", "풀이", "rationale"],
    "exam_type": ["exam_type", "시험종류", "시험유형"],
    "year": ["year", "연도", "시행연도", "년도"],
    "subject": ["subject", "과목", "교과"],
}
FIELD_OF = {re.sub(r"[\s_\-]+", "", k).lower(): field for field, keys in ALIASES.items() for k in keys}
#: Share of a key's values that must look like a logical field for an unknown key to be taken for it.
LOOKS_LIKE = 0.8


def _json_type(kind: Column) -> Column:
    """The JSON type of a value from the name of its VARIANT schema."""
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind != "VOID", "number")
    )


def records(df: DataFrame) -> DataFrame:
    """``feed, file_no, line_no, record variant`` of the readable records: payloads that are one JSON object."""
    v = F.try_parse_json("payload")
    return df.select("feed", "file_no", "line_no", v.alias("record")).where(F.col("record").isNotNull() & F.schema_of_variant("record").startswith("OBJECT"))


def _name(key: Column | str) -> Column:
    """A key as ``FIELD_OF`` has it: without case, spaces, ``_`` and ``-``."""
    return F.lower(F.regexp_replace(key, r"[\s_\-]+", ""))


def _known(key: Column | str) -> Column:
    """The field that a key is known for by its name, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_OF.items() for x in kv]), _name(key))


def values(df: DataFrame) -> DataFrame:
    """``feed, file_no, line_no, named, key, value variant, type`` of the non-null top-level values of the readable records;
    ``named`` are the fields that the record has by name."""
    rec = records(df).select("feed", "file_no", "line_no", F.expr("map_filter(try_variant_get(record, '$', 'map<string, variant>'), (k, x) -> x is not null and schema_of_variant(x) <> 'VOID')").alias("m"))
    named = F.array_distinct(F.transform(F.map_keys("m"), _known))
    out = rec.select("feed", "file_no", "line_no", named.alias("named"), F.explode("m").alias("key", "value"))
    return out.withColumn("type", _json_type(F.schema_of_variant("value"))).where(F.col("type").isNotNull())


def _looks() -> dict[str, Column]:
    """Tests of a value's content for keys of unknown names."""
    text = F.coalesce(F.expr("try_variant_get(value, '$', 'string')"), F.expr("try_variant_get(value, '$.text', 'string')"), F.expr("try_variant_get(value, '$.body', 'string')"), F.expr("to_json(value)"))
    return {
        "question": text.rlike(r"(?:\?|시오[.]?|what|which|고른 것[은]?)\s*\"?$") & (F.length(text) < 300),
        "explanation": text.rlike(r"정답은|정답이|따라서 정답|적절함|윗글에 따르면|answer is"),
        "answer": text.rlike(r"^\s*\[?\"?\s*[1-5]\s*번?\s*\"?\]?\s*$|^<NA>$|^[①-⑤]$"),
        "marked": text.rlike(r"^\s*\[\"?[1-5]|번\s*\"?$|^<NA>$|^[①-⑤]$|^\s+[1-5]\s+$"),
        "year": text.rlike(r"^\s*(?:19|20)\d\d\s*년?\s*$"),
        "exam_type": text.rlike(r"^(?:csat|mock_june|mock_sept|mock|teacher|leet|district|civil_local|civil_national|local)$"),
        "subject": text.rlike(r"^(?:국어|독서|문학|문법|화법|작문|언어와 매체|언어이해|영어)$"),
        "choices": (F.col("type") == "array") & text.rlike(r'^\["[^"]+"(?:,"[^"]+"){2,}'),
        "passage": (F.length(text) >= 30) & text.rlike(r"[.다]\s*\"?\]?\}?$") & ~text.rlike(r"정답은|정답이|적절함"),
    }


def file_schemas(df: DataFrame) -> DataFrame:
    """``feed, file_no, key, type, n, n_type, types map<string,long>, field``: the tagged union of each key of each file.

    ``type`` is the most frequent alternative; of two as frequent ones the first in alphabetical order. ``field`` is the
    logical field by name, or by content where the name is unknown, or else the key itself. A key of which at least half the
    values stand beside a key known by name as that field, over all files, is no other name of it, whatever they look like.
    """
    looks = _looks()
    by_type = values(df).groupBy("feed", "file_no", "key", "type").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"like_{k}") for k, c in looks.items()], *[F.count_if(F.array_contains("named", k)).alias(f"beside_{k}") for k in looks])
    union = by_type.groupBy("feed", "file_no", "key").agg(
        F.max_by("type", F.struct(F.col("n"), -F.ascii("type"))).alias("type"),
        F.sum("n").alias("n"),
        F.max("n").alias("n_type"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"),  # at most five alternatives
        *[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in looks for x in ("like", "beside")],
    )
    known = _known("key")
    # small integers may be anything; an answer is also written in one of its own ways
    content = F.coalesce(*[F.when((F.col(f"like_{k}") >= LOOKS_LIKE * F.col("n")) & ((F.col("like_marked") > 0) | F.lit(k != "answer")), k) for k in looks if k != "marked"])
    beside = F.coalesce(*[F.when(F.col("content") == k, F.col(f"beside_{k}")) for k in looks])
    named = union.select("*", known.alias("known"), F.when(known.isNull(), content).alias("content")).withColumn("beside", beside)
    named = checkpoint(named.select("feed", "file_no", "key", "type", "n", "n_type", "types", "known", "content", "beside"))
    other = named.where("content is not null").groupBy("key", "content").agg(F.sum("n").alias("n"), F.sum("beside").alias("beside")).where("2 * beside >= n").select("key", "content")
    other = checkpoint(other)  # a row for each key that looks like a field it isn't
    judged = named.alias("a").join(broadcast_if_small(other.withColumn("no", F.lit(True)), other.count()).alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.content") == F.col("b.content")), "left")
    return judged.select("feed", "file_no", "a.key", "type", "n", "n_type", "types", F.coalesce("known", F.when(F.col("no").isNull(), F.col("a.content")), F.col("a.key")).alias("field"))


def changes(df: DataFrame) -> DataFrame:
    """``feed, file_no, change, old_key, new_key``: what differs between each file and the one numbered just before it.

    Two keys of one logical field, of which one vanishes and the other appears, are a renaming; of several the first in
    alphabetical order are paired. A file whose predecessor has no readable record isn't compared. Unreadable payloads,
    null feeds and null file numbers are left out; repeated rows change nothing but the counts; an empty table gives an
    empty list.
    """
    keys = file_schemas(df).where("feed is not null and file_no is not null").select("feed", "file_no", F.struct("key", "type", "field").alias("k"))
    files = keys.groupBy("feed", "file_no").agg(F.array_sort(F.collect_list("k")).alias("ks"))  # the keys of one file
    later, earlier = files.alias("b"), files.alias("a")
    both = later.join(earlier, (F.col("b.feed") == F.col("a.feed")) & (F.col("b.file_no") == F.col("a.file_no") + 1)).select("b.feed", "b.file_no", F.col("a.ks").alias("old"), F.col("b.ks").alias("new"))
    both = both.withColumns({
        "gone": F.expr("filter(old, o -> not exists(new, n -> n.key = o.key))"),
        "come": F.expr("filter(new, n -> not exists(old, o -> o.key = n.key))"),
        "kept": F.expr("filter(transform(new, n -> struct(get(filter(old, o -> o.key = n.key), 0) as o, n as n)), x -> x.o is not null)"),
    })
    # the i-th vanished key of a field with the i-th that appears
    both = both.withColumns({
        "gone": F.expr("transform(gone, (g, i) -> struct(g as k, size(filter(slice(gone, 1, i), p -> p.field = g.field)) as at))"),
        "come": F.expr("transform(come, (g, i) -> struct(g as k, size(filter(slice(come, 1, i), p -> p.field = g.field)) as at))"),
    })
    both = both.withColumns({
        "pairs": F.expr("filter(flatten(transform(gone, g -> transform(come, c -> if(g.k.field = c.k.field and g.at = c.at, struct(g.k as o, c.k as n), null)))), x -> x is not null)"),
    })
    out = F.expr("""
        concat(
          transform(pairs, p -> struct('renamed' as change, p.o.key as old_key, p.n.key as new_key)),
          transform(filter(gone, g -> not exists(pairs, p -> p.o.key = g.k.key)), g -> struct('removed' as change, g.k.key as old_key, '' as new_key)),
          transform(filter(come, c -> not exists(pairs, p -> p.n.key = c.k.key)), c -> struct('added' as change, '' as old_key, c.k.key as new_key)),
          transform(filter(concat(pairs, kept), p -> p.o.type <> p.n.type), p -> struct('retyped' as change, p.o.key as old_key, p.n.key as new_key)))
    """)
    return both.select("feed", "file_no", F.explode(out).alias("c")).select("feed", "file_no", "c.change", "c.old_key", "c.new_key")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``feed, file_no, path, type, n``: the JSON types at each path of the records, counted within the batch."""
    kinds = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}
    for batch in batches:
        c: Counter[tuple] = Counter()
        for feed, file_no, record in zip(*(x.to_pylist() for x in batch.columns)):
            todo = [("", json.loads(record))]
            while todo:
                path, v = todo.pop()
                if path and v is not None:
                    c[feed, file_no, path, kinds[type(v)]] += 1
                if isinstance(v, dict):
                    todo += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
                elif isinstance(v, list):
                    todo += [(path + "[]", x) for x in v]
        cols = [*zip(*c)] if c else [(), (), (), ()]
        types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(cols, types)], pa.array([*c.values()], pa.int64())], ["feed", "file_no", "path", "type", "n"])


def path_schemas(df: DataFrame) -> DataFrame:
    """``feed, file_no, path, type, n``: the tagged union of each path of each file, with keys joined by ``.`` and ``[]`` for the
    elements of an array, to any depth. Types are counted within the batches before the shuffle."""
    rec = records(df).select("feed", "file_no", F.expr("to_json(record)").alias("record"))
    kind = rec.schema["file_no"].dataType.simpleString()
    return rec.mapInArrow(_paths, f"feed string, file_no {kind}, path string, type string, n long").groupBy("feed", "file_no", "path", "type").agg(F.sum("n").alias("n"))


def alternatives(df: DataFrame) -> DataFrame:
    """``feed, file_no, path, type, n``: each alternative of a path in the first file of the feed that has it."""
    first = path_schemas(df).groupBy("feed", "path", "type").agg(F.min("file_no").alias("file_no"), F.min_by("n", "file_no").alias("n"))
    return first.select("feed", "file_no", "path", "type", "n")


def report(df: DataFrame) -> DataFrame:
    """``feed, file_no, change, old_key, new_key``: the changes of the keys, and as ``alternative`` each type (``new_key``) that
    appears at a path (``old_key``) which earlier files of the feed had with other types."""
    seen = alternatives(df)
    start = seen.groupBy("feed", "path").agg(F.min("file_no").alias("start"))
    late = seen.join(start, ["feed", "path"]).where("file_no > start")
    return changes(df).unionByName(late.select("feed", "file_no", F.lit("alternative").alias("change"), F.col("path").alias("old_key"), F.col("type").alias("new_key")))


def consistent(df: DataFrame) -> DataFrame:
    """All readable records in one table: a canonical column for each logical field, typed branches where types conflict, the rest as JSON.

    ``feed, file_no, line_no, question, passage, explanation, exam_type, subject string, choices array<string>, answer
    int, year int``, the branches ``answer_text``, ``choices_text`` and ``passage_parts`` for values that the canonical
    conversion can't hold, ``branches`` (field, type and JSON of each value that isn't of its field's own type), ``extra string``
    (an object of all keys with a value that the columns don't hold, or not in full) and ``readable``.
    Unreadable payloads are kept with ``readable`` false and nulls. A key belongs to the field that ``file_schemas`` gives
    it. Of several keys of a field in one record the first in the order of ``ALIASES`` counts, exact spellings before
    others and names before contents; the rest stay in ``extra``. One narrow pass beside a join with the keys that are
    known by their content, which is broadcast if they are few.
    """
    v = F.try_parse_json("payload")
    rec = df.select("feed", "file_no", "line_no", F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("record"))
    m = rec.withColumn("m", F.expr("cast(record as map<string, variant>)"))
    m = m.withColumn("m", F.expr("map_filter(m, (k, x) -> x is not null and schema_of_variant(x) <> 'VOID')"))
    by_content = file_schemas(df).where(F.col("field").isin(*ALIASES) & ~_name("key").isin(*FIELD_OF))
    by_content = checkpoint(by_content.groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("key", "field"))).alias("by_content")))  # the keys of one file
    c = broadcast_if_small(by_content, by_content.count()).alias("c")
    m = m.alias("m").join(c, F.col("m.feed").eqNullSafe(F.col("c.feed")) & F.col("m.file_no").eqNullSafe(F.col("c.file_no")), "left").select("m.*", "by_content")

    exact = F.create_map(*[F.lit(x) for keys in ALIASES.values() for at, k in enumerate(keys) for x in (k, at)])
    spelled = F.create_map(*[F.lit(x) for keys in ALIASES.values() for at, k in enumerate(keys) for x in (k.replace(" ", "").replace("_", "").lower(), 100 + at)])

    def place(k: Column) -> Column:
        field = F.coalesce(_known(k), F.try_element_at("by_content", k))
        return F.struct(field.alias("field"), F.coalesce(F.try_element_at(exact, k), F.try_element_at(spelled, _name(k)), F.lit(1000)).alias("rank"), k.alias("key"))

    m = m.withColumn("ks", F.transform(F.map_keys("m"), place))
    m = m.withColumns({f"k_{f}": F.array_min(F.expr(f"filter(ks, x -> x.field = '{f}')"))["key"] for f in ALIASES})
    m = m.withColumns({f"v_{f}": F.try_element_at("m", F.col(f"k_{f}")) for f in ALIASES})

    def get(c: str, path: str, kind: str) -> Column:
        return F.expr(f"try_variant_get({c}, '{path}', '{kind}')")

    def text(c: str) -> Column:
        kind = F.schema_of_variant(c)
        return (
            F.when(kind.startswith("OBJECT"), F.coalesce(get(c, "$.text", "string"), get(c, "$.body", "string"), F.expr(f"to_json({c})")))
            .when(kind.startswith("ARRAY"), F.coalesce(F.array_join(get(c, "$", "array<string>"), "\n"), F.expr(f"to_json({c})")))
            .otherwise(get(c, "$", "string"))
        )

    def flat(elements: Column) -> Column:
        return ~F.exists(elements, lambda x: F.coalesce(F.schema_of_variant(x).rlike("^(ARRAY|OBJECT)"), F.lit(False)))

    def whole(field: str) -> Column:
        """The columns of ``field`` hold all of its value: a scalar, an array or object of scalars, not one member of several."""
        v, kind = f"v_{field}", F.schema_of_variant(f"v_{field}")
        members = get(v, "$", "map<string, variant>")
        one = F.coalesce(get(v, "$.text", "string"), get(v, "$.body", "string")).isNull() | (F.size(members) == 1)
        return F.when(kind.startswith("ARRAY"), flat(get(v, "$", "array<variant>"))).when(kind.startswith("OBJECT"), flat(F.map_values(members)) if field == "choices" else one).otherwise(True)

    own_type = {"choices": "array", "answer": "number", "year": "number"}
    branches = F.array(*[F.when(F.col(f"v_{f}").isNotNull() & (_json_type(F.schema_of_variant(f"v_{f}")) != own_type.get(f, "string")),
                                F.struct(F.lit(f).alias("field"), _json_type(F.schema_of_variant(f"v_{f}")).alias("type"), F.expr(f"to_json(v_{f})").alias("value"))) for f in ALIASES])
    many = F.coalesce(F.schema_of_variant("v_answer").startswith("ARRAY") & (F.size(get("v_answer", "$", "array<variant>")) > 1), F.lit(False))
    number = F.expr(r"regexp_extract(coalesce(try_variant_get(v_answer, '$[0]', 'string'), try_variant_get(v_answer, '$', 'string')), '^\\s*\\[?\\s*(\\d+)\\s*번?\\s*\\]?\\s*$', 1)")
    number = F.when(~many, number)
    year = F.expr(r"regexp_extract(try_variant_get(v_year, '$', 'string'), '^\\s*(\\d{4})\\s*년?\\s*$', 1)")
    out = m.select(
        "feed", "file_no", "line_no", "m", "record", *[f"k_{f}" for f in ALIASES], *[f"v_{f}" for f in ALIASES], F.array_compact(branches).alias("branches"),
        *[text(f"v_{f}").alias(f) for f in ("question", "passage", "explanation", "exam_type", "subject")],
        F.when(F.schema_of_variant("v_choices").startswith("OBJECT"), F.expr("map_values(try_variant_get(v_choices, '$', 'map<string,string>'))"))
        .when(F.schema_of_variant("v_choices") == "STRING", F.expr(r"filter(split(try_variant_get(v_choices, '$', 'string'), '\\s*[\\n|;]\\s*|\\s+/\\s+|\\s*[①-⑳]\\s*'), x -> x <> '')"))
        .otherwise(get("v_choices", "$", "array<string>")).alias("choices"),
        number.try_cast("int").alias("answer"),
        year.try_cast("int").alias("year"),
        F.when(number.try_cast("int").isNull(), text("v_answer")).alias("answer_text"),
        F.when(F.schema_of_variant("v_choices") == "STRING", get("v_choices", "$", "string")).alias("choices_text"),
        get("v_passage", "$", "array<string>").alias("passage_parts"),
    )
    held = {f: F.col(f).isNotNull() for f in ALIASES} | {"answer": F.col("answer").isNotNull() | F.col("answer_text").isNotNull(), "choices": F.col("choices").isNotNull() | F.col("choices_text").isNotNull()}
    held = {f: c & whole(f) for f, c in held.items()}
    used = F.array(*[F.when(held[f], F.col(f"k_{f}")) for f in ALIASES])
    extra = F.to_json(F.map_filter("m", lambda k, _: ~F.exists(used, lambda u: u.eqNullSafe(k))))
    return out.withColumns({"extra": extra, "readable": F.col("record").isNotNull()}).drop("m", "record", *[f"{x}_{f}" for f in ALIASES for x in "kv"])
