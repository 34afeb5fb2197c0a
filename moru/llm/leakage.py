"""Held-out texts inside the corpus (problem 2).

The held-out passages and questions are normalised (look-alike letters, case, everything but letters and digits) and
their n-grams go into a hash set that is broadcast. Every document is scanned window by window against it; what hits is
verified by aligning the sentences with the place of the hits. Spans can be cut from the documents, or documents dropped.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import ODD, TO_LATIN, fold
from .neardup import mixed, spans

#: Letters of an n-gram.
N = 9
#: Share of an alphabetic sentence's n-grams that a document must hold for it to be verified; of others one is enough.
HELD = 0.25
#: Letters of held-out texts in one broadcast; a larger set goes over the documents in blocks.
BLOCK_LETTERS = 20_000_000
#: Letters that a replaced word may take, and the share of a sentence that may be replaced.
WORD, REPLACED = 16, 0.4
#: Different passages with one question wording that show it isn't specific to one thing.
STOCK = 2
#: Words and titles after whose full stop a sentence goes on.
ABBREVIATIONS = r"Mr|Mrs|Ms|Dr|Prof|St|Gen|Col|Capt|Lt|Rev|Hon|vs|cf|No|Fig|Vol|pp|approx|e\.g|i\.e|Mt"
#: Sentences end at a sign and white space, in Hangul, Han and kana also without the white space; not after an initial or abbreviation.
SENTENCE = regex.compile(
    r"(?<=[.!?。！？．][\"'”’」』)]?)(?<!\b(?:" + ABBREVIATIONS + r")\.)(?!(?<=\b\p{Lu}\.)\s+\p{Lu}\p{Ll})\s+|(?<=[。！？][\"'”’」』)]?)(?![\"'”’」』)])|(?<=[가-힣\p{Han}ぁ-ヺ][.．!?][\"'”’」』)]?)(?=[가-힣\p{Han}ぁ-ヺ“‘「『(])"
)


def plain(text: str) -> str:
    """``text`` with look-alike letters made equal, without case."""
    t = fold(text)
    if ODD.search(t):
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(TO_LATIN))
    return t.casefold()


def letters(text: str) -> str:
    return "".join([c for c in plain(text) if c.isalnum()])


def sentences(passage: str) -> list[str]:
    """The sentences of a passage, normalised; stretches without a letter are none."""
    return [x for s in SENTENCE.split(passage) if (x := letters(s))]


def hashes(c: np.ndarray) -> np.ndarray:
    """The hash of each window of ``N`` code points."""
    n = len(c) - N + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(N):
        h *= np.uint64(0x100000001B3)
        h += c[j : j + n]
    return mixed(h)


class HeldOut:
    """A block of held-out texts: its units are sentences ``(passage, place)``, pairs of neighbouring sentences of which one
    has no n-gram of its own ``(passage, -1 - place)``, and questions ``(-1, question)``.

    The n-grams of a pair also straddle its sentence end. Pairs and questions that are too short for any n-gram are looked for whole.
    """

    def __init__(self, passages: dict[str, list[int]], questions: dict[str, list[int]]) -> None:
        self.passages = [(sentences(p), ids) for p, ids in passages.items()]
        self.questions = list(questions.items())
        units: list[tuple[int, int]] = []
        grams, owner, self.least = [], [], []
        self.short: dict[str, list[int]] = defaultdict(list)

        def add(unit: tuple[int, int], text: str) -> None:
            h = np.unique(hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)))
            if len(text) < N:
                self.short[text].append(len(units))
            grams.append(h)
            alphabet = sum(x < "\u0600" for x in text) > len(text) / 2  # whose n-grams say less
            self.least.append(max(1.0, HELD * len(h)) if alphabet else 1.0)
            owner.append(np.full(len(h), len(units)))
            units.append(unit)

        for p, (ss, _) in enumerate(self.passages):
            for k, x in enumerate(ss):
                if len(x) >= N:
                    add((p, k), x)
                if k + 1 < len(ss) and min(len(x), len(ss[k + 1])) < N:
                    add((p, -1 - k), x + ss[k + 1])
        for q, (text, _) in enumerate(self.questions):
            add((-1, q), text)
        self.units = units
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        o = np.concatenate(owner) if owner else np.empty(0, np.int64)
        order = np.argsort(g, kind="stable")
        self.keys, first = np.unique(g[order], return_index=True)
        self.owners, self.first = o[order], np.r_[first, len(g)]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, texts: list[str]) -> Iterator[tuple[int, set[int]]]:
        """Each text with a hit and the units that it may hold."""
        for a, b in spans(texts):
            yield from ((a + r, units) for r, units in self._hits(texts[a:b]))

    def _hits(self, texts: list[str]) -> Iterator[tuple[int, set[int]]]:
        joined = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        row = np.cumsum(joined == 0)
        keep = joined != 0
        c, row = joined[keep].astype(np.uint64), row[keep]
        h = hashes(c)
        found: dict[int, set[int]] = defaultdict(set)
        times: Counter[tuple[int, int]] = Counter()
        if len(h) and len(self.keys):
            at = np.flatnonzero((row[: len(h)] == row[N - 1 :]) & self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            real = self.keys[place] == h[at]
            for r, k in {*zip(row[at[real]].tolist(), place[real].tolist())}:
                times.update((r, u) for u in self.owners[self.first[k] : self.first[k + 1]].tolist())
        for (r, u), n in times.items():
            if n >= self.least[u]:
                found[r].add(u)
        for x, owners in self.short.items():
            for r, t in enumerate(texts):
                if x in t:
                    found[r].update(owners)
        yield from ((r, u) for r, u in found.items() if u)

    def held(self, text: str, hit: set[int]) -> list[tuple[list[int], int, int]]:
        """``(items, start, end)`` of what ``text`` (normalised) really holds among the units that it hits."""
        out, places, pairs = [], defaultdict(set), defaultdict(set)
        for u in hit:
            p, k = self.units[u]
            if p >= 0:
                (places if k >= 0 else pairs)[p].add(k if k >= 0 else -1 - k)
            elif (at := text.find(self.questions[k][0])) >= 0:
                out.append((self.questions[k][1], at, at + len(self.questions[k][0])))
        for p in places.keys() | pairs.keys():
            ss, items = self.passages[p]
            ks = places.get(p, set())
            for k in sorted({k for k in ks if k + 1 in ks} | pairs.get(p, set())):
                if span := aligned(ss[k], ss[k + 1], text):
                    out.append((items, *span))
        return out


def aligned(a: str, b: str, text: str) -> tuple[int, int] | None:
    """Where ``text`` holds the sentences ``a`` and ``b`` one after the other, but for single replaced words."""
    both = a + b
    at = text.find(both)
    if at >= 0:
        return at, at + len(both)
    # the stretch of the text around the windows that both share with it
    shared = [j - i for i in range(len(both) - N + 1) if (j := text.find(both[i : i + N])) >= 0]
    for start in sorted({round(d / 40) * 40 for d in shared}):
        low, high = max(0, start - 60), start + len(both) + 80
        window = text[low:high]
        blocks = [m for m in SequenceMatcher(None, both, window, False).get_matching_blocks() if m.size >= 3]
        if not blocks:
            continue
        gaps = [(0, blocks[0].a, 0)]  # start and end in the sentences, and length in the text
        gaps += [(m.a + m.size, n.a, n.b - m.b - m.size) for m, n in zip(blocks, blocks[1:])]
        last = blocks[-1]
        gaps.append((last.a + last.size, len(both), 0))
        if any(e - s > WORD or t > WORD + 4 for s, e, t in gaps):
            continue
        lost_a = sum(max(0, min(e, len(a)) - s) for s, e, _ in gaps)
        lost_b = sum(max(0, e - max(s, len(a))) for s, e, _ in gaps)
        begin, end = low + blocks[0].b - blocks[0].a, low + last.b + last.size + len(both) - last.a - last.size
        if lost_a <= REPLACED * len(a) and lost_b <= REPLACED * len(b) and begin >= 0 and end <= len(text):
            return begin, end
    return None


def _blocks(items: DataFrame, stock: set[str]) -> Iterator[HeldOut]:
    """The held-out texts in blocks of bounded size; what shares a text stays together."""
    passages: dict[str, list[int]] = defaultdict(list)
    questions: dict[str, list[int]] = defaultdict(list)
    size = 0
    for r in items.orderBy("passage", "item_id").toLocalIterator():
        if r.passage and r.passage not in passages and size > BLOCK_LETTERS:
            yield HeldOut(dict(passages), dict(questions))
            passages, questions, size = defaultdict(list), defaultdict(list), 0
        if r.passage and r.item_id not in passages[r.passage]:
            passages[r.passage].append(r.item_id)
            size += len(r.passage)
        q = letters(r.question or "")
        if q and q not in stock and r.item_id not in questions[q]:
            questions[q].append(r.item_id)
            size += len(q)
    if passages or questions:
        yield HeldOut(dict(passages), dict(questions))


def stock_questions(items: DataFrame, others: DataFrame | None) -> set[str]:
    """Wordings of held-out questions that several passages, held out or not, are asked about.

    Only wordings of ``items`` come back, so their number is bounded by its rows.
    """
    rough = F.lower(F.regexp_replace("question", r"[^\p{L}\p{N}]+", ""))
    asked = items.select(rough.alias("q"), F.xxhash64("passage").alias("p"))
    own = asked.select("q").where("q <> ''").distinct()
    seen = asked
    if others is not None:
        seen = seen.unionByName(others.select(rough.alias("q"), F.xxhash64("passage").alias("p")).join(own, "q", "left_semi"))
    # a passage near another is as good as another: only wordings on many passages or on several held-out ones are stock
    n = seen.groupBy("q").agg(F.count_distinct("p").alias("n")).where(F.col("n") > STOCK + 2)
    several = asked.groupBy("q").agg(F.count_distinct("p").alias("n")).where(F.col("n") >= STOCK)
    return {letters(r.q) for r in n.select("q").union(several.select("q")).where("q <> ''").distinct().collect()}


def _scan(docs: DataFrame, items: DataFrame, others: DataFrame | None, run, schema: str) -> DataFrame:
    spark, out = docs.sparkSession, None
    for block in _blocks(items.select("item_id", "passage", "question").where("item_id is not null"), stock_questions(items, others)):
        held = spark.sparkContext.broadcast(block)
        part = docs.mapInArrow(run(held), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def leaks(docs: DataFrame, items: DataFrame, others: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id``: each document that holds two consecutive sentences of an item's passage, or its question whole.

    ``others`` are further items whose questions show which wordings are stock. One narrow pass over the documents for
    each block of held-out texts; only the hits are shuffled, to drop repeated ones. Null and empty texts hold nothing,
    rows without an item id are left out, documents without an id come out with null, empty tables give no row.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, item = src.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def run(held):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, ids = held.value, batch.column(0).to_pylist()
                texts = [letters(t).replace("\0", "") if t else "" for t in batch.column(1).to_pylist()]
                pairs = {(ids[r], i) for r, hit in block.hits(texts) for found, _, _ in block.held(texts[r], hit) for i in found}
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], batch.schema.field(0).type), pa.array([b for _, b in pairs], pa.int64())], ["doc_id", "item_id"])

        return go

    return _scan(src, items, others, run, f"doc_id {kind}, item_id {item}").distinct()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the stretches of its normalised letters ``spans``, with the signs between their letters."""
    at: list[tuple[int, int]] = []
    for m in regex.finditer(r"\X", text):
        at += [m.span()] * len(letters(m.group()))
    out, last = [], 0
    for a, b in sorted(spans):
        if a < b <= len(at) and at[a][0] >= last:
            out.append(text[last : at[a][0]])
            last = regex.compile(r"[\p{P}\s]*").match(text, at[b - 1][1]).end()
        elif a < b <= len(at):
            last = max(last, at[b - 1][1])
    return "".join([*out, text[last:]])


def cleaned(docs: DataFrame, items: DataFrame, others: DataFrame | None = None, least_left: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, cut_letters`` of every document, with the held-out stretches removed; a document of which less than
    ``least_left`` of the letters is left is dropped. Documents that hold nothing are unchanged. Each block of held-out
    texts only notes its stretches; they are cut together at the end, so the blocks make no difference."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<bigint>").alias("places"))
    kind = src.schema["doc_id"].dataType.simpleString()
    for block in _blocks(items.select("item_id", "passage", "question").where("item_id is not null"), stock_questions(items, others)):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def go(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [letters(t).replace("\0", "") if t else "" for t in batch.column(1).to_pylist()]
                places = batch.column(2).to_pylist()
                for r, hit in held.value.hits(texts):
                    places[r] += [x for _, a, b in held.value.held(texts[r], hit) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.list_(pa.int64()))], ["doc_id", "text", "places"])

        src = src.mapInArrow(go, f"doc_id {kind}, text string, places array<bigint>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, lost, keep = batch.column(1).to_pylist(), [0] * len(batch), [True] * len(batch)
            for r, places in enumerate(batch.column(2).to_pylist()):
                if places:
                    size = len(letters(raw[r]))
                    raw[r] = without(raw[r], [*zip(places[::2], places[1::2])])
                    lost[r] = size - len(letters(raw[r]))
                    keep[r] = size - lost[r] >= least_left * size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string()), pa.array(lost, pa.int64())], ["doc_id", "text", "cut_letters"]).filter(pa.array(keep, pa.bool_()))

    return src.mapInArrow(cut, f"doc_id {kind}, text string, cut_letters bigint")
