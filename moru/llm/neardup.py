"""Near-duplicate items by pigeonring filtering (problem 3).

A text counts as the set of its runs of three letters or digits; two texts of a and b runs with a similarity of t differ
in at most ``(1-t)/(1+t)·(a+b)`` of them. A third of all runs may differ, so the boxes of the plain pigeonhole over the run space
hold one to three runs each, and nearly any two texts agree in some box. The ring is therefore indexed over sketches: the
minima of many permutations of the run space stand on it in consecutive segments, and two texts of which one segment
agrees are candidates. A candidate is then laid on the ring of ``RING`` segments of the run space itself: if the whole
difference is within its budget, some segment starts a chain whose cumulative differences stay within the proportional
budget at every length. Pairs without such a chain are pruned; the full Hamming distance of the sets decides over the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moru.session import broadcast_if_small, checkpoint

#: Segments of a sketch and minima of a segment. Two texts of similarity t agree in no segment with a probability of
#: ``(1 - t**ROWS) ** SEGMENTS``: 2e-3 at 0.7, 3e-5 at 0.75, 4e-8 at 0.8, wherever they differ and in whatever order.
SEGMENTS, ROWS = 72, 7
#: Texts that may agree in a segment before they are told apart by the longer segments of a second sketch (6e-3 at 0.7).
SHARED = 200
FINE_SEGMENTS, FINE_ROWS = 180, 10
RING = 16
#: Signs whose arrays are in memory at once.
LETTERS = 3_000_000
#: Distinct questions on one passage before their pairs are found through rare runs.
QUESTIONS = 64

_ALNUM: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _ALNUM[0]


def spans(texts: list[str], most: int = LETTERS) -> Iterator[tuple[int, int]]:
    """Stretches of ``texts`` with at most ``most`` signs together; a longer text is a stretch of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def codes(text: str) -> np.ndarray:
    """The letters and digits of ``text`` as code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return c[_alnum()[c]]


def runs(text: str) -> np.ndarray:
    """The set of all runs of three consecutive letters or digits, sorted; a code holds the three exactly."""
    c = codes(text).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]) if len(c) >= 3 else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers without structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(g: np.ndarray, segments: int, rows: int) -> np.ndarray:
    """The segments of a text's sketch: each the hash of the minima of ``rows`` permutations of its runs ``g`` (mixed)."""
    salt = mixed(np.arange(1, segments * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rows))
    odd = (salt >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = np.full(segments * rows, 0xFFFFFFFF, np.uint32)
    x = (g >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, (x[i : i + 4096, None] * odd[None, :]).min(axis=0), out=low)
    low = low.reshape(segments, rows).astype(np.uint64)
    key = np.arange(segments, dtype=np.uint64) + np.uint64(rows) * np.uint64(0x100000001B3)
    for j in range(rows):
        key = mixed(key + low[:, j])
    return key


def _sketches(segments: int, rows: int):
    """``seg, pid`` for each segment of the sketch of each text; texts without a run have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            pid, first = np.unique(pid, return_index=True)  # equal passages of a batch count once
            for a in range(0, len(pid), 2000):
                keys, ids = [], []
                for p, t in zip(pid[a : a + 2000], texts.take(pa.array(first[a : a + 2000])).to_pylist()):
                    g = runs(t)
                    if len(g):
                        keys.append(sketch(mixed(g), segments, rows))
                        ids.append(p)
                seg = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(np.repeat(np.array(ids, np.int64), segments))], ["seg", "pid"])

    return run


_PAIRS = ["seg", "p1", "p2"]


def _batch(seg: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (seg, a, b)], _PAIRS)


def _pairs(most: int):
    """``0, p1, p2`` for the pairs of the texts of each segment, from rows sorted by segment and text. Of a segment with
    more than ``most`` texts come out ``seg, pid, pid`` for each instead."""

    def emit(seg: np.ndarray, pid: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.empty(0, np.int64)
        size = np.diff(np.r_[start, len(seg)])
        big = np.repeat(size > most, size)
        if big.any():
            yield _batch(seg[big], pid[big], pid[big])
        seg, pid = seg[~big], pid[~big]
        a, b, n = [], [], 0
        for d in range(1, len(seg)):  # each with the d-th after it, while any segment is that long
            same = seg[d:] == seg[:-d]
            if not same.any():
                break
            a.append(pid[:-d][same])
            b.append(pid[d:][same])
            n += len(a[-1])
            if n > 500_000:
                yield _batch(np.zeros(n, np.int64), np.concatenate(a), np.concatenate(b))
                a, b, n = [], [], 0
        if n:
            yield _batch(np.zeros(n, np.int64), np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, pid = np.empty(0, np.int64), np.empty(0, np.int64)
        held = False  # the start of a segment with too many texts has been given out already
        for batch in batches:
            seg = np.r_[seg, batch.column(0).to_numpy(zero_copy_only=False)]
            pid = np.r_[pid, batch.column(1).to_numpy(zero_copy_only=False)]
            fresh = np.r_[True, (seg[1:] != seg[:-1]) | (pid[1:] != pid[:-1])] if len(seg) else np.empty(0, bool)
            seg, pid = seg[fresh], pid[fresh]
            cut = int(np.searchsorted(seg, seg[-1])) if len(seg) else 0
            if cut:
                if held:
                    more = int(np.searchsorted(seg, seg[0], "right"))
                    yield _batch(seg[:more], pid[:more], pid[:more])
                    seg, pid, cut, held = seg[more:], pid[more:], cut - more, False
                if cut > 0:
                    yield from emit(seg[:cut], pid[:cut])
                    seg, pid = seg[cut:], pid[cut:]
            if len(seg) > 50 * most:
                yield _batch(seg[:-1], pid[:-1], pid[:-1])
                seg, pid, held = seg[-1:], pid[-1:], True
        if len(seg):
            if held:
                yield _batch(seg, pid, pid)
            else:
                yield from emit(seg, pid)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``seg, pid, i, j, part`` sorted by ``seg, i, j``, of which each group has two parts of bounded size: the pairs between
    the parts, or within the one part where ``i = j``."""
    rest = pa.table({k: pa.array([], t) for k, t in (("seg", pa.int64()), ("pid", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()))})

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        seg, pid, i, j, part = (t.column(k).to_numpy() for k in ("seg", "pid", "i", "j", "part"))
        edge = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True]) if len(seg) else []
        for a, b in zip(edge, edge[1:]):
            x = np.unique(pid[a:b][part[a:b] == i[a]])
            y = np.unique(pid[a:b][part[a:b] == j[a]])
            for p in x:
                z = y[y > p] if i[a] == j[a] else y
                yield _batch(np.zeros(len(z), np.int64), np.minimum(p, z), np.maximum(p, z))

    for batch in batches:
        t = pa.concat_tables([rest, pa.Table.from_batches([batch]).cast(rest.schema)])
        seg, i, j = (t.column(k).to_numpy() for k in ("seg", "i", "j"))
        last = np.flatnonzero((seg != seg[-1]) | (i != i[-1]) | (j != j[-1])) if len(seg) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        yield from emit(t.slice(0, cut))
        rest = t.slice(cut)
    yield from emit(rest)


def _sharing(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("seg").sortWithinPartitions("seg", "pid")
    return checkpoint(ordered.mapInArrow(_pairs(SHARED), "seg long, p1 long, p2 long").distinct())


def _in_parts(hot: DataFrame) -> DataFrame:
    """The pairs of the texts of segments ``seg, pid`` that even the finer sketch leaves large, part by part: a group goes
    to as many tasks as it has pairs of parts, each with at most two parts of about ``SHARED * 10`` texts."""
    n = hot.groupBy("seg").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / (SHARED * 10)).cast("int"))
    rows = hot.join(n, "seg").withColumn("part", F.pmod(F.xxhash64("pid"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("seg", "pid", F.least("part", "other").cast("int").alias("i"), F.greatest("part", "other").cast("int").alias("j"), "part")
    return rows.repartition("seg", "i", "j").sortWithinPartitions("seg", "i", "j").mapInArrow(_across, "seg long, p1 long, p2 long").select("p1", "p2")


def ring_words(g: np.ndarray) -> np.ndarray:
    """The runs on the ring: a bitmap of 64 bits for each of the ``RING`` segments of the run space."""
    h = mixed(g)
    words = np.zeros(RING, np.uint64)
    np.bitwise_or.at(words, (h % np.uint64(RING)).astype(np.int64), np.uint64(1) << ((h >> np.uint64(8)) & np.uint64(63)))
    return words


def on_ring(a: np.ndarray, b: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For each row of two arrays of ring words: a chain of segments within the proportional budgets exists.

    Differing bits are at most the differing runs, so no pair within ``budget`` is pruned.
    """
    d = np.bitwise_count(a ^ b).astype(np.int64)
    total = np.zeros_like(d)
    alive = np.ones(d.shape, bool)
    for n in range(RING):
        total = total + np.roll(d, -n, axis=1)
        alive &= total * RING <= (n + 1) * budget[:, None]
    return alive.any(axis=1)


def budget(n1: np.ndarray, n2: np.ndarray, least: float) -> np.ndarray:
    """In how many runs two sets of ``n1`` and ``n2`` may differ at a similarity of ``least``."""
    return np.floor((1 - least) / (1 + least) * (n1 + n2) + 1e-9).astype(np.int64)


def alike(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Which pairs of texts have a similarity of at least ``least``."""
    memory: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of(t: str) -> tuple[np.ndarray, np.ndarray]:
        if t not in memory:
            g = runs(t)
            memory[t] = (g, ring_words(g))
        return memory[t]

    if not a:
        return np.empty(0, bool)
    x, y = [of(t) for t in a], [of(t) for t in b]
    n1, n2 = np.array([len(g) for g, _ in x]), np.array([len(g) for g, _ in y])
    ok = (np.minimum(n1, n2) >= least * np.maximum(n1, n2) - 1e-9) & (n1 > 0) & (n2 > 0)
    ok &= on_ring(np.array([w for _, w in x]), np.array([w for _, w in y]), budget(n1, n2, least))
    for i in np.flatnonzero(ok):
        shared = len(np.intersect1d(x[i][0], y[i][0], assume_unique=True))
        ok[i] = shared >= least * (n1[i] + n2[i] - shared) - 1e-9
    none = (n1 == 0) & (n2 == 0)
    return ok | (none & np.array([bool(np.array_equal(codes(s), codes(t))) for s, t in zip(a, b)]) if none.any() else ok)


def _alike(keep: int, least: float):
    """Rows of ``keep`` columns and two texts: the columns of the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist()
            ok = np.concatenate([alike(x[a:b], y[a:b], least) for a, b in spans([*map("".join, zip(x, y))])] or [np.empty(0, bool)])
            yield pa.RecordBatch.from_arrays(batch.columns[:keep], batch.schema.names[:keep]).filter(pa.array(ok))

    return run


def _rare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Half of a question's runs, by an order common to all: two questions that share half of their runs share one of these."""
    for batch in batches:
        pid, qid, run = [], [], []
        for p, q, t in zip(*(c.to_pylist() for c in batch.columns)):
            g = np.sort(mixed(runs(t)))
            g = g[: len(g) - (len(g) + 1) // 2 + 1]
            pid += [p] * len(g)
            qid += [q] * len(g)
            run += g.view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(qid, pa.int64()), pa.array(run, pa.int64())], ["pid", "qid", "run"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pid, n, words``: how many runs each text has and its bitmaps on the ring."""
    for batch in batches:
        pid, n, words = [], [], []
        for p, t in zip(*(c.to_pylist() for c in batch.columns)):
            g = runs(t)
            pid.append(p)
            n.append(len(g))
            words.append(ring_words(g).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(n, pa.int32()), pa.array(words, pa.binary())], ["pid", "n", "words"])


def _on_ring(least: float):
    """Rows ``p1, p2, n1, n2, w1, w2``: the pairs with a chain within the budgets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            w1, w2 = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, RING) for k in (4, 5))
            ok = (np.minimum(n1, n2) >= least * np.maximum(n1, n2) - 1e-9) & on_ring(w1, w2, budget(n1, n2, least))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["p1", "p2"]).filter(pa.array(ok))

    return run


def candidates(texts: DataFrame) -> DataFrame:
    """``p1 < p2``: the pairs of texts of ``texts`` (``pid, text``) whose sketches agree in a segment.

    A segment in which more than ``SHARED`` texts agree gives no pairs; its texts are compared by the finer sketch
    instead, and what agrees there is paired in parts of bounded size, so no task holds a group and no pair is left out.
    """
    shared = _sharing(texts.mapInArrow(_sketches(SEGMENTS, ROWS), "seg long, pid long"))
    pairs, hot = shared.where("p1 < p2").select("p1", "p2"), shared.where("p1 = p2").select(F.col("p1").alias("pid")).distinct()
    if hot.isEmpty():
        return pairs
    fine = texts.join(hot, "pid", "left_semi").mapInArrow(_sketches(FINE_SEGMENTS, FINE_ROWS), "seg long, pid long")
    refined = _sharing(fine)
    large = _in_parts(refined.where("p1 = p2").select("seg", F.col("p1").alias("pid")))
    return checkpoint(pairs.unionByName(refined.where("p1 < p2").select("p1", "p2")).unionByName(large).distinct())


def _of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose texts are in ``pairs``."""
    ids = checkpoint(pairs.select(F.explode(F.array("p1", "p2")).alias("pid")).distinct())
    return texts.join(broadcast_if_small(ids, ids.count()), "pid", "left_semi")


def passage_pairs(texts: DataFrame, least: float) -> DataFrame:
    """``p1 < p2``: the pairs of different texts of ``texts`` (``pid, text``) with a similarity of at least ``least``.

    The bitmaps of the ring, of a fixed size, go to the candidates; whole texts go only to the pairs with a chain.
    """
    pairs = candidates(texts)
    words = _of(texts, pairs).mapInArrow(_words, "pid long, n int, words binary").groupBy("pid").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    words = checkpoint(words)
    laid = pairs.join(words.toDF("p1", "n1", "w1"), "p1").join(words.toDF("p2", "n2", "w2"), "p2").select("p1", "p2", "n1", "n2", "w1", "w2")
    chained = checkpoint(laid.mapInArrow(_on_ring(least), "p1 long, p2 long"))
    need = checkpoint(_of(texts, chained).groupBy("pid").agg(F.first("text").alias("text")))
    both = chained.join(need.toDF("p1", "t1"), "p1").join(need.toDF("p2", "t2"), "p2").select("p1", "p2", "t1", "t2")
    return both.mapInArrow(_alike(2, least), "p1 long, p2 long")


def near_links(df: DataFrame, passage_least: float = 0.7, question_least: float = 0.5, id_col: str = "item_id", passage_col: str = "passage", question_col: str = "question") -> DataFrame:
    """The members ``item_id, pid, qid`` and links ``p1, q1, p2, q2`` of the classes of items with equal passage and question.

    Linked are classes whose passages share at least ``passage_least`` and whose questions at least ``question_least`` of the runs
    that occur in either, each two once; a class of several items is linked to itself. No copies are expanded.  Rows with a null id or a
    passage without a letter or digit are in no class; a null question is an empty text, questions too short for a run are alike
    when they have the same letters, passages too short for one when they are the same string. Repeated rows and second deliveries add nothing, an empty table gives no pair.
    """
    src = df.select(F.col(id_col).alias("item_id"), F.col(passage_col).alias("text"), F.coalesce(F.col(question_col), F.lit("")).alias("question"))
    src = src.where(F.col("text").rlike(r"[\p{L}\p{N}]") & F.col("item_id").isNotNull()).withColumn("pid", F.xxhash64("text")).withColumn("qid", F.xxhash64("question"))
    edges = checkpoint(passage_pairs(src.select("pid", "text"), passage_least))
    members = checkpoint(src.select("item_id", "pid", "qid", "question").distinct())
    several = members.groupBy("pid").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a < b").select(F.col("pid").alias("p1"), F.col("pid").alias("p2"))
    edges = edges.unionByName(several)

    asked = members.groupBy("pid", "qid").agg(F.first("question").alias("question"))
    width = asked.groupBy("pid").agg(F.count("*").alias("n")).where(F.col("n") > QUESTIONS).select("pid")
    wide = checkpoint(width)
    same_q = F.col("a.qid") == F.col("b.qid")
    if wide.isEmpty():
        small, large = edges, None
    else:
        is_wide = edges.join(wide.select(F.col("pid").alias("p1"), F.lit(1).alias("w1")), "p1", "left").join(wide.select(F.col("pid").alias("p2"), F.lit(1).alias("w2")), "p2", "left")
        small, large = is_wide.where("w1 is null or w2 is null").select("p1", "p2"), is_wide.where("w1 = 1 and w2 = 1").select("p1", "p2")
    a, b = asked.alias("a"), asked.alias("b")
    cols = [F.col("p1"), F.col("a.qid").alias("q1"), F.col("p2"), F.col("b.qid").alias("q2")]
    joined = small.join(a, F.col("p1") == F.col("a.pid")).join(b, F.col("p2") == F.col("b.pid"))
    joined = joined.where((F.col("p1") < F.col("p2")) | (F.col("a.qid") <= F.col("b.qid"))).select(*cols, F.col("a.question").alias("s1"), F.col("b.question").alias("s2"))
    if large is not None:  # many questions on both passages: only those with a rare run in common
        rare = asked.join(wide, "pid", "left_semi").select("pid", "qid", "question").mapInArrow(_rare_runs, "pid long, qid long, run long")
        x, y = rare.alias("a"), rare.alias("b")
        keys = large.join(x, F.col("p1") == F.col("a.pid")).join(y, (F.col("p2") == F.col("b.pid")) & (F.col("a.run") == F.col("b.run"))).where((F.col("p1") < F.col("p2")) | (F.col("a.qid") <= F.col("b.qid"))).select(*cols).distinct()
        keys = keys.unionByName(large.join(a, F.col("p1") == F.col("a.pid")).join(b, (F.col("p2") == F.col("b.pid")) & same_q).select(*cols)).distinct()
        text = asked.select("pid", "qid", "question")
        far = keys.join(text.toDF("p1", "q1", "s1"), ["p1", "q1"]).join(text.toDF("p2", "q2", "s2"), ["p2", "q2"])
        joined = joined.unionByName(far.select(*joined.columns))
    kinds = checkpoint(joined.mapInArrow(_alike(4, question_least), "p1 long, q1 long, p2 long, q2 long"))
    return members.select("item_id", "pid", "qid"), kinds


def near_pairs(df: DataFrame, passage_least: float = 0.7, question_least: float = 0.5, id_col: str = "item_id", passage_col: str = "passage", question_col: str = "question") -> DataFrame:
    """``item_a < item_b``: all pairs of different items of linked classes (see ``near_links``); the links are expanded at the end."""
    ids, kinds = near_links(df, passage_least, question_least, id_col, passage_col, question_col)
    out = (
        kinds.join(ids.toDF("a", "p1", "q1"), ["p1", "q1"]).join(ids.toDF("b", "p2", "q2"), ["p2", "q2"]).where("a <> b")
        .select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
    )
    return out.distinct()


def near_classes(df: DataFrame, passage_least: float = 0.7, question_least: float = 0.5, id_col: str = "item_id", passage_col: str = "passage", question_col: str = "question") -> DataFrame:
    """``item_id, class_id, links``: each item with a passage, the class of those equal to it, and how many other items it is alike to.

    The links are counted by the sizes of the classes, so a group of copies of any size gives as many rows as it has items.
    An item that is delivered with several texts has a row for each.
    """
    ids, kinds = near_links(df, passage_least, question_least, id_col, passage_col, question_col)
    size = checkpoint(ids.groupBy("pid", "qid").agg(F.count_distinct("item_id").alias("n"), F.min("item_id").alias("class_id")))
    sides = kinds.unionByName(kinds.select(F.col("p2").alias("p1"), F.col("q2").alias("q1"), F.col("p1").alias("p2"), F.col("q1").alias("q2"))).distinct()
    sides = sides.where("not (p1 = p2 and q1 = q2)").join(size.select(F.col("pid").alias("p2"), F.col("qid").alias("q2"), "n"), ["p2", "q2"])
    linked = sides.groupBy(F.col("p1").alias("pid"), F.col("q1").alias("qid")).agg(F.sum("n").alias("others"))
    classes = size.join(linked, ["pid", "qid"], "left").select("pid", "qid", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return ids.distinct().join(classes, ["pid", "qid"]).select("item_id", "class_id", "links")
