"""Byte-level BPE over a public rank file (problem 6).

A word's merges run on a contiguous rank array: the boundaries of its parts and, beside them, the rank of each pair of
adjacent parts. The array is scanned for its minimum, that boundary is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. For the short words that make up nearly all text this beats a heap; a word longer
than ``LONG`` bytes (text written without spaces) goes through a heap with the same order of merges, so that its cost
doesn't grow with the square of its length.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("MORU_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text into words before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word of more bytes is merged through a heap.
LONG = 128
#: Words that a worker remembers with their ids; the memory is emptied when it is full.
REMEMBERED = 200_000
NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines ``base64(token) rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``word`` by the contiguous rank array."""
    get = ranks.get
    cut = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == NONE:
            break
        i = pair.index(low)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[cut[i] : cut[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[cut[i - 1] : cut[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order (lowest rank, then leftmost) with a heap and a linked list of parts."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : after[j]])) is not None:
            heapq.heappush(heap, (rank, i, after[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


class RankBPE:
    """Encoder of one rank file. Strings that look like special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.words, self.memory = ranks, regex.compile(pattern), {}

    def word(self, word: str) -> list[int]:
        ids = self.memory.get(word)
        if ids is None:
            data = word.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else (merge_short if len(data) <= LONG else merge_long)(data, self.ranks)
            if len(word) <= 64:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; null and empty texts have none."""
        out: list[int] = []
        if text:
            word = self.word
            for w in self.words.findall(text):
                out += word(w)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        word = self.word
        return sum([len(word(w)) for w in self.words.findall(text)])


_ENCODERS: dict[int, RankBPE] = {}


def encoder(data: bytes) -> RankBPE:
    """The encoder of a rank file's bytes, made once a worker."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = RankBPE(read_ranks(data))
    return _ENCODERS[key]


def rank_bytes(directory: str | None = None, name: str = RANK_FILE) -> bytes:
    """A rank file's bytes, read on the driver and broadcast: under 1 MB whatever the corpus."""
    with open(os.path.join(directory or TOKENIZER_DIR, name), "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of the unchanged text, without special tokens.

    One narrow pass over the two columns; no shuffle. Null and empty texts get an empty list. Rows are kept as they are:
    repeated rows come out repeated, an empty table gives an empty one, null ids stay null, other columns are ignored.
    Texts of any length are encoded whole.
    """
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str, *keep: str, directory: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens long`` of every row, in one narrow pass; null and empty texts have 0 tokens."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(ranks.value).count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], [*batch.schema.names[1:], "n_tokens"])

    src = df.select(F.col(text_col).alias("_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{kinds}, n_tokens bigint")
