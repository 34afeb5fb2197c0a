"""Tokenizers of public libraries over tables: any object that encodes and decodes in batches.

A factory makes the tokenizer in the worker from bytes that are broadcast (a model file: bounded whatever the corpus), so
nothing needs to be installed or opened on the executors but the library. Libraries are imported only where they are used.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("MORU_TOKENIZERS", "/opt/tokenizers")


class Tokenizer(Protocol):
    """What the operators need of a tokenizer."""

    pad: int
    bos: int
    eos: int

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[list[int]]) -> list[str]: ...


class Ranks:
    """A byte-level rank file with three special tokens after its ids: padding, start and end."""

    def __init__(self, data: bytes, pattern: str | None = None) -> None:
        import base64

        import tiktoken

        # Fixed value: the pattern that splits text before the merges of these files.
        pattern = pattern or r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        n = max(ranks.values()) + 1
        self.pad, self.bos, self.eos = n, n + 1, n + 2
        self.inner = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<pad>": n, "<bos>": n + 1, "<eos>": n + 2})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.inner.encode_ordinary(t) for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.inner.decode([i for i in x if i < self.pad]) for x in ids]


class Pieces:
    """A SentencePiece model; unknown and control pieces aren't decoded."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pad, self.bos, self.eos = max(self.inner.pad_id(), 0), self.inner.bos_id(), self.inner.eos_id()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.inner.encode(texts, num_threads=1) if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.inner.decode([i for i in x if not self.inner.is_control(i)]) for x in ids]


_MADE: dict[tuple[str, int], Tokenizer] = {}


def _made(make: Callable[[bytes], Tokenizer], data: bytes) -> Tokenizer:
    key = (make.__name__, hash(data))
    if key not in _MADE:
        _MADE[key] = make(data)
    return _MADE[key]


def file_bytes(name: str, directory: str | None = None) -> bytes:
    with open(os.path.join(directory or TOKENIZER_DIR, name), "rb") as f:
        return f.read()


def encode(df: DataFrame, make: Callable[[bytes], Tokenizer], data: bytes, id_col: str, text: str = "text", bos: bool = False, eos: bool = False) -> DataFrame:
    """``id_col, ids`` in one narrow pass; null and empty texts have no ids but the ends asked for."""
    held = df.sparkSession.sparkContext.broadcast(data)
    src = df.select(F.col(id_col), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _made(make, held.value)
        head, tail = [t.bos] * bos, [t.eos] * eos
        for batch in batches:
            ids = [head + x + tail for x in t.encode([x or "" for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [batch.schema.names[0], "ids"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, make: Callable[[bytes], Tokenizer], data: bytes, id_col: str, ids: str = "ids") -> DataFrame:
    """``id_col, text`` in one narrow pass; null ids give an empty text."""
    held = df.sparkSession.sparkContext.broadcast(data)
    src = df.select(F.col(id_col), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _made(make, held.value)
        for batch in batches:
            texts = t.decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")


def round_trips(df: DataFrame, make: Callable[[bytes], Tokenizer], data: bytes, id_col: str, text: str = "text") -> DataFrame:
    """One row ``texts, same``: how many texts come back, white space aside."""
    back = decode(encode(df, make, data, id_col, text), make, data, id_col).withColumnRenamed("text", "_back")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    both = df.where(F.col(text).isNotNull()).select(id_col, F.col(text).alias("_was")).join(back, id_col)
    return both.agg(F.count("*").alias("texts"), F.count_if(bare("_was") == bare("_back")).alias("same"))
