"""Encoding of texts with a public byte-level BPE vocabulary, through a sentencepiece model written from its rank file.

The model is serialised directly: one piece per rank, its bytes mapped to letters from U+0100 on, its score the negative
rank, so that sentencepiece merges in rank order; normalisation is the identity. A text is cut into chunks at single
blanks, which no pre-token crosses, and each distinct chunk is split by the vocabulary's pattern and encoded once per
worker. Texts are encoded whole; decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import sys
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function that needs it.
TOKENIZERS = os.environ.get("TABULON_TOKENIZERS", "/opt/tokenizers")
#: The pattern that comes with the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks that a worker remembers before it starts anew.
REMEMBERED = 250_000

_BASE = 0x100
_MAP = {b: chr(_BASE + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, of a rank file with lines `base64 rank`."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _number(tag: int, value: int) -> bytes:
    return _varint(tag << 3) + _varint(value)


def _blob(tag: int, value: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(value)) + value


def letters(data: bytes) -> str:
    """Bytes as the letters that stand for them in the model."""
    return data.decode("latin-1").translate(_MAP)


def write_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last.

    Tags are those of sentencepiece's public model schema: pieces 1 (piece 1, score 2, type 3), trainer 2 (model type 3,
    vocabulary size 4, ids of unknown, begin, end and padding 40 to 43), normaliser 3 (name 1, dummy prefix 3, blanks 4 and 5).
    """
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _blob(1, _blob(1, letters(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _blob(1, _blob(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    none = (1 << 64) - 1
    out += _blob(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(t, none) for t in (41, 42, 43)))
    out += _blob(3, _blob(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Encoder:
    """Encodes texts with a model from write_model(). Chunks seen before cost one look-up."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.runs = re.compile(r"\s\s").search
        self.known: dict[str, list[int]] = {}
        self.tokens: dict[str, list[int]] = {}

    def pre_tokens(self, parts: list[str]) -> list[list[int]]:
        new = [p for p in dict.fromkeys(parts) if p not in self.tokens]
        if new:
            if len(self.tokens) > REMEMBERED:
                self.tokens.clear()
                new = list(dict.fromkeys(parts))
            self.tokens.update(zip(new, self.pieces.encode([letters(p.encode("utf-8", "replace")) for p in new])))
        return [self.tokens[p] for p in parts]

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text whose encodings simply follow each other.

        No pre-token holds a blank behind another character, so a blank between two others that aren't blank starts a
        new one. Texts with two white-space characters in a row are one chunk.
        """
        if self.runs(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def look_up(self, chunks: list[str]) -> dict[str, list[int]]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            split = [self.split(c) for c in new]
            ids = iter(self.pre_tokens(list(chain.from_iterable(split))))
            for c, parts in zip(new, split):
                known[c] = list(chain.from_iterable(next(ids) for _ in parts))
        return known

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        c = self.chunks(text)
        return list(chain.from_iterable(map(self.look_up(c).__getitem__, c)))


def encoder(model: bytes) -> Encoder:
    """The worker's encoder for a model, kept for its later tasks."""
    kept = sys.__dict__.setdefault("_tabulon_encoders", {})
    key = hash(model)
    if key not in kept:
        kept[key] = Encoder(model)
    return kept[key]


def model_of(vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    return write_model(read_ranks(os.path.join(folder, f"{vocabulary}.tiktoken")))


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` (default: all but the text) and `ids` (array<int>), without special tokens.

    Null and empty texts have the empty list. Texts are never cut. Strings of special tokens are ordinary text. A column
    of df named like `ids` is replaced. The model is one broadcast value, as large as the vocabulary.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in (text, ids)]
    model = df.sparkSession.sparkContext.broadcast(model_of(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                split = [e.chunks(t) if t else [] for t in _texts(part.column(part.num_columns - 1))]
                known = e.look_up(list(chain.from_iterable(split)))
                per = [list(map(known.__getitem__, c)) for c in split]
                sizes = [sum(map(len, p)) for p in per]
                values = np.fromiter(chain.from_iterable(chain.from_iterable(per)), np.int32, sum(sizes))
                out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], names=[*keep, ids])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{ids}` array<int>"])
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, count: str = "n_tokens", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` (default: all but the text) and the number of tokens; 0 for null and empty texts."""
    keep = keep if keep is not None else [c for c in df.columns if c not in (text, count)]
    model = df.sparkSession.sparkContext.broadcast(model_of(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                split = [e.chunks(t) if t else [] for t in _texts(part.column(part.num_columns - 1))]
                known = e.look_up(list(chain.from_iterable(split)))
                sizes = [sum(len(known[c]) for c in cs) for cs in split]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, count])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{count}` bigint"])
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _decoded(table: list[bytes], ids) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def decode(df: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """df with the text its ids stand for. Empty lists give the empty text, null lists null."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(os.path.join(folder, f"{vocabulary}.tiktoken")))

    @F.pandas_udf("string")
    def back(lists: pd.Series) -> pd.Series:
        return lists.map(partial(_decoded, tokens.value), na_action="ignore")

    return df.withColumn(text, back(F.col(ids)))


def rate(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
