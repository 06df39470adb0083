"""Byte-level BPE encoding and decoding.

A piece of the pattern is merged with a segment tree over its byte positions: a leaf holds
the rank of the pair that starts there, an inner node the least of its leaves, ties to the
left, so the root names the next merge; a merge updates three leaves, of the part and its
live neighbours, each in a logarithm of the piece's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces that a worker remembers; beyond that it starts anew. Results don't depend on it.
REMEMBERED = 600_000
NONE = 1 << 62


def merge(piece: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """The ids of a piece; every single byte must have a rank."""
    n = len(piece)
    if piece in rank_of:
        return [rank_of[piece]]
    if n < 2:
        return [rank_of[piece[i : i + 1]] for i in range(n)]
    size = 1 << (n - 2).bit_length()  # leaves: n - 1 pairs
    shift = size.bit_length()
    low = (1 << shift) - 1
    get = rank_of.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            if b < a:
                a = b
            if tree[at] == a:
                return
            tree[at] = a
            at >>= 1

    while (top := tree[1]) != NONE:
        i = top & low
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        put(j, NONE) if j < size else None
        r = get(piece[i : after[k]]) if k < n else None
        put(i, NONE if r is None else r << shift | i)
        p = before[i]
        if p >= 0:
            r = get(piece[p:k])
            put(p, NONE if r is None else r << shift | p)
    out, i = [], 0
    while i < n:
        out.append(rank_of[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Piece -> its ids as little-endian bytes, worked out when first asked for."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            self.rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.rank_of.items()}
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.rank_of), dtype="<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One a worker: the vocabulary is a file of fixed size that every executor has."""
    return Encoder(path, pattern)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array, if with_ids), ids_sha256, decoded_sha256.

    The ids are decoded again and decoded_sha256 is of those bytes. Null and empty texts have
    no ids. Equal rows get equal results; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in sliced(batches, 500):
            found, n, hashed, back = [], [], [], []
            for t in b.column(1):
                ids = e.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                hashed.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(e.decode(ids)).hexdigest())
                if with_ids:
                    found.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), with_ids=False)
