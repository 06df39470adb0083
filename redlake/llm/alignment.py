"""Alignment of two tokenizers' tokens over the same bytes.

The tokens of both are sorted by where they start, the running maximum of their ends is
taken, and a group ends where the next start reaches it: both tokenizers have a token end
there. Within groups the overlapping pairs of tokens are expanded, and those that end
together are links. Links are counted over the whole corpus by pairs of ids.

A text is cut before spaces that follow a word. Neither tokenizer has a token across such a
cut (see `Aligner`), so the parts are encoded and aligned by themselves, many at once, and
parts that come again need no second encoding.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, written

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")
#: Parts that a worker remembers, and their characters; beyond that it starts anew. Results don't depend on it.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8 << 20
#: A pair of ids with this share of all links or more is looked up in a broadcast table, which has so many rows at most.
FREQUENT = 100_000
#: Letters of scripts whose classes no version of Unicode has changed: parts of these alone, if no longer than this, are encoded from the ranks.
_SURE, SHORT = re.compile(r"[\x00-\u024F\u0391-\u03A1\u03A3-\u03CE\u0400-\u045F\u2010-\u2027\u20AC]*"), 1000
#: What any of the libraries may take for white space.
_GAP = r"\s\x1c-\x1f\x85᠎​⁠﻿"
_ENDS = frozenset(chr(c) for c in range(0x10000) if re.match(f"[{_GAP}]", chr(c)))
_PART = re.compile(rf"[{_GAP}]*+[^{_GAP}]++(?:(?! )[{_GAP}]++[^{_GAP}]++)*+(?:[{_GAP}]++\Z)?|[{_GAP}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token; a and b: rows of (start, end), each in order."""
    start, end = np.concatenate([a[:, 0], b[:, 0]]), np.concatenate([a[:, 1], b[:, 1]])
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.concatenate([[0], np.cumsum(start[order][1:] >= reached[:-1])]) if len(order) else order
    return group[: len(a)], group[len(a) :]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of an A token and a B token that share a byte, in order."""
    low, high = np.searchsorted(b[:, 1], a[:, 0], "right"), np.searchsorted(b[:, 0], a[:, 1], "left")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(a)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]


class Aligner:
    """Both tokenizers, and what is known of the parts met so far.

    A's pattern takes a space only with what follows it, so no A token goes over a cut; B is
    cut only if none of its pieces has a space after another letter. Texts stay whole if B
    has such pieces.

    If A's vocabulary gives each of its entries back as that one token, merging by the
    entries' ranks is the same as merging by its list of pairs: parts that stay next to each
    other are merged as they would be alone, and alone the listed pair is what is left. Then
    ordinary parts are encoded many at once from the ranks.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        ranks, self.bytes_a = {}, [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            plain = i not in self.a.get_added_tokens_decoder() and all(c in letters for c in piece)
            self.bytes_a[i] = bytes(letters[c] for c in piece) if plain else piece.encode()
            if plain:
                ranks[self.bytes_a[i]] = i
        own = all(len(t) == 1 and t[0].id == i for i, t in ((i, self.a.model.tokenize(piece)) for piece, i in self.a.get_vocab().items() if ranks.get(self.bytes_a[i]) == i))
        self.ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if own else None
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in of], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        most = max(len(pieces), len(self.bytes_a))
        self.written = [f"{i}{c}" for c in ",|;" for i in range(most)]  # an id and what follows it
        self.most = most
        self.cut = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.at, self.chars, self.groups = {}, 0, []
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # A tokens, B tokens, groups, whether the bytes are the text's
        self.first, self.pairs = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def parts(self, text: str) -> list[str]:
        return _PART.findall(" " + text) if self.cut else [" " + text]

    def encode_a(self, parts: list[str], size: np.ndarray, ranked: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of A and how many each part has; the first `ranked` parts are encoded from the ranks, as one text."""
        flat = np.array(self.ranked.encode_ordinary("".join(parts[:ranked])) if ranked else [], dtype=np.int64)
        n = np.diff(np.searchsorted(np.cumsum(self.size_a[flat]), np.cumsum(size[:ranked]), "right"), prepend=0)
        rest = [e.ids for e in self.a.encode_batch_fast(parts[ranked:], add_special_tokens=False)]
        return np.concatenate([flat, np.array(list(chain.from_iterable(rest)), dtype=np.int64)]), np.concatenate([n, np.array([len(x) for x in rest], dtype=np.int64)])

    def learn(self, parts: list[str]) -> None:
        """Encodes and aligns parts, each of which begins with a space."""
        sure = [self.ranked is not None and len(p) <= SHORT and p[-1] not in _ENDS and _SURE.fullmatch(p) is not None for p in parts]
        ranked = sum(sure)
        if ranked < len(parts):
            parts = [p for p, x in zip(parts, sure, strict=True) if x] + [p for p, x in zip(parts, sure, strict=True) if not x]
        each = [p.encode("utf-8", "surrogatepass") for p in parts]
        size = np.fromiter(map(len, each), np.int64, len(each))
        a, n_a = self.encode_a(parts, size, ranked)
        ids_b = self.b.encode([p[1:] for p in parts], num_threads=1)
        b, n_b = np.array(list(chain.from_iterable(ids_b)), dtype=np.int64), np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        right = self.keeps(a, n_a, self.size_a, self.bytes_a, each, size) & self.keeps(b, n_b, self.size_b, self.bytes_b, each, size)
        part_a, part_b = np.repeat(np.arange(len(parts)), n_a), np.repeat(np.arange(len(parts)), n_b)
        a, part_a, b, part_b = a[right[part_a]], part_a[right[part_a]], b[right[part_b]], part_b[right[part_b]]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        span_a, span_b = np.stack([end_a - self.size_a[a], end_a], axis=1), np.stack([end_b - self.size_b[b], end_b], axis=1)
        group_a, group_b = groups_of(span_a, span_b)
        i, j = overlaps(span_a, span_b)
        together = end_a[i] == end_b[j]
        i, j = i[together], j[together]

        side = np.repeat([0, 1], [len(a), len(b)])
        key = np.concatenate([group_a, group_b]) * 2 + side
        order = np.argsort(key, kind="stable")
        key, ids, part = key[order], np.concatenate([a, b])[order], np.concatenate([part_a, part_b])[order]
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, dtype=bool)
        letters = list(map(self.written.__getitem__, (ids + self.most * np.where(last, 1 + key % 2, 0)).tolist()))
        ends = np.searchsorted(part, np.arange(len(parts)), "right").tolist()
        n = len(self.at)
        self.groups += ["".join(letters[s:e]) for s, e in zip([0, *ends], ends)]
        counts = [np.bincount(x, minlength=len(parts)) for x in (part_a, part_b, part[last & (key % 2 == 1)])] + [right.astype(np.int64)]
        self.sizes = np.concatenate([self.sizes, np.stack(counts, axis=1)])
        self.pairs = np.concatenate([self.pairs, a[i] << 32 | b[j]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(part_a[i], minlength=len(parts)))])
        self.at |= {p: n + k for k, p in enumerate(parts)}
        self.chars += sum(map(len, parts))

    @staticmethod
    def keeps(ids: np.ndarray, n: np.ndarray, size_of: np.ndarray, bytes_of: list[bytes], each: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each part have the part's bytes."""
        part = np.repeat(np.arange(len(n)), n)
        if (np.bincount(part, size_of[ids], minlength=len(n)) == size).all() and b"".join(map(bytes_of.__getitem__, ids.tolist())) == b"".join(each):
            return np.ones(len(n), dtype=bool)
        ends = np.cumsum(n).tolist()
        return np.array([b"".join(map(bytes_of.__getitem__, ids[s:e].tolist())) == x for s, e, x in zip([0, *ends], ends, each)], dtype=bool)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: (A tokens, B tokens, groups, links), its groups in writing; and (text, pair, times) of the different links."""
        if len(self.at) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        cut = [self.parts(t) if t else [] for t in texts]
        if new := list(dict.fromkeys(p for parts in cut for p in parts if p not in self.at)):
            self.learn(new)
        at = [list(map(self.at.__getitem__, parts)) for parts in cut]
        n = [len(x) for x in at]
        text, flat = np.repeat(np.arange(len(texts)), n), np.array([i for x in at for i in x], dtype=np.int64)
        fine = np.bincount(text, 1 - self.sizes[flat, 3], minlength=len(texts)) == 0
        flat, text = flat[fine[text]], text[fine[text]]
        sizes = np.stack([np.bincount(text, self.sizes[flat, k], minlength=len(texts)) for k in range(3)] + [np.zeros(len(texts))], axis=1).astype(np.int64)
        groups = ["".join(map(self.groups.__getitem__, x))[:-1] if ok else "" for x, ok in zip(at, fine.tolist(), strict=True)]
        many = self.first[flat + 1] - self.first[flat]
        where = np.arange(many.sum()) + np.repeat(self.first[flat] - (np.cumsum(many) - many), many)
        owner, pair = np.repeat(text, many), self.pairs[where]
        sizes[:, 3] = np.bincount(owner, minlength=len(texts))
        order = np.lexsort((pair, owner))
        owner, pair = owner[order], pair[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        return sizes, groups, owner[starts], pair[starts], np.diff(np.append(starts, len(pair)))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker: the vocabularies are files of fixed size that every executor has."""
    return Aligner(path_a, path_b)


def align_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = PATH_A, path_b: str = PATH_B, with_groups: bool = True) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (if with_groups), pairs, times.

    groups has the ids of each group, 'a1,a2|b1;a3|b2'; pairs (A id * 2^32 + B id) and times
    the different links and how often the text has each. Texts that are null or empty, and
    those whose bytes a tokenizer doesn't keep, have no tokens: zeros and ''. Repeated rows
    get equal results; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = aligner(path_a, path_b)
        for b in sliced(batches, 200):
            sizes, groups, owner, pair, times = x.align(b.column(1).to_pylist())
            bounds = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            columns = [b.column(0), *(pa.array(sizes[:, k]) for k in range(4)), pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())]
            columns += [pa.array(groups, pa.string())] * with_groups
            columns += [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (pair, times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups, "pairs", "times"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * with_groups + ", pairs array<long>, times array<long>")


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): how many links each pair of ids has, and whether no pair with its B id has more. links: (pair, n)."""
    counts = written(links.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    own = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(own.alias("b")).agg(F.max("count").alias("most"))  # a row for each B id
    return written(counts.join(F.broadcast(most), own == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def alignment_scores(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """aligned (written) with n_best and count_sum instead of pairs and times.

    Pairs with a share of 1 / frequent of all links are at most `frequent`, and are broadcast;
    what is left has no pair that many rows hold, and is joined by merging. Either way each
    text's sums are added up before they are shuffled.
    """
    rows = aligned.withColumn("__row", F.monotonically_increasing_id())
    links = rows.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = link_counts(links)
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * frequent >= total
    met = links.join(F.broadcast(counts.where(often)), "pair", "left")
    rest = met.where("count is null").select("__row", "pair", "n").join(counts.where(~often).hint("merge"), "pair")
    every = met.where("count is not null").select("__row", "n", "count", "best").union(rest.select("__row", "n", "count", "best"))
    sums = every.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums.hint("merge"), "__row", "left").drop("__row").fillna(0, ["n_best", "count_sum"])


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = written(align_texts(table(spark, sf_dir, "documents"), with_groups=False), "aligned", zstd=True)
    return alignment_scores(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
