"""Removal of long repeated byte strings, by suffixes of the whole collection.

Every window of DEPTH bytes has an anchor, its gram of least hash, leftmost of equals, and
equal windows have equal anchors at equal places. So texts are cut into pieces: runs of
windows with one anchor, at places within one of a few ranges. All windows of a piece have
its core in common, over half of a window, and equal windows stand in pieces of equal core.
Pieces whose core stands nowhere else drop out; equal pieces are counted, not compared; the
different pieces of a core make a collection of strings, whose Burrows-Wheeler transform
and common prefixes are built column by column, a symbol of each string a round. A suffix
that shares DEPTH bytes with another is a repeated window.

A core with more different pieces than one task should hold is cut again, by narrower
ranges, so by longer cores; the narrowest range has one place, and its core is the window.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection_bwt import suffixes_shared
from .common import hinted, sliced, table, written

DEPTH = 200
GRAM = 32
#: Places of an anchor that share a piece, at first and for cores of too many pieces.
WIDTHS = (100, 20, 1)
#: Bytes of a symbol; DEPTH is a multiple of it.
BLOCK = 8
#: Starts of windows handled at once; longer texts are taken in parts that overlap by a window.
PART = (1 << 20) - 256
#: Pieces whose BWT is built together, made of whole groups of a core.
COLLECTION = 1000
#: A core with more different pieces than this is cut again.
LARGE_GROUP = 4000
#: Cores that occur again are broadcast only if they are this few.
BROADCAST_CORES = 500_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFF)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(1 << 20, x, dtype=np.uint64)]))

    return powers(_MULTIPLIER), powers(pow(_MULTIPLIER, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _part(x: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of bytes that hold at least one window: core hash, first start, number of starts and anchor's place of each piece."""
    up, down = _powers()
    n = len(x)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    m, grams = len(h), DEPTH - GRAM + 1
    keyed = np.full(-(-m // grams) * grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    keyed[:m] = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
    blocks = keyed.reshape(-1, grams)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[: m - grams + 1], ahead[grams - 1 : m]) & _LOW).astype(np.int64)
    range_ = (at - np.arange(len(at))) // width
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (range_[1:] != range_[:-1])]))
    a, r = at[first], range_[first]
    lo, hi = a - r * width, a + DEPTH - np.minimum(r * width + width, grams) + 1
    core = _mixed((sums[hi] - sums[lo]) * down[lo] + r.astype(np.uint64))
    return core.view(np.int64), first, np.diff(np.append(first, len(at))), a


def pieces(text: bytes, width: int = WIDTHS[0]) -> tuple[np.ndarray, ...]:
    """Core hash, first start, number of starts and anchor's place of each piece of a text; none if it has no window."""
    x, found = np.frombuffer(text, dtype=np.uint8), []
    for o in range(0, len(x) - DEPTH + 1, PART):
        core, first, n, at = _part(x[o : o + PART + DEPTH - 1], width)
        found.append((core, first + o, n, at + o))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _utf8(column: pa.Array) -> Iterator[bytes]:
    return (v or b"" for v in column.cast(pa.binary()).to_pylist())


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, text) -> (owner, core, at, n, place) of each piece."""
    for b in sliced(batches, 100):
        found = [pieces(t) for t in _utf8(b.column(1))]
        which = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        core, at, n, place = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 4
        yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(core), *(pa.array(c.astype(np.int32)) for c in (at, n, place - at))], names=["owner", "core", "at", "n", "place"])


def _row(owner: bytes, core: int, at: int, cut: bytes, place: int, n: int) -> tuple:
    return owner, core, at, hashlib.md5(cut + bytes([place])).digest(), place, cut, n


_CUT = "owner binary, core long, at int, name binary, place int, bytes binary, n long"
_CUT_TYPES = [("owner", pa.binary()), ("core", pa.int64()), ("at", pa.int32()), ("name", pa.binary()), ("place", pa.int32()), ("bytes", pa.binary()), ("n", pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_CUT_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _CUT_TYPES, strict=True)], names=[k for k, _ in _CUT_TYPES])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, text, found) -> the named pieces with their bytes."""
    for b in sliced(batches, 100):
        rows = []
        for owner, text, found in zip(b.column(0).to_pylist(), _utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
            rows += [_row(owner, f["core"], f["at"], text[f["at"] : f["at"] + f["n"] - 1 + DEPTH], f["place"], 1) for f in found]
        yield _batch(rows)


def _cut_again(width: int):
    """(name, bytes, n) -> pieces of pieces, whose owner is the name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 100):
            rows = []
            for name, text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows += [_row(name, core, at, text[at : at + k - 1 + DEPTH], place - at, n) for core, at, k, place in zip(*(c.tolist() for c in pieces(text, width)), strict=True)]
            yield _batch(rows)

    return run


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true places as first and last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _cut_alike(text: bytes, place: int) -> list[tuple[int, np.ndarray]]:
    """A piece as strings of blocks, with the byte that each begins at: one for each cut, counted from the anchor."""
    x = np.frombuffer(text, dtype=np.uint8)
    starts = [(place - t) % BLOCK for t in range(BLOCK)]
    return [(s, x[s : s + (len(x) - s) // BLOCK * BLOCK].view(f"<u{BLOCK}")) for s in starts]


def repeated_starts(texts: list[bytes], places: list[int], folder: str | None = None) -> list[np.ndarray]:
    """For each piece, whether the window at each of its starts stands elsewhere in a piece."""
    strings = [c for t, p in zip(texts, places, strict=True) for c in _cut_alike(t, p)]
    names = np.unique(np.concatenate([c for _, c in strings]), return_inverse=True)[1] + 1
    names = names.astype(np.uint16 if names.max() < 1 << 16 else np.uint32)
    ends = np.cumsum([len(c) for _, c in strings])
    shared = suffixes_shared(np.split(names, ends[:-1]), DEPTH // BLOCK, folder)
    out = [np.zeros(len(t) - DEPTH + 1, dtype=bool) for t in texts]
    for k, ((start, _), f) in enumerate(zip(strings, shared, strict=True)):
        out[k // BLOCK][start : start + len(f) * BLOCK : BLOCK] = f
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (core, name, place, bytes, n) in the order of cores -> (name, ranges of starts that occur again).

    The transforms are files of the task's own scratch folder, gone with the task.
    """

    def done(rows: list[tuple], folder: str) -> pa.RecordBatch:
        found = repeated_starts([r[3] for r in rows], [r[2] for r in rows], folder)
        for r, f in zip(rows, found, strict=True):
            if r[4] > 1:
                f[:] = True
        hit = [(r[1], _runs(f)) for r, f in zip(rows, found, strict=True) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in hit], pa.binary()), pa.array([x for _, x in hit], _RANGES)], names=["name", "ranges"])

    def groups() -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and r[0] != group[0][0]:
                    yield group
                    group = []
                group.append(r)
        if group:
            yield group

    held: list[tuple] = []
    with tempfile.TemporaryDirectory() as folder:
        for g in groups():
            if len(g) == 1:  # copies of one piece, or a piece that only seemed to occur again
                if g[0][4] > 1:
                    whole = [{"a": 0, "b": len(g[0][3]) - DEPTH}]
                    yield pa.RecordBatch.from_arrays([pa.array([g[0][1]], pa.binary()), pa.array([whole], _RANGES)], names=["name", "ranges"])
                continue
            held += g
            if len(held) >= COLLECTION:
                yield done(held, folder)
                held = []
        if held:
            yield done(held, folder)


def _settled(cut: DataFrame, widths: tuple[int, ...], large_group: int) -> DataFrame:
    """(owner, r) of pieces (written): a first and a last start of repeated windows, a row for each range."""
    different = written(cut.groupBy("core", "name", "place").agg(F.first("bytes").alias("bytes"), F.sum("n").alias("n")), "pieces", zstd=True)
    sizes = different.groupBy("core").agg(F.count(F.lit(1)).alias("k"))
    large = written(sizes.where(F.col("k") > large_group).select("core"), "large") if widths else None
    again = large is not None and not large.isEmpty()
    usual = different.join(hinted(large, BROADCAST_CORES), "core", "left_anti") if again else different
    marks = usual.select("core", "name", "place", "bytes", "n").repartition("core").sortWithinPartitions("core").mapInArrow(_compare, "name binary, ranges array<struct<a:long,b:long>>")
    marks = written(marks.select("name", F.explode("ranges").alias("r")), "marks")
    if again:
        finer = different.join(hinted(large, BROADCAST_CORES), "core", "left_semi").select("name", "bytes", "n").mapInArrow(_cut_again(widths[0]), _CUT)
        inner = _settled(written(finer, "cut", zstd=True), widths[1:], large_group)
        marks = marks.union(inner.select(F.col("owner").alias("name"), "r"))
    found = cut.select("owner", "at", "name").join(marks.hint("merge"), "name")
    return found.select("owner", F.struct((F.col("r.a") + F.col("at")).alias("a"), (F.col("r.b") + F.col("at")).alias("b")).alias("r"))


def repeated_ranges(docs: DataFrame, text_col: str = "text", large_group: int = LARGE_GROUP) -> DataFrame:
    """(digest, ranges): by a text's MD5, the first and last starts of its windows that occur anywhere else.

    Texts with copies are repeated as a whole; among the pieces a text counts once.
    """
    text = F.col(text_col)
    texts = docs.where(F.octet_length(text) >= DEPTH).select(F.unhex(F.md5(text.cast("binary"))).alias("owner"), text.alias("text"))
    every = written(texts.mapInArrow(lambda b: _joined(_places(b), 20_000), "owner binary, core long, at int, n int, place int"), "places", zstd=True)
    own = F.xxhash64("owner", "at")
    cores = every.groupBy("core").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo < hi").select("core")
    again = written(cores, "cores")
    hits = every.join(hinted(again, BROADCAST_CORES), "core", "left_semi")
    of_text = hits.groupBy("owner").agg(F.collect_set(F.struct("core", "at", "n", "place")).alias("found"))
    one = texts.groupBy("owner").agg(F.first("text").alias("text"))
    cut = written(one.join(of_text.hint("merge"), "owner").mapInArrow(lambda b: _joined(_cut(b), 5_000), _CUT), "cut", zstd=True)
    ranges = _settled(cut, WIDTHS[1:], large_group)
    last = docs.where(F.octet_length(text) >= DEPTH).groupBy(F.unhex(F.md5(text.cast("binary"))).alias("owner")).agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length(text)).alias("n"))
    whole = last.where("copies > 1").select("owner", F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - DEPTH).cast("long").alias("b")).alias("r"))
    return written(ranges.union(whole).groupBy(F.col("owner").alias("digest")).agg(F.collect_set("r").alias("ranges")), "ranges")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 200):
        out = []
        for text, ranges in zip(_utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
            gone = np.zeros(len(text) + 1, dtype=np.int32)
            for r in ranges or ():
                gone[r["a"]] += 1
                gone[r["b"] + DEPTH] -= 1
            out_of = np.cumsum(gone)[:-1] > 0
            kept = np.frombuffer(text, dtype=np.uint8)[~out_of].tobytes()
            spans = int(np.count_nonzero(np.diff(np.concatenate([[False], out_of]).astype(np.int8)) == 1))
            out.append((len(text), len(text) - len(kept), spans, kept))
        n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large_group: int = LARGE_GROUP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left).

    Null texts count as empty; texts shorter than DEPTH bytes are kept whole. All copies of a
    repeated passage go, the first one too. Equal rows get equal results; a null id is kept;
    other columns are not read. Removal may split a character: kept is binary.
    """
    ranges = repeated_ranges(docs, text_col, large_group)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    kind = d.schema["doc_id"].dataType.simpleString()
    found = d.join(ranges.hint("merge"), "digest", "left").select("doc_id", "text", "ranges")
    return found.mapInArrow(_strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
