"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints differ in at most two bits only if three of five blocks of bits are equal, so
ten keys of three blocks bring all links together. Rows that share a key are compared bit
plane by bit plane: plane b holds bit b of 64 fingerprints a word; counter words,
added to with carries, count the differing bits of 64 pairs at once; a block of 64 is
given up as soon as all its counts exceed the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, written
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
BLOCKS = 5
#: A key with more fingerprints than this is compared in squares of so many by so many, each a task's group.
SQUARE = 16384


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; no word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    hashes = np.fromiter((hash_of(s, SEED) for s in shingles), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # a long text's bits are counted in parts
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """For each choice of blocks that must be equal, the mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(each, blocks - radius)]


def sliced_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of places in fps at `radius` or fewer differing bits."""
    m = len(fps)
    words = (m + 63) // 64
    bits = np.unpackbits(fps.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    varying = np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0))
    padded = np.zeros((64, words * 64), dtype=np.uint8)
    padded[:, :m] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    flips = np.where(bits, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    left, right = [], []
    step = max(1, (1 << 18) // words)
    for at in range(0, m, step):
        q = np.arange(at, min(m, at + step))
        row = np.repeat(q, words - q // 64)  # a query meets its own word and those after it
        word = np.concatenate([np.arange(i // 64, words) for i in q]) if words > 1 else np.zeros(len(q), dtype=np.int64)
        counts = [np.zeros(len(row), dtype=np.uint64) for _ in range(radius.bit_length() + 1)]  # the last stays set once the others are full
        for k, b in enumerate(varying):
            d = planes[b, word] ^ flips[row, b]
            for i, c in enumerate(counts[:-1]):
                counts[i], d = c ^ d, c & d
            counts[-1] |= d
            if k >= radius and k % 6 == 5 and k + 1 < len(varying):
                live = np.flatnonzero(_beyond(counts, radius) != np.uint64(0xFFFFFFFFFFFFFFFF))
                if len(live) < len(row):
                    row, word, counts = row[live], word[live], [c[live] for c in counts]
                if not len(row):
                    break
        if len(row):
            hits = np.unpackbits((~_beyond(counts, radius)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(hits)
            i, j = row[r], word[r] * 64 + c
            good = (j < m) & (j > i)
            left.append(i[good])
            right.append(j[good])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _beyond(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the pairs whose count exceeds the radius: compared from the highest counter down."""
    over, same = counts[-1], ~counts[-1]
    for i in range(len(counts) - 2, -1, -1):
        if radius >> i & 1:
            same = same & counts[i]
        else:
            over, same = over | same & counts[i], same & ~counts[i]
    return over


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k, key, lo, hi, fp) -> links (a, b); a group may go over several batches."""

    def links(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.unique(group[4])
        i, j = sliced_links(fps.view(np.uint64))
        return fps[i], fps[j]

    def done(rows: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [links(rows[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rest = np.zeros((5, 0), dtype=np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns])], axis=1)
        if rows.shape[1]:
            bounds = np.concatenate([[0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1])
            yield from done(rows, bounds)
            rest = rows[:, bounds[-1] :]
    yield from done(rest, np.array([0, rest.shape[1]]))


def fingerprint_links(fps: DataFrame, square: int = SQUARE) -> DataFrame:
    """Distinct pairs (a, b) of different values of fps.fp that link, each once or more."""
    masks = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("m")) for k, m in enumerate(block_masks())])
    keyed = fps.select("fp", F.explode(masks).alias("x")).select(F.col("x.k").alias("k"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    squares = F.ceil(F.col("n") / square).cast("long")
    own = F.pmod(F.xxhash64("fp"), "parts")
    return (
        keyed.join(sizes.hint("merge"), ["k", "key"])
        .withColumn("parts", squares)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("k", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
        .repartition("k", "key", "lo", "hi")
        .sortWithinPartitions("k", "key", "lo", "hi")
        .mapInArrow(_compare, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, n_same (rows of the same fingerprint), component_id.

    Null, empty and blank texts have fingerprint zero and link like any other. Equal rows
    share all results. A component's id is its smallest doc_id that isn't null, and null if
    there is none. Copies meet in a count by fingerprint before anything is compared.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")), "simhash-fps")
    roots = components(fingerprint_links(fps))
    grouped = fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = grouped.join(smallest.hint("merge"), "root").select("fp", "n_same", "component_id")
    return rows.join(classes.hint("merge"), "fp").select("doc_id", "fp", "n_same", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")
