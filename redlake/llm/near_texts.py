"""SimHash near-duplicates at a wide radius: those with a Jaccard similarity of five-word shingles of 0.8.

At that similarity 64-bit fingerprints differ in 10 bits on average and in up to RADIUS, too
many for keys of equal blocks. So candidates share a band, five least hashes of BANDS times
five; their fingerprints are compared bit-sliced, as in `simhash`; and the shingles of what
is left decide exactly, by text or, within a band, by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, sliced, written
from .components import components
from .simhash import fingerprint, sliced_links

SHINGLE = 5
MIN_JACCARD = 0.8
#: Bands of ROWS least hashes: a pair at MIN_JACCARD shares none with a chance of (1 - 0.8 ** 5) ** 20 = 0.0004.
BANDS = 20
ROWS = 5
SEED = 42
#: Differing bits: at MIN_JACCARD 9.7 of 64 on average, with a deviation of 2.9; more in one of 10,000 pairs.
RADIUS = 21
#: A band with more texts than this is compared in squares of so many by so many.
SQUARE = 2048
#: Shingles whose counts are taken together in a square.
COLUMNS = 4096
#: Texts of pairs are picked with a broadcast only if they are this few.
BROADCAST_TEXTS = 1_000_000
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _RANDOM.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> set[bytes]:
    """Runs of SHINGLE words; fewer words are one, no words none."""
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))


def bands(found: set[bytes]) -> list[int]:
    """A hash for each band of least hashes; none without shingles."""
    if not found:
        return []
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found))
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 4096):  # a long text's in parts
        mixed = (h[at : at + 4096] ^ _FLIPS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=1))
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(least.reshape(BANDS, ROWS))]


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, text) -> (own, key, n, fp, bands): key names the text's words, n is its number of shingles."""
    for b in sliced(batches, 500):
        keys, n, fps, found = [], [], [], []
        for t in b.column(1):
            words = words_of(t.as_py())
            s = shingles(words)
            keys.append(_key(words))
            n.append(len(s))
            fps.append(fingerprint(t.as_py(), SHINGLE))
            found.append(bands(s))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))], names=["own", "key", "n", "fp", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b) of the pairs that are similar enough."""
    was, second = None, set()
    for batch in sliced(batches, 500):
        out = []
        for r in batch.to_pylist():
            if r["b"] != was:
                was, second = r["b"], shingles(words_of(r["text_b"]))
            if jaccard(shingles(words_of(r["text_a"])), second) >= MIN_JACCARD:
                out.append((r["a"], r["b"]))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (key, text) are similar enough, written."""
    pairs = written(pairs, "near-pairs")
    need = written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "near-need")
    picked = written(texts.join(hinted(need, BROADCAST_TEXTS), "key", "left_semi"), "near-texts", zstd=True)
    with_a = pairs.join(picked.select(F.col("key").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = with_a.join(picked.select(F.col("key").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "near-links")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, s): the hashes of its shingles."""
    for b in sliced(batches, 200):
        found = [[xxhash.xxh64_intdigest(x, SEED) - (1 << 63) for x in shingles(words_of(t.as_py()))] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "s"])


def links_of_group(n: np.ndarray, fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of texts in different components with MIN_JACCARD or more: n has their numbers of shingles, sets the hashes of those that others have too."""
    i, j = sliced_links(fps, RADIUS)
    keep = (roots[i] != roots[j]) & (np.minimum(n[i], n[j]) >= MIN_JACCARD * np.maximum(n[i], n[j]))
    i, j = i[keep], j[keep]
    if not len(i):
        return i, j
    # Shingles in common of all those texts: a table of texts by shingles times itself, some columns at a time.
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i2, j2 = np.split(at, 2)
    every = np.concatenate([sets[r] for r in rows])
    who = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    column = np.unique(every, return_inverse=True)[1]
    both = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        some = (column >= first) & (column < first + COLUMNS)
        x = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        x[who[some], column[some] - first] = 1
        both += x @ x.T
    shared = both[i2, j2]
    good = shared >= MIN_JACCARD * (n[i] + n[j] - shared)
    return i[good], j[good]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (band, lo, hi, key, n, fp, root, s) -> links (a, b)."""

    def done(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(group) > 1:
            key, n, fps, root = (np.array(c, dtype=np.int64) for c in list(zip(*group, strict=True))[3:7])
            i, j = links_of_group(n, fps.view(np.uint64), root, [np.array(r[7], dtype=np.int64) for r in group])
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], names=["a", "b"])

    group: list[tuple] = []
    for batch in sliced(batches, 1000):
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and r[:3] != group[0][:3]:
                yield from done(group)
                group = []
            group.append(r)
    yield from done(group)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and component_id, the smallest doc_id of its group.

    Texts of MIN_JACCARD or more are linked, and groups are what links join. Texts of the
    same words are one; null, empty and blank texts are one. doc_id must be unique to a row,
    and docs a written table.

    Each text of a band is first compared with the band's hub, the text that shares most
    bands with others, as an original does with its copies; then only texts that this left
    in different groups are compared, all pairs of them, so that a band of many near copies
    costs no more than its size.
    """
    d = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    own = d.schema["own"].dataType.simpleString()
    rows = written(d.mapInArrow(_sketch, f"own {own}, key long, n long, fp long, bands array<long>"), "near-rows")
    nodes = written(rows.groupBy("key").agg(F.min("own").alias("first"), *(F.any_value(c).alias(c) for c in ("n", "fp", "bands"))), "near-nodes")
    keyed = nodes.select("key", "n", "fp", F.explode("bands").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = written(keyed.join(sizes.hint("merge"), "band"), "near-bands")
    scored = met.join(met.groupBy("key").agg(F.sum("m").alias("score")).hint("merge"), "key")
    hubs = scored.groupBy("band").agg(F.max(F.struct("score", "key", "n", "fp")).alias("h")).select("band", F.col("h.key").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.fp").alias("hub_fp"))
    alike = F.least("n", "hub_n") >= MIN_JACCARD * F.greatest("n", "hub_n")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= RADIUS
    star = met.join(hubs.hint("merge"), "band").where((F.col("key") != F.col("hub")) & alike & near).select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    chosen = nodes.select("key", "first")
    texts = d.join(chosen.hint("merge"), F.col("own") == F.col("first")).select("key", "text")
    links = _similar(star, texts)
    roots = written(components(links), "near-roots")
    named = met.join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("band", "key", "n", "fp", F.coalesce("root", "key").alias("root"))
    split = named.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m")).where("r0 < r1").select("band", F.ceil(F.col("m") / SQUARE).cast("long").alias("parts"))
    left = written(named.join(split.hint("merge"), "band"), "near-left")
    # Shingles that only one of these texts has are in no common part: a text of too many is like none of them.
    some = texts.join(hinted(written(left.select("key").distinct(), "near-need"), BROADCAST_TEXTS), "key", "left_semi")
    each = written(some.mapInArrow(_hashed, "key long, s array<long>"), "near-shingles").select("key", F.explode("s").alias("h"))
    common = each.groupBy("h").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 < k1").select("h")
    sets = each.join(common.hint("merge"), "h").groupBy("key").agg(F.collect_list("h").alias("s"))
    rows_left = left.join(sets.hint("merge"), "key").where(F.size("s") >= MIN_JACCARD * F.col("n"))
    parts = rows_left.withColumn("part", F.pmod(F.xxhash64("key"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    squares = parts.select("band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "key", "n", "fp", "root", "s")
    rest = squares.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(_close, "a long, b long").distinct()
    roots = components(links.union(rest))
    grouped = chosen.join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = grouped.join(smallest.hint("merge"), "root").select("key", "component_id")
    return rows.select("own", "key").join(classes.hint("merge"), "key").select(F.col("own").alias("doc_id"), "component_id")
