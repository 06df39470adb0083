"""Resampling towards a target distribution with hashed n-grams.

A text's separators are collapsed to single spaces. One pattern for each n, with boundary
lookarounds, is run over it with overlapping matches, so its spans are the n-grams as they
stand in the text, and each span goes to the bucket of its CRC-32. Buckets that the target
texts use more often than the corpus does have a gain; a document's weight is the mean gain
of its n-grams, and the documents with the highest sums of weight and Gumbel noise are drawn.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, written

BUCKETS = 10_000
#: N-grams of 1 to so many words.
MOST_WORDS = 1
#: Documents with fewer words are weighed but never drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes as n-grams see them: A-Z in lower case, separators as spaces; the rest are parts of words.
_SEEN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Rows of a written table that one task wrote: numbers below this many bits count within the task.
_TASK_BITS = 33


def collapsed(text: str | None) -> bytes:
    """The words of a text in UTF-8, a single space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_SEEN).split())


@lru_cache(maxsize=16)
def _runs(n: int) -> regex.Pattern:
    """Runs of n words, from a word's first byte to a word's last."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


class _Buckets(dict):
    """N-gram -> bucket."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


_bucket_of = lru_cache(maxsize=4)(_Buckets)


def bucket_counts(text: str | None, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> tuple[int, Counter]:
    """The number of words and how many n-grams each bucket has."""
    seen, bucket_of, counts = collapsed(text), _bucket_of(buckets), Counter()
    for n in range(1, most_words + 1):
        for feature, times in Counter(map(itemgetter(0), _runs(n).finditer(seen, overlapped=True))).items():
            counts[bucket_of[feature]] += times
    return seen.count(b" ") + 1 if seen else 0, counts


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """One row per row: doc_id, n_words, n_features, buckets and times (arrays of one length). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            words, features, at, times = [], [], [], []
            for t in b.column(1):
                n, counts = bucket_counts(t.as_py(), most_words, buckets)
                words.append(n)
                features.append(counts.total())
                at.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                times.append(np.fromiter(counts.values(), np.int64, len(counts)))
            columns = [b.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets", "times"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets array<int>, times array<long>")


def _totals(rows: DataFrame, buckets: int) -> list[int]:
    """How many n-grams each bucket has in all rows; at most `buckets` sums go to the driver."""
    each = rows.select(F.explode(F.arrays_zip("buckets", "times")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.times").alias("n"))
    found = [0] * buckets
    for r in each.collect():
        found[r.bucket] = r.n
    return found


def gains(raw: list[int], target: list[int]) -> list[int]:
    """A thousandfold log ratio of each bucket's smoothed shares in target and raw n-grams, rounded down."""
    size = len(raw)
    raw_all, target_all = float(sum(raw) + size), float(sum(target) + size)
    return [math.floor(1000 * math.log(float(t + 1) * raw_all / (float(s + 1) * target_all))) for s, t in zip(raw, target, strict=True)]


def noise(key: Column, seed: str = SEED) -> Column:
    """Standard Gumbel noise times a thousand, rounded down, from the SHA-256 of seed and key; a null key is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """rows with `place` from 0 in the given order, and their number.

    One sort by ranges, written; each task numbers its own rows, and the tasks' counts, one a
    task, say where each begins. The order should tell equal rows apart, so that none of
    them, however many, have to be in one task.
    """
    out = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("__at", _TASK_BITS)
    counts = sorted(out.groupBy(task.alias("task")).count().collect())
    first, n = [], 0
    for r in counts:
        first.append((r.task, n))
        n += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(first, "__task long, __first long"))
    place = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    return out.join(starts, task == F.col("__task")).withColumn("place", place).drop("__at", "__task", "__first"), n


def resample_to_target(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    most_words: int = MOST_WORDS,
    buckets: int = BUCKETS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    Of the rows with at least least_words words, percent in a hundred are drawn, those with
    the highest scores; equal scores go by doc_id, nulls last, and rows of one doc_id by
    their own number. Null and empty texts have no words and weight 0. An empty target has
    equal shares in all buckets; an empty docs gives no rows. Other columns are not read.
    Texts are read once: what remains of them is a count for each bucket that they use.
    """
    rows = written(hashed(docs, id_col, text_col, most_words, buckets), "ngrams", zstd=True)
    gain = gains(_totals(rows, buckets), _totals(hashed(target.select(F.lit(0).alias("id"), target_text), "id", target_text, most_words, buckets), buckets))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, dtype=np.int64))  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, times = b.column(3), b.column(4)
            each = np.concatenate([[0], np.cumsum(shared.value[at.flatten().to_numpy()] * times.flatten().to_numpy())])
            ends = np.cumsum(np.fromiter((len(x) for x in at), np.int64, len(at)))
            total = each[ends] - each[np.concatenate([[0], ends[:-1]])] if len(at) else ends
            n = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("__long", F.col("n_words") >= least_words).withColumn("__row", F.monotonically_increasing_id())
    placed, _ = ranked(written(scored, "scores"), F.desc("__long"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row"))
    k = percent * placed.where("__long").count() // 100
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("__long") & (F.col("place") < k), F.col("place") + 1).alias("rank"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_to_target(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of the different words alone, byte by byte over the 256 remainders.
ORACLE = r"""
WITH remainders AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) AS x(i))),
every AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM every),
uses AS (SELECT side, r, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM uses), remainders),
per_doc AS (SELECT side, r, bucket, sum(n) AS n FROM uses JOIN hashed USING (w) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM per_doc GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(st + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM sums, (SELECT sum(s) AS st, sum(t) AS tt FROM sums)),
weights AS (SELECT r, sum(n) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM per_doc JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scores AS (
  SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM every LEFT JOIN weights USING (r) WHERE side = 'd'),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS k FROM scores)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * k // 100 THEN place END AS rank FROM ranks
"""
