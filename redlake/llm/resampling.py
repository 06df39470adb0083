"""Quality by importance resampling with hashed n-gram models.

Two generative models over hashed unigrams and bigrams, one of target texts (those labelled
good) and one of all texts, give each document the logarithm of the ratio of its
probabilities. It is taken at a temperature in proportion to the document's length, so that
texts of all lengths compete alike. Gumbel noise is added to this log weight, and the k
highest sums are kept: a sample of k documents without replacement, in proportion to their
importance weights. k is the target mass: how many documents have weights on the target's
side of the middle between labelled targets and labelled bad rows. Documents with words that
labelled rejects have and target texts all but never do don't take part in the draw; these
words have no share in the weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import sliced, table, written

#: Buckets of the hashed n-grams: the size of a model, whatever the input's.
BUCKETS = 1 << 14
#: Most labelled rows that the target model is fitted on, and most rejects that its words are held against; the raw model counts every document.
TARGET_ROWS = 20_000
#: N-grams drawn from the raw model that are added to the target's in each bucket: rare buckets say little.
SMOOTHING = 5.0
#: N-grams of a text for which the log ratio is taken, and the temperature it is divided by: a text whose n-grams are
#: e ** -0.2 times as likely in the target model as in the raw one, each of them, has the weight 1 / e. Labelled bad rows then come
#: within a few deviations of the noise, so the draw is graded: what it keeps isn't the k highest weights.
LENGTH = 100
TEMPERATURE = 20.0
#: A word bars a document if it is in this share of the rejects, in so many at least, and e ** 3 times rarer in target texts.
BARRED_SHARE = 0.01
BARRED_LEAST = 8
BARRED_LOG_RATIO = -3.0
#: The middle lies between these quantiles of the log weights: of targets, and of bad rows. Without bad rows it lies MARGIN below the targets'.
TARGET_QUANTILE, BAD_QUANTILE, MARGIN = 0.05, 0.95, 3.0
SEED = 2023
#: Rows of a histogram that the driver may see at once.
BINS = 4096
_INNER = re.compile(r"[^\W_]+(?:[^\s]*[^\W_])?")


class _Codes(dict):
    """Word -> hash of its letters in its low half, hash of the marks around them in its high half."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        m = _INNER.search(word)
        core, marks = (m[0], word[: m.start()] + word[m.end() :]) if m else ("", word)
        core = re.sub(r"\d", "0", core)
        case = "^" if len(core) > 1 and core.isupper() else ""
        self[word] = code = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) | (zlib.crc32((marks + case).encode("utf-8", "surrogatepass")) if marks or case else 0) << 32
        return code


_CODES = _Codes()


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's n-grams: words in lower case, the marks at words, pairs of words.

    A word that follows itself is one bigram, whatever the word.
    """
    return _features(text, buckets)[0]


def _features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, and the hashes of the words."""
    words = (text or "").split()
    codes = np.fromiter(map(_CODES.__getitem__, words), dtype=np.uint64, count=len(words))
    core, marks = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
    a, b = core[:-1], core[1:]
    pairs = np.where(a == b, np.uint64(0x9E3779B97F4A7C15), a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs ^= pairs >> np.uint64(29)
    found = np.concatenate([core, marks[marks > 0] * np.uint64(0x165667B19E3779F9) >> np.uint64(17), pairs])
    return (found % np.uint64(buckets)).astype(np.int64), core


class _Plain(dict):
    """Word -> in lower case, without the marks around it; nothing is left of marks alone."""

    def __missing__(self, word: str) -> str:
        if len(self) > 400_000:
            self.clear()
        m = _INNER.search(word)
        self[word] = plain = m[0].lower() if m else ""
        return plain


_PLAIN = _Plain()


def plain_words(text: str | None) -> set[str]:
    """The different words of a text, in lower case, without the marks around them."""
    return set(map(_PLAIN.__getitem__, set((text or "").split()))) - {""}


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows of docs (text, target), and of those with target true.

    Each task sends a row for each bucket it met, whatever its number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for b in sliced(batches, 500):
            for t, good in zip(b.column(0), b.column(1), strict=True):
                n = np.bincount(features(t.as_py(), buckets), minlength=buckets)
                raw += n
                if good.as_py():
                    target += n
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], names=["bucket", "raw", "target"])

    parts = docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most `rows` ids of documents labelled good and not toxic (by any of their labels), picked by their hash."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if "toxic" in labels.columns:
        good = good.join(labels.where("toxic = 1").select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def reject_ids(labels: DataFrame, rows: int = TARGET_ROWS, toxic: bool = True) -> DataFrame:
    """At most `rows` ids of documents with a label that says bad, or toxic, picked by their hash."""
    toxic = F.col("toxic") == 1 if toxic and "toxic" in labels.columns else F.lit(False)
    return labels.where(((F.col("quality") == 0) | toxic) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def barred_words(labelled: DataFrame) -> dict[str, float]:
    """Words that rejects have and targets all but never do, with their log ratio; labelled: (text, target), few rows.

    As many as rejects have words in BARRED_SHARE of them, at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            each = [(w, g.as_py()) for t, g in zip(b.column(0), b.column(1), strict=True) for w in plain_words(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in each], pa.string()), pa.array([g for _, g in each], pa.bool_())], names=["word", "target"])

    n = {r.target: r["count"] for r in labelled.groupBy("target").count().collect()}
    good, bad = n.get(True, 0), n.get(False, 0)
    words = labelled.mapInArrow(run, "word string, target boolean").groupBy("word").agg(F.count_if("target").alias("good"), F.count_if(~F.col("target")).alias("bad"))
    ratio = F.log((F.col("good") + 0.5) / (good + 0.5)) - F.log((F.col("bad") + 0.5) / (bad + 0.5))
    least = max(BARRED_LEAST, math.ceil(BARRED_SHARE * bad))
    return {r.word: r.ratio for r in words.select("word", ratio.alias("ratio"), "bad").where((F.col("bad") >= least) & (F.col("ratio") <= BARRED_LOG_RATIO)).collect()}


class Model(NamedTuple):
    """The log ratio of each bucket, a vector, and that of each word that bars a document."""

    ratios: np.ndarray
    barred: dict[str, float]


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TARGET_ROWS) -> Model:
    """The models' log ratios; all zero if no row of docs is a target."""
    good = target_ids(labels, rows).withColumn("target", F.lit(True))
    ids = written(good.union(reject_ids(labels, rows).withColumn("target", F.lit(False))), "labelled")  # at most twice `rows` ids, no id twice
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    counts = ngram_counts(marked, buckets).collect()  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return Model(np.zeros(buckets), {})
    ratios = np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING))
    return Model(ratios, barred_words(marked.where("target is not null").select("text", "target")))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, the same for the same key and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit("gumbel")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, model: Model, seed: int = SEED) -> DataFrame:
    """docs with __n_features, __log_ratio (of the whole text), __n_barred (different words that bar it), __log_weight, __noise and __row, each row's own number."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value.ratios
        barred = np.array(sorted({_CODES[w] & 0xFFFFFFFF for w in shared.value.barred}), dtype=np.uint64)
        for b in sliced(batches, 500):
            out = []
            for t in b.column(at):
                x, words = _features(t.as_py(), len(ratios))
                total = float(ratios[x].sum())
                out.append((len(x), total, len(np.intersect1d(words, barred)) if len(barred) and np.isin(words, barred).any() else 0, LENGTH / TEMPERATURE * total / max(1, len(x))))
            n, total, k, weight = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(k, pa.int64()), pa.array(weight, pa.float64())], names=[*b.schema.names, *_ADDED])

    added = [StructField(c, DoubleType() if "log" in c else LongType()) for c in _ADDED]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added])).withColumn("__noise", gumbel(F.col("doc_id"), seed)).withColumn("__row", F.monotonically_increasing_id())


_ADDED = ["__n_features", "__log_ratio", "__n_barred", "__log_weight"]


#: Rows that take part in the draw.
_DRAWN = "__n_barred = 0"


def target_mass(rows: DataFrame, labels: DataFrame) -> int:
    """How many rows (written) of those in the draw have a log weight on the target's side; all of them where no row is a target."""
    rows = rows.where(_DRAWN)
    kind = target_ids(labels).withColumn("kind", F.lit("target")).union(reject_ids(labels, toxic=False).withColumn("kind", F.lit("bad")))
    of = rows.select("doc_id", "__log_weight").join(F.broadcast(written(kind, "kinds")), "doc_id").groupBy("kind").agg(F.percentile("__log_weight", F.array(F.lit(TARGET_QUANTILE), F.lit(BAD_QUANTILE))).alias("q"))
    q = {r.kind: r.q for r in of.collect()}
    if "target" not in q:
        return rows.count()
    low = q["target"][0]
    middle = min(low, (low + q["bad"][1]) / 2) if "bad" in q else low - MARGIN
    return rows.where(F.col("__log_weight") >= middle).count()


def effective_size(rows: DataFrame) -> float:
    """The effective sample size of the rows in the draw: how many rows of equal weight have as much variance."""
    top = rows.where(_DRAWN).agg(F.max("__log_weight")).first()[0] or 0.0
    w = F.exp(F.col("__log_weight") - F.lit(top))
    one, two = rows.where(_DRAWN).agg(F.sum(w), F.sum(w * w)).first()
    return one * one / two if two else 0.0


def top_k(rows: DataFrame, keys: list[str], k: int, among: str = "true") -> Column:
    """A condition that holds for exactly k of the rows `among`, those with the highest keys; the last key is unique. All of them if there are fewer.

    A histogram of BINS bins is narrowed to the bin of the k-th row until that bin is small
    or ends with it; rows must be a written table. No sort, and no more than BINS rows go to
    the driver.
    """
    above, inside = F.lit(False), F.expr(among)
    if k <= 0:
        return above
    for key in keys:
        while True:
            lo, hi, n = rows.where(inside).agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
            if n <= k:
                return above | inside
            if lo == hi:
                break
            if n <= BINS:
                ends = sorted((tuple(r) for r in rows.where(inside).select(*keys).collect()), reverse=True)[k - 1]
                last = F.lit(False)
                for x, end in zip(reversed(keys), reversed(ends), strict=True):
                    last = (F.col(x) > F.lit(end)) | ((F.col(x) == F.lit(end)) & (last if x != keys[-1] else F.lit(True)))
                return above | (inside & last)
            bin_ = F.least(F.floor((F.col(key) - F.lit(lo)) * F.lit((BINS - 1) / (hi - lo))), F.lit(BINS - 1))
            counts = dict(rows.where(inside).groupBy(bin_.alias("bin")).count().collect())
            for at in sorted(counts, reverse=True):
                if counts[at] >= k:
                    break
                k -= counts[at]
            above, inside = above | (inside & (bin_ > at)), inside & (bin_ == at)
    return above | inside


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """docs (with doc_id and text among its columns) with __n_features, __log_ratio, __n_barred, __log_weight, __noise, __row, __kept.

    Null and empty texts have no n-grams and log weight 0. Rows of one doc_id share their
    noise; equal sums are told apart by __row, so exactly k rows are kept, none of them with
    a barred word; if fewer have none, all of those. Without labelled rows all weights are 0
    and all rows are kept. k: the target mass, unless given.
    """
    rows = written(weigh(docs, fit(docs, labels), seed), "weighed").withColumn("__sum", F.col("__log_weight") + F.col("__noise"))
    return rows.withColumn("__kept", top_k(rows, ["__sum", "__row"], target_mass(rows, labels) if k is None else k, _DRAWN)).drop("__sum")


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    rows = written(weigh(docs.select("doc_id", "text"), model).drop("text"), "weighed").withColumn("__sum", F.col("__log_weight") + F.col("__noise"))
    kept = top_k(rows, ["__sum", "__row"], target_mass(rows, labels), _DRAWN)
    names = ["n_features", "log_ratio", "n_barred", "log_weight"]
    return rows.select("doc_id", *[F.col(f"__{c}").alias(c) for c in names], F.col("__sum").alias("perturbed"), kept.alias("kept"))
