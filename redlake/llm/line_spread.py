"""Cross-site boilerplate lines by their distinct-site spread.

Each line's sites go into a HyperLogLog sketch; sketches of a line merge in its aggregation,
and lines whose estimate is near the threshold get exact counts. Copied documents repeat
their lines on many sites too. So the lines on enough sites are counted again, in the same
way, over the texts that host them: equal texts count once, and a text that consists of
such lines for the most part is a copy and no host, unless they come to less than a text has:
a thin page with a footer is a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_CHARS, hinted, table, written

#: Sites from which a line is boilerplate.
MIN_SITES = 10
#: A text of which this share, in characters of lines, is spread lines is no host: as a fraction.
COPIED = (2, 3)
#: Spread lines with fewer characters in a text are headers and footers, whatever their share: some fifty words are a text that may be copied.
LEAST_COPIED = 400
#: log2 of a sketch's buckets: a standard error of 1.6 %; up to some hundred sites it is exact.
SKETCH_LOG_K = 12
#: An estimate this far from MIN_SITES, either way, is near it: six standard errors.
NEAR = 0.1
#: Lines and texts are broadcast only if they are this few; more are joined by a shuffle.
BROADCAST_LINES = 200_000


def _inner(line: Column) -> Column:
    return F.btrim(line, F.lit(GAP_CHARS))


def _key(line: Column) -> Column:
    """A line's hash without white space at its ends; null for a blank line."""
    return F.when(_inner(line) != "", F.xxhash64(_inner(line)))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, n_sites), written, of the lines (h, site) on enough sites: exact near the threshold, else estimated."""
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LOG_K)).alias("n_sites"))
    some = written(spread.where(F.col("n_sites") >= min_sites * (1 - NEAR)), "lines")
    sure, near = some.where(F.col("n_sites") > min_sites * (1 + NEAR)), some.where(F.col("n_sites") <= min_sites * (1 + NEAR)).select("h")
    # Two partial counts, so that a line's rows meet as its sites only.
    exact = lines.join(hinted(near, BROADCAST_LINES), "h").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n_sites"))
    return written(sure.union(exact.where(F.col("n_sites") >= min_sites)), "spread")


def lines_of_texts(docs: DataFrame, spread: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, hs, n), written: by a text's MD5 the lines of `spread` in it, and their characters in all its copies."""
    each = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.struct(_key(x).alias("h"), F.length(_inner(x)).cast("long").alias("n")))
    lines = docs.select(_digest(F.col(text_col)).alias("digest"), F.explode(each).alias("x")).select("digest", "x.h", "x.n").where("h is not null")
    return written(lines.join(hinted(spread.select("h"), BROADCAST_LINES), "h").groupBy("digest").agg(F.collect_set("h").alias("hs"), F.sum("n").alias("n")), "lines-of-texts")


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(h, n_sites) of the lines to remove, sites counted over hosts; and (digest, hs, n) of the texts with lines on enough sites.

    A null site is a site of its own; of a text's sites the smallest counts. Short texts
    (LEAST_COPIED) that differ in a line are thin pages, not copies: what they share on
    enough sites goes.
    """
    text, site = F.col(text_col), F.coalesce(F.col(site_col).cast("string"), F.lit("\x01"))
    keys = F.array_distinct(F.transform(F.split(text, "\n"), _key))
    lines = docs.select(F.xxhash64(site).alias("site"), F.explode(keys).alias("h")).where("h is not null")
    of_texts = lines_of_texts(docs, spread_lines(lines, min_sites), text_col)
    chars = F.aggregate(F.transform(F.split(text, "\n"), lambda x: F.length(_inner(x)).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    all_of_it = docs.where(text.isNotNull()).select(_digest(text).alias("digest"), site.alias("site"), chars.alias("chars")).groupBy("digest").agg(F.min("site").alias("site"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("copies"))
    hosts = all_of_it.join(of_texts.hint("merge"), "digest").where((COPIED[1] * F.col("n") < COPIED[0] * F.col("chars")) | (F.col("n") < LEAST_COPIED * F.col("copies")))
    return spread_lines(hosts.select(F.xxhash64("site").alias("site"), F.explode("hs").alias("h")), min_sites), of_texts


def strip_lines(docs: DataFrame, bad: DataFrame, of_texts: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __clean (the text without the lines of bad), __n_lines and __n_removed.

    The bad lines of each text are found once for all its copies and joined back by the
    text's digest; texts without any pass by.
    """
    each = of_texts.select(F.col("digest").alias("__digest"), F.explode("hs").alias("h"))
    of_text = each.join(hinted(bad.select("h"), BROADCAST_LINES), "h").groupBy("__digest").agg(F.collect_set("h").alias("__bad"))
    found = docs.withColumn("__digest", _digest(F.col(text_col))).join(written(of_text, "bad-of-texts").hint("merge"), "__digest", "left").drop("__digest")
    lines = F.split(F.col(text_col), "\n")
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__bad", _key(x)), F.lit(False)))
    return (
        found.withColumn("__n_lines", F.coalesce(F.size(F.filter(lines, lambda x: _key(x).isNotNull())), F.lit(0)).cast("long"))
        .withColumn("__clean", F.when(F.col("__bad").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
        .withColumn("__n_removed", F.when(F.col("__bad").isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long"))
        .drop("__bad")
    )


def remove_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with __clean, __n_lines, __n_removed; one row per input row.

    A null text has no lines and stays null; an empty one stays empty; blank lines are never
    removed. Equal rows get equal results. All columns are passed on.
    """
    bad, of_texts = boilerplate_lines(docs, site_col, text_col, min_sites)
    return strip_lines(docs, bad, of_texts, text_col)


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    clean = F.coalesce(F.col("__clean"), F.lit(""))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length(clean).cast("long").alias("clean_chars"), F.sha2(clean, 256).alias("clean_sha256"))


_TRIM = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS s, text FROM documents),
d AS (SELECT text, min(s) AS s, row_number() OVER () AS tid FROM t WHERE text IS NOT NULL GROUP BY text),
l AS (SELECT tid, line, regexp_replace(line, {_TRIM}, '', 'g') AS k, i FROM (SELECT tid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
c AS (SELECT DISTINCT tid, t.s FROM t JOIN d USING (text)),
spread AS (SELECT k FROM l JOIN c USING (tid) WHERE k <> '' GROUP BY k HAVING count(DISTINCT s) >= {MIN_SITES}),
hosts AS (SELECT tid FROM l GROUP BY tid HAVING {COPIED[1]} * sum(length(k)) FILTER (k IN (SELECT k FROM spread)) < {COPIED[0]} * sum(length(k)) OR sum(length(k)) FILTER (k IN (SELECT k FROM spread)) < {LEAST_COPIED}),
bad AS (SELECT k FROM l JOIN hosts USING (tid) JOIN d USING (tid) WHERE k IN (SELECT k FROM spread) GROUP BY k HAVING count(DISTINCT d.s) >= {MIN_SITES}),
o AS (SELECT tid, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (k IN (SELECT k FROM bad)) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM bad)), '') AS clean FROM l GROUP BY tid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(coalesce(clean, ''))::BIGINT AS clean_chars, sha256(coalesce(clean, '')) AS clean_sha256 FROM t LEFT JOIN d USING (text) LEFT JOIN o USING (tid)
"""
