"""Current-state tables: a new version of the state from the old one and a run's captures.

A state is kept in buckets of its key, and each version of it has a manifest that names the
folder of every bucket. A new version writes the buckets that captures fall into; the
manifest carries the others over by name, so their files are never read or written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a state.
BUCKETS = 64


def _with_bucket(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _folders(spark: SparkSession, pattern: str) -> dict[int, str]:
    """The number at the end of a folder's name -> its path."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top) or []
    return {int(p.rpartition("=")[2]): p for p in (f.getPath().toString() for f in found)}


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest version of a state and its buckets' folders, a row a bucket; -1 and none before the first."""
    done = _folders(spark, f"{path}/manifest/*/done=*")
    if not done:
        return -1, {}
    return max(done), {r.bucket: r.folder for r in spark.read.schema("bucket int, folder string").json(done[max(done)]).collect()}


def _read(spark: SparkSession, folders: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of a state."""
    return _read(spark, list(manifest(spark, path)[1].values()), schema)


def update_state(captured: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], schema, buckets: int = BUCKETS) -> list[int]:
    """A new version of the state under `path`: merge(its rows, captured), bucket by bucket; the buckets that were written.

    captured has the key columns; its null keys make no bucket of their own. What merge
    gives has the columns of schema. A version counts once its manifest, which is written
    last, is there: a job that ends before leaves the state as it was.
    """
    spark = captured.sparkSession
    version, old = manifest(spark, path)
    rows = _with_bucket(captured, keys, buckets)
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
    current = _read(spark, [old[b] for b in touched if b in old], schema)
    data = f"{path}/data/version={version + 1}"
    _with_bucket(merge(current, captured), keys, buckets).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    new = _folders(spark, f"{data}/bucket=*")
    kept = {b: f for b, f in old.items() if b not in touched} | new
    spark.createDataFrame(sorted(kept.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version + 1}/written")
    at, done = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{version + 1}/{x}") for x in ("written", f"done={version + 1}"))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, done):
        raise RuntimeError(f"{path}: version {version + 1} is there")
    return sorted(new)


def _kept(new: Column, old: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.when(new != "", new), old)


def upsert_documents(current: DataFrame, captured: DataFrame) -> DataFrame:
    """(id, title, category, active): captured rows are active; an empty title or category keeps the old one."""
    c, n = current.alias("c"), captured.alias("n")
    seen = F.col("n.id").isNotNull()
    return c.join(n, F.col("c.id") == F.col("n.id"), "full_outer").select(
        F.coalesce("n.id", "c.id").alias("id"),
        F.coalesce(_kept(F.col("n.title"), F.col("c.title")), F.lit("")).alias("title"),
        F.coalesce(_kept(F.col("n.category"), F.col("c.category")), F.lit("")).alias("category"),
        F.when(seen, True).otherwise(F.col("c.active")).alias("active"),
    )


def upsert_attachments(current: DataFrame, captured: DataFrame) -> DataFrame:
    """(document_id, url, display_name, active): captured links are active and take the new name."""
    c, n = current.alias("c"), captured.alias("n")
    same = (F.col("c.document_id") == F.col("n.document_id")) & (F.col("c.url") == F.col("n.url"))
    seen = F.col("n.url").isNotNull()
    return c.join(n, same, "full_outer").select(
        F.coalesce("n.document_id", "c.document_id").alias("document_id"),
        F.coalesce("n.url", "c.url").alias("url"),
        F.when(seen, F.col("n.display_name")).otherwise(F.col("c.display_name")).alias("display_name"),
        F.when(seen, True).otherwise(F.col("c.active")).alias("active"),
    )


def touch_not_modified(current: DataFrame, captured: DataFrame) -> DataFrame:
    """State after a run in which equal validators say nothing changed: only last_seen, active and missing_runs move."""
    n = captured.select("key", F.col("validator").alias("v"), F.col("seen_at"))
    same = F.coalesce(F.col("validator") == F.col("v"), F.lit(False)) & (F.col("validator") != "")
    return current.join(n, "key", "left").select(
        "key", "validator",
        F.when(same, F.col("seen_at")).otherwise(F.col("last_seen")).alias("last_seen"),
        (same | F.col("active")).alias("active"),
        F.when(same, 0).otherwise(F.col("missing_runs")).cast("long").alias("missing_runs"),
    )
