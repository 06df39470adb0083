"""Reading and writing the engine's tables. All state is Parquet; a write never replaces what is being read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch while a table is written between steps.
ARROW_ROWS = 1000


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='redlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/redlake/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, zstd: bool = False) -> DataFrame:
    """df, written to the shared folder and read back: lineage is cut, sizes are known,
    and the rows stay the same however often they are read or executors are lost."""
    spark, path, key, clean = df.sparkSession, fresh_path(df.sparkSession, label), "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    # Rows may be long texts: fewer go to Python at once while this is written. Nothing reads its shuffles afterwards.
    was, cleaned = int(spark.conf.get(key)), spark.conf.get(clean, "false")
    spark.conf.set(key, str(was if 0 < was < ARROW_ROWS else ARROW_ROWS))
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path, compression="zstd" if zstd else None)
    finally:
        spark.conf.set(key, str(was))
        spark.conf.set(clean, cleaned)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes what this application wrote between steps. For the end of a job, when its results are stored elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checked(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df for a join: broadcast if it has at most `most` rows, which is counted; a larger one is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def append_events(events: DataFrame, path: str, partition: str = "kind") -> None:
    """Append change rows, partitioned so that readers of a kind skip the others."""
    events.write.mode("append").partitionBy(partition).parquet(path)


#: Characters of an error that the run log keeps.
ERROR_CHARS = 10_000
RUN = "run_id long, trigger string, baseline boolean, documents long, errors long, started_at timestamp, finished_at timestamp, error string"


def append_run(spark: SparkSession, path: str, **row: object) -> None:
    """One row of the run log."""
    spark.createDataFrame([tuple(row.get(c.split()[0]) for c in RUN.split(", "))], RUN).coalesce(1).write.mode("append").parquet(path)


def logged(rows: DataFrame, path: str, work: Callable[[DataFrame], None], failed: Column, **row: object) -> dict:
    """Does the work on rows, and appends a row of the run log with what the job itself counted.

    documents and errors (rows for which failed holds) are observed while the work's first
    action runs over rows: no second pass. A run that ends in an error leaves its row too,
    with the error and without counts, and the error goes on.
    """
    seen, spark, started, error, counts = Observation(), rows.sparkSession, datetime.now(), "", {}
    try:
        work(rows.observe(seen, F.count(F.lit(1)).alias("documents"), F.count_if(failed).alias("errors")))
        counts = seen.get
    except BaseException as e:
        error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        raise
    finally:
        append_run(spark, path, started_at=started, finished_at=datetime.now(), error=error, **row, **counts)
    return counts


def write_reports(reports: DataFrame, path: str) -> None:
    """A Markdown report per event, a record each, by kind: as many files as the log's size asks for."""
    reports.select("event_id", "kind", "report").write.partitionBy("kind").parquet(path)


def export_reports(reports: DataFrame, path: str) -> None:
    """A Markdown file per event, for a page of events; `wholetext` reads a file as one row."""
    reports.select("event_id", F.col("report").alias("value")).write.partitionBy("event_id").text(path)


def schema_upgrade(old: DataFrame, columns: Mapping[str, object]) -> DataFrame:
    """An old table with the columns it lacks, each with its default; those it has keep their values."""
    return old.withColumns({c: F.lit(v) for c, v in columns.items() if c not in old.columns})


def append_version(rows: DataFrame, path: str, version: int) -> None:
    """Rows as a version of a table's schema has them, in that version's folder."""
    rows.write.mode("append").parquet(f"{path}/schema_version={version}")


def read_versions(spark: SparkSession, path: str, schema: str, defaults: Mapping[str, object]) -> DataFrame:
    """All rows of a folder of files of several versions, with the columns and types of schema.

    Columns that a version lacks have their default, or null; a value that is null where the
    version has the column stays null. Types are widened (int to long, date to timestamp);
    a column that can't be widened is an error, as it would lose values. Other columns of a
    version are left out. A folder without files has no rows.
    """
    want = spark.createDataFrame([], schema).schema
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/schema_version=*")
    found = sorted(f.getPath().toString() for f in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top) or [])
    out = spark.createDataFrame([], want)
    for folder in found:
        part = spark.read.parquet(folder)
        for f in want:
            own = part.schema[f.name].dataType if f.name in part.columns else None
            if own is not None and own != f.dataType and f.dataType.simpleString() not in _WIDER.get(own.simpleString(), ()):
                raise TypeError(f"{folder}: {f.name} is {own.simpleString()}, which is not a part of {f.dataType.simpleString()}")
        out = out.unionByName(schema_upgrade(part, {f.name: defaults.get(f.name) for f in want}).select(*[F.col(f.name).cast(f.dataType) for f in want]))
    return out


#: What a type may become without losing a value.
_WIDER = {"tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp", "timestamp_ntz"), "void": ("string", "bigint", "int", "boolean", "double")}


def purge(events: DataFrame, kinds: list[str]) -> DataFrame:
    """events without the named kinds; a null kind stays."""
    return events.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)))
