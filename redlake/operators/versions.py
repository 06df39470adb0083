"""Version histories: latest, classified, compacted; presence over runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_in_order


def latest(versions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest version of each key: an aggregate, so that no key's history is sorted."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), *rest)).alias("m")).select(*keys, *[f"m.{c}" for c in rest])


def latest_two(versions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The two newest versions of each key, labelled new and old."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return versions.withColumn("rn", rn).where("rn <= 2").withColumn("which", F.when(F.col("rn") == 1, "new").otherwise("old")).drop("rn")


def with_previous(captures: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("run")
    return captures.withColumns({"prev_semantic": F.lag("semantic_sha256").over(w), "prev_html": F.lag("html_sha256").over(w), "prev_run": F.lag("run").over(w)})


def snapshot_required(previous: Column, current: Column) -> Column:
    """A version is kept if there is none before it or its text differs."""
    return previous.isNull() | (previous != current)


def classify(captures: DataFrame) -> DataFrame:
    """captures with `change` against the capture before: first, content, markup or same."""
    change = (
        F.when(F.col("prev_semantic").isNull(), "first")
        .when(F.col("prev_semantic") != F.col("semantic_sha256"), "content")
        .when(F.col("prev_html") != F.col("html_sha256"), "markup")
        .otherwise("same")
    )
    return with_previous(captures).withColumn("change", change)


def compact(captures: DataFrame) -> DataFrame:
    """The captures that differ from the one before: A, A, B, A becomes A, B, A."""
    return classify(captures).where("change <> 'same'")


def classify_attachments(versions: DataFrame) -> DataFrame:
    """versions (key, run, binary_sha256, text_sha256) with `change`: first, same, binary (text equal and not empty) or content."""
    w = Window.partitionBy("key").orderBy("run")
    binary, text = F.lag("binary_sha256").over(w), F.lag("text_sha256").over(w)
    change = F.when(binary.isNull(), "first").when(binary == F.col("binary_sha256"), "same").when((F.col("text_sha256") != "") & (text == F.col("text_sha256")), "binary").otherwise("content")
    return versions.withColumn("change", change)


def presence(captures: DataFrame, runs: int = 2) -> DataFrame:
    """(key, run, kind): removed in the run that is the second in a row without the key, restored when it is seen again.

    Runs are numbers without gaps; the last run of any key ends the history. Gaps between a
    key's sightings say all: no run is simulated.
    """
    last = captures.agg(F.max("run").alias("last"))
    w = Window.partitionBy("key").orderBy("run")
    seen = captures.select("key", "run").distinct().withColumn("next", F.lead("run").over(w)).crossJoin(F.broadcast(last))
    gap = seen.where((F.coalesce("next", F.col("last") + 1) - F.col("run")) > runs)
    removed = gap.select("key", (F.col("run") + runs).alias("run"), F.lit("document_removed").alias("kind"))
    restored = gap.where("next is not null").select("key", F.col("next").alias("run"), F.lit("document_restored").alias("kind"))
    return removed.unionByName(restored)


def missing_streak(captures: DataFrame, runs: int = 2) -> DataFrame:
    """(key, missing_runs, active) after the last run; missing runs aren't counted beyond the removal."""
    last = captures.agg(F.max("run").alias("last"))
    gone = F.col("last") - F.col("seen")
    return captures.groupBy("key").agg(F.max("run").alias("seen")).crossJoin(F.broadcast(last)).select("key", F.least(gone, F.lit(runs)).cast("long").alias("missing_runs"), (gone < runs).alias("active"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the smallest `order`; null keys are keys like others. An aggregate: a hot key is reduced before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    least = rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__m"))
    return least.select(*[F.col(f"__m.{c}") if c not in keys else F.col(c) for c in rows.columns])


def throttle(notices: DataFrame, seconds: int = 60) -> DataFrame:
    """(key, id, at, sent): a notice is sent if none was sent in the `seconds` before it. Each key is folded in order."""
    wait = timedelta(seconds=seconds)

    def step(last: datetime | None, row: dict) -> tuple[datetime, tuple]:
        send = last is None or row["at"] >= last + wait
        return row["at"] if send else last, (send,)

    return fold_in_order(notices.select("key", "id", "at"), "key", ["at", "id"], step, "sent boolean")
