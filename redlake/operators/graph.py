"""Walks over link graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redlake.sources.tables import fresh_path, written

MAX_ROUNDS = 1000
MAX_NODES = 10_000_000_000
#: A catalogue that is crawled and has more pages than this is taken for a trap.
MAX_PAGES = 10_000


#: Nodes that are broadcast at most: a frontier, what was seen, what is closed.
BROADCAST_NODES = 100_000


def adjacency(edges: DataFrame, buckets: int | None = None) -> DataFrame:
    """edges (src, dst, ...) as a table, each once, bucketed and sorted by src: rounds join it as it lies. As many buckets as a shuffle has parts, unless said."""
    spark, name = edges.sparkSession, f"adjacency_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.distinct().repartition(buckets, "src")
    rows.write.bucketBy(buckets, "src").sortBy("src").option("path", fresh_path(spark, "adjacency")).saveAsTable(name)
    return spark.table(name)


def _few(df: DataFrame, n: int) -> DataFrame:
    """df, counted as n nodes, for a join."""
    return F.broadcast(df) if n <= BROADCAST_NODES else df.hint("merge")


def bfs(edges: DataFrame, roots: DataFrame, closed: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(node, depth): what edges (src, dst) reach from roots; closed nodes are reached but not expanded.

    A round joins the frontier with the edges and takes away what was seen; each round's new
    nodes are written, so lineage stays short and cycles end. A frontier that is counted as
    small is broadcast, and so is what was seen: then the round's one shuffle is that of the
    new nodes. A larger frontier is dealt to the buckets of an `adjacency`, whose links stay
    where they are. More than max_nodes is an error.
    """
    closed = written(closed.select("node").distinct(), "closed")
    closed = _few(closed, closed.limit(BROADCAST_NODES + 1).count())
    frontier = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, total = frontier, frontier.count()
    n = total
    for depth in range(1, MAX_ROUNDS):
        open_ = frontier.join(closed, "node", "left_anti").select(F.col("node").alias("src"))
        found = edges.join(_few(open_, n), "src", "left_semi").select(F.col("dst").alias("node"))
        frontier = written(found.join(_few(seen.select("node"), total), "node", "left_anti").distinct().withColumn("depth", F.lit(depth)), "frontier")
        n = frontier.count()
        if not n:
            break
        total += n
        if total > max_nodes:
            raise ValueError(f"more than {max_nodes} nodes")
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError(f"not at an end after {MAX_ROUNDS} rounds")
    return seen


def discover(links: DataFrame, roots: DataFrame, muted: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """(node): the documents that links (src, dst, is_document) lead to from roots.

    Other pages are walked through; what muted pages link to is neither walked nor a
    document. Documents are leaves. More than max_pages pages are an error; None is for
    links of a stored table, which has an end.
    """
    links = adjacency(links)
    pages = bfs(links.where("not is_document").select("src", "dst"), roots, muted, max_pages or MAX_NODES)
    open_ = written(pages.join(muted.hint("merge"), "node", "left_anti").select(F.col("node").alias("src")), "open")
    open_ = _few(open_, open_.limit(BROADCAST_NODES + 1).count())
    return links.where("is_document").join(open_, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
