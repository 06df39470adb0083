"""Findings of round 3, a test each."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from redlake.operators import graph
from redlake.plans import registry
from redlake.sources import blobs
from redlake.sources.tables import fresh_path
from redlake.streaming import streams


def test_a_stored_catalogue_may_be_larger_than_a_crawl(spark):
    n = graph.MAX_PAGES + 100
    pages = spark.range(n).select(F.lit("r").alias("src"), F.format_string("p%d", "id").alias("dst"), F.lit(False).alias("is_document"))
    files = spark.range(n).select(F.format_string("p%d", "id"), F.format_string("d%d", "id"), F.lit(True))
    links, root, muted = pages.union(files), spark.createDataFrame([("r",)], "node string"), spark.createDataFrame([("p7",)], "node string")
    assert graph.discover(links, root, muted, max_pages=None).count() == n - 1
    with pytest.raises(ValueError, match="more than 10000"):
        graph.discover(links, root, muted)


def against_sql(spark, name, **tables):
    """A query's rows over the given tables, and those of its SQL."""
    path, duck = fresh_path(spark, "tables").removeprefix("file://"), duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"file://{path}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got = registry.queries()[name](spark, f"file://{path}")
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r[c] for c in columns) for r in got.collect()), sorted(want)


@pytest.mark.parametrize("name", ["page_title", "content_root"])
def test_entities_that_are_cut_off(spark, name):
    """A title that was cut inside an entity: HTML takes &amp without a semicolon for &."""
    cut = ["a &amp;&amp", "b &amp;amp; &lt", "c &quot;x&quot", "d &am", "e &amp;lt", "f &ampx &gty"]
    pages = spark.createDataFrame([(i, "http://a.test/", f"<body><article><h1>{t}</h1><p>x</p></article></body>") for i, t in enumerate(cut)], "page_id long, url string, html string")
    got, want = against_sql(spark, name, pages=pages)
    assert got == want
    if name == "page_title":
        assert [t for _, t in got] == ["a &&", "b &amp; <", 'c "x"', "d &am", "e &lt", "f &x >y"]


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def test_two_events_in_an_interval(spark):
    """One row an interval, in the SQL too, which made one of each time in it."""
    rows = [(1, 26.417, "purchase"), (2, 26.476, "click"), (3, 27.9, "signup"), (4, 30.0, "view"), (5, 120.0, "click")]
    events = spark.createDataFrame(rows, "event_id long, s double, event_type string").selectExpr("event_id", "timestamp_ntz'2024-01-14' + make_dt_interval(0, 0, 0, cast(s as decimal(18,6))) as ts", "7L as user_id", "event_type")
    got, want = against_sql(spark, "latest_per_interval", events=events)
    assert got == want and len(got) == 2


def test_a_batch_is_dealt_by_its_rows(spark, monkeypatch):
    """However few files a batch is, tasks make a bounded number of its pairs distinct."""
    monkeypatch.setattr(streams, "BATCH_ROWS", 100)
    seen, keep = [], streams.written
    monkeypatch.setattr(streams, "written", lambda df, label: seen.append(df.rdd.getNumPartitions()) or keep(df, label))
    pairs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("chat_id"))
    path = fresh_path(spark, "ledger")
    streams.book(path, pairs.union(pairs), 0)
    assert seen == [20] and streams.ledger(spark, path).count() == 1000


def test_many_objects_are_listed_and_opened_by_executors(spark, tmp_path):
    """The driver makes no list of the store's files; objects without bytes, and keys without an object, are told."""
    root, texts = f"file://{tmp_path}/store", ["", *map(str, range(200))]
    stored = blobs.put(spark.createDataFrame([(t.encode(), ".txt") for t in texts], "data binary, suffix string"), root).collect()
    (tmp_path / "store" / stored[5].key).parent.joinpath("_left-by-a-lost-task").write_bytes(b"half")
    objects = blobs.objects(spark, root)
    assert not objects.inputFiles() and sorted(map(tuple, objects.collect())) == sorted(map(tuple, stored))
    keys = [r.key for r in stored]
    got = blobs.read(spark.createDataFrame([(k,) for k in [*keys, keys[0], None, "00/00/" + "0" * 64, keys[3][:5], "no key"]], "key string"), root)
    assert not [f for f in got.inputFiles() if "/store/" in f]
    want = {r.key: t.encode() for r, t in zip(stored, texts, strict=True)} | dict.fromkeys(["00/00/" + "0" * 64, keys[3][:5], "no key"])
    rows = got.collect()
    assert {r.key: None if r.data is None else bytes(r.data) for r in rows} == want and len(rows) == len(want)
    assert all(r.len == (None if r.data is None else len(r.data)) for r in rows) and hashlib.sha256(b"7").hexdigest() in keys[8]
