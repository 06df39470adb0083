"""Findings of round 4 on attachments, a test each."""

import hashlib

import duckdb
import pytest

from redlake.functions import html
from redlake.plans import registry, sources
from redlake.sources import blobs

sha = lambda data: hashlib.sha256(data).hexdigest()


def test_the_text_of_an_attachment_is_stored_too(spark, tmp_path):
    """A version row has the hash and key of its text, and keys are the store's own; equal bytes under another address have no text."""
    odt, other, root = html.make_odt("a  b\nc"), html.make_odt("a b\nc\n"), f"file://{tmp_path}/store"
    text = b"a b\nc"
    rows = [(1, "http://a.test/x.odt", "", odt), (2, "http://a.test/x.odt?v=1", "", odt), (3, "http://a.test/y", "application/vnd.opendocument.text", other), (4, "http://a.test/z.ODT", None, b"no archive"), (5, None, None, b"page"), (6, "http://a.test/n.odt", "", None), (7, "http://a.test/e.odt", "", html.make_odt(""))]
    fetched = spark.createDataFrame(rows, "id long, url string, content_type string, data binary")
    got = {r.id: r.asDict() for r in sources.ingested(fetched, root).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    key = lambda data, suffix: f"{sha(data)[:2]}/{sha(data)[2:4]}/{sha(data)}{suffix}"
    for (i, _, _, data), suffix, t in zip(rows, [".odt", ".odt", ".odt", ".odt", ".bin", ".odt", ".odt"], [text, b"", text, b"", b"", b"", b""], strict=True):
        want = {"id": i, "binary_sha256": data and sha(data), "content_length": data and len(data), "suffix": suffix, "object_key": data and key(data, suffix), "semantic_sha256": sha(t) if t else "", "extracted_text_key": key(t, ".txt") if t else ""}
        assert got[i] == want
    stored = {r.key for r in blobs.objects(spark, root).collect()}
    assert stored == {r["object_key"] for r in got.values() if r["object_key"]} | {key(text, ".txt")}
    assert [bytes(r.data) for r in blobs.read(spark.createDataFrame([(key(text, ".txt"),)], "key string"), root).collect()] == [text]


@pytest.mark.parametrize("url", ["http://a.test/x.odt", None])
def test_pages_without_bytes_are_kept(spark, tmp_path, url):
    pages = spark.createDataFrame([(1, url, None), (2, url, ""), (3, url, "<p>x</p>"), (4, url, "<p>x</p>")], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = registry.queries()["attachment_ingest"](spark, f"file://{tmp_path}")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['attachment_ingest']}) ORDER BY page_id").fetchall()
    assert sorted(map(tuple, got.collect())) == want and len(want) == 4
