"""Queries over scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redlake.functions import html, urls
from redlake.functions.text import clean_attachment_text, sha256
from redlake.operators import events as ev
from redlake.operators import versions
from redlake.sources import blobs, state, tables

from .base import Inputs, query

QUOTA = 100_000


@query("scan_captures", "SELECT page_id, url, strlen(html)::BIGINT AS n_bytes, sha256(html) AS html_sha256 FROM pages")
def scan_captures(x: Inputs) -> DataFrame:
    return x.table("pages").select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"), sha256(F.col("html")).alias("html_sha256"))


@query("scan_tables", "SELECT id, title, category, active, url FROM documents_dim", "documents_dim")
def scan_tables(x: Inputs) -> DataFrame:
    return x.documents_dim


@query("scan_blobs", "SELECT DISTINCT b.digest, b.len, left(d.text, 40) AS head FROM (SELECT store, max_by(digest, seq) AS digest FROM blobs GROUP BY store) r JOIN blobs b USING (digest) JOIN documents d ON sha256(d.text) = b.digest", "blobs")
def scan_blobs(x: Inputs) -> DataFrame:
    """The newest object of each source, its bytes read from the store by key."""
    root = tables.fresh_path(x.spark, "store")
    stored = tables.written(blobs.put(texts(x), root), "puts")
    newest = versions.latest(x.blobs, ["store"], "seq").select("digest").distinct()
    found = blobs.read(newest.join(stored.select("digest", "key").hint("merge"), "digest"), root)
    return tables.written(found.select(F.substring("key", 7, 64).alias("digest"), "len", F.substring(F.decode("data", "UTF-8"), 1, 40).alias("head")), "heads")


def texts(x: Inputs) -> DataFrame:
    """The documents as bytes to store."""
    return x.table("documents").select("lang", F.col("text").cast("binary").alias("data"), F.lit(".txt").alias("suffix"))


@query("cas_put", "SELECT digest, suffix, min(len) AS len, left(digest, 2) || '/' || digest[3:4] || '/' || digest || suffix AS key FROM (SELECT digest, '.txt' AS suffix, len FROM blobs WHERE lang <> 'fr') WHERE digest NOT IN (SELECT digest FROM blobs WHERE lang = 'fr') GROUP BY digest, suffix", "blobs")
def cas_put(x: Inputs) -> DataFrame:
    """What a second batch of puts adds to the files of a store."""
    root, rows = tables.fresh_path(x.spark, "store"), texts(x)
    tables.written(blobs.put(rows.where("lang = 'fr'"), root), "puts")
    before = tables.written(blobs.objects(x.spark, root), "objects")
    tables.written(blobs.put(rows.where("lang <> 'fr'"), root), "puts")
    return tables.written(blobs.objects(x.spark, root), "objects").join(before.select("key").hint("merge"), "key", "left_anti").select("digest", "suffix", "len", "key")


@query("cas_usage", f"SELECT count(*) AS n_objects, sum(len)::BIGINT AS used_bytes, sum(len) >= {QUOTA} AS full FROM (SELECT digest, min(len) AS len FROM blobs GROUP BY digest)", "blobs")
def cas_usage(x: Inputs) -> DataFrame:
    return blobs.usage(x.blobs, QUOTA)


@query(
    "quota_admission",
    f""", f AS (SELECT store, digest, min(seq) AS seq, min(len) AS len FROM blobs GROUP BY store, digest), n AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq) AS rn FROM f),
    r AS (SELECT store, seq, len, rn, len <= {QUOTA} AS admitted, CASE WHEN len <= {QUOTA} THEN len ELSE 0 END AS used FROM n WHERE rn = 1
      UNION ALL SELECT n.store, n.seq, n.len, n.rn, r.used + n.len <= {QUOTA}, CASE WHEN r.used + n.len <= {QUOTA} THEN r.used + n.len ELSE r.used END FROM r JOIN n ON n.store = r.store AND n.rn = r.rn + 1)
    SELECT store, seq, len, admitted, used::BIGINT AS used FROM r""",
    "blobs",
)
def quota_admission(x: Inputs) -> DataFrame:
    return blobs.quota_admission(x.blobs, QUOTA)


@query("quota_prefix", f", f AS (SELECT store, digest, min(seq) AS seq, min(len) AS len FROM blobs GROUP BY store, digest) SELECT store, seq, (sum(len) OVER w)::BIGINT AS running_bytes, sum(len) OVER w > {QUOTA} AS over_quota FROM f WINDOW w AS (PARTITION BY store ORDER BY seq)", "blobs")
def quota_prefix(x: Inputs) -> DataFrame:
    return blobs.quota_prefix(x.blobs, QUOTA)


@query("append_events", "SELECT id, document_id, kind, summary, details FROM change_log", "change_log")
def append_events(x: Inputs) -> DataFrame:
    path = tables.fresh_path(x.spark, "events")
    log = x.change_log.select("id", "document_id", "kind", "summary", "details")
    tables.append_events(log.where(F.col("document_id").isNotNull()), path)
    tables.append_events(log.where(F.col("document_id").isNull()), path)
    return x.spark.read.schema(log.schema).parquet(path)


def updated(x: Inputs, current: DataFrame, captured: DataFrame, keys: list[str], merge) -> DataFrame:
    """A stored state after a run: its first version is current, its second what captured makes of it."""
    path = tables.fresh_path(x.spark, "state")
    state.update_state(current, path, keys, lambda _, first: first, current.schema)
    state.update_state(captured, path, keys, merge, current.schema)
    return state.read_state(x.spark, path, current.schema)


_CAPTURED = "SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN '' ELSE c_name || ' v2' END AS title, CASE WHEN c_nationkey > 20 THEN '' ELSE c_mktsegment END AS category FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey + 10000000, s_name, '' FROM supplier"


@query(
    "upsert_document_state",
    f""", n AS ({_CAPTURED}) SELECT coalesce(n.id, c.id) AS id, coalesce(nullif(n.title, ''), c.title, '') AS title, coalesce(nullif(n.category, ''), c.category, '') AS category,
    CASE WHEN n.id IS NOT NULL THEN true ELSE c.active END AS active FROM documents_dim c FULL JOIN n ON c.id = n.id""",
    "documents_dim",
)
def upsert_document_state(x: Inputs) -> DataFrame:
    captured = x.spark.sql(_CAPTURED.replace("FROM customer", "FROM {customer}").replace("FROM supplier", "FROM {supplier}"), customer=x.table("customer"), supplier=x.table("supplier"))
    return updated(x, x.documents_dim.select("id", "title", "category", "active"), captured, ["id"], state.upsert_documents)


@query(
    "upsert_attachment_state",
    """, c AS (SELECT document_id, url, title AS display_name, url LIKE '%.pdf' AS active FROM attachment_links WHERE url NOT LIKE '%.zip'), n AS (SELECT document_id, url, upper(title) AS display_name FROM attachment_links WHERE url NOT LIKE '%.docx')
    SELECT coalesce(n.document_id, c.document_id) AS document_id, coalesce(n.url, c.url) AS url, CASE WHEN n.url IS NOT NULL THEN n.display_name ELSE c.display_name END AS display_name, CASE WHEN n.url IS NOT NULL THEN true ELSE c.active END AS active
    FROM c FULL JOIN n ON c.document_id = n.document_id AND c.url = n.url""",
    "attachment_links",
)
def upsert_attachment_state(x: Inputs) -> DataFrame:
    links = x.attachment_links
    current = links.where(~links.url.endswith(".zip")).select("document_id", "url", links.title.alias("display_name"), links.url.endswith(".pdf").alias("active"))
    captured = links.where(~links.url.endswith(".docx")).select("document_id", "url", F.upper("title").alias("display_name"))
    return updated(x, current, captured, ["document_id", "url"], state.upsert_attachments)


_STATE_CTES = """, cur AS (SELECT key, max_by(html_sha256, run) AS validator, max_by(fetched_at, run) AS last_seen, max(run) % 2 = 0 AS active, max(run) % 3 AS missing_runs FROM captures WHERE run < 20 GROUP BY key),
    nxt AS (SELECT key, min_by(html_sha256, run) AS v, min_by(fetched_at, run) AS seen_at FROM captures WHERE run >= 20 GROUP BY key)"""


def _states(x: Inputs) -> tuple[DataFrame, DataFrame]:
    before, after = x.captures.where("run < 20"), x.captures.where("run >= 20")
    current = before.groupBy("key").agg(F.max_by("html_sha256", "run").alias("validator"), F.max_by("fetched_at", "run").alias("last_seen"), (F.max("run") % 2 == 0).alias("active"), (F.max("run") % 3).alias("missing_runs"))
    return current, after.groupBy("key").agg(F.min_by("html_sha256", "run").alias("validator"), F.min_by("fetched_at", "run").alias("seen_at"))


@query(
    "touch_not_modified",
    _STATE_CTES + """ SELECT key, validator, CASE WHEN validator = v THEN seen_at ELSE last_seen END AS last_seen, active OR coalesce(validator = v, false) AS active, CASE WHEN validator = v THEN 0 ELSE missing_runs END::BIGINT AS missing_runs FROM cur LEFT JOIN nxt USING (key)""",
    "captures",
)
def touch_not_modified(x: Inputs) -> DataFrame:
    return updated(x, *_states(x), ["key"], state.touch_not_modified)


@query("validator_match", _STATE_CTES + " SELECT key, coalesce(validator = v, false) AS not_modified FROM nxt LEFT JOIN cur USING (key)", "captures")
def validator_match(x: Inputs) -> DataFrame:
    current, captured = _states(x)
    stored = current.select("key", F.nullif("validator", F.lit("")).alias("stored"))
    return captured.join(stored, "key", "left").select("key", F.coalesce(F.col("stored") == F.col("validator"), F.lit(False)).alias("not_modified"))


@query("run_log", "SELECT trigger, count(*) AS n_runs, count(finished_at) AS n_finished, count(*) FILTER (finished_at IS NULL) AS n_failed FROM runs GROUP BY trigger", "runs")
def run_log(x: Inputs) -> DataFrame:
    """A logged run for each trigger; what it counts is observed in the job that stores its rows."""
    path, stored = tables.fresh_path(x.spark, "run-log"), tables.fresh_path(x.spark, "runs")
    runs = tables.written(x.runs, "runs")
    for n, r in enumerate(runs.select("trigger").distinct().orderBy("trigger").collect()):  # a handful
        store = lambda rows, r=r: rows.write.parquet(f"{stored}/{hash(r.trigger) & 0xFFFFFFFF:x}")
        tables.logged(runs.where(F.col("trigger").eqNullSafe(F.lit(r.trigger))), path, store, F.col("finished_at").isNull(), run_id=n, trigger=r.trigger, baseline=False)
    log = x.spark.read.schema(tables.RUN).parquet(path)
    return log.select("trigger", F.col("documents").alias("n_runs"), (F.col("documents") - F.col("errors")).alias("n_finished"), F.col("errors").alias("n_failed"))


@query("delivery_ledger", "SELECT id AS event_id, chat_id FROM change_log, recipients WHERE status = 'approved' AND kind = 'document_added' UNION SELECT event_id, chat_id FROM deliveries", "deliveries")
def delivery_ledger(x: Inputs) -> DataFrame:
    """The ledger after two batches, the second of them twice."""
    from redlake.operators import delivery
    from redlake.streaming import streams

    path = tables.fresh_path(x.spark, "ledger")
    streams.book(path, x.deliveries, 0)
    batch = delivery.fan_out(x.change_log.where("kind = 'document_added'"), delivery.approved(x.recipients)).select(F.col("id").alias("event_id"), "chat_id")
    for _ in range(2):
        streams.book(path, batch.union(batch), 1)
    return streams.ledger(x.spark, path)


@query("purge_errors", "SELECT id, kind FROM change_log WHERE kind NOT IN ('fetch_error', 'storage_error')", "change_log")
def purge_errors(x: Inputs) -> DataFrame:
    return tables.purge(x.change_log, list(ev.ERRORS)).select("id", "kind")


@query("schema_upgrade", "SELECT c_custkey AS id, c_name AS title, '' AS current_etag, '' AS current_last_modified, 0::BIGINT AS missing_runs FROM customer")
def schema_upgrade(x: Inputs) -> DataFrame:
    """A folder of files from before and after columns were added and ids widened."""
    path, every = tables.fresh_path(x.spark, "documents"), x.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    tables.append_version(every.where("id % 2 = 0 and id < 2147483648").withColumn("id", F.col("id").cast("int")), path, 1)
    new = {"current_etag": "", "current_last_modified": "", "missing_runs": 0}
    tables.append_version(tables.schema_upgrade(every.where("id % 2 = 1 or id >= 2147483648"), new), path, 2)
    return tables.read_versions(x.spark, path, "id long, title string, current_etag string, current_last_modified string, missing_runs long", new)


_SUFFIX = r"coalesce(nullif(regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$'), ''), '.bin')"


def ingested(fetched: DataFrame, root: str) -> DataFrame:
    """Version rows of attachments (id, url, content_type, data): the bytes go to the store under `root`, and so does the text of those that have one.

    Keys are those that the store tells; length, digest and text are those of the object that
    is read back from it. An attachment without text has '' for the text's hash and key, one
    without bytes has nulls. Equal texts are one object.
    """
    rows = fetched.select("id", "data", urls.path_suffix(F.col("url"), F.col("content_type")).alias("suffix"), html.is_odt("url", "content_type").alias("odt"))
    stored = tables.written(blobs.put(rows, root, "id", "odt"), "puts")
    odt = stored.where("key is not null").groupBy("key").agg(F.max("odt").alias("odt"))
    text = F.when(F.col("odt"), clean_attachment_text(html.extracted("data", F.lit(""), F.when(F.col("odt"), ".odt").otherwise(""))))
    found = blobs.read(stored, root).join(odt.hint("merge"), "key").select("key", F.sha2("data", 256).alias("binary_sha256"), F.octet_length("data").cast("long").alias("content_length"), text.alias("text"))
    found = tables.written(found, "read")
    texts = found.where("text <> ''").select("key", F.col("text").alias("data"), F.lit(".txt").alias("suffix")).withColumnRenamed("key", "of")
    texts = tables.written(blobs.put(texts, root, "of"), "texts").select(F.col("of").alias("key"), F.col("digest").alias("semantic_sha256"), F.col("key").alias("extracted_text_key"))
    both = found.drop("text").join(texts.hint("merge"), "key", "left")
    own = lambda c: F.when(F.col("odt"), F.coalesce(c, F.lit(""))).otherwise("").alias(c)
    return stored.select("id", "suffix", "odt", "key").join(both.hint("merge"), "key", "left").select(
        "id", "binary_sha256", own("semantic_sha256"), "content_length", "suffix", F.col("key").alias("object_key"), own("extracted_text_key")
    )


@query("attachment_ingest", f"SELECT page_id, sha256(html) AS binary_sha256, '' AS semantic_sha256, strlen(html)::BIGINT AS content_length, {_SUFFIX} AS suffix, left(sha256(html), 2) || '/' || sha256(html)[3:4] || '/' || sha256(html) || {_SUFFIX} AS object_key, '' AS extracted_text_key FROM pages")
def attachment_ingest(x: Inputs) -> DataFrame:
    """Version rows of what was fetched. Pages are no ODTs, so their text is empty; tests ingest ODTs."""
    fetched = x.table("pages").select(F.col("page_id").alias("id"), "url", F.lit("text/html").alias("content_type"), F.col("html").cast("binary").alias("data"))
    return ingested(fetched, tables.fresh_path(x.spark, "store")).withColumnRenamed("id", "page_id")


@query("odt_text")
def odt_text(x: Inputs) -> DataFrame:
    """The text of ODT attachments in the store. The tables have none, so objects are made of the documents' texts first; tests hold the texts against the documents."""
    root = tables.fresh_path(x.spark, "store")
    made = x.table("documents").select("doc_id", html.odt_of("text").alias("data"), F.lit(".odt").alias("suffix"))
    made = tables.written(made.withColumn("key", blobs.object_key(F.sha2("data", 256), F.col("suffix"))), "attachments")
    stored = tables.written(blobs.put(made, root), "puts")
    text = clean_attachment_text(html.extracted("data", F.lit(""), "key"))
    found = blobs.read(stored, root).select("key", text.alias("text"))
    return made.select("doc_id", "key").join(found.hint("merge"), "key").select("doc_id", F.length("text").cast("long").alias("n_chars"), "text")
