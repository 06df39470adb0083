"""Queries over filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redlake.functions import urls
from redlake.functions.text import category_key, category_token
from redlake.operators import delivery, versions
from redlake.operators import events as ev
from redlake.sources.tables import checked

from .base import Inputs, query

_MEANINGFUL = "(" + ", ".join(f"'{k}'" for k in ev.MEANINGFUL) + ")"
_ERRORS = "(" + ", ".join(f"'{k}'" for k in ev.ERRORS) + ")"
PREFIX = "https://docs.example.test/"
MUTED = "MACHINERY, household ,, "


@query("filter_meaningful", f"SELECT id, kind FROM change_log WHERE kind IN {_MEANINGFUL}", "change_log")
def filter_meaningful(x: Inputs) -> DataFrame:
    return ev.meaningful(x.change_log).select("id", "kind")


@query("filter_errors", f"SELECT id, kind FROM change_log WHERE kind IN {_ERRORS}", "change_log")
def filter_errors(x: Inputs) -> DataFrame:
    return ev.errors(x.change_log).select("id", "kind")


@query("filter_active", "SELECT id, title FROM documents_dim WHERE active", "documents_dim")
def filter_active(x: Inputs) -> DataFrame:
    return x.documents_dim.where("active").select("id", "title")


@query("filter_pending", "SELECT id, kind, summary FROM change_log WHERE NOT notified ORDER BY id", "change_log")
def filter_pending(x: Inputs) -> DataFrame:
    return ev.pending(x.change_log).select("id", "kind", "summary").orderBy("id")


@query("filter_finished_runs", "SELECT id, finished_at FROM runs WHERE finished_at IS NOT NULL", "runs")
def filter_finished_runs(x: Inputs) -> DataFrame:
    return x.runs.where(F.col("finished_at").isNotNull()).select("id", "finished_at")


@query("ignored_category_filter", "SELECT id, category FROM documents_dim WHERE lower(category) NOT IN ('machinery', 'household')", "documents_dim")
def ignored_category_filter(x: Inputs) -> DataFrame:
    muted = _configured(x)
    return x.documents_dim.withColumn("key", category_key(F.col("category"))).join(F.broadcast(muted), "key", "left_anti").select("id", "category")


def _configured(x: Inputs) -> DataFrame:
    """Keys of the configured mutes: one short setting, whatever the tables' size."""
    from redlake.functions.text import split_keys

    return x.spark.range(1).select(F.explode(split_keys(F.lit(MUTED))).alias("key"))


@query("ignored_category_deactivate", "SELECT id, active AND lower(category) NOT IN ('machinery', 'household') AS active FROM documents_dim", "documents_dim")
def ignored_category_deactivate(x: Inputs) -> DataFrame:
    muted = _configured(x).withColumn("muted", F.lit(True))
    d = x.documents_dim.withColumn("key", category_key(F.col("category"))).join(F.broadcast(muted), "key", "left")
    return d.select("id", F.when(F.col("muted"), False).otherwise(F.col("active")).alias("active"))


@query("is_document_url", "SELECT url, contains(url, '/machinery/') AND ends_with(url, '/v1') AS is_document FROM (SELECT url FROM documents_dim UNION ALL SELECT url || '/v1' FROM documents_dim)", "documents_dim")
def is_document_url(x: Inputs) -> DataFrame:
    both = x.documents_dim.select("url").union(x.documents_dim.select(F.concat("url", F.lit("/v1"))))
    return both.select("url", urls.is_document_url(F.col("url"), f"{PREFIX}machinery").alias("is_document"))


@query("is_attachment", r"SELECT url, regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$') OR contains(lower(url), '/download/') AS is_file FROM (SELECT url FROM attachment_links UNION ALL SELECT url FROM pages UNION ALL SELECT target FROM page_links)", "attachment_links", "page_links")
def is_attachment(x: Inputs) -> DataFrame:
    every = x.attachment_links.select("url").union(x.table("pages").select("url")).union(x.page_links.select("target"))
    return every.select("url", urls.is_attachment(F.col("url")).alias("is_file"))


@query("snapshot_required", "SELECT key, run, p IS NULL OR p <> semantic_sha256 AS required FROM (SELECT *, lag(semantic_sha256) OVER (PARTITION BY key ORDER BY run) AS p FROM captures)", "captures")
def snapshot_required(x: Inputs) -> DataFrame:
    c = versions.with_previous(x.captures)
    return c.select("key", "run", versions.snapshot_required(F.col("prev_semantic"), F.col("semantic_sha256")).alias("required"))


@query("audit_due", ", m AS (SELECT max(fetched_at) AS now FROM captures), k AS (SELECT key, max(fetched_at) AS last FROM captures GROUP BY key) SELECT c.id, k.last IS NULL OR m.now - k.last >= INTERVAL 86400 SECONDS AS due FROM documents_dim c CROSS JOIN m LEFT JOIN k ON k.key = c.id", "captures", "documents_dim")
def audit_due(x: Inputs) -> DataFrame:
    now = x.captures.agg(F.max("fetched_at").alias("now"))
    last = x.captures.groupBy(F.col("key").alias("id")).agg(F.max("fetched_at").alias("last"))
    d = x.documents_dim.select("id").join(last, "id", "left").crossJoin(F.broadcast(now))
    return d.select("id", (F.col("last").isNull() | (F.col("now") - F.col("last") >= F.expr("interval 86400 seconds"))).alias("due"))


@query("recipient_filter", "SELECT user_id, chat_id FROM recipients WHERE status = 'approved'", "recipients")
def recipient_filter(x: Inputs) -> DataFrame:
    return delivery.approved(x.recipients).select("user_id", "chat_id")


@query("baseline_suppression", f"SELECT id, kind FROM change_log JOIN (SELECT min(created_at)::DATE AS first FROM change_log) ON true WHERE created_at::DATE > first OR kind IN {_ERRORS}", "change_log")
def baseline_suppression(x: Inputs) -> DataFrame:
    """The first day is the baseline run: its changes go, its errors stay."""
    first = x.change_log.agg(F.min("created_at").cast("date").alias("first"))
    log = x.change_log.crossJoin(F.broadcast(first))
    return log.where((F.col("created_at").cast("date") > F.col("first")) | F.col("kind").isin(*ev.ERRORS)).select("id", "kind")


@query("pending_requests", "SELECT user_id, chat_id, display_name FROM recipients WHERE status = 'pending' ORDER BY user_id", "recipients")
def pending_requests(x: Inputs) -> DataFrame:
    return x.recipients.where("status = 'pending'").select("user_id", "chat_id", "display_name").orderBy("user_id")


@query("event_document_join", "SELECT e.id, e.kind, d.title, d.category, d.url FROM change_log e LEFT JOIN documents_dim d ON d.id = e.document_id", "change_log", "documents_dim")
def event_document_join(x: Inputs) -> DataFrame:
    return delivery.with_documents(x.change_log, x.documents_dim).select("id", "kind", "title", "category", "url")


@query("version_pair_join", "SELECT key, run, semantic_sha256, lag(semantic_sha256) OVER w AS previous_sha256, lag(run) OVER w AS previous_run FROM captures WINDOW w AS (PARTITION BY key ORDER BY run)", "captures")
def version_pair_join(x: Inputs) -> DataFrame:
    return versions.with_previous(x.captures).select("key", "run", "semantic_sha256", F.col("prev_semantic").alias("previous_sha256"), F.col("prev_run").alias("previous_run"))


@query("attachment_pair_join", "SELECT store AS key, seq, digest, lag(digest) OVER (PARTITION BY store ORDER BY seq) AS previous_digest FROM blobs", "blobs")
def attachment_pair_join(x: Inputs) -> DataFrame:
    from pyspark.sql import Window

    return x.blobs.select(F.col("store").alias("key"), "seq", "digest", F.lag("digest").over(Window.partitionBy("store").orderBy("seq")).alias("previous_digest"))


@query("new_documents", "SELECT DISTINCT key FROM captures WHERE run >= 15 AND key NOT IN (SELECT key FROM captures WHERE run < 1)", "captures")
def new_documents(x: Inputs) -> DataFrame:
    return x.captures.where("run >= 15").select("key").distinct().join(x.captures.where("run < 1").select("key"), "key", "left_anti")


_LINKS = """, k AS (SELECT DISTINCT user_id AS document_id, event_type AS url FROM events WHERE ts < TIMESTAMP '2024-01-08'), c AS (SELECT DISTINCT user_id AS document_id, event_type AS url FROM events WHERE ts >= TIMESTAMP '2024-01-25'), one AS (SELECT 1)"""


def _links(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """Known links, and those on the page now: here the event types of a user early and late in the month."""
    e = x.table("events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("url"), "ts")
    known = e.where("ts < timestamp_ntz'2024-01-08'").select("document_id", "url").distinct()
    return known, e.where("ts >= timestamp_ntz'2024-01-25'").select("document_id", "url").distinct()


@query("removed_links", "WITH " + _LINKS[2:] + " SELECT document_id, url FROM k WHERE document_id IN (SELECT document_id FROM c) AND (document_id, url) NOT IN (SELECT document_id, url FROM c)")
def removed_links(x: Inputs) -> DataFrame:
    known, now = _links(x)
    return known.join(now.select("document_id"), "document_id", "left_semi").join(now, ["document_id", "url"], "left_anti")


@query("added_links", "WITH " + _LINKS[2:] + " SELECT document_id, url FROM c WHERE document_id IN (SELECT document_id FROM k) AND (document_id, url) NOT IN (SELECT document_id, url FROM k)")
def added_links(x: Inputs) -> DataFrame:
    known, now = _links(x)
    return now.join(known.select("document_id"), "document_id", "left_semi").join(known, ["document_id", "url"], "left_anti")


@query("presence_join", ", s AS (SELECT DISTINCT key FROM captures WHERE run = (SELECT max(run) FROM captures)) SELECT DISTINCT captures.key, s.key IS NOT NULL AS seen FROM captures LEFT JOIN s ON s.key = captures.key", "captures")
def presence_join(x: Inputs) -> DataFrame:
    last = x.captures.agg(F.max("run").alias("last"))
    return x.captures.crossJoin(F.broadcast(last)).groupBy("key").agg((F.max("run") == F.max("last")).alias("seen"))


@query("error_suppression", f""", e AS (SELECT * FROM change_log WHERE kind IN {_ERRORS}), u AS (SELECT * FROM e WHERE NOT notified AND NOT EXISTS (SELECT 1 FROM e o WHERE o.notified AND o.kind = e.kind AND o.summary = e.summary AND o.document_id IS NOT DISTINCT FROM e.document_id))
    SELECT id, kind, document_id, summary FROM (SELECT *, row_number() OVER (PARTITION BY kind, document_id, summary ORDER BY id) AS rn FROM u) WHERE rn = 1""", "change_log")
def error_suppression(x: Inputs) -> DataFrame:
    return delivery.new_errors(x.change_log).select("id", "kind", "document_id", "summary")


_PAIRS = f", p AS (SELECT e.id, e.kind, d.category, r.user_id, r.chat_id FROM change_log e LEFT JOIN documents_dim d ON d.id = e.document_id, recipients r WHERE r.status = 'approved' AND e.kind IN {_MEANINGFUL} AND NOT e.notified)"
_PAIR_NAMES = ("change_log", "documents_dim", "recipients", "deliveries", "mutes")


def pairs(x: Inputs) -> DataFrame:
    return delivery.fan_out(delivery.with_documents(ev.pending(ev.meaningful(x.change_log)), x.documents_dim), delivery.approved(x.recipients))


@query("fanout", _PAIRS + " SELECT id, chat_id FROM p", *_PAIR_NAMES)
def fanout(x: Inputs) -> DataFrame:
    return pairs(x).select("id", "chat_id")


@query("undelivered", _PAIRS + " SELECT id, chat_id FROM p WHERE (id, chat_id) NOT IN (SELECT event_id, chat_id FROM deliveries)", *_PAIR_NAMES)
def undelivered(x: Inputs) -> DataFrame:
    return delivery.undelivered(pairs(x), x.deliveries).select("id", "chat_id")


@query("muted_pairs", _PAIRS + " SELECT id, chat_id FROM p WHERE category IS NOT NULL AND (user_id, lower(category)) IN (SELECT user_id, category_key FROM mutes)", *_PAIR_NAMES)
def muted_pairs(x: Inputs) -> DataFrame:
    return delivery.muted(pairs(x), x.mutes).select("id", "chat_id")


@query("delivery_complete", "SELECT event_id FROM deliveries JOIN (SELECT chat_id FROM recipients WHERE status = 'approved') USING (chat_id) GROUP BY event_id HAVING count(DISTINCT chat_id) = (SELECT count(DISTINCT chat_id) FROM recipients WHERE status = 'approved')", "deliveries")
def delivery_complete(x: Inputs) -> DataFrame:
    return delivery.delivery_complete(x.deliveries, delivery.approved(x.recipients))


@query("versions_by_hash", """, t AS (SELECT store, lag(digest) OVER w AS a, digest AS b, seq FROM blobs WINDOW w AS (PARTITION BY store ORDER BY seq)), e AS (SELECT seq AS event_id, a AS digest, 'old' AS which FROM t WHERE a IS NOT NULL UNION ALL SELECT seq, b, 'new' FROM t WHERE a IS NOT NULL)
    SELECT DISTINCT e.event_id, e.which, b.digest, b.len FROM e JOIN blobs b USING (digest) WHERE b.len <= 47185920""", "blobs")
def versions_by_hash(x: Inputs) -> DataFrame:
    from redlake.functions.text import extract_hashes

    named = attachment_pair_join(x).where("previous_digest is not null").select(F.col("seq").alias("event_id"), F.concat(F.lit("url\nold="), "previous_digest", F.lit("\nnew="), "digest").alias("details"))
    each = named.select("event_id", F.posexplode(extract_hashes(F.col("details"))).alias("i", "digest")).withColumn("which", F.when(F.col("i") == 0, "old").otherwise("new"))
    objects = x.blobs.select("digest", "len").distinct().where(F.col("len") <= 45 * 1024 * 1024)
    return each.join(objects.hint("merge"), "digest").select("event_id", "which", "digest", "len")


@query("frontier_antijoin", """, f AS (SELECT DISTINCT dst FROM catalog_edges WHERE src = 0), s AS (SELECT 0 AS n UNION SELECT dst FROM f) SELECT DISTINCT e.dst AS node FROM f JOIN catalog_edges e ON e.src = f.dst WHERE e.dst NOT IN (SELECT n FROM s)""", "catalog_edges")
def frontier_antijoin(x: Inputs) -> DataFrame:
    edges = x.catalog_edges
    first = edges.where("src = 0").select("dst").distinct()
    seen = first.union(x.spark.range(1).select(F.col("id").alias("dst")))
    return edges.join(first.withColumnRenamed("dst", "src"), "src").select("dst").distinct().join(seen.hint("merge"), "dst", "left_anti").withColumnRenamed("dst", "node")


@query("category_mute_flags", """, c AS (SELECT DISTINCT category FROM documents_dim WHERE category <> '') SELECT r.user_id, c.category, left(sha1(lower(c.category)), 16) AS token, m.user_id IS NOT NULL AS muted FROM recipients r, c LEFT JOIN mutes m ON m.user_id = r.user_id AND m.category_key = lower(c.category)""", "documents_dim", "recipients", "mutes")
def category_mute_flags(x: Inputs) -> DataFrame:
    c = x.documents_dim.where("category <> ''").select("category").distinct().withColumn("category_key", category_key(F.col("category")))
    m = x.mutes.withColumn("m", F.lit(True))
    each = c.crossJoin(checked(x.recipients.select("user_id"))).join(checked(m), ["user_id", "category_key"], "left")
    return each.select("user_id", "category", category_token(F.col("category")).alias("token"), F.col("m").isNotNull().alias("muted"))


@query("blob_join", "SELECT n.key, n.version, sha256(n.text) AS new_sha256, sha256(o.text) AS old_sha256, length(n.text)::BIGINT - length(o.text)::BIGINT AS grown FROM text_versions n JOIN text_versions o ON o.key = n.key AND o.version = n.version - 1 WHERE n.text <> o.text", "text_versions")
def blob_join(x: Inputs) -> DataFrame:
    """Old and new text side by side, by digest, only where the digests differ."""
    from pyspark.sql import Window

    log = x.text_versions.select("key", "version", F.sha2("text", 256).alias("new_sha256"))
    changed = log.withColumn("old_sha256", F.lag("new_sha256").over(Window.partitionBy("key").orderBy("version"))).where("old_sha256 <> new_sha256")
    texts = x.text_versions.select(F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["sha"])
    both = changed.join(texts.select(F.col("sha").alias("new_sha256"), F.col("text").alias("new")).hint("merge"), "new_sha256").join(texts.select(F.col("sha").alias("old_sha256"), F.col("text").alias("old")).hint("merge"), "old_sha256")
    return both.select("key", "version", "new_sha256", "old_sha256", (F.length("new") - F.length("old")).cast("long").alias("grown"))


@query("ignored_union", "SELECT DISTINCT key FROM (SELECT unnest(['machinery', 'household']) AS key UNION ALL SELECT category_key FROM mutes)", "mutes")
def ignored_union(x: Inputs) -> DataFrame:
    return _configured(x).union(x.mutes.select("category_key")).distinct()


@query("recipients_union", "SELECT DISTINCT chat_id FROM (SELECT 1000::BIGINT AS chat_id UNION ALL SELECT 999 UNION ALL SELECT chat_id FROM recipients WHERE status = 'approved') WHERE chat_id IS NOT NULL", "recipients")
def recipients_union(x: Inputs) -> DataFrame:
    fixed = x.spark.range(1).select(F.explode(F.array(F.lit(1000), F.lit(999), F.lit(None)).cast("array<bigint>")).alias("chat_id"))
    return fixed.union(delivery.approved(x.recipients).select("chat_id")).distinct().where("chat_id is not null")


@query("candidates_union", f"SELECT id, kind, kind IN {_ERRORS} AS is_error FROM change_log WHERE NOT notified AND kind IN {_MEANINGFUL[:-1]}, {_ERRORS[1:]}", "change_log")
def candidates_union(x: Inputs) -> DataFrame:
    fresh = ev.pending(x.change_log)
    return ev.errors(fresh).select("id", "kind", F.lit(True).alias("is_error")).unionByName(ev.meaningful(fresh).select("id", "kind", F.lit(False).alias("is_error")))


@query("emit_change_events", """, c AS (SELECT *, lag(semantic_sha256) OVER w AS ps, lag(html_sha256) OVER w AS ph, lead(run) OVER w AS nr, max(run) OVER () AS mr FROM captures WINDOW w AS (PARTITION BY key ORDER BY run)),
    e AS (SELECT 'document_added' AS kind, key AS document_id, run FROM c WHERE ps IS NULL UNION ALL SELECT 'html_content_changed', key, run FROM c WHERE ps <> semantic_sha256 UNION ALL SELECT 'html_markup_changed', key, run FROM c WHERE ps = semantic_sha256 AND ph <> html_sha256
      UNION ALL SELECT 'document_removed', key, run + 2 FROM c WHERE coalesce(nr, mr + 1) - run > 2 UNION ALL SELECT 'document_restored', key, nr FROM c WHERE nr - run > 2)
    SELECT kind, document_id, 'run ' || run AS summary, '' AS details, CASE kind WHEN 'html_content_changed' THEN 'critical' WHEN 'html_markup_changed' THEN 'info' ELSE 'warning' END AS severity FROM e""", "captures")
def emit_change_events(x: Inputs) -> DataFrame:
    named = {"first": "document_added", "content": "html_content_changed", "markup": "html_markup_changed"}
    kinds = F.create_map(*[F.lit(v) for pair in named.items() for v in pair])
    changed = versions.classify(x.captures).where("change <> 'same'").select(kinds[F.col("change")].alias("kind"), F.col("key").alias("document_id"), "run")
    moved = versions.presence(x.captures).select("kind", F.col("key").alias("document_id"), "run")
    text = {"summary": F.concat(F.lit("run "), F.col("run").cast("string")), "details": F.lit("")}
    return ev.change_events(changed.withColumns(text), moved.withColumns(text))


@query("mute_toggle", "SELECT user_id, category_key FROM (SELECT user_id, category_key FROM mutes UNION ALL SELECT c_nationkey::BIGINT, lower(c_mktsegment) FROM customer WHERE c_acctbal > 5000) GROUP BY ALL HAVING count(*) % 2 = 1", "mutes")
def mute_toggle(x: Inputs) -> DataFrame:
    toggles = x.table("customer").where("c_acctbal > 5000").select(F.col("c_nationkey").cast("long").alias("user_id"), category_key(F.col("c_mktsegment")).alias("category_key"))
    known = x.documents_dim.select(category_key(F.col("category")).alias("category_key")).distinct()
    log = x.mutes.union(toggles.join(known, "category_key", "left_semi").select("user_id", "category_key"))
    return log.groupBy("user_id", "category_key").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")


@query("line_delta", """, l AS (SELECT key, version, unnest(string_split(text, chr(10))) AS line FROM text_versions), n AS (SELECT key, version, line, count(*) AS n FROM l GROUP BY ALL),
    d AS (SELECT key, version, line, n AS plus, 0 AS minus FROM n UNION ALL SELECT key, version + 1, line, 0, n FROM n WHERE (key, version + 1) IN (SELECT key, version FROM text_versions))
    SELECT key, version, sum(greatest(p - m, 0))::BIGINT AS added, sum(greatest(m - p, 0))::BIGINT AS removed FROM (SELECT key, version, line, sum(plus) AS p, sum(minus) AS m FROM d GROUP BY ALL) WHERE version > 1 GROUP BY ALL""", "text_versions")
def line_delta(x: Inputs) -> DataFrame:
    """Lines gained and lost from each version to the next, as multisets: one pass, a line's counts with signs."""
    from pyspark.sql import Window

    last = F.max("version").over(Window.partitionBy("key"))
    lines = x.text_versions.withColumn("last", last).select("key", "version", "last", F.explode(F.split("text", "\n")).alias("line"))
    signed = lines.select("key", "version", F.xxhash64("line").alias("h"), "line", F.lit(1).alias("s")).union(lines.where("version < last").select("key", F.col("version") + 1, F.xxhash64("line"), "line", F.lit(-1)))
    net = signed.groupBy("key", "version", "h", "line").agg(F.sum("s").alias("d")).where("version > 1")
    return net.groupBy("key", "version").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


@query("dependency_closure", """, l AS (SELECT DISTINCT page_id, target, regexp_matches(lower(target), '\\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$') AS is_file FROM page_links)
    SELECT page_id, count(*) FILTER (NOT is_file) AS n_documents, count(*) FILTER (is_file) AS n_files FROM l GROUP BY page_id""", "page_links")
def dependency_closure(x: Inputs) -> DataFrame:
    each = x.page_links.select("page_id", "target").distinct().withColumn("is_file", urls.is_attachment(F.col("target")))
    return each.groupBy("page_id").agg(F.count_if(~F.col("is_file")).alias("n_documents"), F.count_if("is_file").alias("n_files"))
