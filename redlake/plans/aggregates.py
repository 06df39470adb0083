"""Queries over aggregates, version windows, order and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redlake.functions import urls
from redlake.functions.text import format_ts, percent
from redlake.operators import delivery, versions
from redlake.operators import events as ev

from .base import Inputs, query
from .joins import _ERRORS, _MEANINGFUL

_ICON = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟠' WHEN 'info' THEN '🔵' ELSE '⚪' END"
_SEVERITY = "CASE WHEN kind IN ('html_content_changed', 'attachment_content_changed', 'storage_error') THEN 'critical' WHEN kind IN ('html_markup_changed', 'attachment_binary_changed') THEN 'info' ELSE 'warning' END"
_DIGEST_NAMES = ("change_log", "documents_dim", "recipients", "deliveries", "mutes")
#: Events of approved recipients still to be told, one row per pair, for DuckDB.
_TOLD = f""", f AS (SELECT *, {_SEVERITY} AS severity FROM (SELECT *, row_number() OVER (PARTITION BY kind, document_id, summary, details ORDER BY id) AS rn FROM change_log WHERE NOT notified AND kind IN {_MEANINGFUL}) WHERE rn = 1),
    p AS (SELECT f.*, d.title, d.category, d.url, r.user_id, r.chat_id FROM f LEFT JOIN documents_dim d ON d.id = f.document_id, recipients r WHERE r.status = 'approved'),
    t AS (SELECT *, coalesce(nullif(category, ''), '{ev.NO_CATEGORY}') AS cat FROM p WHERE (id, chat_id) NOT IN (SELECT event_id, chat_id FROM deliveries) AND (category IS NULL OR (user_id, lower(category)) NOT IN (SELECT user_id, category_key FROM mutes)))"""
_VISIBLE = _TOLD + """, v0 AS (SELECT *, min(id) OVER (PARTITION BY chat_id, cat, document_id) AS first_id, bool_or(kind = 'document_added') OVER (PARTITION BY chat_id, cat, document_id) AS added FROM t), v AS (SELECT * FROM v0 WHERE NOT (added AND kind = 'attachment_added'))"""
_GROUPS = _VISIBLE + f""", g AS (SELECT chat_id, cat, document_id, max(title) AS title, min(first_id) AS first_id, count(*) AS n, string_agg({_ICON} || ' ' || summary || ' <code>' || kind || '</code>' || coalesce(' · <a href="' || url || '">открыть</a>', ''), chr(10) ORDER BY (kind <> 'document_added')::INT, id) AS body FROM v GROUP BY chat_id, cat, document_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY first_id) AS rank FROM g)"""


def told(x: Inputs) -> DataFrame:
    fresh = delivery.dedupe_fingerprint(ev.pending(ev.meaningful(x.change_log))).withColumn("severity", ev.severity(F.col("kind")))
    pairs = delivery.fan_out(delivery.with_documents(fresh, x.documents_dim), delivery.approved(x.recipients))
    return delivery.muted(delivery.undelivered(pairs, x.deliveries), x.mutes, "left_anti")


@query("change_digest", _GROUPS + """ SELECT chat_id, sum(n)::BIGINT AS n_events, '🔔 Изменения: ' || sum(n) || ' событий' || chr(10) || string_agg(chr(10) || '📁 <b>' || cat || '</b>' || chr(10) || '<b>' || coalesce(title, 'Общие события') || '</b>' || chr(10) || body, chr(10) ORDER BY rank) FILTER (rank <= 20)
    || CASE WHEN count(*) > 20 THEN chr(10) || '… и ещё ' || (count(*) - 20) || ' документов. Подробности: /changes' ELSE '' END AS text FROM k GROUP BY chat_id""", *_DIGEST_NAMES)
def change_digest(x: Inputs) -> DataFrame:
    return delivery.outbox(x.change_log, x.documents_dim, x.recipients, x.mutes, x.deliveries)


@query("change_digest_groups", _TOLD + " SELECT chat_id, cat AS category, document_id, min(id) AS first_id, count(*) AS n FROM t GROUP BY ALL", *_DIGEST_NAMES)
def change_digest_groups(x: Inputs) -> DataFrame:
    return delivery.digest_groups(told(x), ["chat_id"])


@query("initial_noise_suppression", _VISIBLE + " SELECT chat_id, id FROM v", *_DIGEST_NAMES)
def initial_noise_suppression(x: Inputs) -> DataFrame:
    return delivery.without_initial_noise(told(x), ["chat_id"]).select("chat_id", "id")


@query("digest_order", _VISIBLE + " SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id, cat, document_id ORDER BY (kind <> 'document_added')::INT, id) AS place FROM v", *_DIGEST_NAMES)
def digest_order(x: Inputs) -> DataFrame:
    w = Window.partitionBy("chat_id", delivery.group_key(F.col("category")), "document_id").orderBy(F.col("kind") != "document_added", "id")
    return delivery.without_initial_noise(told(x), ["chat_id"]).select("chat_id", "id", F.row_number().over(w).cast("long").alias("place"))


@query("topk_groups", _GROUPS + " SELECT chat_id, cat AS category, document_id, rank, greatest(count(*) OVER (PARTITION BY chat_id) - 20, 0) AS n_left_out FROM k QUALIFY rank <= 20", *_DIGEST_NAMES)
def topk_groups(x: Inputs) -> DataFrame:
    g = delivery.digest_groups(delivery.without_initial_noise(told(x), ["chat_id"]).withColumn("id", F.col("first_id")), ["chat_id"])
    w = Window.partitionBy("chat_id")
    ranked = g.withColumns({"rank": F.row_number().over(w.orderBy("first_id")).cast("long"), "n_left_out": F.greatest(F.count(F.lit(1)).over(w) - 20, F.lit(0)).cast("long")})
    return ranked.where("rank <= 20").select("chat_id", "category", "document_id", "rank", "n_left_out")


@query("error_digest", f""", e AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS rank FROM change_log WHERE kind IN {_ERRORS})
    SELECT document_id, count(*) AS n_errors, '🔴 Ошибки проверки: ' || count(*) || ' событий' || chr(10) || string_agg('• ' || kind || ': ' || summary || ' — ' || details, chr(10) ORDER BY rank) FILTER (rank <= 20) || CASE WHEN count(*) > 20 THEN chr(10) || '… и ещё ' || (count(*) - 20) ELSE '' END AS text FROM e GROUP BY document_id""", "change_log")
def error_digest(x: Inputs) -> DataFrame:
    """A digest for each document, and one for the errors of none."""
    return delivery.error_digest(ev.errors(x.change_log), ["document_id"])


_DT = "strftime(created_at, '%Y-%m-%d %H:%M')"


@query("changes_listing", f""", p AS (SELECT * FROM change_log WHERE kind IN {_MEANINGFUL} ORDER BY id DESC LIMIT 30), j AS (SELECT p.*, d.title, coalesce(nullif(d.category, ''), '{ev.NO_CATEGORY}') AS cat FROM p LEFT JOIN documents_dim d ON d.id = p.document_id),
    g AS (SELECT cat, document_id, max(title) AS title, max(id) AS last_id, string_agg('• #' || id || ' ' || {_DT} || ' — ' || summary, chr(10) ORDER BY (kind <> 'document_added')::INT, id) AS body FROM j GROUP BY cat, document_id)
    SELECT '📰 Последние изменения' || chr(10) || string_agg(chr(10) || '📁 ' || cat || chr(10) || '<b>' || coalesce(title, 'Общие события') || '</b>' || chr(10) || body, chr(10) ORDER BY last_id DESC) AS text FROM g""", "change_log", "documents_dim")
def changes_listing(x: Inputs) -> DataFrame:
    g = delivery.with_documents(page(x.change_log, 0, 30), x.documents_dim)
    return delivery.changes_listing(g)


@query("status_summary", f""", r AS (SELECT epoch_us(finished_at - started_at) / 1e6 AS s, id FROM runs WHERE finished_at IS NOT NULL ORDER BY id DESC LIMIT 7)
    SELECT (SELECT count(*) FILTER (active) FROM documents_dim) AS n_active, (SELECT count(DISTINCT url) FROM attachment_links) AS n_attachments, count(*) FILTER (NOT notified AND kind IN {_MEANINGFUL}) AS n_pending, count(*) FILTER (kind IN {_ERRORS}) AS n_errors,
      max(created_at) FILTER (kind IN {_MEANINGFUL}) AS last_change, (SELECT max(fetched_at) FROM captures) AS last_version_at, (SELECT max(finished_at) FROM runs) AS last_run_at, (SELECT max_by(s, id) FROM r)::DOUBLE AS last_seconds, (SELECT avg(s) FROM r)::DOUBLE AS mean_seconds FROM change_log""",
    "change_log", "documents_dim", "attachment_links", "captures", "runs")
def status_summary(x: Inputs) -> DataFrame:
    """One row; each table is read once, and the joined results have one row each."""
    log = x.change_log.agg(
        F.count_if(~F.col("notified") & F.col("kind").isin(*ev.MEANINGFUL)).alias("n_pending"), F.count_if(F.col("kind").isin(*ev.ERRORS)).alias("n_errors"), F.max(F.when(F.col("kind").isin(*ev.MEANINGFUL), F.col("created_at"))).alias("last_change")
    )
    out = x.documents_dim.agg(F.count_if("active").alias("n_active")).crossJoin(x.attachment_links.agg(F.countDistinct("url").alias("n_attachments"))).crossJoin(log)
    out = out.crossJoin(x.captures.agg(F.max("fetched_at").alias("last_version_at"))).crossJoin(x.runs.agg(F.max("finished_at").alias("last_run_at")))
    return out.crossJoin(run_durations(x).select("last_seconds", "mean_seconds"))


@query("run_durations", """, r AS (SELECT epoch_us(finished_at - started_at) / 1e6 AS s, id FROM runs WHERE finished_at IS NOT NULL ORDER BY id DESC LIMIT 7) SELECT count(*) AS n_runs, max_by(s, id)::DOUBLE AS last_seconds, avg(s)::DOUBLE AS mean_seconds FROM r""", "runs")
def run_durations(x: Inputs) -> DataFrame:
    last = x.runs.where("finished_at is not null").orderBy(F.desc("id")).limit(7)
    took = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return last.agg(F.count(F.lit(1)).alias("n_runs"), F.max_by(took, "id").alias("last_seconds"), F.avg(took).alias("mean_seconds"))


@query("last_change", f"SELECT max(created_at) AS last_change FROM change_log WHERE kind IN {_MEANINGFUL}", "change_log")
def last_change(x: Inputs) -> DataFrame:
    return ev.meaningful(x.change_log).agg(F.max("created_at").alias("last_change"))


@query("error_count", f"SELECT count(*) FILTER (kind IN {_ERRORS}) AS n_errors FROM change_log", "change_log")
def error_count(x: Inputs) -> DataFrame:
    return x.change_log.agg(F.count_if(F.col("kind").isin(*ev.ERRORS)).alias("n_errors"))


@query("change_count", f"SELECT count(*) FILTER (kind IN {_MEANINGFUL}) AS n_changes FROM change_log", "change_log")
def change_count(x: Inputs) -> DataFrame:
    return x.change_log.agg(F.count_if(F.col("kind").isin(*ev.MEANINGFUL)).alias("n_changes"))


@query("category_list", "SELECT DISTINCT category FROM documents_dim WHERE category <> '' ORDER BY category", "documents_dim")
def category_list(x: Inputs) -> DataFrame:
    return x.documents_dim.where("category <> ''").select("category").distinct().orderBy("category")


@query("run_progress", "SELECT trigger, count(*) AS total, count(finished_at) AS completed, count(*) FILTER (finished_at IS NULL) AS errors, round_even(100.0 * count(finished_at) / count(*), 0)::BIGINT AS percent FROM runs GROUP BY trigger", "runs")
def run_progress(x: Inputs) -> DataFrame:
    out = x.runs.groupBy("trigger").agg(F.count(F.lit(1)).alias("total"), F.count("finished_at").alias("completed"), F.count_if(F.col("finished_at").isNull()).alias("errors"))
    return out.withColumn("percent", percent(F.col("completed"), F.col("total")))


@query("identical_content_groups", "SELECT digest, count(*) AS copies, min(len) AS len FROM blobs GROUP BY digest HAVING count(*) > 1", "blobs")
def identical_content_groups(x: Inputs) -> DataFrame:
    return x.blobs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("len").alias("len")).where("copies > 1")


@query("link_out_degree", r", l AS (SELECT DISTINCT page_id, target, regexp_matches(lower(target), '\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$') AS is_file FROM page_links) SELECT page_id, is_file, count(*) AS n_links FROM l GROUP BY ALL", "page_links")
def link_out_degree(x: Inputs) -> DataFrame:
    return x.page_links.groupBy("page_id", urls.is_attachment(F.col("target")).alias("is_file")).agg(F.countDistinct("target").alias("n_links"))


@query("latest_version", "SELECT key, max(run) AS run, max_by(semantic_sha256, run) AS semantic_sha256 FROM captures GROUP BY key", "captures")
def latest_version(x: Inputs) -> DataFrame:
    return versions.latest(x.captures, ["key"], "run").select("key", "run", "semantic_sha256")


@query("latest_two_versions", "SELECT key, run, CASE rn WHEN 1 THEN 'new' ELSE 'old' END AS which FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS rn FROM captures) WHERE rn <= 2", "captures")
def latest_two_versions(x: Inputs) -> DataFrame:
    return versions.latest_two(x.captures, ["key"], "run").select("key", "run", "which")


_CHANGES = """, c AS (SELECT *, lag(semantic_sha256) OVER w AS ps, lag(html_sha256) OVER w AS ph FROM captures WINDOW w AS (PARTITION BY key ORDER BY run)),
    d AS (SELECT key, run, semantic_sha256, html_sha256, CASE WHEN ps IS NULL THEN 'first' WHEN ps <> semantic_sha256 THEN 'content' WHEN ph <> html_sha256 THEN 'markup' ELSE 'same' END AS change FROM c)"""


@query("change_classify", _CHANGES + " SELECT key, run, change FROM d", "captures")
def change_classify(x: Inputs) -> DataFrame:
    return versions.classify(x.captures).select("key", "run", "change")


@query("version_compaction", _CHANGES + " SELECT key, run, semantic_sha256, html_sha256 FROM d WHERE change <> 'same'", "captures")
def version_compaction(x: Inputs) -> DataFrame:
    return versions.compact(x.captures).select("key", "run", "semantic_sha256", "html_sha256")


@query("attachment_classify", """, v AS (SELECT key, run, html_sha256 AS b, CASE WHEN key % 5 = 0 THEN '' ELSE semantic_sha256 END AS t FROM captures), c AS (SELECT *, lag(b) OVER w AS pb, lag(t) OVER w AS pt FROM v WINDOW w AS (PARTITION BY key ORDER BY run))
    SELECT key, run, CASE WHEN pb IS NULL THEN 'first' WHEN pb = b THEN 'same' WHEN t <> '' AND pt = t THEN 'binary' ELSE 'content' END AS change FROM c""", "captures")
def attachment_classify(x: Inputs) -> DataFrame:
    """A fifth of the keys have no extracted text."""
    v = x.captures.select("key", "run", F.col("html_sha256").alias("binary_sha256"), F.when(F.col("key") % 5 == 0, "").otherwise(F.col("semantic_sha256")).alias("text_sha256"))
    return versions.classify_attachments(v).select("key", "run", "change")


_PRESENCE = ", s AS (SELECT key, run, lead(run) OVER (PARTITION BY key ORDER BY run) AS nr, max(run) OVER () AS mr FROM captures)"


@query("presence_reconcile", _PRESENCE + " SELECT key, run + 2 AS run, 'document_removed' AS kind FROM s WHERE coalesce(nr, mr + 1) - run > 2 UNION ALL SELECT key, nr, 'document_restored' FROM s WHERE nr - run > 2", "captures")
def presence_reconcile(x: Inputs) -> DataFrame:
    return versions.presence(x.captures)


@query("missing_streak", "SELECT key, least((SELECT max(run) FROM captures) - max(run), 2)::BIGINT AS missing_runs, (SELECT max(run) FROM captures) - max(run) < 2 AS active FROM captures GROUP BY key", "captures")
def missing_streak(x: Inputs) -> DataFrame:
    return versions.missing_streak(x.captures)


@query("dedupe_fingerprint", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY kind, document_id, summary, details ORDER BY id) AS rn FROM change_log) WHERE rn = 1", "change_log")
def dedupe_fingerprint(x: Inputs) -> DataFrame:
    return delivery.dedupe_fingerprint(x.change_log).select("id")


_GROUP_KEY = r"lower(regexp_replace(title, '\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$', ''))"


@query("preferred_attachment", rf"SELECT document_id, gk AS group_key, url FROM (SELECT *, row_number() OVER (PARTITION BY document_id, gk ORDER BY CASE WHEN url LIKE '%.odt' THEN 0 WHEN url LIKE '%.pdf' THEN 1 ELSE 2 END, pos) AS rn FROM (SELECT *, {_GROUP_KEY} AS gk FROM attachment_links)) WHERE rn = 1", "attachment_links")
def preferred_attachment(x: Inputs) -> DataFrame:
    path = F.lower(urls.path_of(F.col("url")))
    rank = F.when(path.endswith(".odt"), 0).when(path.endswith(".pdf"), 1).otherwise(2)
    links = x.attachment_links.withColumn("group_key", urls.attachment_group_key(F.col("title"), F.col("url")))
    best = links.groupBy("document_id", "group_key").agg(F.min(F.struct(rank.alias("r"), "pos", "url")).alias("m"))
    return best.select("document_id", "group_key", "m.url")


@query("first_link_per_url", "SELECT page_id, target, min(pos) AS pos, min_by(title, pos) AS title FROM page_links GROUP BY page_id, target", "page_links")
def first_link_per_url(x: Inputs) -> DataFrame:
    return x.page_links.groupBy("page_id", "target").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))


@query("throttle_notice", f""", n AS (SELECT coalesce(document_id, -1) // 10 AS key, id, created_at AS "at", row_number() OVER (PARTITION BY coalesce(document_id, -1) // 10 ORDER BY created_at, id) AS rn FROM change_log WHERE kind IN {_ERRORS} AND document_id IS NOT NULL),
    r AS (SELECT key, id, "at", rn, true AS sent, "at" AS last FROM n WHERE rn = 1 UNION ALL SELECT n.key, n.id, n."at", n.rn, n."at" >= r.last + INTERVAL 60 SECONDS, CASE WHEN n."at" >= r.last + INTERVAL 60 SECONDS THEN n."at" ELSE r.last END FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1)
    SELECT key, id, "at", sent FROM r""", "change_log")
def throttle_notice(x: Inputs) -> DataFrame:
    notices = ev.errors(x.change_log).where("document_id is not null").select(F.expr("document_id div 10").alias("key"), "id", F.col("created_at").alias("at"))
    return versions.throttle(notices)


@query("recent_events", "SELECT id, created_at, kind, summary FROM change_log ORDER BY id DESC LIMIT 20", "change_log")
def recent_events(x: Inputs) -> DataFrame:
    return x.change_log.orderBy(F.desc("id")).limit(20).select("id", "created_at", "kind", "summary")


def page(events: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of changes, newest first: 1 to 30 rows from an offset of 0 or more."""
    return ev.meaningful(events).orderBy(F.desc("id")).offset(max(0, offset)).limit(max(1, min(limit, 30)))


@query("changes_offset", f"SELECT id, kind, summary FROM change_log WHERE kind IN {_MEANINGFUL} ORDER BY id DESC LIMIT 30 OFFSET 40", "change_log")
def changes_offset(x: Inputs) -> DataFrame:
    return page(x.change_log, 40, 100).select("id", "kind", "summary")


@query("changes_page", f""", m AS (SELECT user, id FROM (SELECT document_id AS user, id FROM change_log WHERE kind IN {_MEANINGFUL})), p AS (SELECT user, id, (row_number() OVER (PARTITION BY user ORDER BY id DESC) - 1) // 5 AS page, greatest(1, (count(*) OVER (PARTITION BY user) + 4) // 5) AS pages FROM m)
    SELECT user AS document_id, id, page, pages, CASE WHEN page > 0 THEN page - 1 ELSE pages - 1 END AS previous, CASE WHEN page + 1 < pages THEN page + 1 ELSE 0 END AS following FROM p""", "change_log")
def changes_page(x: Inputs) -> DataFrame:
    """Every document's changes dealt to pages of five, with the pages before and after, around the ends."""
    w = Window.partitionBy("document_id")
    n = F.count(F.lit(1)).over(w)
    p = ev.meaningful(x.change_log).select("document_id", "id", F.floor((F.row_number().over(w.orderBy(F.desc("id"))) - 1) / 5).alias("page"), F.greatest(F.lit(1), F.floor((n + 4) / 5)).alias("pages"))
    previous = F.when(F.col("page") > 0, F.col("page") - 1).otherwise(F.col("pages") - 1)
    return p.select("document_id", "id", "page", "pages", previous.alias("previous"), F.when(F.col("page") + 1 < F.col("pages"), F.col("page") + 1).otherwise(F.lit(0).cast("long")).alias("following"))


@query("error_log_view", f", e AS (SELECT * FROM change_log WHERE kind IN {_ERRORS} ORDER BY id DESC LIMIT 10) SELECT string_agg('#' || id || ' ' || {_DT} || ' ' || summary || ': ' || left(details, 300), chr(10) ORDER BY id DESC) AS text FROM e", "change_log")
def error_log_view(x: Inputs) -> DataFrame:
    last = ev.errors(x.change_log).orderBy(F.desc("id")).limit(10)
    line = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), format_ts(F.col("created_at")), F.lit(" "), F.col("summary"), F.lit(": "), F.substring("details", 1, 300))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("id")).alias("o"), line.alias("t"))))
    return last.agg(F.array_join(F.transform(rows, lambda r: r.t), "\n").alias("text"))


@query("latest_change_id", f"SELECT max(id) AS id FROM change_log WHERE kind IN {_MEANINGFUL}", "change_log")
def latest_change_id(x: Inputs) -> DataFrame:
    return ev.meaningful(x.change_log).agg(F.max("id").alias("id"))


@query("sorted_limit_urls", "SELECT DISTINCT target AS url FROM page_links ORDER BY url LIMIT 100", "page_links")
def sorted_limit_urls(x: Inputs) -> DataFrame:
    return x.page_links.select(F.col("target").alias("url")).distinct().orderBy("url").limit(100)
