"""Queries over scalar functions and document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redlake.functions import html, text, urls
from redlake.operators import delivery
from redlake.operators import events as ev
from redlake.operators.graph import discover
from redlake.sources import tables
from redlake.sources.fixtures import CATALOG, CATALOG_URL

from .aggregates import _SEVERITY
from .base import Inputs, query

_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("fn_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(x: Inputs) -> DataFrame:
    return x.table("documents").select("doc_id", text.sha256(F.col("text")).alias("digest"))


@query("fn_category_token", "SELECT id, left(sha1(lower(trim(regexp_replace(category, '\\s+', ' ', 'g')))), 16) AS token FROM documents_dim", "documents_dim")
def fn_category_token(x: Inputs) -> DataFrame:
    return x.documents_dim.select("id", text.category_token(F.col("category")).alias("token"))


@query("fn_normalize_space", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def fn_normalize_space(x: Inputs) -> DataFrame:
    return x.table("documents").select("doc_id", F.sha2(text.normalize_space(F.col("text")), 256).alias("digest"))


@query("fn_category_key", "SELECT id, lower(category || ' ' || title) AS key FROM documents_dim", "documents_dim")
def fn_category_key(x: Inputs) -> DataFrame:
    return x.documents_dim.select("id", text.category_key(F.concat(F.lit("  "), "category", F.lit("\t  "), "title", F.lit("\n"))).alias("key"))


_CANONICAL = r"regexp_replace(regexp_replace({0}, '(?s)[?#].*$', ''), '/+$', '')"


@query("fn_canonicalize_url", f"SELECT page_id, CASE WHEN regexp_matches(u, '^[a-z]+://[^/]+$') THEN u || '/' ELSE u END AS url FROM (SELECT page_id, {_CANONICAL.format('url')} AS u FROM pages)")
def fn_canonicalize_url(x: Inputs) -> DataFrame:
    return x.table("pages").select("page_id", urls.canonicalize(F.col("url")).alias("url"))


@query("fn_url_join", "SELECT page_id, pos, target FROM page_links", "page_links")
def fn_url_join(x: Inputs) -> DataFrame:
    href = F.regexp_replace("target", "^[a-z]+://[^/]+", "")
    return x.page_links.select("page_id", "pos", urls.url_join_any(F.col("page_url"), href).alias("target"))


@query("fn_attachment_group_key", r"SELECT document_id, pos, lower(regexp_replace(title, '\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$', '')) AS group_key FROM attachment_links", "attachment_links")
def fn_attachment_group_key(x: Inputs) -> DataFrame:
    return x.attachment_links.select("document_id", "pos", urls.attachment_group_key(F.col("title"), F.col("url")).alias("group_key"))


@query("fn_path_suffix", r"SELECT url, CASE WHEN m <> '' THEN m ELSE '.bin' END AS suffix FROM (SELECT url, regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$') AS m FROM (SELECT url FROM attachment_links UNION ALL SELECT url FROM pages))", "attachment_links")
def fn_path_suffix(x: Inputs) -> DataFrame:
    every = x.attachment_links.select("url").union(x.table("pages").select("url"))
    return every.select("url", urls.path_suffix(F.col("url"), F.lit("text/html")).alias("suffix"))


@query("fn_validators", "SELECT key, run, CASE WHEN run % 3 = 0 THEN '' ELSE left(html_sha256, 8) END AS etag, CASE WHEN run % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN run % 3 = 0 THEN 0 ELSE 1 END AS n_headers FROM captures", "captures")
def fn_validators(x: Inputs) -> DataFrame:
    etag = F.when(F.col("run") % 3 == 0, "").otherwise(F.substring("html_sha256", 1, 8))
    headers = urls.validators(etag, F.when(F.col("run") % 2 == 0, F.col("fetched_at").cast("string")))
    return x.captures.select("key", "run", F.coalesce(F.element_at(headers, "If-None-Match"), F.lit("")).alias("etag"), F.size(headers).alias("n_headers"))


@query("fn_html_escape", f"SELECT page_id, sha256({_ESCAPED.format('html')}) AS digest FROM pages")
def fn_html_escape(x: Inputs) -> DataFrame:
    return x.table("pages").select("page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("digest"))


_EVENTS = f", e AS (SELECT c.*, {_SEVERITY} AS severity, d.title, d.category, d.url FROM change_log c LEFT JOIN documents_dim d ON d.id = c.document_id)"
_ICON = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟠' WHEN 'info' THEN '🔵' ELSE '⚪' END"


def events(x: Inputs) -> DataFrame:
    return delivery.with_documents(x.change_log, x.documents_dim).withColumn("severity", ev.severity(F.col("kind")))


@query("fn_format_event", _EVENTS + f""" SELECT id, {_ICON} || ' <b>' || summary || '</b>' || chr(10) || chr(10) || '<code>' || kind || '</code>' || chr(10) || details || coalesce(chr(10) || chr(10) || '🔗 <a href="' || url || '">Открыть страницу документа</a>', '') AS message FROM e""", "change_log", "documents_dim")
def fn_format_event(x: Inputs) -> DataFrame:
    return events(x).select("id", text.format_event(F.col("severity"), F.col("kind"), F.col("summary"), F.col("details"), F.col("url")).alias("message"))


@query("fn_severity_icon", _EVENTS + f" SELECT id, {_ICON} AS icon FROM e", "change_log", "documents_dim")
def fn_severity_icon(x: Inputs) -> DataFrame:
    return events(x).select("id", text.severity_icon(F.col("severity")).alias("icon"))


@query("fn_truncate", "SELECT doc_id, left(text, 240) AS head FROM documents")
def fn_truncate(x: Inputs) -> DataFrame:
    return x.table("documents").select("doc_id", text.truncate(F.col("text"), 240).alias("head"))


@query("text_chunks", "SELECT conv_id, turn, i - 1 AS part, substr(text, (i - 1) * 100 + 1, 100) AS chunk FROM (SELECT conv_id, turn, text, unnest(range(1, (length(text) + 99) // 100 + 1)) AS i FROM conversations)")
def text_chunks(x: Inputs) -> DataFrame:
    parts = F.posexplode(text.chunks(F.col("text"), 100))
    return x.table("conversations").select("conv_id", "turn", parts.alias("part", "chunk")).withColumn("part", F.col("part").cast("long"))


@query("fn_duration_label", """, r AS (SELECT id, datediff('second', started_at, finished_at) * 37 AS s FROM runs WHERE finished_at IS NOT NULL)
    SELECT id, CASE WHEN s < 60 THEN s || ' с' WHEN s < 3600 THEN (s // 60) || ' мин ' || lpad((s % 60)::VARCHAR, 2, '0') || ' с' ELSE (s // 3600) || ' ч ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ' мин' END AS label FROM r""", "runs")
def fn_duration_label(x: Inputs) -> DataFrame:
    took = (F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))) * 37
    return x.runs.where("finished_at is not null").select("id", text.duration_label(took).alias("label"))


@query("fn_format_ts", "SELECT id, coalesce(strftime(finished_at, '%Y-%m-%d %H:%M'), 'нет данных') AS label FROM runs", "runs")
def fn_format_ts(x: Inputs) -> DataFrame:
    return x.runs.select("id", text.format_ts(F.col("finished_at")).alias("label"))


_MODES = ("noon", "midnight", "even", "disabled")


@query("fn_next_slot", """, m AS (SELECT unnest(['noon', 'midnight', 'even', 'disabled']) AS mode), t AS (SELECT id, created_at AS t, date_trunc('day', created_at)::TIMESTAMP AS d FROM change_log)
    SELECT id, mode, CASE mode WHEN 'noon' THEN CASE WHEN t < d + INTERVAL 12 HOURS THEN d + INTERVAL 12 HOURS ELSE d + INTERVAL 36 HOURS END WHEN 'midnight' THEN d + INTERVAL 1 DAY WHEN 'even' THEN d + to_hours((hour(t) // 2 + 1) * 2) END AS slot FROM t, m""", "change_log")
def fn_next_slot(x: Inputs) -> DataFrame:
    each = x.change_log.select("id", "created_at", F.explode(F.array(*map(F.lit, _MODES))).alias("mode"))
    return each.select("id", "mode", text.next_slot(F.col("created_at"), F.col("mode")).alias("slot"))


@query("fn_safe_filename", r"SELECT page_id, coalesce(nullif(left(trim(regexp_replace(url, '[^A-Za-z0-9\-_.]', '_', 'g'), '._'), 80), ''), 'report') || '.txt' AS name FROM pages")
def fn_safe_filename(x: Inputs) -> DataFrame:
    return x.table("pages").select("page_id", text.safe_filename(F.col("url"), ".txt").alias("name"))


@query("fn_extract_hashes", ", t AS (SELECT store, seq, digest, lag(digest) OVER (PARTITION BY store ORDER BY seq) AS p FROM blobs) SELECT seq, coalesce(p || ',', '') || digest AS hashes FROM t", "blobs")
def fn_extract_hashes(x: Inputs) -> DataFrame:
    previous = F.lag("digest").over(Window.partitionBy("store").orderBy("seq"))
    details = F.concat(F.coalesce(F.concat(F.lit("u\nold="), previous), F.lit("u")), F.lit("\nnew="), "digest", F.lit("\nsemantic_same=False"))
    return x.blobs.select("seq", F.array_join(text.extract_hashes(details), ",").alias("hashes"))


@query("fn_split_csv_keys", "SELECT user_id, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT n_nationkey::BIGINT AS user_id, unnest([lower(n_name), 'b c']) AS k FROM nation) GROUP BY user_id")
def fn_split_csv_keys(x: Inputs) -> DataFrame:
    settings = F.concat(F.lit(" B  c ,"), "n_name", F.lit(", ,"), F.lower("n_name"), F.lit(","))
    return x.table("nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.array_join(text.split_keys(settings), ",").alias("keys"))


@query("fn_split_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))::BIGINT AS n_lines FROM documents")
def fn_split_lines(x: Inputs) -> DataFrame:
    return x.table("documents").select("doc_id", F.size(text.split_lines(F.concat("text", F.lit("\n")))).cast("long").alias("n_lines"))


@query("fn_identity_label", "SELECT user_id, CASE WHEN status = 'approved' THEN '@' || lower(display_name) WHEN status = 'denied' THEN 'без имени' ELSE display_name END AS label FROM recipients", "recipients")
def fn_identity_label(x: Inputs) -> DataFrame:
    username = F.when(F.col("status") == "approved", F.lower("display_name")).otherwise("")
    return x.recipients.select("user_id", text.identity_label(username, F.when(F.col("status") != "denied", F.col("display_name"))).alias("label"))


@query("fn_progress_bar", "SELECT trigger, repeat('█', n) || repeat('░', 10 - n) AS bar FROM (SELECT trigger, round_even(round_even(100.0 * count(finished_at) / count(*), 0) / 10.0, 0)::INT AS n FROM runs GROUP BY trigger)", "runs")
def fn_progress_bar(x: Inputs) -> DataFrame:
    done = x.runs.groupBy("trigger").agg(text.percent(F.count("finished_at"), F.count(F.lit(1))).alias("p"))
    return done.select("trigger", text.progress_bar(F.col("p")).alias("bar"))


def reports(x: Inputs) -> DataFrame:
    e = events(x).withColumn("details", F.when(F.col("id") % 3 == 0, F.concat(F.lit("@@ -1 +1 @@\n"), "details")).otherwise(F.col("details")))
    args = [F.col(c) for c in ("id", "title", "kind", "severity", "created_at", "url", "summary", "details")]
    return e.select("id", "kind", text.event_report(*args).alias("report"), text.event_report_md(*args).alias("report_md"))


_N = "chr(10)"
_AT = "strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' UTC'"


_REPORTS = _EVENTS + f""", r AS (SELECT *, CASE WHEN id % 3 = 0 THEN '@@ -1 +1 @@' || {_N} || details ELSE details END AS body FROM e),
    p AS (SELECT id, kind, 'Отчёт об изменении' || {_N} || 'Событие #' || id || {_N} || 'Время: ' || {_AT} || {_N} || 'Тип: ' || kind || {_N} || 'Важность: ' || severity || {_N} || 'Документ: ' || coalesce(title, 'Документ') || {_N} || 'URL: ' || coalesce(url, 'нет данных') || {_N} || {_N} || 'Кратко:' || {_N} || summary || {_N} || {_N} || 'Подробности / old-new diff:' || {_N} || body || {_N} AS report,
    '# Отчёт об изменении · событие #' || id || {_N} || {_N} || '- Время: ' || {_AT} || {_N} || '- Тип: `' || kind || '`' || {_N} || '- Важность: `' || severity || '`' || {_N} || '- Документ: ' || coalesce(title, 'Документ') || {_N} || '- URL: ' || coalesce(url, 'нет данных') || {_N} || {_N} || '## Кратко' || {_N} || {_N} || summary || {_N} || {_N} || '## До / после (unified diff)' || {_N} || {_N}
      || CASE WHEN starts_with(body, '@@') THEN '```diff' || {_N} || body || {_N} || '```' ELSE body END || {_N} AS report_md FROM r)"""


@query("event_report", _REPORTS + " SELECT id, kind, report, report_md FROM p", "change_log", "documents_dim")
def event_report(x: Inputs) -> DataFrame:
    return reports(x)


@query("report_sink", _REPORTS + " SELECT id AS event_id, kind, length(report_md)::BIGINT AS n_chars, sha256(report_md) AS sha256 FROM p", "change_log", "documents_dim")
def report_sink(x: Inputs) -> DataFrame:
    """A report per event, stored and read again."""
    path = tables.fresh_path(x.spark, "reports")
    tables.write_reports(reports(x).select(F.col("id").alias("event_id"), "kind", F.col("report_md").alias("report")), path)
    stored = x.spark.read.schema("event_id long, report string, kind string").parquet(path)
    return stored.select("event_id", "kind", F.length("report").cast("long").alias("n_chars"), F.sha2("report", 256).alias("sha256"))


@query("attachment_text_clean", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents")
def attachment_text_clean(x: Inputs) -> DataFrame:
    return x.table("documents").select("doc_id", F.sha2(text.clean_attachment_text(F.col("text")), 256).alias("digest"))


#: Entities as characters again, for DuckDB; as in HTML, these four need no semicolon.
_UNESCAPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query("page_title", "SELECT page_id, " + _UNESCAPED.format("title") + " AS title FROM (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM pages)")
def page_title(x: Inputs) -> DataFrame:
    return html.parse_pages(x.table("pages"), "title").select("page_id", "title")


@query("page_category", "SELECT page_id, 'Cat ' || (page_id % 11) AS category FROM pages")
def page_category(x: Inputs) -> DataFrame:
    return html.parse_pages(x.catalog_pages, "category").select("page_id", "category")


def links_of(parsed: DataFrame, prefix: str) -> DataFrame:
    """(page_id, kind, target, title): canonical links in a page's content root, the first of each; parsed: pages with their `links`.

    Files are attachments wherever they are; what else lies under the prefix, but for the
    page itself, is a document link.
    """
    each = parsed.select("page_id", "url", F.posexplode("links").alias("pos", "link")).where("link.in_root")
    # Written once: the rules for URLs are long expressions, and each use below would repeat them.
    told = each.select("page_id", "pos", urls.canonicalize(F.col("link.url")).alias("target"), F.col("link.title").alias("title"), urls.canonicalize(F.col("url")).alias("own"))
    named = F.coalesce(F.nullif("title", F.lit("")), F.regexp_extract("target", r"([^/]*)$", 1))
    links = tables.written(told, "canonical-links").withColumn("title", named)
    inside = F.col("target").startswith(prefix.rstrip("/") + "/") & (F.col("target") != F.col("own"))
    kind = F.when(urls.is_attachment(F.col("target")), "attachment").when(inside, "document")
    return links.withColumn("kind", kind).where("kind is not null").groupBy("page_id", "kind", "target").agg(F.min_by("title", "pos").alias("title"))


#: What the pages of the catalogue link to: their children in the tree, above each fifth page its parent, a file, and what doesn't count.
CATALOG_LINKS = f""", n AS (SELECT max(page_id) + 1 AS n FROM pages), u AS (SELECT page_id AS k, {CATALOG_URL.format('page_id', '//')} AS url, 8 * page_id >= n AS leaf FROM pages, n),
    l AS (SELECT p.k AS page_id, 'document' AS kind, c.url AS target, 'Page ' || c.k AS title, c.k AS child FROM u p JOIN u c ON c.k // 8 = p.k AND c.k > 0
      UNION ALL SELECT c.k, 'document', p.url, 'Back', p.k FROM u c JOIN u p ON c.k // 8 = p.k WHERE c.k % 5 = 0 AND p.k > 0
      UNION ALL SELECT k, 'attachment', 'https://docs.example.test/files/' || k || '.pdf', 'File ' || k, NULL FROM u)"""


@query("page_links", CATALOG_LINKS.replace(", n AS", "WITH RECURSIVE n AS", 1) + " SELECT page_id, kind, target, title FROM l")
def page_links(x: Inputs) -> DataFrame:
    return links_of(html.parse_pages(x.catalog_pages, "links"), CATALOG)


@query("catalog_bfs", CATALOG_LINKS.replace(", n AS", "WITH RECURSIVE n AS", 1) + """, r AS (SELECT 0::BIGINT AS k UNION SELECT l.child FROM r JOIN l ON l.page_id = r.k JOIN u ON u.k = l.child WHERE r.k % 11 <> 3 AND NOT u.leaf)
    SELECT DISTINCT l.target AS url FROM r JOIN l ON l.page_id = r.k JOIN u ON u.k = l.child WHERE r.k % 11 <> 3 AND u.leaf""")
def catalog_bfs(x: Inputs) -> DataFrame:
    """The documents of a catalogue of pages, each parsed once; one category is muted."""
    parsed = tables.written(html.parse_pages(x.catalog_pages, "category", "links"), "parsed")
    links = links_of(parsed, CATALOG).where("kind = 'document'").join(parsed.select("page_id", "url").hint("merge"), "page_id")
    root = x.spark.range(1).select(F.lit(CATALOG).alias("node"))
    muted = parsed.where(text.category_key(F.col("category")) == "cat 3").select(F.col("url").alias("node"))
    found = discover(links.select(F.col("url").alias("src"), F.col("target").alias("dst"), urls.is_document_url(F.col("target"), CATALOG).alias("is_document")), root, tables.written(muted, "muted"), max_pages=None)
    return found.select(F.col("node").alias("url"))


#: The pieces of text in the article, each without white space at its ends, for DuckDB.
_PIECES = r"list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>'), lambda t: trim(t, ' ' || chr(9) || chr(10) || chr(13))), lambda t: t <> '')"


@query("content_root", "SELECT page_id, 'article' AS root_tag, length(" + _UNESCAPED.format(f"array_to_string({_PIECES}, ' ')") + ")::BIGINT AS root_chars FROM pages")
def content_root(x: Inputs) -> DataFrame:
    return html.parse_pages(x.table("pages"), "root_tag", "root_chars").select("page_id", "root_tag", "root_chars")


@query("normalize_html")
def normalize_html(x: Inputs) -> DataFrame:
    return html.parse_pages(x.table("pages"), "normalized_html").select("page_id", "normalized_html", F.sha2("normalized_html", 256).alias("html_sha256"))


@query("semantic_text")
def semantic_text(x: Inputs) -> DataFrame:
    return html.parse_pages(x.table("pages"), "semantic_text").select("page_id", "semantic_text", F.sha2("semantic_text", 256).alias("semantic_sha256"), "error")


@query("unified_diff")
def unified_diff(x: Inputs) -> DataFrame:
    """Diffs of pairs of versions that differ: digests are compared first, then texts are joined, then Python runs."""
    log = x.text_versions.select("key", "version", F.sha2("text", 256).alias("sha"))
    changed = log.withColumn("old", F.lag("sha").over(Window.partitionBy("key").orderBy("version"))).where("old <> sha")
    texts = x.text_versions.select(F.sha2("text", 256).alias("s"), "text").dropDuplicates(["s"])
    both = changed.join(texts.select(F.col("s").alias("sha"), F.col("text").alias("new_text")).hint("merge"), "sha").join(texts.select(F.col("s").alias("old"), F.col("text").alias("old_text")).hint("merge"), "old")
    return both.select("key", "version", html.diff_of("old_text", "new_text").alias("diff"))
