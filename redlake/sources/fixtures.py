"""The engine's input relations, derived from the star-schema test tables.

Each is written twice by one rule: as Spark SQL, and as DuckDB SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import scan

_EXT = "CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.odt' WHEN 'de' THEN '.docx' ELSE '.zip' END"
_KIND = """CASE event_type WHEN 'signup' THEN 'document_added' WHEN 'click' THEN 'attachment_added'
  WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'html_markup_changed' ELSE 'html_content_changed' END
  WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'storage_error' ELSE 'fetch_error' END
  ELSE CASE WHEN event_id % 2 = 0 THEN 'attachment_content_changed' ELSE 'document_removed' END END"""

#: The root of a catalogue of pages, and the URL of page {0}, whose parent is page {0} {1} 8: a category if it has children, else a document.
CATALOG = "https://docs.example.test/docs"
CATALOG_URL = f"CASE WHEN {{0}} = 0 THEN '{CATALOG}' WHEN 8 * {{0}} < n THEN '{CATALOG}/c' || {{0}} ELSE '{CATALOG}/c' || ({{0}} {{1}} 8) || '/d' || {{0}} END"
_CHILDREN = "array_join(transform(filter(sequence(8 * page_id, 8 * page_id + 7), i -> i > 0 and i < n), i -> '<a href=\"' || substr(" + CATALOG_URL.format("i", "div") + ", 26) || '/\">Page ' || i || '</a>'), ' ')"
_BACK = "CASE WHEN page_id > 0 AND page_id % 5 = 0 THEN '<a href=\"' || " + CATALOG_URL.format("(page_id div 8)", "div") + " || '\">Back</a>' ELSE '' END"

#: name -> (tables it reads, fixtures it reads, Spark SQL, DuckDB SQL or None if the Spark text serves both)
DEFINITIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str, str | None]] = {
    "captures": (
        ("events",), (),
        """SELECT key, run, fetched_at, sha2(et, 256) AS semantic_sha256, sha2(concat(et, ':', cast(event_id % 3 AS string)), 256) AS html_sha256 FROM (
          SELECT user_id AS key, cast(datediff(ts, DATE '2024-01-01') AS bigint) AS run, ts AS fetched_at, event_type AS et, event_id,
            row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) WHERE rn = 1""",
        """SELECT key, run, fetched_at, sha256(et) AS semantic_sha256, sha256(et || ':' || (event_id % 3)) AS html_sha256 FROM (
          SELECT user_id AS key, date_diff('day', DATE '2024-01-01', cast(ts AS date))::BIGINT AS run, ts AS fetched_at, event_type AS et, event_id,
            row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    ),
    "change_log": (
        ("events",), (),
        f"""SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE user_id END AS document_id, {_KIND} AS kind,
          concat(event_type, '-', cast(event_id % 2 AS string)) AS summary, concat('d', cast(event_id % 2 AS string)) AS details, event_id % 7 < 2 AS notified FROM {{events}}""",
        f"""SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE user_id END AS document_id, {_KIND} AS kind,
          event_type || '-' || (event_id % 2) AS summary, 'd' || (event_id % 2) AS details, event_id % 7 < 2 AS notified FROM events""",
    ),
    "documents_dim": (
        ("customer",), (),
        "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS category, c_acctbal >= 0 AS active, concat('https://docs.example.test/', lower(c_mktsegment), '/', cast(c_custkey AS string)) AS url FROM {customer}",
        "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS category, c_acctbal >= 0 AS active, 'https://docs.example.test/' || lower(c_mktsegment) || '/' || c_custkey AS url FROM customer",
    ),
    "recipients": (
        ("nation",), (),
        "SELECT cast(n_nationkey AS bigint) AS user_id, cast(1000 + n_nationkey AS bigint) AS chat_id, CASE n_nationkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'denied' ELSE 'approved' END AS status, n_name AS display_name FROM {nation}",
        None,
    ),
    "mutes": (
        ("nation", "customer"), (),
        """SELECT cast(n_nationkey AS bigint) AS user_id, lower(seg) AS category_key FROM {nation}, (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS i FROM (SELECT DISTINCT c_mktsegment AS seg FROM {customer}))
          WHERE n_nationkey % 3 = 0 AND i = n_nationkey % 5""",
        None,
    ),
    "deliveries": ((), ("change_log", "recipients"), "SELECT id AS event_id, chat_id FROM {change_log}, {recipients} WHERE status = 'approved' AND (id % 10 = 0 OR (id + user_id) % 4 = 0)", None),
    "blobs": (
        ("documents",), (),
        "SELECT doc_id AS seq, source AS store, sha2(text, 256) AS digest, cast(octet_length(text) AS bigint) AS len, lang FROM {documents}",
        "SELECT doc_id AS seq, source AS store, sha256(text) AS digest, strlen(text)::BIGINT AS len, lang FROM documents",
    ),
    "text_versions": (
        ("documents",), (),
        "SELECT source AS key, cast(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS bigint) AS version, text FROM {documents}",
        "SELECT source AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, text FROM documents",
    ),
    "attachment_links": (
        ("documents",), (),
        f"""SELECT source AS document_id, doc_id AS pos, concat('Doc ', cast(doc_id % 7 AS string), {_EXT}) AS title,
          concat('https://docs.example.test/', source, '/', cast(doc_id AS string), {_EXT}) AS url FROM {{documents}}""",
        f"""SELECT source AS document_id, doc_id AS pos, 'Doc ' || (doc_id % 7) || {_EXT} AS title,
          'https://docs.example.test/' || source || '/' || doc_id || {_EXT} AS url FROM documents""",
    ),
    "catalog_edges": (
        ("part",), (),
        "SELECT p_partkey div 8 AS src, p_partkey AS dst FROM {part} WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey div 8 FROM {part} WHERE p_partkey > 0 AND p_partkey % 5 = 0",
        "SELECT p_partkey // 8 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 8 FROM part WHERE p_partkey > 0 AND p_partkey % 5 = 0",
    ),
    "runs": (
        ("orders",), (),
        "SELECT o_orderkey AS id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + make_dt_interval(0, 0, 0, cast(o_orderkey % 600 AS decimal(18,6))) END AS finished_at, o_orderpriority AS trigger FROM {orders}",
        "SELECT o_orderkey AS id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + to_seconds(o_orderkey % 600) END AS finished_at, o_orderpriority AS trigger FROM orders",
    ),
    "catalog_pages": (
        ("pages",), (),
        f"""SELECT page_id, url, replace(html, '<article>', '<div class="breadcrumbs"><a href="/">Home</a> <a href="' || url || '">Cat ' || (page_id % 11) || '</a></div><article><p>' || {_CHILDREN} || {_BACK}
          || '<a href="/files/' || page_id || '.pdf">File ' || page_id || '</a> <a href="https://other.example.test/docs/x">Out</a> <a href="' || url || '#top">Self</a> <a href="/docs/">All</a></p>') AS html
          FROM (SELECT page_id, {CATALOG_URL.format("page_id", "div")} AS url, html, n FROM {{pages}}, (SELECT max(page_id) + 1 AS n FROM {{pages}}))""",
        None,
    ),
    "page_links": (
        ("pages",), (),
        r"""SELECT page_id, url AS page_url, cast(pos AS bigint) AS pos, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), href) AS target, title FROM (
          SELECT page_id, url, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)', 1) AS title FROM (
          SELECT page_id, url, posexplode(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*', 0)) AS (pos, a) FROM {pages}))""",
        r"""SELECT page_id, url AS page_url, pos - 1 AS pos, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS target, title FROM (
          SELECT page_id, url, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)', 1) AS title FROM (
          SELECT page_id, url, unnest(m) AS a, unnest(range(1, len(m) + 1)) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*') AS m FROM pages)))""",
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, others, sql, _ = DEFINITIONS[name]
    frames = {t: scan(spark, sf_dir, t) for t in tables} | {o: fixture(spark, sf_dir, o) for o in others}
    return spark.sql(sql, **frames)


def oracle_ctes(*names: str) -> str:
    """WITH ... : the named fixtures and those they read, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        for o in DEFINITIONS[name][1]:
            add(o)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)

    def text(name: str) -> str:
        tables, others, sql, duck = DEFINITIONS[name]
        return duck or sql.format(**{t: t for t in (*tables, *others)})

    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({text(n)})" for n in order) if order else ""
