"""From change log to outbox: joins, suppression, fan-out, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redlake.functions.text import category_key, format_ts, html_escape, severity_icon
from redlake.sources.tables import checked, written

from . import events as ev
from .versions import first_of

MAX_LINE = 240
MAX_GROUPS = 20
NO_DOCUMENT = "Общие события"


def with_documents(events: DataFrame, documents: DataFrame) -> DataFrame:
    """events with title, category and url of their documents; events without one stay."""
    d = documents.select(F.col("id").alias("document_id"), "title", "category", "url")
    return events.join(d, "document_id", "left")


def dedupe_fingerprint(events: DataFrame) -> DataFrame:
    """The first event of each (kind, document_id, summary, details); nulls are equal."""
    return first_of(events, ["kind", "document_id", "summary", "details"], "id")


def new_errors(events: DataFrame) -> DataFrame:
    """Pending errors whose (kind, document_id, summary) was never announced, the first of each.

    Null document_ids are equal: a plain join would announce them again and again.
    """
    errors = ev.errors(events)
    known = errors.where("notified").select(F.col("kind").alias("k"), F.col("document_id").alias("d"), F.col("summary").alias("s")).distinct()
    fresh = errors.where(~F.col("notified"))
    # kind and summary are never null: they spread the rows; only document_id needs a null-safe test.
    unseen = fresh.join(known, (F.col("kind") == F.col("k")) & (F.col("summary") == F.col("s")) & F.col("document_id").eqNullSafe(F.col("d")), "left_anti")
    return first_of(unseen, ["kind", "document_id", "summary"], "id")


def approved(recipients: DataFrame) -> DataFrame:
    return recipients.where("status = 'approved'")


def fan_out(events: DataFrame, recipients: DataFrame) -> DataFrame:
    """Each event for each recipient: the one product of two tables here, as the result is that product."""
    return events.crossJoin(checked(recipients.select("user_id", "chat_id")))


def undelivered(pairs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pairs (id, chat_id) that the ledger doesn't have."""
    return pairs.join(deliveries.select(F.col("event_id").alias("id"), "chat_id"), ["id", "chat_id"], "left_anti")


def muted(pairs: DataFrame, mutes: DataFrame, how: str = "left_semi") -> DataFrame:
    """Pairs whose event's category the recipient muted (left_semi), or the others (left_anti). No category: never muted."""
    m = mutes.select("user_id", F.col("category_key").alias("ck")).distinct()
    p = pairs.withColumn("ck", category_key(F.col("category")))
    return p.join(checked(m), ["user_id", "ck"], how).drop("ck")


def delivery_complete(deliveries: DataFrame, recipients: DataFrame) -> DataFrame:
    """Events in the ledger for every recipient."""
    chats = recipients.select("chat_id").distinct()
    n = chats.agg(F.count(F.lit(1)).alias("n"))
    done = deliveries.join(checked(chats), "chat_id").groupBy("event_id").agg(F.countDistinct("chat_id").alias("k"))
    return done.crossJoin(F.broadcast(n)).where("k = n").select("event_id")


def new_ledger_rows(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch to append: each once, none that is there."""
    return batch.select("event_id", "chat_id").distinct().join(ledger, ["event_id", "chat_id"], "left_anti")


def group_key(category: Column) -> Column:
    return F.coalesce(F.when(category != "", category), F.lit(ev.NO_CATEGORY))


def digest_groups(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, category, document_id, first_id, n): events by category and document, in the order of first appearance."""
    g = events.withColumn("category", group_key(F.col("category")))
    return g.groupBy(*by, "category", "document_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def without_initial_noise(events: DataFrame, by: list[str]) -> DataFrame:
    """A new document's first attachments say nothing: where a group has document_added, attachment_added goes."""
    w = Window.partitionBy(*by, group_key(F.col("category")), "document_id")
    added = F.max((F.col("kind") == "document_added").cast("int")).over(w)
    first = F.min("id").over(w)
    marked = events.withColumns({"__added": added, "first_id": first})
    return marked.where((F.col("__added") == 0) | (F.col("kind") != "attachment_added")).drop("__added")


def _groups(events: DataFrame, by: list[str], line: Column) -> DataFrame:
    """(by, category, document_id, title, first_id, n, body): one text per group, events in digest order.

    events has first_id, the group's first appearance.
    """
    order = F.struct((F.col("kind") != "document_added").alias("late"), "id", "line")
    g = events.withColumns({"category": group_key(F.col("category")), "line": line})
    folded = g.groupBy(*by, "category", "document_id").agg(
        F.max("title").alias("title"), F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(order)).alias("rows")
    )
    return folded.withColumn("body", F.array_join(F.transform("rows", lambda r: r.line), "\n")).drop("rows")


def change_digest(events: DataFrame, by: list[str], groups: int = MAX_GROUPS, details: DataFrame | None = None) -> DataFrame:
    """(by, n_events, text): header with the number of events, the first groups, a line each event, an overflow line.

    events has category, title, url and severity, or, with details (by id), only ids, kinds
    and group keys. Groups stand in order of their first events. A recipient's groups are
    ranked by their keys before any text is gathered, and only the first ones' texts are.
    """
    keys = [*by, "category", "document_id"]
    named = events.withColumn("category", group_key(F.col("category")))
    # A group's first event is its first before noise goes, as without_initial_noise has it.
    told = (F.col("kind") != "attachment_added") | ~F.col("added")
    sizes = named.groupBy(*keys).agg(F.min("id").alias("first_id"), F.max(F.col("kind") == "document_added").alias("added"), F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("kind") == "attachment_added").alias("n_files"))
    sizes = written(sizes.withColumn("n", F.col("n_all") - F.when(F.col("added"), F.col("n_files")).otherwise(0)), "groups")
    totals = sizes.groupBy(*by).agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_groups"))
    shown = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("first_id"))).where(F.col("rank") <= groups).select(*keys, "first_id", "added", "rank")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"e.{c}")) for c in keys]
    some = named.alias("e").join(checked(written(shown, "shown")).alias("g"), same).select("e.*", "g.first_id", "g.added", "g.rank").where(told)
    if details is not None:
        some = some.join(details.select("id", "title", "url", "summary", "severity").hint("merge"), "id")

    link = F.coalesce(F.concat(F.lit(' · <a href="'), html_escape(F.col("url")), F.lit('">открыть</a>')), F.lit(""))
    line = F.concat(severity_icon(F.col("severity")), F.lit(" "), html_escape(F.substring("summary", 1, MAX_LINE)), F.lit(" <code>"), html_escape(F.col("kind")), F.lit("</code>"), link)
    head = F.concat(F.lit("\n📁 <b>"), html_escape(F.col("category")), F.lit("</b>\n<b>"), html_escape(F.coalesce("title", F.lit(NO_DOCUMENT))), F.lit("</b>\n"))
    block = _groups(some, [*by, "rank"], line).select(*by, F.struct("rank", F.concat(head, F.col("body")).alias("t")).alias("block"))
    texts = block.groupBy(*by).agg(F.array_sort(F.collect_list("block")).alias("shown"))  # at most `groups` a recipient
    over = F.when(F.col("n_groups") > groups, F.concat(F.lit("\n… и ещё "), (F.col("n_groups") - groups).cast("string"), F.lit(" документов. Подробности: /changes")))
    text = F.concat(F.lit("🔔 Изменения: "), F.col("n_events").cast("string"), F.lit(" событий\n"), F.array_join(F.transform("shown", lambda s: s.t), "\n"), F.coalesce(over, F.lit("")))
    return totals.join(texts, by).select(*by, "n_events", text.alias("text"))


def changes_listing(events: DataFrame) -> DataFrame:
    """(text): a page of changes grouped as in a digest, all events, with ids and times. events is one page: at most 30 rows."""
    line = F.concat(F.lit("• #"), F.col("id").cast("string"), F.lit(" "), format_ts(F.col("created_at")), F.lit(" — "), F.col("summary"))
    grouped = _groups(events.withColumns({"first_id": -F.col("id"), "url": F.lit(None).cast("string")}), [], line)
    block = F.concat(F.lit("\n📁 "), F.col("category"), F.lit("\n<b>"), F.coalesce("title", F.lit(NO_DOCUMENT)), F.lit("</b>\n"), F.col("body"))
    blocks = F.array_sort(F.collect_list(F.struct("first_id", block.alias("t"))))
    return grouped.agg(F.concat(F.lit("📰 Последние изменения\n"), F.array_join(F.transform(blocks, lambda b: b.t), "\n")).alias("text"))


def error_digest(events: DataFrame, by: list[str], shown: int = MAX_GROUPS) -> DataFrame:
    """(by, n_errors, text): the first errors, a line each, line breaks as spaces, an overflow line."""
    detail = F.substring(F.replace("details", F.lit("\n"), F.lit(" ")), 1, MAX_LINE)
    suffix = F.when(detail != "", F.concat(F.lit(" — "), detail)).otherwise("")
    line = F.concat(F.lit("• "), html_escape(F.col("kind")), F.lit(": "), html_escape(F.col("summary")), html_escape(suffix))
    # Each task keeps the first lines of a key and a count of its own before anything is shuffled, however many errors the key has.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    first = events.select(*by, "id", line.alias("line")).withColumn("rank", rank).where(F.col("rank") <= shown)
    counts = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(first.drop("id"), allowMissingColumns=True)
    out = both.groupBy(*by).agg(F.sum("n").alias("n_errors"), F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "line")))).alias("lines"))
    over = F.when(F.col("n_errors") > shown, F.concat(F.lit("\n… и ещё "), (F.col("n_errors") - shown).cast("string")))
    text = F.concat(F.lit("🔴 Ошибки проверки: "), F.col("n_errors").cast("string"), F.lit(" событий\n"), F.array_join(F.transform("lines", lambda x: x.line), "\n"), F.coalesce(over, F.lit("")))
    return out.select(*by, "n_errors", text.alias("text"))


def outbox(events: DataFrame, documents: DataFrame, recipients: DataFrame, mutes: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(chat_id, n_events, text): what each approved recipient is still to be told."""
    fresh = dedupe_fingerprint(ev.pending(ev.meaningful(events))).withColumn("severity", ev.severity(F.col("kind")))
    fresh = written(with_documents(fresh, documents), "fresh")
    keys = ["id", "kind", "category", "document_id"]
    pairs = fan_out(fresh.select(*keys), approved(recipients))
    # The product of events and recipients is made once, and of keys alone.
    told = written(muted(undelivered(pairs, deliveries), mutes, "left_anti").select("chat_id", *keys), "told")
    return change_digest(told, ["chat_id"], details=fresh)
