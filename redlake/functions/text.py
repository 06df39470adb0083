"""Scalar functions over text: keys, labels, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that Python's str methods know: \s in Unicode mode and the four separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
ICONS = {"critical": "🔴", "warning": "🟠", "info": "🔵"}
DEFAULT_ICON = "⚪"


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def normalize_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, SPACE, " "))


def category_key(value: Column) -> Column:
    """Normalized and case-folded: also ß as ss and final sigma as sigma."""
    return F.replace(F.replace(F.lower(normalize_space(value)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def category_token(value: Column) -> Column:
    return F.substring(F.sha1(category_key(value)), 1, 16)


def html_escape(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def severity_icon(severity: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])
    return F.coalesce(F.element_at(icons, severity), F.lit(DEFAULT_ICON))


def truncate(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def format_event(severity: Column, kind: Column, summary: Column, details: Column, url: Column) -> Column:
    """One event as a message; url may be null or empty."""
    link = F.when(url != "", F.concat(F.lit('\n\n🔗 <a href="'), html_escape(url), F.lit('">Открыть страницу документа</a>')))
    head = F.concat(severity_icon(severity), F.lit(" <b>"), html_escape(summary), F.lit("</b>\n\n<code>"), html_escape(kind), F.lit("</code>\n"))
    return F.concat(head, html_escape(truncate(details, 3000)), F.coalesce(link, F.lit("")))


def chunks(value: Column, size: int = 3900) -> Column:
    """The text in parts of `size` characters; an empty text has none."""
    n = F.ceil(F.length(value) / size).cast("int")
    return F.when(F.length(value) > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(value, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def duration_label(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    minutes, hours = F.floor((s % 3600) / 60), F.floor(s / 3600)
    return F.when(s < 60, F.format_string("%d с", s)).when(s < 3600, F.format_string("%d мин %02d с", minutes, s % 60)).otherwise(F.format_string("%d ч %02d мин", hours, minutes))


def format_ts(value: Column, fallback: str = "нет данных") -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm"), F.lit(fallback))


def next_slot(value: Column, mode: Column) -> Column:
    """The next noon, midnight or even hour after a time; null for any other mode."""
    day = F.date_trunc("day", value)
    noon = day + F.expr("interval 12 hours")
    hour = F.hour(value)
    return (
        F.when(mode == "noon", F.when(value < noon, noon).otherwise(noon + F.expr("interval 1 day")))
        .when(mode == "midnight", day + F.expr("interval 1 day"))
        .when(mode == "even", day + F.make_dt_interval(F.lit(0), hour + 2 - hour % 2))
    ).cast("timestamp_ntz")


def safe_filename(name: Column, suffix: str = "") -> Column:
    clean = F.substring(F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_"), F.lit("._")), 1, 80)
    return F.concat(F.coalesce(F.when(clean != "", clean), F.lit("report")), F.lit(suffix))


def extract_hashes(details: Column) -> Column:
    return F.regexp_extract_all(details, F.lit(r"(?:old|new)=([0-9a-f]{64})"), F.lit(1))


def split_keys(settings: Column) -> Column:
    """The distinct category keys of a comma-separated setting, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(settings, ","), category_key), lambda x: x != "")))


def split_lines(settings: Column) -> Column:
    return F.filter(F.transform(F.split(settings, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), F.trim), lambda x: x != "")


def identity_label(username: Column, display_name: Column) -> Column:
    named = F.when(username != "", F.concat(F.lit("@"), username))
    return F.coalesce(named, F.when(display_name != "", display_name), F.lit("без имени"))


def percent(done: Column, total: Column) -> Column:
    """Rounded half to even, 0 of nothing."""
    return F.when(total == 0, 0).otherwise(F.bround(F.lit(100.0) * done / total, 0)).cast("long")


def progress_bar(value: Column, width: int = 10) -> Column:
    full = F.bround(F.greatest(F.least(value, F.lit(100)), F.lit(0)) * F.lit(width / 100.0), 0).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def is_diff(details: Column) -> Column:
    start = F.ltrim(details)
    return start.startswith("--- ") | start.startswith("@@")


def _report_time(created: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(created, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit("нет данных"))


def _or(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))


def event_report(id_: Column, title: Column, kind: Column, severity: Column, created: Column, url: Column, summary: Column, details: Column) -> Column:
    """A change as plain text."""
    fields = (("Событие #", id_.cast("string")), ("Время: ", _report_time(created)), ("Тип: ", kind), ("Важность: ", severity), ("Документ: ", _or(title, "Документ")), ("URL: ", _or(url, "нет данных")))
    rows = [F.concat(F.lit(name), value) for name, value in fields]
    return F.concat_ws("\n", F.lit("Отчёт об изменении"), *rows, F.lit(""), F.lit("Кратко:"), summary, F.lit(""), F.lit("Подробности / old-new diff:"), _or(details, "нет подробностей"), F.lit(""))


def event_report_md(id_: Column, title: Column, kind: Column, severity: Column, created: Column, url: Column, summary: Column, details: Column) -> Column:
    """A change as Markdown; details that are a diff stand in a fence."""
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    fields = (("- Время: ", _report_time(created)), ("- Тип: ", quoted(kind)), ("- Важность: ", quoted(severity)), ("- Документ: ", _or(title, "Документ")), ("- URL: ", _or(url, "нет данных")))
    rows = [F.concat(F.lit(name), value) for name, value in fields]
    text = _or(details, "нет подробностей")
    body = F.when(is_diff(text), F.concat(F.lit("```diff\n"), text, F.lit("\n```"))).otherwise(text)
    head = F.concat(F.lit("# Отчёт об изменении · событие #"), id_.cast("string"))
    return F.concat_ws("\n", head, F.lit(""), *rows, F.lit(""), F.lit("## Кратко"), F.lit(""), summary, F.lit(""), F.lit("## До / после (unified diff)"), F.lit(""), body, F.lit(""))


def clean_attachment_text(value: Column) -> Column:
    """Runs of spaces and tabs as one space, three or more line breaks as two."""
    return F.btrim(F.regexp_replace(F.regexp_replace(value, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \n"))
