"""The event vocabulary and predicates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MEANINGFUL = (
    "document_added", "document_removed", "document_restored", "html_content_changed",
    "attachment_added", "attachment_removed", "attachment_content_changed", "attachment_binary_changed",
)
ERRORS = ("fetch_error", "storage_error")
SEVERITY = {
    "document_added": "warning", "document_removed": "warning", "document_restored": "warning", "html_content_changed": "critical", "html_markup_changed": "info",
    "attachment_added": "warning", "attachment_removed": "warning", "attachment_content_changed": "critical", "attachment_binary_changed": "info", "storage_error": "critical",
}
SEVERITY_DEFAULT = "warning"
NO_CATEGORY = "Без категории"


def severity(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.coalesce(F.element_at(names, kind), F.lit(SEVERITY_DEFAULT))


def meaningful(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*MEANINGFUL))


def errors(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*ERRORS))


def pending(events: DataFrame) -> DataFrame:
    return events.where(~F.col("notified"))


def change_events(*detected: DataFrame) -> DataFrame:
    """All detectors' rows (kind, document_id, summary, details) as one relation with severity."""
    columns = ["kind", "document_id", "summary", "details"]
    out = detected[0].select(*columns)
    for d in detected[1:]:
        out = out.unionByName(d.select(*columns))
    return out.withColumn("severity", severity(F.col("kind")))
