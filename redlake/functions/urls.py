"""URLs, by patterns that take any text: parse_url fails on spaces."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import category_key

# Fixed values.
ATTACHMENT = r"\.(pdf|odt|docx?|xlsx?|zip|rar|7z)$"


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def canonicalize(url: Column) -> Column:
    """Without fragment, query and final slashes; scheme in lower case; an empty path is /."""
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    cut = F.regexp_replace(F.concat(F.lower(scheme), F.substr(bare, F.length(scheme) + 1)), r"/+$", "")
    return F.when(cut.rlike(r"^[a-z][a-z0-9+.\-]*://[^/]+$"), F.concat(cut, F.lit("/"))).otherwise(cut)


@pandas_udf(StringType())
def _resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href, strict=True)])


def url_join(base: Column, href: Column) -> Column:
    """href as seen from base, for absolute, scheme-relative, root-relative and plain relative links without dot segments."""
    scheme, site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"(?s)[?#].*$", "")
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(F.when(path_of(bare) == "", F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", "")), href))
    )


def url_join_any(base: Column, href: Column) -> Column:
    """url_join, with an Arrow UDF only for links with dot segments."""
    return F.when(href.rlike(r"(^|/)\.\.?(/|$)"), _resolve(base, href)).otherwise(url_join(base, href))


def is_document_url(url: Column, prefix: str) -> Column:
    """At least two segments below the prefix's path."""
    top = re.sub(r"^[^:]+://[^/]*|[?#].*$", "", prefix).strip("/")
    path = F.btrim(path_of(canonicalize(url)), F.lit("/"))
    return path.startswith(f"{top}/") & (F.size(F.split(path, "/")) >= len(top.split("/")) + 2)


def is_attachment(url: Column) -> Column:
    path = F.lower(path_of(url))
    return path.rlike(ATTACHMENT) | F.contains(path, F.lit("/download/")) | F.contains(F.lower(url), F.lit("?download"))


def attachment_group_key(title: Column, url: Column) -> Column:
    """The title's key without extension and what trails before it; if that is empty, the file name's without extension."""
    key = category_key(F.coalesce(title, F.lit("")))
    own = F.when(key.rlike(ATTACHMENT), F.regexp_replace(F.regexp_replace(key, ATTACHMENT, ""), r"[ ._\-–—]+$", "")).otherwise(key)
    return F.coalesce(F.nullif(own, F.lit("")), F.regexp_replace(F.lower(F.regexp_extract(path_of(url), r"([^/]*)$", 1)), ATTACHMENT, ""))


def path_suffix(url: Column, content_type: Column) -> Column:
    """The path's extension, else one from the content type."""
    own = F.regexp_extract(F.lower(path_of(url)), ATTACHMENT, 0)
    kind = F.coalesce(content_type, F.lit(""))
    return F.when(own != "", own).when(F.contains(kind, F.lit("pdf")), ".pdf").when(F.contains(kind, F.lit("opendocument")), ".odt").otherwise(".bin")


def validators(etag: Column, modified: Column) -> Column:
    """The headers of a conditional request, those that have a value."""
    return F.map_filter(F.create_map(F.lit("If-None-Match"), F.coalesce(etag, F.lit("")), F.lit("If-Modified-Since"), F.coalesce(modified, F.lit(""))), lambda _, v: v != "")
