"""What a page says about itself: title and description, by patterns over its html. Its article: see `tree`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tree import articles  # noqa: F401


def _first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def _tag(html: Column, tag: str) -> Column:
    inner = _first(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>")
    return F.nullif(T.clean_text(T.unescaped(F.regexp_replace(inner, r"(?s)<[^>]*>", ""))), F.lit(""))


def summaries(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `title`, `description` and `success`: the meta description, else og:description, else first heading and paragraph; success needs 20 characters."""
    html = F.coalesce("html", F.lit(""))
    meta = lambda attr: T.clean_text(T.unescaped(_first(html, rf"""(?is)<meta\b[^>]*{attr}["'][^>]*content=["']([^"']*)["']""")))
    fallback = F.nullif(F.concat_ws(" - ", _tag(html, "h1"), _tag(html, "p")), F.lit(""))
    out = pages.select("page_id", "url", _tag(html, "title").alias("title"), F.coalesce(meta("name=[\"']description"), meta("property=[\"']og:description"), fallback).alias("description"))
    return out.withColumn("success", F.length(F.coalesce("description", F.lit(""))) >= 20)
