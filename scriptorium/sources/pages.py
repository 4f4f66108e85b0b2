"""Saved page records and raw HTML as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RECORD = "array<struct<page:string,page_number:string,page_num:string,content:string,markdown:string,text:string>>"
SHORT_EXTRACTION = 300


def page_records(saved: DataFrame, json_col: str = "json") -> DataFrame:
    """``(page, content)`` of saved page arrays of any known shape: first page field that is a number, else the ordinal; first content field that isn't blank; empty pages go."""
    rows = saved.select(F.posexplode(F.from_json(json_col, _RECORD)).alias("i", "r"))
    number = F.coalesce(*[F.col(f"r.{c}").try_cast("int") for c in ("page", "page_number", "page_num")], F.col("i") + 1)
    content = F.coalesce(*[F.nullif(F.trim(f"r.{c}"), F.lit("")) for c in ("content", "markdown", "text")])
    return rows.select(number.alias("page"), content.alias("content")).where("content is not null")


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments, navigation and tags out, entities of the five kinds back, white space as single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    flat = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        flat = F.replace(flat, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def page_title(html: Column) -> Column:
    """The content of a page's title as it stands, blanks around it too; empty without one."""
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, title, chars, short_extraction)`` of ``pages(page_id, html)``."""
    text = html_text(F.col("html"))
    return pages.select("page_id", F.trim(page_title(F.col("html"))).alias("title"), F.length(text).alias("chars")).withColumn("short_extraction", F.col("chars") < SHORT_EXTRACTION)


def sniffed(head: Column, declared: Column) -> Column:
    """Content type by first bytes, else as declared."""
    low = F.lower(F.ltrim(head))
    return F.when(F.startswith(head, F.lit("%PDF-")), "application/pdf").when(F.startswith(low, F.lit("<!doctype html")) | F.startswith(low, F.lit("<html")), "text/html").otherwise(F.lower(F.split_part(declared, F.lit(";"), F.lit(1))))
