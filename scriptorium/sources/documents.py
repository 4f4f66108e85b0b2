"""Files of all known kinds as one table of blocks, parsed once for each content and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.blocks import markdown_blocks
from scriptorium.sources import office
from scriptorium.sources.pages import html_text

#: Fixed value: the suffixes of texts; the office formats have readers of their own.
TEXTS = ("md", "markdown", "txt", "csv", "html", "htm", "json")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def lookup_key(content: Column, profile: str) -> Column:
    """What a parse is found by: the content and how it is parsed."""
    return F.sha2(F.concat_ws("/", F.sha2(content, 256), F.lit(profile)), 256)


def text_blocks(files: DataFrame) -> DataFrame:
    """``(path, ord, kind, text, location, context, error)`` of texts: fences, headings and paragraphs, each with its first line; headings only in Markdown."""
    kind = suffix(F.col("path"))
    raw = office.decoded_text("content")
    read = files.where(kind.isin(*TEXTS)).select("path", kind.alias("kind"), raw.alias("raw"))
    saved = F.when(F.col("kind") == "json", office.saved_pages_text(F.col("raw"))).when(F.col("kind").isin("html", "htm"), html_text(F.col("raw"))).otherwise(F.col("raw"))
    texts = read.select("path", "kind", saved.alias("text"))
    split = markdown_blocks(texts.where("text is not null"), "path").withColumnRenamed("doc_id", "path")
    plain = F.col("kind").isin("heading") & ~suffix(F.col("path")).isin("md", "markdown", "json")
    none = F.lit(None).cast("string")
    where = F.to_json(F.struct(F.lit("text").alias("kind"), F.col("line")))
    good = split.select("path", "ord", F.when(plain, "paragraph").otherwise(F.col("kind")).alias("kind"), "text", where.alias("location"), F.lit("").alias("context"), none.alias("error"))
    bad = texts.where("text is null").select("path", F.lit(0).alias("ord"), none.alias("kind"), none.alias("text"), none.alias("location"), none.alias("context"), F.lit("unreadable").alias("error"))
    return good.unionByName(bad)


def parse_files(files: DataFrame, done: DataFrame | None = None, profile: str = "1") -> DataFrame:
    """Blocks of ``files(path, content)`` of any known suffix; contents whose key is in ``done(lookup_key)`` are not parsed again, unknown suffixes give an error."""
    keyed = files.withColumn("lookup_key", lookup_key(F.col("content"), profile))
    if done is not None:
        keyed = keyed.join(done.select("lookup_key").distinct(), "lookup_key", "left_anti")
    kind = suffix(F.col("path"))
    cells = office.xlsx_blocks(keyed.where(kind == "xlsx"))
    place = F.to_json(F.struct(F.lit("xlsx").alias("kind"), "sheet", "sheet_index", F.col("address").alias("cell_address"), F.col("merged").alias("cell_range")))
    context = F.concat_ws("\n", F.when(F.size("peers") > 0, F.concat(F.lit("Same row cells: "), F.array_join("peers", " | "))), F.when(F.col("first_above").isNotNull(), F.concat(F.lit("First populated cell in column: "), F.col("first_above"))))
    order = F.struct("sheet_index", "row", "col")
    listed = cells.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "kind", "text", place.alias("location"), context.alias("context")))).alias("rows"))
    sheets = listed.select("path", F.posexplode("rows").alias("ord", "r")).select("path", "ord", "r.kind", "r.text", "r.location", "r.context", F.lit(None).cast("string").alias("error"))
    lost = office.xlsx_cells(keyed.where(kind == "xlsx")).where("error is not null").select("path", F.lit(0).alias("ord"), *[F.lit(None).cast("string").alias(c) for c in ("kind", "text", "location", "context")], "error")
    none = F.lit(None).cast("string")
    unknown = keyed.where(~kind.isin(*TEXTS, "xlsx", "docx", "pptx")).select("path", F.lit(0).alias("ord"), *[none.alias(c) for c in ("kind", "text", "location", "context")], F.lit("unknown_kind").alias("error"))
    parts = [text_blocks(keyed), sheets, lost, office.docx_blocks(keyed.where(kind == "docx")), office.pptx_blocks(keyed.where(kind == "pptx")), unknown]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_quality(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(path, status, reason)``: a row to review for each file that failed or in which nothing can be read, else verified."""
    shown = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")) != ""
    found = blocks.groupBy("path").agg(F.max("error").alias("error"), F.bool_or(shown & (F.col("kind") != "image")).alias("readable"))
    seen = files.select("path").join(found, "path", "left")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce("readable", F.lit(False)), "readable_text_absent")
    return seen.select("path", F.when(reason.isNull(), "verified").otherwise("needs_review").alias("status"), reason.alias("reason"))
