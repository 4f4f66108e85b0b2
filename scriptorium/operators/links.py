"""Links between pages: graph, lint and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import normal_target
from scriptorium.operators.sequences import numbered


def link_rows(pages: DataFrame) -> DataFrame:
    """``(path, target)`` of ``pages(path, links)``."""
    return pages.select("path", F.explode("links").alias("target"))


def stem(path):
    return F.element_at(F.split(path, "/"), -1)


def graph_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``(source, target)`` by normalised full path, without self links. Of paths with one normal form the least is the target."""
    keys = pages.groupBy(normal_target(F.col("path")).alias("norm")).agg(F.min("path").alias("to"))
    links = link_rows(pages).select("path", normal_target(F.col("target")).alias("norm"))
    return links.join(keys, "norm").where("path != to").select(F.col("path").alias("source"), F.col("to").alias("target")).distinct()


def degrees(pages: DataFrame) -> DataFrame:
    edges = graph_edges(pages)
    out = edges.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("n_in"))
    return pages.select("path").join(out, "path", "left").join(into, "path", "left").select("path", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def broken_links(pages: DataFrame) -> DataFrame:
    """Links that are neither a page's path nor its bare stem, exactly."""
    known = pages.select(F.col("path").alias("target")).union(pages.select(stem(F.col("path")))).distinct()
    return link_rows(pages).join(known, "target", "left_anti").select("path", "target")


def orphans(pages: DataFrame) -> DataFrame:
    """Pages with no outgoing link at all that no link names by path or bare stem."""
    links = link_rows(pages)
    named = links.select("target").distinct()
    return (
        pages.where(F.size("links") == 0).select("path")
        .join(named, pages.path == named.target, "left_anti")
        .join(named.where(~F.contains("target", F.lit("/"))), stem(F.col("path")) == F.col("target"), "left_anti")
    )


def repaired_links(pages: DataFrame) -> DataFrame:
    """Each link with its repair: the exact path, else the path of the same normal form, else null (plain text)."""
    exact = pages.select(F.col("path").alias("target"), F.col("path").alias("exact"))
    normal = pages.groupBy(normal_target(F.col("path")).alias("norm")).agg(F.min("path").alias("close"))
    links = link_rows(pages).withColumn("norm", normal_target(F.col("target")))
    return links.join(exact, "target", "left").join(normal, "norm", "left").select("path", "target", F.coalesce("exact", "close").alias("fixed"))


def resolved_readings(pages: DataFrame) -> DataFrame:
    """Links as the reader resolves them: anchor and ``.md`` off, exact path, else normal path, else a bare name that is unique."""
    bare = F.regexp_replace(F.split_part(F.col("target"), F.lit("#"), F.lit(1)), r"\.md$", "")
    links = link_rows(pages).withColumn("bare", bare).withColumn("norm", normal_target(bare))
    exact = pages.select(F.col("path").alias("bare"), F.col("path").alias("exact"))
    whole = pages.groupBy(normal_target(F.col("path")).alias("norm")).agg(F.min("path").alias("whole"), F.count("*").alias("n")).where("n = 1").drop("n")
    names = pages.groupBy(normal_target(stem(F.col("path"))).alias("norm")).agg(F.min("path").alias("named"), F.count("*").alias("n")).where("n = 1").drop("n")
    return links.join(exact, "bare", "left").join(whole, "norm", "left").join(names, "norm", "left").select("path", "target", F.coalesce("exact", "whole", "named").alias("to"))


def hrefs(pages: DataFrame) -> DataFrame:
    """``(page_id, href)`` of anchors in raw HTML, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("ord", "href"))


def interned(rows: DataFrame, key: str, order: str, least_chars: int) -> DataFrame:
    """Values met more than once and longer than ``least_chars``, labelled ``c1`` … in order of first use; ``order`` is a unique number."""
    often = rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("uses")).where((F.col("uses") > 1) & (F.length(key) > least_chars))
    return numbered(often, "first").withColumn("label", F.concat(F.lit("c"), F.col("place").cast("string"))).drop("place")
