"""Literal search, pagination and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import folded


def literal_hits(blocks: DataFrame, literal: str, fold=folded) -> DataFrame:
    """Every block whose folded text holds the folded literal, with the place of its first occurrence (folded code points from 0)."""
    wanted = literal.casefold()
    folded = fold(F.col("text"))
    return blocks.withColumn("at", F.instr(folded, wanted).cast("long") - 1).where("at >= 0")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in a total order, with the total and the next offset (null at the end)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    return cut.join(F.broadcast(total)).withColumn("next_offset", F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit).cast("long")))


def sessions(turns: DataFrame, title: Column) -> DataFrame:
    """``(conv_id, n_turns, last_turn, title)``: title of the first user turn."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.min_by(title, F.when(F.col("role") == "user", F.col("turn"))).alias("title"))


def resolve_prefix(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each ``prefixes(prefix)``: how many ``ids(id)`` it begins, and the id where it is exact or unique.

    Ids are cut to the lengths that prefixes have (which are few) and joined by equality.
    """
    sizes = prefixes.select(F.length("prefix").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("sizes"))
    cut = ids.join(F.broadcast(sizes)).select("id", F.explode(F.filter("sizes", lambda n: n <= F.length("id"))).alias("n"))
    met = prefixes.distinct().join(cut.select("id", F.expr("substring(id, 1, n)").alias("prefix")), "prefix", "left")
    found = met.groupBy("prefix").agg(F.count("id").alias("n"), F.min("id").alias("least"), F.max((F.col("id") == F.col("prefix")).cast("int")).alias("exact"))
    return found.select("prefix", "n", F.when(F.col("exact") == 1, F.col("prefix")).when(F.col("n") == 1, F.col("least")).alias("resolved"))
