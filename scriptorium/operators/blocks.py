"""Ordered blocks of documents, and windows over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType


@F.pandas_udf(ArrayType(LongType()))
def _starts(sizes: pd.Series) -> pd.Series:
    """Where each of the lines of these sizes begins."""
    return sizes.map(lambda n: None if n is None else np.cumsum(n, dtype=np.int64) - n)


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ord, text, start, end)``: each line as a block with its place in code points.

    Places are summed within the row, so nothing is shuffled; only the sizes of
    lines leave the JVM for that, not the texts.  A null text has no lines; an
    empty one has one empty line.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("whole")).where("whole is not null")
    rows = F.split("whole", "\n", -1)
    zipped = F.arrays_zip(rows.alias("text"), _starts(F.transform(rows, lambda r: F.length(r) + 1)).alias("start"))
    lines = whole.select("doc_id", F.posexplode(zipped).alias("ord", "x"))
    return lines.select("doc_id", "ord", "x.text", "x.start", (F.col("x.start") + F.length("x.text")).alias("end"))


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ord, kind, line, text)``: headings alone, fenced code whole, paragraphs up to a blank line."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("i", "row"))
    by = Window.partitionBy("doc_id").orderBy("i")
    lines = lines.withColumn("mark", F.rlike("row", F.lit(r"^\s*(```|~~~)")).cast("int"))
    lines = lines.withColumn("fences", F.sum("mark").over(by)).withColumn("code", ((F.col("fences") % 2 == 1) | (F.col("mark") == 1)))
    lines = lines.withColumn("head", ~F.col("code") & F.rlike("row", F.lit(r"^#{1,6}\s"))).withColumn("blank", ~F.col("code") & (F.trim("row") == ""))
    before = lambda c: F.coalesce(F.lag(c).over(by), F.lit(False))
    cut = F.col("head") | F.col("blank") | before("head") | before("blank") | (F.col("code") != before("code")) | ((F.col("mark") == 1) & (F.col("fences") % 2 == 1))
    grouped = lines.withColumn("part", F.sum(cut.cast("int")).over(by)).where(~F.col("blank"))
    parts = grouped.groupBy("doc_id", "part").agg(F.min("i").alias("line"), F.max("head").alias("head"), F.max("code").alias("code"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]), "\n").alias("text"))
    kind = F.when(F.col("head"), "heading").when(F.col("code"), "code").otherwise("paragraph")
    return parts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1).alias("ord"), kind.alias("kind"), (F.col("line") + 1).alias("line"), "text")


def repetition(lines: DataFrame, widths=range(1, 9), repeats: int = 32, chars: int = 1024) -> DataFrame:
    """``(doc_id, width)`` with aligned runs of equal chunks of ``width`` lines, at least ``repeats`` of them and ``chars`` characters.

    Lines are gathered once; every width is read off the same array of hashes
    and lengths.
    """

    @F.pandas_udf("array<int>")
    def found(rows: pd.Series, sizes: pd.Series) -> pd.Series:
        def hits(h, n):
            out = []
            for w in widths:
                whole = len(h) // w
                if whole < repeats:
                    continue
                chunks = h[: whole * w].reshape(whole, w)
                size = n[: whole * w].reshape(whole, w).sum(1)
                fresh = np.r_[True, (chunks[1:] != chunks[:-1]).any(1)]
                run = np.cumsum(fresh) - 1
                if ((np.bincount(run) >= repeats) & (np.bincount(run, size) >= chars)).any():
                    out.append(w)
            return out

        return pd.Series([hits(h, n) for h, n in zip(rows, sizes, strict=True)])

    gathered = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.xxhash64("text").alias("h"), (F.length("text") + 1).cast("long").alias("n")))).alias("rows"))
    return gathered.select("doc_id", F.explode(found(F.col("rows.h"), F.col("rows.n"))).alias("width"))


def budget_read(blocks: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """Blocks of each document until the budget is spent; the block that spends it is cut: ``taken`` characters and the cursor ``resume``."""
    cost = F.length("text") if cost is None else cost
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = blocks.withColumn("cost", cost.cast("long")).withColumn("spent", F.coalesce(F.sum("cost").over(before), F.lit(0)))
    read = spent.where(F.col("spent") < budget).withColumn("taken", F.least("cost", F.lit(budget) - F.col("spent")))
    return read.withColumn("resume", F.when(F.col("taken") < F.col("cost"), F.col("taken")))


def navigation_nodes(blocks: DataFrame, boundary: Column) -> DataFrame:
    """``(doc_id, node, start, end)``: a node at the first block and at each boundary, up to the next one."""
    by = Window.partitionBy("doc_id").orderBy("ord")
    total = blocks.groupBy("doc_id").agg((F.max("ord") + 1).alias("total"))
    starts = blocks.where((F.col("ord") == 0) | boundary).select("doc_id", "ord").join(total, "doc_id")
    return starts.select("doc_id", F.row_number().over(by).alias("node"), F.col("ord").alias("start"), F.coalesce(F.lead("ord").over(by), "total").alias("end"))


def node_of_block(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The deepest (last) node that holds each block of ``(doc_id, ord)``, found by a sweep over starts and blocks, not by pairs.

    Nodes ``(doc_id, node, start, end)`` nest or follow one another, as those of
    a tree do, so the last one to begin at or before a block holds it, or one
    of its ancestors does.  Blocks outside all nodes are left out.
    """
    none = F.lit(None)
    marks = blocks.select("doc_id", "ord", F.lit(1).alias("side"), none.cast("int").alias("node"), none.cast("int").alias("end"))
    starts = nodes.select("doc_id", F.col("start").alias("ord"), F.lit(0).alias("side"), F.col("node").cast("int").alias("node"), F.col("end").cast("int").alias("end"))
    by = Window.partitionBy("doc_id").orderBy("ord", "side", "node")
    swept = starts.unionByName(marks).withColumn("last", F.last(F.when(F.col("side") == 0, F.struct("node", "end")), ignorenulls=True).over(by))
    met = swept.where("side = 1")
    direct = met.where("ord < last.end").select("doc_id", "ord", F.col("last.node").alias("node"))
    # Blocks past the end of the last node lie in one of the nodes around it: only these are held against ranges.
    late = met.where("last is not null and ord >= last.end").select("doc_id", "ord")
    n = nodes.select(F.col("doc_id").alias("d"), "node", F.col("start").alias("s"), F.col("end").alias("e"))
    around = late.join(n, (late.doc_id == n.d) & (late.ord >= n.s) & (late.ord < n.e)).groupBy("doc_id", "ord").agg(F.max("node").cast("int").alias("node"))
    return direct.unionByName(around)


@F.pandas_udf(ArrayType(IntegerType()))
def _fill(costs: pd.Series, limit: pd.Series) -> pd.Series:
    """The batch of each cost in order: a new one where the sum would pass the limit."""

    def batches(row, most):
        out, total, batch = np.zeros(len(row), np.int32), 0, 0
        for i, c in enumerate(row.tolist()):
            if total and total + c > most:
                total, batch = 0, batch + 1
            total += c
            out[i] = batch
        return out

    return pd.Series([batches(r, m) for r, m in zip(costs, limit, strict=True)])


def greedy_batches(units: DataFrame, limit: int, cost: Column) -> DataFrame:
    """``(doc_id, ord, batch)``: units in order, a new batch where the next would pass the limit. Greedy, so folded in order."""
    ordered = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", cost.cast("long").alias("cost")))).alias("units"))
    filled = ordered.select("doc_id", F.arrays_zip(F.col("units.ord").alias("ord"), _fill(F.col("units.cost"), F.lit(limit).cast("long")).alias("batch")).alias("units"))
    return filled.select("doc_id", F.explode("units").alias("x")).select("doc_id", "x.ord", "x.batch")
