"""Runs in ordered rows, removal plans and checks of cited targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import graph


def longest_runs(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """``(key, kinds, longest)``: distinct kinds and the longest run of one kind. A blank kind breaks runs and never extends one."""
    by = Window.partitionBy(key).orderBy(order)
    same = (F.col(kind) == F.lag(kind).over(by)) & (F.col(kind) != "")
    marked = rows.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(by))
    runs = marked.groupBy(key, "run").agg(F.count("*").alias("n"))
    kinds = rows.where((F.col(kind) != "")).groupBy(key).agg(F.countDistinct(kind).alias("kinds"))
    return runs.groupBy(key).agg(F.max("n").alias("longest")).join(kinds, key, "left").select(key, F.coalesce("kinds", F.lit(0)).alias("kinds"), "longest")


def removal_plan(pages: DataFrame, marker: Column) -> DataFrame:
    """``(path, action)`` of ``pages(path, sources)``: delete where the document is the last source, modify where others stay, else keep."""
    held = F.array_contains("sources", marker)
    rest = F.size(F.array_remove("sources", marker))
    return pages.select("path", F.when(~held, "KEEP").when(rest == 0, "DELETE").otherwise("MODIFY").alias("action"))


def unseen_targets(cited: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of ``cited(answer, target)`` whose target was not observed for that answer."""
    return cited.distinct().join(observed.select("answer", "target").distinct(), ["answer", "target"], "left_anti")


def tail_within(rows: DataFrame, key: str, order: str, cost: Column, limit: int) -> DataFrame:
    """The newest rows of each key whose costs together stay within ``limit``, the newest always."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    total = F.sum(cost.cast("long")).over(back)
    return rows.withColumn("total", total).withColumn("place", F.row_number().over(back)).where((F.col("total") <= limit) | (F.col("place") == 1)).drop("total", "place")


def preceding_while(rows: DataFrame, key: str, order: str, fits: Column, cost: Column, limit: int) -> DataFrame:
    """From the newest row backwards as long as every row fits and the running cost stays within ``limit``."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    marked = rows.withColumn("ok", F.bool_and(fits).over(back)).withColumn("spent", F.sum(cost.cast("long")).over(back))
    return marked.where(F.col("ok") & (F.col("spent") <= limit)).drop("ok", "spent")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``place``, 1 and up by ``order`` over the whole table; rows with a null order come last, equal ones in any order.

    Rows are sorted in ranges, also those of one value, and written; a row's
    place in its range moves up by the sizes of the ranges before it, of which there
    are as many as shuffle partitions.
    """
    spark = rows.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.asc_nulls_last(order), F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    held = graph.kept(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of the number are the range, the lower 33 the place in it.
    parted = held.withColumn("_part", F.shiftright("_at", 33)).withColumn("_own", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select("_part", before.alias("_before"))
    return parted.join(F.broadcast(moved), "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_own", "_at", "_before")
