"""Accounting of requests and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage_totals(requests: DataFrame, key: str) -> DataFrame:
    """Sums by ``key`` of ``requests(used, reserved)``; an unknown use is charged at what was reserved."""
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.count_if(F.col("used").isNull()).alias("unknown"), F.round(F.sum(F.coalesce("used", "reserved")), 4).alias("charged"))


def unreported(requests: DataFrame, reported: DataFrame) -> DataFrame:
    """By journal: charge of requests whose id isn't in ``reported(request_id)``; the journal's run counts only if none of its ids was reported."""
    marked = requests.join(reported.select("request_id", F.lit(True).alias("seen")).distinct(), "request_id", "left")
    return marked.groupBy("journal").agg(F.count_if(F.col("seen").isNull()).alias("requests"), F.round(F.sum(F.when(F.col("seen").isNull(), F.coalesce("used", "reserved")).otherwise(0.0)), 4).alias("charged"), F.when(F.bool_or(F.coalesce("seen", F.lit(False))), 0).otherwise(1).alias("runs"))


def peak_concurrency(spans: DataFrame, key: str) -> DataFrame:
    """Most spans ``(begin, end)`` open at once by ``key``; one that ends frees its place first."""
    steps = spans.select(key, F.col("begin").alias("at"), F.lit(1).alias("d")).unionByName(spans.select(key, F.col("end").alias("at"), F.lit(-1).alias("d")))
    moments = steps.groupBy(key, "at").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("d")).otherwise(0)).alias("down"))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("at"))
    return moments.withColumn("open", running).groupBy(key).agg(F.max("open").cast("long").alias("peak"))


def rates(verdicts: DataFrame, key: str) -> DataFrame:
    """Pass rate by ``key`` of ``verdicts(passed)``: unknown verdicts leave the denominator; 0 if none is known."""
    scored, passed = F.count_if(F.col("passed").isNotNull()), F.count_if(F.col("passed"))
    return verdicts.groupBy(key).agg(F.count("*").alias("total"), scored.alias("scored"), F.round(F.coalesce(F.try_divide(passed, scored), F.lit(0.0)), 6).alias("rate"))


def budget_ledger(requests: DataFrame, key: str, order: str, limit: float) -> DataFrame:
    """Running charge by ``key`` and whether each request was within the limit before it began."""
    by = Window.partitionBy(key).orderBy(order)
    charge = F.coalesce("used", "reserved")
    before = F.coalesce(F.sum(charge).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return requests.withColumn("spent", F.round(before, 4)).withColumn("admitted", F.col("spent") + F.col("reserved") <= limit)
