"""Streams of file events: debounced flushes, a ring buffer and first claims.

A debounce timer is processing time; here sessions of event time take its place,
which gives the same sets for any replay of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, gap: str, key: str, at: str = "ts", delay: str | None = None) -> DataFrame:
    """Per ``key`` one row for each run of events with less than ``gap`` between them; sorted distinct paths. ``delay`` sets the watermark of a stream.

    A stream uses session windows.  A table is dealt by key and windows of the
    length ``gap``: events of one window always belong together, so only the
    windows of a key, not its events, are put in order.  Rows without a time take no part.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed if delay is None else timed.withWatermark(at, delay)
        return timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "events", "paths")
    length = F.expr(f"INTERVAL {gap}")
    dealt = timed.groupBy(F.col(key).alias("_key"), F.window(at, gap).alias("_w"), "path").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).select("_key", F.col("_w.start").alias("_bin"), "path", "n", "first", "last")
    by = Window.partitionBy("_key").orderBy("_bin")
    bins = dealt.groupBy("_key", "_bin").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    fresh = F.coalesce(F.col("first") >= F.lag("last").over(by) + length, F.lit(True))
    runs = bins.withColumn("_fresh", F.when(fresh, F.col("first"))).select(F.col("_key").alias("_k"), F.col("_bin").alias("_b"), F.last("_fresh", ignorenulls=True).over(by).alias("begin"))
    named = dealt.join(runs, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b")))
    once = named.groupBy("_key", "begin", "path").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return once.groupBy("_key", "begin").agg((F.max("last") + length).alias("finish"), F.sum("n").alias("events"), F.array_sort(F.collect_set("path")).alias("paths")).select(F.col("_key").alias(key), "begin", "finish", "events", "paths")


def ring_buffer(events: DataFrame, key: str, order: str, size: int = 200) -> DataFrame:
    """The last ``size`` events of each key, with the number ``seq`` that each got when it came, from 1 (batch form of ``stateful.numbered_stream``)."""
    by = Window.partitionBy(key)
    numbered = events.withColumn("seq", F.row_number().over(by.orderBy(order)).cast("long")).withColumn("_n", F.count("*").over(by))
    return numbered.where(F.col("seq") > F.col("_n") - size).drop("_n")


def first_claims(requests: DataFrame, key: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Stream of requests without repeats of ``key`` within the watermark: the first claimant computes."""
    return requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def replay(events: DataFrame, key: str, order: str, since: int, most: int) -> DataFrame:
    """The first ``most`` kept events of each key from the number ``since`` on, or from the oldest kept if it has gone."""
    first = F.greatest(F.lit(since), F.min("seq").over(Window.partitionBy(key)))
    rows = ring_buffer(events, key, order).withColumn("_first", first)
    return rows.where((F.col("seq") >= F.col("_first")) & (F.col("seq") < F.col("_first") + most)).drop("_first")


def settled(stamps: DataFrame, digests: DataFrame, now, debounce: float, at: str = "at") -> DataFrame:
    """``(path, stamp, digest)``: files whose newest stamp has stood for ``debounce`` seconds and whose content is new.

    ``stamps(path, at, stamp, digest)`` are the observations so far,
    ``digests(digest)`` the contents already taken; of files with one content
    the least path is taken.
    """
    by = Window.partitionBy("path").orderBy(at)
    moved = stamps.withColumn("_new", ~F.lag("stamp").over(by).eqNullSafe(F.col("stamp")))
    last = moved.groupBy("path").agg(F.max_by(F.struct("stamp", "digest"), at).alias("l"), F.max(F.when(F.col("_new"), F.col(at))).alias("since"))
    stable = last.where(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")) >= debounce)
    fresh = stable.select("path", "l.stamp", "l.digest").join(digests.select("digest").distinct(), "digest", "left_anti")
    first = fresh.groupBy("digest").agg(F.min_by(F.struct("path", "stamp"), "path").alias("f"))
    return first.select("f.path", "f.stamp", "digest")


def submissions(requests: DataFrame) -> DataFrame:
    """``(task, seq, verdict)`` of ``requests(task, seq, binding)`` in order: accepted first, the same binding again is repeated, another one is refused."""
    first = requests.groupBy("task").agg(F.min_by(F.struct("seq", "binding"), "seq").alias("f"))
    seen = requests.join(first, "task")
    verdict = F.when(F.col("seq") == F.col("f.seq"), "accepted").when(F.col("binding").eqNullSafe(F.col("f.binding")), "repeated").otherwise("refused")
    return seen.select("task", "seq", verdict.alias("verdict"))


def queue_places(tasks: DataFrame, key: str, order: str, running: int) -> DataFrame:
    """``tasks`` with ``state``: the first ``running`` of each key run, the others queue with their ``place``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return tasks.withColumn("_k", place).withColumn("state", F.when(F.col("_k") <= running, "running").otherwise("queued")).withColumn("place", F.when(F.col("_k") > running, F.col("_k") - running)).drop("_k")


def log_tail(files: DataFrame, limit: int) -> DataFrame:
    """``(task, text)``: the last ``limit`` bytes of numbered log files ``(task, number, content)``, newest file first, put together in order.

    A character that the cut splits is dropped.
    """
    back = Window.partitionBy("task").orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    raw = F.col("content").cast("binary")
    read = files.withColumn("_after", F.coalesce(F.sum(F.octet_length(raw)).over(back), F.lit(0))).where(F.col("_after") < limit)
    size = F.least(F.octet_length(raw), (F.lit(limit) - F.col("_after")).cast("int"))
    cut = read.withColumn("_part", F.substring(raw, F.octet_length(raw) - size + 1, size))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.hex("_part").alias("h")))), lambda x: x["h"]), "")
    tail = cut.groupBy("task").agg(whole.alias("h"))
    return tail.select("task", F.decode(F.unhex(F.regexp_replace("h", "^(?:[89AB][0-9A-F]){1,3}", "")), "UTF-8").alias("text"))


def recorded_turns(turns: DataFrame) -> DataFrame:
    """``turns(session, at, seq, role, text)`` with their ``turn`` from 0, repeated sequence numbers taken once."""
    once = turns.dropDuplicates(["session", "seq"])
    return once.withColumn("turn", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1)
