"""Queries that run a stream over the event files and read what it has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.plans.registry import query
from scriptorium.streaming import stateful

#: The streams wait so long for late events; six hours without another stamp settle a file.
DELAY, DELAY_MS, SETTLED_MS = "1 hour", 3_600_000, 6 * 3_600_000


def _files(e):
    """Each user is a file, a kind of event its stamp, the whole part of the value its content."""
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts", F.col("event_type").alias("stamp"), F.pmod(F.floor("value"), F.lit(3)).cast("string").alias("digest"))


@query(f"""
WITH e AS (SELECT 'u' || user_id AS path, epoch_us(ts) // 1000 AS ms, event_type AS stamp, CAST(((CAST(floor(value) AS BIGINT) % 3) + 3) % 3 AS VARCHAR) AS digest FROM events),
m AS (SELECT max(ms) - {DELAY_MS} AS mark FROM e),
r AS (SELECT *, stamp IS DISTINCT FROM lag(stamp) OVER (PARTITION BY path ORDER BY ms, stamp || chr(31) || digest) AS fresh FROM e WHERE ms <= (SELECT mark FROM m)),
b AS (SELECT path, stamp, digest, ms AS since, lead(ms) OVER (PARTITION BY path ORDER BY ms, stamp || chr(31) || digest) AS next FROM r WHERE fresh),
s AS (SELECT path, stamp, digest, since + {SETTLED_MS} AS settled_ms FROM b, m WHERE since + {SETTLED_MS} < coalesce(next, mark + 1)),
t AS (SELECT *, digest IS DISTINCT FROM lag(digest) OVER (PARTITION BY path ORDER BY settled_ms) AS told FROM s)
SELECT path, stamp, digest, settled_ms FROM t WHERE told
""")
def settled_stream(spark, d):
    """Files that have settled, told by timers on the state of each path."""
    return stateful.drained(spark, stateful.file_stream(spark, f"{d}/events.parquet", lambda e: stateful.settled_stream(_files(e), SETTLED_MS, DELAY)))


@query(f"""
WITH e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS at_ms, CAST(event_id AS VARCHAR) AS event FROM events),
n AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY at_ms, event) AS seq, count(*) OVER (PARTITION BY key) AS n, event, at_ms FROM e WHERE at_ms <= (SELECT max(at_ms) - {DELAY_MS} FROM e))
SELECT key, seq, event, at_ms FROM n WHERE seq >= greatest(40, n - 199) AND seq < greatest(40, n - 199) + 30
""")
def replayed_stream(spark, d):
    """Thirty events of each kind from number 40 on, or from the oldest of the last 200 (the bound is the feature); numbers stay as events come."""
    numbered = stateful.drained(spark, stateful.file_stream(spark, f"{d}/events.parquet", lambda e: stateful.numbered_stream(e, "event_type", "event_id", DELAY)))
    return stateful.replayed(numbered, 40, 30, 200)


@query()
def task_stream(spark, d):
    """Each user's queue of tasks with two running: every third event ends a task, the others submit them; a plain machine says the same in the tests."""

    def commands(e):
        task = F.concat_ws("-", F.col("user_id").cast("string"), F.pmod(F.floor("value"), F.lit(40)).cast("string"))
        return e.select(F.col("user_id").cast("string").alias("queue"), "ts", F.col("event_id").alias("id"), task.alias("task"), F.when(F.pmod("event_id", F.lit(3)) == 0, "end").otherwise("submit").alias("command"), F.col("event_type").alias("binding"))

    return stateful.drained(spark, stateful.file_stream(spark, f"{d}/events.parquet", lambda e: stateful.task_stream(commands(e), 2, DELAY)))
