"""URL filters by a sort-merge range join.

A host is turned around label by label (``blog.example.com`` gives
``com.example.blog.``), so a rule for a host and its subdomains is an interval
of the sorted keys, and intervals nest or lie apart.  Addresses and rules are
dealt into ranges of keys; each range is swept in key order with a stack of the
rules that are open there.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, partitions

#: Rows from which the bounds of the ranges are taken, for each range.
BOUND_ROWS = 32
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def _turned(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


def _sweep(default: str):
    def run(parts):
        stack: list[tuple[str, str, dict, list[int]]] = []  # end of the interval, host, path -> action, lengths
        bucket = None
        for part in parts:
            out = []
            for b, key, kind, pid, host, path, action in zip(*(part[c] for c in ("bucket", "key", "kind", "page_id", "host", "path", "action")), strict=True):
                if b != bucket:
                    stack.clear()
                    bucket = b
                while stack and key >= stack[-1][0]:
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][1] != host:
                        stack.append((key[:-1] + "/", host, {}, []))
                    known, lengths = stack[-1][2:]
                    # the same rule twice with both actions blocks
                    known[path] = "block" if known.get(path, action) != action else action
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, h, known, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and path[:n] in known:
                            if best is None or len(h) + n >= best[0]:
                                best = (len(h) + n, h + path[:n], known[path[:n]])
                            break
                out.append((pid, host, path, best and best[1], best[2] if best else default))
            if out:
                yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])

    return run


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules(action, host, path)``: a rule fits its host and all subdomains where
    the address's path starts with its path; the longest (host and path
    together, then the longer host) wins.  The verdict is its action, or
    ``default`` where none fits; ``rule`` is null then.

    A null address, or one without ``://``, has an empty host and path and fits
    no rule.  Ids may be null or repeat: each row gets its verdict.  Rules with a
    null or empty host are dropped, a null path counts as empty; the same rule
    with both actions blocks.  An empty table of rules gives ``default``
    everywhere.  Only the named columns are read.
    """
    spark = pages.sparkSession
    width = partitions(spark)
    asked = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    asked = asked.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", "\\.")), "."), F.lit("."), F.col("path"))).withColumn("salt", F.rand(11))
    # Bounds of the ranges, of a number of rows that depends on the number of ranges alone.
    drawn = sorted((r["key"], r["salt"]) for r in asked.select("key", "salt").orderBy("salt").limit(BOUND_ROWS * width).collect())
    ranges = 4 * width
    bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in zip(key, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def buckets_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(bounds, (x, -1.0)), bisect_left(bounds, (x[:-1] + "/", -1.0)) + 1)) for x in key])

    listed = rules.select(F.col("action"), ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host != '' and action is not null")
    listed = listed.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", "\\.")), "."), F.lit(".")))
    null = F.lit(None)
    events = asked.select(bucket_of("key", "salt").alias("bucket"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", null.cast("string").alias("action")).unionByName(
        listed.select(F.explode(buckets_of("key")).alias("bucket"), "key", F.lit(0).alias("kind"), null.cast("long").alias("page_id"), "host", "path", "action")
    )
    swept = events.repartition(width, "bucket").sortWithinPartitions("bucket", "key", "kind").withColumn("page_id", F.col("page_id").cast("string"))
    return swept.mapInPandas(_sweep(default), "page_id string, host string, path string, rule string, verdict string").withColumn("page_id", F.col("page_id").cast("long"))
