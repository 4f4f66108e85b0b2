"""Reachability and components by fixpoint rounds of joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; one of this machine only where that is unset and the master local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="rounds-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Written to the folder that all executors share, so that rounds don't pile up."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(roots: DataFrame, refs: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """``(id)`` reached from ``roots(id)`` along ``refs(src, dst)``; weak roots are added at the end and not followed."""
    seen = kept(roots.select("id").distinct())
    frontier = seen
    while True:
        step = frontier.join(refs, frontier.id == refs.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = kept(step)
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen if weak is None else seen.unionByName(weak.select("id")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)``: least id of each component of ``edges(a, b)``, by least labels and pointer jumps."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        labels = kept(low.join(up, "low", "left").select("id", "old", F.least("low", F.coalesce("up", "low")).alias("label")))
        if labels.where("label != old").limit(1).count() == 0:
            return labels.select("id", "label")
        labels = labels.select("id", "label")
