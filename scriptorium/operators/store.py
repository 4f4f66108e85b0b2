"""Versioned documents, differences, lookup and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import document_stem


def versions(intake: DataFrame) -> DataFrame:
    """``(origin, ord, input_key, revision, is_new)`` of ``intake(origin, ord, input_key)``: a key equal to the one before gives no new version."""
    by = Window.partitionBy("origin").orderBy("ord")
    changed = F.coalesce(F.lag("input_key").over(by) != F.col("input_key"), F.lit(True))
    return intake.withColumn("is_new", changed).withColumn("revision", F.sum(F.col("is_new").cast("int")).over(by).cast("long"))


def shared_analysis(units: DataFrame, key: Column) -> DataFrame:
    """Each unit with the first unit of equal meaning, so that work is done once."""
    keyed = units.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("uses"))
    return keyed.join(first, "key").select("doc_id", "key", "first_id", "uses")


def document_names(files: DataFrame) -> DataFrame:
    """Stable names of ``files(path, stem, ord)``: the clean stem for the first that has it, else with the path's hash."""
    clean = files.withColumn("clean", document_stem(F.col("stem")))
    first = F.row_number().over(Window.partitionBy("clean").orderBy("ord"))
    return clean.withColumn("k", first).select("path", F.when(F.col("k") == 1, F.col("clean")).otherwise(F.concat("clean", F.lit("-"), F.substring(F.sha2("path", 256), 1, 8))).alias("name"))


def proposal(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)`` of two tables ``(path, digest)``."""
    b, a = before.select("path", F.col("digest").alias("old")), after.select("path", F.col("digest").alias("new"))
    joined = b.join(a, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return joined.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("changed").alias("change"))


def lookup(registry: DataFrame, identifier: str) -> DataFrame:
    """Rows of ``registry(hash, name, doc_name)`` in the first bucket that has any: hash, name, document name, part of a name."""
    low = identifier.lower()
    bucket = F.when(F.col("hash") == identifier, 1).when(F.col("name") == identifier, 2).when(F.col("doc_name") == identifier, 3).when(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("doc_name"), F.lit(low)), 4)
    found = registry.withColumn("bucket", bucket).where("bucket is not null")
    least = found.agg(F.min("bucket").alias("bucket"))
    return found.join(F.broadcast(least), "bucket")


def reconcile(expected: DataFrame, received: DataFrame) -> DataFrame:
    """``(id, problem)``: ids that are missing, unexpected or received more than once."""
    e = expected.select("id", F.lit(True).alias("wanted")).distinct()
    r = received.groupBy("id").agg(F.count("*").alias("n"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return e.join(r, "id", "full_outer").select("id", problem.alias("problem")).where("problem is not null")


def layered_config(keys: DataFrame) -> DataFrame:
    """``keys(key, base, site, own)``: the last layer with a value and its name."""
    return keys.select("key", F.coalesce("own", "site", "base").alias("value"), F.when(F.col("own").isNotNull(), "own").when(F.col("site").isNotNull(), "site").otherwise("base").alias("layer"))


def merge_patch(base: Column, patch: Column) -> Column:
    """Map merge: absent keys stay, null removes, other values replace."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, F.map_filter(patch, lambda k, v: v.isNotNull()))
