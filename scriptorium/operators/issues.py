"""What is left open of a source, with the places to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.coverage import overlaps

_ROW = ["source_id", "reason", "stage", "item", "block", "start", "end"]


def source_issues(pending: DataFrame, omissions: DataFrame, topics: DataFrame, members: DataFrame, assets: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """``(source_id, reason, stage, item, block, start, end)``: every omission, open range, image and parsing fault.

    * ``pending(source_id, block, start, end, reason)``: the open ranges; those of a block don't overlap.
    * ``omissions(source_id, stage, reason, item)``: what was left out.  An item of stage ``facts`` is a block, whose
      open ranges it gets whole; one of ``generation`` is a target of ``members(source_id, target, topic)``; any
      other is the id of a topic.  ``topics(source_id, topic, topic_id, block, start, end)`` has the places of
      a topic, and an item gets the parts of open ranges that lie in them, each once.
    * ``assets(source_id, asset, block, chars, transcription, understanding)`` that are pending in either, and
      ``quality(source_id, reason)``, a fault without a place.

    An omission without an open place stays, with nulls.  An open range stays for itself unless some omission has
    exactly that range.  Equal omissions count once; so do equal open ranges, topics and members.  Rows with a null
    source or item have no places.  Blocks are strings.
    """
    block = F.col("block").cast("string").alias("block")
    start, end = F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")
    open_ = pending.select("source_id", block, start, end, F.col("reason").alias("open_reason")).distinct()
    left_out = omissions.select("source_id", "stage", "reason", F.col("item").cast("string").alias("item")).distinct()
    placed = topics.select("source_id", "topic", "topic_id", block, start, end).distinct()

    by_id = placed.select("source_id", F.lit(False).alias("made"), F.col("topic_id").alias("item"), "block", "start", "end")
    by_target = placed.join(members.select("source_id", "target", "topic").distinct(), ["source_id", "topic"]).select("source_id", F.lit(True).alias("made"), F.col("target").alias("item"), "block", "start", "end")
    asked = left_out.withColumn("made", F.col("stage") == "generation")
    # Places of a topic are met with open ranges before the omissions multiply them.
    wanted = by_id.unionByName(by_target).distinct().join(asked.select("source_id", "made", "item").distinct(), ["source_id", "made", "item"], "left_semi")
    parts = overlaps(wanted, open_.select("source_id", "block", "start", "end"), ["source_id", "block"]).select("source_id", "made", "item", "block", "start", "end").distinct()
    cut = asked.join(parts, ["source_id", "made", "item"]).select(*_ROW)
    whole = left_out.where("stage = 'facts'").join(open_.select("source_id", F.col("block").alias("item"), "block", "start", "end"), ["source_id", "item"]).select(*_ROW)
    found = cut.unionByName(whole).distinct()

    keys = ["source_id", "stage", "reason", "item"]
    some = found.select(*keys).distinct()
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    bare = left_out.alias("o").join(some.alias("s"), same, "left_anti")
    rest = open_.join(found.select("source_id", "block", "start", "end").distinct(), ["source_id", "block", "start", "end"], "left_anti")
    nothing, nowhere = F.lit(""), [F.lit(None).cast(t).alias(c) for c, t in (("block", "string"), ("start", "long"), ("end", "long"))]
    rows = found.unionByName(bare.select("source_id", "reason", "stage", "item", *nowhere)).unionByName(rest.select("source_id", F.col("open_reason").alias("reason"), nothing.alias("stage"), nothing.alias("item"), "block", "start", "end"))
    if assets is not None:
        unread, unclear = F.col("transcription") == "pending", F.col("understanding") == "pending"
        reason = F.when(unread, "image_content_requires_ocr").otherwise("image_understanding_pending")
        rows = rows.unionByName(assets.where(unread | unclear).select("source_id", reason.alias("reason"), F.lit("parsing").alias("stage"), F.col("asset").alias("item"), block, F.lit(0).cast("long").alias("start"), F.col("chars").cast("long").alias("end")))
    if quality is not None:
        rows = rows.unionByName(quality.select("source_id", F.coalesce("reason", F.lit("quality_incomplete")).alias("reason"), F.lit("parsing").alias("stage"), nothing.alias("item"), *nowhere))
    return rows
