"""Links and citations rewritten in place: scanned to rows, joined with what is known, spliced back.

A text is scanned once for each distinct content, so repeated rows and rows without
an id get the same edits; every character outside an edit stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.markdown import EDITS, markdown_spans, spliced
from scriptorium.functions.text import normal_target, short_citation


def span_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(key, kind, start, end, target, label, title, cell)`` of the distinct texts, ``key`` being a text's SHA-256."""
    once = docs.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("key")).agg(F.any_value(text).alias("_text"))
    return once.select("key", F.explode(markdown_spans(F.col("_text"))).alias("s")).select("key", "s.*")


def _barred(value: Column) -> Column:
    """A value for a cell of a table keeps its bars behind backslashes."""
    return F.when(F.col("cell"), F.replace(value, F.lit("|"), F.lit("\\|"))).otherwise(value)


def _edited(docs: DataFrame, edits: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``new_text`` and ``faults`` from ``edits(key, start, end, value, fault)``."""
    by_key = edits.groupBy("key").agg(
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col("start"), F.col("end"), F.col("value")))).alias("_edits"),
        F.array_sort(F.collect_set("fault")).alias("_faults"),
    )
    met = docs.withColumn("_key", F.sha2(text, 256)).join(by_key.withColumnRenamed("key", "_key"), "_key", "left")
    none = F.array().cast("array<string>")
    made = met.withColumn("new_text", spliced(F.col(text), F.coalesce("_edits", F.array()).cast(EDITS))).withColumn("faults", F.coalesce("_faults", none))
    return made.drop("_key", "_edits", "_faults")


def normalized_links(docs: DataFrame, targets: DataFrame, assets: DataFrame, links_only: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with ``new_text`` and ``faults``: wiki links and images outside code brought to what there is.

    A wiki link to a ``targets(target)`` stays; one whose normal form a target has gets
    that target; others become their alias, or the last part of their name as
    words.  An image must name one of ``assets(id, path)`` by ``asset:id`` or by path:
    it gets the path, as a link if the path ends in ``.bin``; any other is a fault and stays.
    A null text stays null; an empty ``targets`` turns all wiki links to words.
    """
    spans = span_rows(docs, text)
    wiki = spans.where("kind = 'wiki'")
    named = wiki.select("target").distinct().join(targets.select("target", F.lit(True).alias("live")).distinct(), "target", "left").where("live is null").drop("live")
    normal = targets.groupBy(normal_target(F.col("target")).alias("norm")).agg(F.max("target").alias("to"))
    dead = named.withColumn("norm", normal_target(F.col("target"))).join(normal, "norm", "left").select("target", "to")
    words = F.translate(F.element_at(F.split("target", "/"), -1), "-_", "  ")
    alias = F.nullif(F.col("label"), F.lit(""))
    link = F.concat(F.lit("[["), F.col("to"), F.coalesce(F.concat(F.lit("|"), alias), F.lit("")), F.lit("]]"))
    no_fault = F.lit(None).cast("string").alias("fault")
    edits = wiki.join(dead, "target").select("key", "start", "end", _barred(F.coalesce(link, alias, words)).alias("value"), no_fault)
    if not links_only:
        images = spans.where("kind = 'image'").withColumn("_id", F.when(F.startswith("target", F.lit("asset:")), F.substr("target", F.lit(7))))
        ids = assets.select(F.col("id").alias("_id"), F.col("path").alias("_by_id")).distinct()
        paths = assets.select(F.col("path").alias("target"), F.col("path").alias("_by_path")).distinct()
        met = images.join(ids, "_id", "left").join(paths, "target", "left").withColumn("path", F.when(F.col("_id").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_path")))
        quoted = F.when(F.col("title") != "", F.concat(F.lit(' "'), F.replace(_html_escaped(F.col("title")), F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise("")
        shown = F.when(F.endswith("path", F.lit(".bin")), F.concat(F.lit("["), "label", F.lit("]("), "path", F.lit(")"))).otherwise(F.concat(F.lit("!["), F.col("label"), F.lit("]("), F.col("path"), quoted, F.lit(")")))
        fault = F.when(F.col("path").isNull(), F.concat(F.lit("no asset "), F.col("target")))
        edits = edits.unionByName(met.select("key", "start", "end", _barred(shown).alias("value"), fault.alias("fault")))
    return _edited(docs, edits, text)


def _html_escaped(value: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def cited(answers: DataFrame, observed: DataFrame) -> DataFrame:
    """``answers(answer, text)`` with ``new_text`` and ``unresolved``: citation marks outside code replaced by the citation that the answer observed.

    ``observed(answer, citation)``: a mark stands for the one citation with its short
    form; marks of several citations, or of none, stay and are listed.
    """
    bound = observed.where("citation is not null").select("answer", "citation", short_citation(F.col("citation")).alias("target")).groupBy("answer", "target").agg(F.min("citation").alias("citation"), F.max("citation").alias("_last")).where("citation = _last").drop("_last")
    marks = span_rows(answers).where("kind = 'citation'")
    asked = answers.withColumn("key", F.sha2("text", 256)).select("answer", "key").distinct()
    met = asked.join(marks, "key").join(bound, ["answer", "target"], "left")
    edit = F.when(F.col("citation").isNotNull(), F.struct(F.col("start"), F.col("end"), _barred(F.col("citation")).alias("value")))
    by = met.groupBy("answer", "key").agg(F.collect_list(edit).alias("_edits"), F.array_sort(F.collect_set(F.when(F.col("citation").isNull(), F.col("label")))).alias("_open"))
    out = answers.withColumn("key", F.sha2("text", 256)).join(by, ["answer", "key"], "left")
    return out.withColumn("new_text", spliced(F.col("text"), F.coalesce("_edits", F.array()).cast(EDITS))).withColumn("unresolved", F.coalesce("_open", F.array().cast("array<string>"))).drop("key", "_edits", "_open")
