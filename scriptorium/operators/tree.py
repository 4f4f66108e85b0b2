"""Navigation trees: nested nodes over ordered blocks, their order and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import graph, nesting

#: Fixed value: characters of a preview.
PREVIEW = 256
#: Hops along a chain of styles at most.
STYLE_HOPS = 32


def basic_tree(blocks: DataFrame, level: Column, place: Column | None = None, title: Column | None = None) -> DataFrame:
    """``(doc_id, node, parent, start, end, level, title, preview)`` over blocks ``(doc_id, ord, text)``.

    Node 0 is the whole document.  Others begin at the first block, at every
    heading (``level`` not null) and where ``place`` changes; their level is the
    heading's, else 1.  A node ends where the next of its level or above
    begins, and its parent is the last earlier node of a smaller level.  The
    preview is the start of the node's own blocks up to the next node.
    """
    by = Window.partitionBy("doc_id").orderBy("ord")
    place = F.lit(0) if place is None else place
    title = F.col("text") if title is None else title
    marked = blocks.withColumn("_level", level).withColumn("_place", place)
    begins = (F.row_number().over(by) == 1) | F.col("_level").isNotNull() | ~F.lag("_place").over(by).eqNullSafe(F.col("_place"))
    marked = marked.withColumn("_begins", begins.cast("int")).withColumn("node", F.sum("_begins").over(by).cast("int"))
    upto = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id", "node").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = marked.withColumn("_upto", upto).where((F.col("_begins") == 1) | (F.col("_upto") < PREVIEW))
    nodes = own.groupBy("doc_id", "node").agg(
        F.min("ord").alias("start"),
        F.coalesce(F.min_by("_level", "ord"), F.lit(1)).cast("int").alias("level"),
        F.min_by(F.when(F.col("_level").isNotNull(), F.left(title, F.lit(PREVIEW))), "ord").alias("title"),
        F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.left("text", F.lit(PREVIEW)).alias("text")))), lambda x: x["text"]), "\n"), F.lit(PREVIEW)).alias("preview"),
    )
    total = blocks.groupBy("doc_id").agg((F.max("ord") + 1).cast("int").alias("total"))
    around = nesting.nested(nodes, "doc_id", "node", F.col("level"), F.col("start")).select("doc_id", "node", "above", "until")
    begins_at = nodes.select("doc_id", F.col("node").alias("until"), F.col("start").alias("_until"))
    near = nodes.join(around, ["doc_id", "node"]).join(begins_at, ["doc_id", "until"], "left").join(total, "doc_id")
    inner = near.select("doc_id", "node", F.coalesce("above", F.lit(0)).cast("int").alias("parent"), F.col("start").cast("int").alias("start"), F.coalesce("_until", "total").cast("int").alias("end"), "level", "title", "preview")
    none = F.lit(None)
    root = total.select("doc_id", F.lit(0).alias("node"), none.cast("int").alias("parent"), F.lit(0).alias("start"), F.col("total").alias("end"), F.lit(0).alias("level"), none.cast("string").alias("title"), F.lit("").alias("preview"))
    return root.unionByName(inner)


def node_faults(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """``(doc_id, node, fault)``: a root that doesn't cover ``totals(doc_id, total)``, reversed ranges, unordered starts, children outside their parent, overlapping siblings, unknown parents."""
    order, kin = Window.partitionBy("doc_id").orderBy("node"), Window.partitionBy("doc_id", "parent").orderBy("node")
    up = nodes.select("doc_id", F.col("node").alias("parent"), F.col("start").alias("_ps"), F.col("end").alias("_pe"))
    seen = nodes.withColumn("_before", F.lag("start").over(order)).withColumn("_first", F.row_number().over(order) == 1).withColumn("_kin", F.max("end").over(kin.rowsBetween(Window.unboundedPreceding, -1)))
    held = seen.join(up, ["doc_id", "parent"], "left").join(totals, "doc_id", "left")
    root = F.col("parent").isNull()
    fault = (
        F.when(~((0 <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("total"))), "range")
        .when(F.col("start") < F.col("_before"), "order")
        .when(root & (~F.col("_first") | (F.col("start") != 0) | (F.col("end") != F.col("total"))), "root")
        .when(~root & (F.col("_ps").isNull() | (F.col("parent") >= F.col("node"))), "parent")
        .when(~root & ((F.col("start") < F.col("_ps")) | (F.col("end") > F.col("_pe"))), "outside")
        .when(~root & (F.col("start") < F.col("_kin")), "overlap")
    )
    return held.select("doc_id", "node", fault.alias("fault")).where("fault is not null")


def preorder(nodes: DataFrame) -> DataFrame:
    """``nodes`` ``(doc_id, node, parent)`` with ``depth`` and ``place``: parents before children, children by node; nodes of no root are left out.

    Each round puts the path of the furthest ancestor known before a node's own
    and looks as far again, so a chain of ``n`` nodes takes about log2 n rounds, each
    a written table.  A node holds its path; nodes on a cycle, under one, or under
    an unknown parent have none to a root.
    """
    own = nodes.select("doc_id", "node", F.col("parent").alias("up"), F.array("node").alias("path"))
    done, left = own.where("up is null"), graph.kept(own.where("up is not null"))
    found = [graph.kept(done)]
    while left.limit(1).count():
        known = found[-1] if len(found) == 1 else found[0].unionByName(found[-1])
        heads = known.select("doc_id", F.col("node").alias("up"), F.lit(None).cast(nodes.schema["parent"].dataType).alias("_next"), F.col("path").alias("_path"))
        via = left.select("doc_id", F.col("node").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_path"))
        longer = left.join(heads.unionByName(via), ["doc_id", "up"]).select("doc_id", "node", F.col("_next").alias("up"), F.concat("_path", "path").alias("path"))
        longer = graph.kept(longer.where(F.size(F.array_distinct("path")) == F.size("path")))
        found = [known, graph.kept(longer.where("up is null"))]
        left = longer.where("up is not null")
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    return every.select("doc_id", "node", F.size("path").alias("depth"), place.alias("place"))


def style_levels(styles: DataFrame) -> DataFrame:
    """``(style, level)`` of ``styles(style, parent, level)``: a style's own level plus 1, else the nearest one up its chain; cycles and 32 hops end it."""
    own = graph.kept(styles.select("style", "parent", F.when(F.col("level").between(0, 8), F.col("level") + 1).cast("int").alias("level")))
    # Pointer jumps: after k rounds a style knows the nearest level within 2 ** k hops; each round is written, so that the next reads it twice and no more.
    for _ in range(STYLE_HOPS.bit_length() - 1):
        up = own.select(F.col("style").alias("parent"), F.col("parent").alias("_next"), F.col("level").alias("_level"))
        own = graph.kept(own.join(up, "parent", "left").select("style", F.col("_next").alias("parent"), F.coalesce("level", "_level").alias("level")))
    return own.select("style", "level")


def marker_digest(blocks: DataFrame, marker: str) -> DataFrame:
    """``(doc_id, markers, digest)``: markers of missing images over all places, and a digest of place and count."""
    count = F.regexp_count("text", F.lit(marker)).cast("long")
    some = blocks.withColumn("n", count).where("n > 0")
    rows = F.array_sort(F.collect_list(F.struct("ord", "n")))
    return some.groupBy("doc_id").agg(F.sum("n").alias("markers"), F.sha2(F.to_json(F.transform(rows, lambda r: F.array(r["ord"].cast("long"), r["n"]))), 256).alias("digest"))


def summary_markdown(nodes: DataFrame) -> DataFrame:
    """``(doc_id, text)``: nodes as nested headings with their range, parents before children."""
    # Nodes are numbered in order of their starts, so their number is the order of a walk.
    line = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), F.col("level") + 1))), F.lit(" "), F.coalesce("title", F.lit("Part")), F.lit(" ("), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("node", line.alias("line"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("text"))
