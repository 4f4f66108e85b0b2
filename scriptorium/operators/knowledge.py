"""Topics, sections of catalogues, owned ranges, caches and proposals."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions.text import composed, let, unique_place
from scriptorium.operators import graph

#: Retries of a batch, characters of a brief.
ATTEMPTS, BRIEF_CHARS = 3, 150


def label_clusters(groups: DataFrame) -> DataFrame:
    """``(group, cluster)``: groups ``(group, labels)`` that share a label, directly or through others, with the least group of their cluster.

    Labels are compared by compatible form and case; blank ones join nothing.
    A group that shares none is a cluster of its own.
    """
    rows = groups.select("group", F.explode_outer("labels").alias("label")).withColumn("label", F.lower(F.trim(composed(F.col("label")))))
    named = rows.where("label is not null and label <> ''").distinct()
    first = named.groupBy("label").agg(F.min("group").alias("b"))
    edges = named.join(first, "label").select(F.col("group").alias("a"), "b")
    alone = groups.select(F.col("group").alias("a"), F.col("group").alias("b"))
    return graph.components(edges.unionByName(alone)).select(F.col("id").alias("group"), F.col("label").alias("cluster"))


def candidate_windows(groups: DataFrame, clusters: DataFrame, most: int) -> DataFrame:
    """``(cluster, window, group)``: clusters of more than one group, by path, in windows of at most ``most`` members; a group alone may pass that."""
    from scriptorium.operators.blocks import greedy_batches

    joined = groups.join(clusters, "group").withColumn("n", F.count("*").over(Window.partitionBy("cluster"))).where("n > 1")
    ordered = joined.withColumn("ord", F.row_number().over(Window.partitionBy("cluster").orderBy("path", "group")).cast("int"))
    filled = greedy_batches(ordered.select(F.col("cluster").alias("doc_id"), "ord", "members"), most, F.size("members"))
    return ordered.join(filled.withColumnRenamed("doc_id", "cluster"), ["cluster", "ord"]).select("cluster", F.col("batch").alias("window"), "group")


def unique_paths(topics: DataFrame) -> DataFrame:
    """``topics(path, members)`` with ``name``: the first of a path keeps it, others get a hash of their members; sorted members decide the order."""
    key = F.array_join(F.array_sort("members"), "\u001f")
    place = F.row_number().over(Window.partitionBy("path").orderBy(key))
    return topics.withColumn("_k", place).withColumn("name", F.when(F.col("_k") == 1, F.col("path")).otherwise(F.concat(F.left("path", F.lit(100)), F.lit("-"), F.substring(F.sha2(key, 256), 1, 12)))).drop("_k")


def members_conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(member, n_before, n_after)`` of members that two tables ``(members)`` don't hold equally often."""
    count = lambda t, n: t.select(F.explode("members").alias("member")).groupBy("member").agg(F.count("*").alias(n))
    both = count(before, "n_before").join(count(after, "n_after"), "member", "full_outer").fillna(0, ["n_before", "n_after"])
    return both.where("n_before <> n_after")


def _suffixed(members: Column, turn: int) -> Column:
    """The start of a hash of a group's members, and of the turn from the second on."""
    listed = F.to_json(F.array_sort(members))
    return F.substring(F.sha2(listed if turn == 0 else F.concat(F.lit("["), listed, F.lit(f",{turn}]")), 256), 1, 12)


def settled_paths(groups: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``groups(path, name, members)`` with paths of their own.

    Of groups that share a path the one with the least members keeps it; each
    other one's name gets a hash of its members.  Those whose new path another
    group or an ``existing(path)`` page has try the next hash, round by round,
    each a written table, until no path is asked for twice.  Groups with the same
    members in full are told apart by their place.
    """
    key = F.to_json(F.array_sort("members"))
    rows = graph.kept(groups.select("path", "name", "members", key.alias("_key")).withColumn("_tie", F.monotonically_increasing_id()))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("_key", "_tie"))
    dealt = graph.kept(rows.withColumn("_rank", rank))
    placed, open_ = dealt.where("_rank = 1").drop("_rank"), dealt.where("_rank > 1").drop("_rank")
    pages = existing.select("path").distinct() if existing is not None else None
    turn = 0
    while open_.limit(1).count():
        name = F.concat(F.left("name", F.lit(100)), F.lit("-"), _suffixed(F.col("members"), turn))
        asked = open_.withColumn("_name", name).withColumn("_path", F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"), "_name"))
        taken = placed.select(F.col("path").alias("_path"))
        taken = taken if pages is None else taken.union(pages.select(F.col("path").alias("_path")))
        ranked = asked.withColumn("_rank", F.row_number().over(Window.partitionBy("_path").orderBy("_key", "_tie")))
        free = ranked.join(taken.distinct().withColumn("_taken", F.lit(True)), "_path", "left").withColumn("_won", F.col("_taken").isNull() & (F.col("_rank") == 1))
        told = graph.kept(free)
        won = told.where("_won").select(F.col("_path").alias("path"), F.col("_name").alias("name"), "members", "_key", "_tie")
        placed = graph.kept(placed.select("path", "name", "members", "_key", "_tie").unionByName(won))
        open_ = told.where("not _won").select("path", "name", "members", "_key", "_tie")
        turn += 1
    return placed.select("path", "name", "members")


def reconciled(groups: DataFrame, most: int, resolve: Callable[[DataFrame], DataFrame], existing: DataFrame | None = None) -> DataFrame:
    """``(path, name, members)``: groups ``(group, path, name, labels, members)`` after those that may be one topic have been compared.

    Groups that share their path or a label, directly or through others, form a
    cluster; a cluster of several goes in order of path to ``resolve`` in windows of
    at most ``most`` members.  ``resolve`` gets rows ``(cluster, window, group, path,
    name, members)`` and gives ``(cluster, window, path, name, members)`` for the
    windows it can decide; the groups of other windows, and of windows of one
    group, stay as they are.  Paths that then collide are told apart.  Raises
    unless every member is there as often as before.
    """
    rows = graph.kept(groups.select("group", "path", "name", "labels", "members"))
    marks = rows.select("group", F.array_append(F.coalesce(F.col("labels"), F.array().cast("array<string>")), F.concat(F.lit("\u001f"), F.col("path"))).alias("labels"))
    marks = marks.select("group", F.transform("labels", lambda x: F.regexp_replace(x, r"\s+", " ")).alias("labels"))
    clusters = label_clusters(marks)
    windows = candidate_windows(rows, clusters, most)
    placed = graph.kept(rows.join(windows, "group", "left").select("cluster", "window", "group", "path", "name", "members"))
    several = placed.where("cluster is not null").groupBy("cluster", "window").agg(F.count("*").alias("n")).where("n > 1").select("cluster", "window")
    asked = placed.join(several, ["cluster", "window"], "left_semi")
    answers = graph.kept(resolve(asked).select("cluster", "window", "path", "name", "members"))
    done = answers.select("cluster", "window").distinct()
    same = placed.join(done, (placed.cluster == done.cluster) & (placed.window == done.window), "left_anti")
    after = graph.kept(settled_paths(same.select("path", "name", "members").unionByName(answers.select("path", "name", "members")), existing))
    lost = members_conserved(rows, after).limit(1).collect()
    if lost:
        raise ValueError(f"member {lost[0]['member']} was held {lost[0]['n_before']} times and is now held {lost[0]['n_after']} times")
    return after


def section(lines: Column, heading: str) -> Column:
    """``(start, end)`` of the lines under the second-level heading, up to the next one; null without it."""
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.rtrim(x).alias("head"))), lambda h: F.startswith(h["head"], F.lit("## ")))
    mine = lambda hs: F.get(F.filter(hs, lambda h: h["head"] == heading), F.lit(0))["at"]
    after = lambda hs, at: F.get(F.filter(hs, lambda h: h["at"] > at), F.lit(0))["at"]
    return let(heads, lambda hs: F.when(mine(hs).isNotNull(), F.struct((mine(hs) + 1).alias("start"), F.coalesce(after(hs, mine(hs)), F.size(lines)).alias("end"))))


def upsert_entry(text: Column, heading: str, prefix: Column, entry: Column) -> Column:
    """The text with ``entry`` in place of the section's first line that begins with ``prefix``, else as its first line; unchanged without the section."""

    def put(lines: Column, s: Column) -> Column:
        at = F.get(F.filter(F.transform(F.slice(lines, s["start"] + 1, s["end"] - s["start"]), lambda x, i: F.when(F.startswith(x, prefix), i)), lambda i: i.isNotNull()), F.lit(0))
        rest = lambda a: F.slice(lines, a + 1, F.greatest(F.lit(0), F.size(lines) - a))
        replaced = let(s["start"] + at, lambda i: F.concat(F.slice(lines, F.lit(1), i), F.array(entry), rest(i + 1)))
        added = F.concat(F.slice(lines, F.lit(1), s["start"]), F.array(entry), rest(s["start"]))
        return F.when(s.isNull(), text).otherwise(F.array_join(F.when(at.isNotNull(), replaced).otherwise(added), "\n"))

    return let(F.split(text, "\n"), lambda lines: let(section(lines, heading), lambda s: put(lines, s)))


def remove_entry(text: Column, heading: str, prefix: Column) -> Column:
    """The text without the section's lines that begin with ``prefix``."""

    def drop(lines: Column, s: Column) -> Column:
        kept = F.filter(lines, lambda x, i: ~((i >= s["start"]) & (i < s["end"]) & F.startswith(x, prefix)))
        return F.when(s.isNull(), text).otherwise(F.array_join(kept, "\n"))

    return let(F.split(text, "\n"), lambda lines: let(section(lines, heading), lambda s: drop(lines, s)))


def catalogue_text(entries: DataFrame, headings: list[str]) -> DataFrame:
    """One row ``text``: entries ``(heading, link, kind, brief)`` under their headings in order. A catalogue is one text, as its readers want it."""
    line = F.concat(F.lit("- [["), "link", F.lit("]]"), F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("kind"), F.lit("")), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" — "), F.nullif(F.col("brief"), F.lit(""))), F.lit("")))
    listed = entries.groupBy("heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    place = F.array_position(F.array(*[F.lit(h) for h in headings]), F.col("heading"))
    one = F.concat(F.lit("## "), F.col("heading"), F.lit("\n"), F.col("body"))
    rows = listed.where(place > 0).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), one.alias("t")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["t"]), "\n\n").alias("text"))


def owned_range(text: Column, owner: Column, tag: str = "source") -> Column:
    """``(start, end, fault)`` of the one range that ``owner`` marked, in code points; null without marks, a fault if marks repeat, cross or nest."""
    opening, closing = F.concat(F.lit(f"<!-- {tag}:"), owner, F.lit(" -->")), F.concat(F.lit(f"<!-- /{tag}:"), owner, F.lit(" -->"))
    count = lambda mark: F.floor((F.length(text) - F.length(F.replace(text, mark, F.lit("")))) / F.length(mark))
    start, end = F.position(opening, text), F.position(closing, text)
    inner = F.substring(text, start + F.length(opening), end - start - F.length(opening))
    marks = F.regexp_extract_all(F.substring(text, F.lit(1), start - 1), F.lit(rf"<!-- (/?{tag}:[^>\s]+) -->"), F.lit(1))
    # Ranges before it must follow one another: marks come in pairs of an opening and its own closing.
    paired = (F.size(marks) % 2 == 0) & F.forall(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(marks) - 2), F.lit(2)), lambda i: (F.size(marks) == 0) | (F.get(marks, i + 1) == F.concat(F.lit("/"), F.get(marks, i))))
    fault = F.when((count(opening) != 1) | (count(closing) != 1) | (end < start) | F.contains(inner, F.lit(f"<!-- {tag}:")) | F.contains(inner, F.lit(f"<!-- /{tag}:")) | ~paired, "ambiguous")
    none = F.lit(None).cast("int")
    row = F.struct(F.when(fault.isNull(), start - 1).otherwise(none).alias("start"), F.when(fault.isNull(), end - 1 + F.length(closing)).otherwise(none).alias("end"), fault.alias("fault"))
    return F.when((start > 0) | (end > 0), row)


def without_range(text: Column, owner: Column, tag: str = "source") -> Column:
    """The text without the owner's range; unchanged without marks, null if they are ambiguous."""
    r = owned_range(text, owner, tag)
    return let(r, lambda r: F.when(r.isNull(), text).when(r["fault"].isNull(), F.concat(F.substring(text, F.lit(1), r["start"]), F.substring(text, r["end"] + 1, F.length(text)))))


def split_retry(batches: DataFrame, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(done, failed)`` of ``batches(batch, ord, …)``: ``run`` gives ``(batch, ok)``; batches that fail are halved, in order, and run again until each holds one row.

    A batch's name tells its halves apart (``b/0``, ``b/1``); rows keep their
    ``ord``, and those that fail alone the name of their last batch.  A batch of
    ``n`` rows takes log2 n rounds at most.
    """
    from scriptorium.operators.units import halved

    done = failed = None
    left = batches
    while True:
        verdict = graph.kept(run(left).select("batch", "ok"))
        joined = left.join(verdict, "batch")
        good = graph.kept(joined.where("ok").drop("ok"))
        done = good if done is None else done.unionByName(good)
        parts = halved(joined.where("not coalesce(ok, false)").drop("ok"), "batch", "ord")
        bad = graph.kept(parts.where("half is null").drop("half"))
        failed = bad if failed is None else failed.unionByName(bad)
        left = graph.kept(parts.where("half is not null").withColumn("batch", F.concat_ws("/", "batch", F.col("half").cast("string"))).drop("half"))
        if not left.limit(1).count():
            break
    return done, failed


def cached(work: DataFrame, results: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """``work`` with the result of its content key where ``results(key, result)`` has one, and the distinct keys still to be done.

    Of several results of a key the newest by ``at`` counts, where that column is there, else the greatest.
    """
    keyed = work.withColumn("key", key)
    newest = F.max_by("result", "at") if "at" in results.columns else F.max("result")
    found = keyed.join(results.where("result is not null").groupBy("key").agg(newest.alias("result")), "key", "left")
    return found, found.where("result is null").select("key").distinct()


def publication(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """``(proposal, state)``: ``published`` if every page ``(proposal, path, before)`` still has the digest it was made against, else ``input_conflict``; protected pages need acceptance.

    ``proposals(proposal, path, before, protected)``, ``current(path, digest)``; a null digest stands for no page.
    """
    now = proposals.join(current.select("path", "digest"), "path", "left")
    moved = ~F.col("digest").eqNullSafe(F.col("before"))
    return now.groupBy("proposal").agg(F.when(F.bool_or(moved), "input_conflict").when(F.bool_or(F.coalesce("protected", F.lit(False))), "needs_acceptance").otherwise("published").alias("state"))


def page_diffs(most: int):
    """A function of two texts: their unified diff, a note for bytes that are no text, an error beyond ``most`` characters."""

    @F.pandas_udf(StringType())
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        def one(a, b):
            a, b = a or "", b or ""
            if "\x00" in a + b:
                return "binary page changed" if a != b else ""
            out = "".join(x if x.endswith("\n") else x + "\n" for x in difflib.unified_diff(a.splitlines(True), b.splitlines(True), "before", "after"))
            return out if len(out) <= most else None

        return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)], dtype=object)

    return diff


def omission_rows(rows: DataFrame) -> DataFrame:
    """``(doc_id, omissions)``: omissions ``(doc_id, stage, reason, items)`` in order of stage, reason and items, repeats kept; raises for a blank stage or reason."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    checked = rows.withColumn("stage", F.when(blank("stage") | blank("reason"), F.raise_error(F.lit("an omission needs a stage and a reason"))).otherwise(F.col("stage")))
    return checked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("stage", "reason", "items"))).alias("omissions"))


#: Fixed value: what a unit may not be without facts about: numbers and words of duty.
BINDING = r"(?i)\d|\b(must|shall|should|required|never|only)\b"


def unit_fault(text: Column, facts: Column, reason: Column, code: Column) -> Column:
    """Faults of a unit's extraction: no facts and no reason, none though the text binds, or a quote that is not there once."""
    lost = F.exists(facts, lambda q: unique_place(text, q, code).isNull())
    empty = F.size(F.coalesce(facts, F.array().cast("array<string>"))) == 0
    return F.when(empty & (reason.isNull() | (F.trim(reason) == "")), "no reason").when(empty & F.rlike(text, F.lit(BINDING)), "binding text without facts").when(lost, "quote")


def semantic_key(columns: dict[str, Column]) -> Column:
    """A key of what a unit says, not where: pass its fields without places."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def node_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits ``(doc_id, ord, …)`` with the first node, in order of nodes, around them and how many blocks they lie past its start.

    Nodes are numbered by their starts and nest or follow one another, so the
    first around a block is the one that no other holds.
    """
    from scriptorium.operators.blocks import node_of_block

    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "node").rowsBetween(Window.unboundedPreceding, -1))
    outer = nodes.withColumn("_before", before).where("_before is null or _before <= start").drop("_before")
    places = node_of_block(hits.select("doc_id", "ord").distinct(), outer)
    starts = outer.select("doc_id", "node", F.col("start").alias("_start"))
    return hits.join(places, ["doc_id", "ord"], "left").join(starts, ["doc_id", "node"], "left").withColumn("offset", F.col("ord") - F.col("_start")).drop("_start")


def snapshot(registry: DataFrame, versions: DataFrame, parses: DataFrame, trees: DataFrame) -> DataFrame:
    """``(source_id, version_id, parse_id, tree_id)`` of registered sources whose version, parse and tree all belong together; others have no row.

    ``registry(source_id, version_id)``, ``versions(version_id, source_id)``, ``parses(parse_id, version_id, selected)``, ``trees(tree_id, parse_id)``.
    """
    own = registry.join(versions, ["source_id", "version_id"])
    chosen = parses.where("selected").select("parse_id", "version_id")
    return own.join(chosen, "version_id").join(trees, "parse_id").select("source_id", "version_id", "parse_id", "tree_id")


def by_path(registry: DataFrame, path: str) -> DataFrame:
    """The first row (by ``ord``) of ``registry(ord, path, raw_path, origin, …)`` that has ``path`` in any of its three paths; no row without one."""
    hit = (F.col("path") == path) | (F.col("raw_path") == path) | (F.col("origin") == path)
    found = registry.where(F.coalesce(hit, F.lit(False)))
    return found.orderBy("ord").limit(1)


def legacy_stem(registry: DataFrame, stem: str) -> DataFrame:
    """Rows without a path whose name's stem is ``stem`` in compatible form."""
    import unicodedata

    own = F.regexp_replace("name", r"(?<=.)\.[^.]+$", "")
    return registry.where("path is null").where(composed(own) == unicodedata.normalize("NFKC", stem))


def known_labels(labels: DataFrame, topics: DataFrame) -> DataFrame:
    """``(plan, label, member)`` of labels ``(plan, label)``; raises for a label that ``topics(label, member)`` doesn't know."""
    found = labels.join(topics, "label", "left")
    return found.select("plan", F.when(F.col("member").isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col("label")))).otherwise(F.col("label")).alias("label"), "member")


def accepted_groups(groups: DataFrame, failures: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups ``(path, …)`` without those of ``failures(path)``, and every target ``(target)`` that a link may then name."""
    good = groups.join(failures.select("path").distinct(), "path", "left_anti")
    return good, existing.select("target").union(good.select("path")).distinct()
