"""Pages with front matter and wiki links: lint, back-links, repair and page actions.

Pages come as ``(path, text)`` with paths like ``concepts/name.md``.  A null
text counts as an empty page; a row without a path is no page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import frontmatter as fm
from scriptorium.functions.text import normal_target, wikilinks

# Generated pages, folders of generated pages, folders of knowledge pages.
GENERATED = ["AGENTS.md", "SCHEMA.md", "log.md"]
GENERATED_FOLDERS = ["reports", "sources"]
KNOWLEDGE = ["summaries", "concepts", "entities"]


def parsed(pages: DataFrame) -> DataFrame:
    """``(path, folder, name, key, stem, text, block, body)``; the key is the path without its suffix."""
    text = F.coalesce(F.col("text"), F.lit(""))
    block, body = fm.parts(text)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    suffix = r"\.[^./]*$"
    return pages.where("path is not null").select("path", folder.alias("folder"), name.alias("name"), F.regexp_replace("path", suffix, "").alias("key"), F.regexp_replace(name, suffix, "").alias("stem"), text.alias("text"), block.alias("block"), body.alias("body"))


def written(rows: DataFrame) -> DataFrame:
    """Without generated pages and folders."""
    return rows.where(~F.col("name").isin(GENERATED) & ~F.col("folder").isin(GENERATED_FOLDERS))


def knowledge(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("folder").isin(KNOWLEDGE))


def targets(rows: DataFrame) -> DataFrame:
    """``(target)``: what a link can name, knowledge pages by key and the index."""
    return rows.where(F.col("folder").isin(KNOWLEDGE) | (F.col("key") == "index")).select(F.col("key").alias("target")).distinct()


def link_rows(rows: DataFrame) -> DataFrame:
    """``(path, key, ord, target)`` of the wiki links in order."""
    return rows.select("path", "key", F.posexplode(wikilinks(F.col("text"))).alias("ord", "target"))


def _known(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("bare")).union(rows.select("stem")).distinct()


def broken(rows: DataFrame) -> DataFrame:
    """``(path, target)``: links of written pages whose target, slashes at its ends aside, is neither key nor stem of a page."""
    bare = F.regexp_replace("target", "^/+|/+$", "")
    return link_rows(written(rows)).withColumn("bare", bare).join(_known(rows), "bare", "left_anti").select("path", "target")


def index_issues(rows: DataFrame) -> DataFrame:
    """``(issue, subject)``: links of the index that lead nowhere, and knowledge pages that it doesn't mention by link or in its text."""
    index = rows.where("key = 'index'")
    names = index.select(F.explode(F.array_distinct(wikilinks(F.col("text")))).alias("target"))
    lost = names.withColumn("bare", F.regexp_replace("target", "^/+|/+$", "")).join(_known(rows), "bare", "left_anti").select(F.lit("missing page").alias("issue"), F.col("target").alias("subject"))
    linked = names.select(F.regexp_replace(F.element_at(F.split("target", "/"), -1), r"(?<=.)\.[^.]*$", "").alias("stem")).distinct()
    said = index.select(F.lower("text").alias("said"))
    absent = knowledge(rows).select("path", "stem").join(linked, "stem", "left_anti").join(F.broadcast(said)).where(~F.contains("said", F.lower("stem")))
    return lost.unionByName(absent.select(F.lit("not mentioned").alias("issue"), F.col("path").alias("subject")))


def invalid_front(rows: DataFrame) -> DataFrame:
    """``(path, fault)`` of written pages whose block breaks a rule."""
    return written(rows).where("block is not null").select("path", fm.fault(F.col("block")).alias("fault")).where("fault is not null")


def missing_fields(rows: DataFrame, fields: tuple[str, ...] = ("type", "description")) -> DataFrame:
    """``(path, field)``: a row for each field of a knowledge page that is no string or blank."""
    blank = lambda f: F.coalesce(F.trim(fm.scalar(F.col("block"), f)), F.lit("")) == ""
    found = F.array_compact(F.array(*[F.when(blank(f), F.lit(f)) for f in fields]))
    return written(knowledge(rows)).select("path", F.explode(found).alias("field"))


def structural_lint(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``(check, subject, detail)``: the union of the link, orphan, entry, index and front matter checks; ``files(name, stem)`` are the sources."""
    outgoing = link_rows(written(rows))
    named = outgoing.select(F.regexp_replace("target", "^/+|/+$", "").alias("bare"), F.col("path").alias("by"))
    plain = written(knowledge(rows))
    met = named.where(F.contains("bare", F.lit("/"))).select(F.col("bare").alias("key"), "by")
    met = met.unionByName(plain.select("key", "stem").join(named.withColumnRenamed("bare", "stem"), "stem").select("key", "by"))
    lonely = plain.join(outgoing.select("path").distinct(), "path", "left_anti").select("path", "key").join(met.select("key").distinct(), "key", "left_anti")
    unread = files.join(rows.where(F.col("folder").isin("summaries", "sources")).select("stem").distinct(), "stem", "left_anti")
    none = F.lit(None).cast("string")
    checks = [
        broken(rows).select(F.lit("broken link").alias("check"), F.col("path").alias("subject"), F.col("target").alias("detail")),
        lonely.select(F.lit("orphan"), "path", none),
        unread.select(F.lit("missing entry"), "name", none),
        index_issues(rows).select(F.lit("index"), "subject", "issue"),
        invalid_front(rows).select(F.lit("front matter"), "path", "fault"),
        missing_fields(rows).select(F.lit("missing field"), "path", "field"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def back_links(rows: DataFrame) -> DataFrame:
    """``(key, by)``: knowledge pages and the other written pages, the index aside, that link to them in normal form."""
    keys = knowledge(rows).select("key", normal_target(F.col("key")).alias("norm"))
    links = link_rows(written(rows).where("name <> 'index.md'")).select(F.col("key").alias("by"), normal_target(F.col("target")).alias("norm")).distinct()
    return links.join(keys, "norm").where("key <> by").select("key", "by").distinct()


def page_context(rows: DataFrame) -> DataFrame:
    """``(key, outlinks, backlinks)``: sorted pages that each knowledge page links to and that link to it."""
    known = targets(rows).groupBy(normal_target(F.col("target")).alias("norm")).agg(F.max("target").alias("to"))
    out = link_rows(knowledge(rows)).select("key", normal_target(F.col("target")).alias("norm")).distinct().join(known, "norm").where(F.col("norm") != normal_target(F.col("key")))
    outs = out.groupBy("key").agg(F.array_sort(F.collect_set("to")).alias("outlinks"))
    backs = back_links(rows).groupBy("key").agg(F.array_sort(F.collect_set("by")).alias("backlinks"))
    none = F.array().cast("array<string>")
    return knowledge(rows).select("key").join(outs, "key", "left").join(backs, "key", "left").select("key", F.coalesce("outlinks", none).alias("outlinks"), F.coalesce("backlinks", none).alias("backlinks"))


def _demoted(text: Column, fixes: Column) -> Column:
    """``text`` with its links as ``fixes`` (map of a raw target to the target it gets, null for plain text) says; others stay."""
    link = r"^\[\[([^\]]+)\]\]"

    def piece(p: Column) -> Column:
        raw = F.regexp_extract(p, link, 1)
        target = F.trim(F.split_part(raw, F.lit("|"), F.lit(1)))
        alias = F.trim(F.substring(raw, F.position(F.lit("|"), raw) + 1, F.length(raw)))
        has_alias = F.contains(raw, F.lit("|")) & (alias != "")
        to = fixes[target]
        words = F.translate(F.element_at(F.split(target, "/"), -1), "-_", "  ")
        shown = F.when(to.isNull(), F.when(has_alias, alias).otherwise(words)).otherwise(F.concat(F.lit("[["), to, F.when(has_alias, F.concat(F.lit("|"), alias)).otherwise(""), F.lit("]]")))
        return F.when((raw != "") & F.map_contains_key(fixes, target), F.concat(shown, F.substring(p, F.length(raw) + 5, F.length(p)))).otherwise(p)

    return F.array_join(F.transform(F.split(text, r"(?=\[\[[^\]]+\]\])"), piece), "")


def repaired(rows: DataFrame, known: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(path, text, ghosts)``: links to known targets of the same normal form rewritten, other dead ones as plain text.

    ``known(target)`` are the live targets; ``only(path)`` restricts the pages.
    ``ghosts`` lists the dead targets of a page, one for each link.  Pages that
    nothing changes are left out.
    """
    pages = written(rows) if only is None else rows.join(only.select("path").distinct(), "path", "left_semi").where(~F.col("name").isin(GENERATED))
    exact = known.select("target", F.lit(True).alias("live"))
    normal = known.groupBy(normal_target(F.col("target")).alias("norm")).agg(F.max("target").alias("to"))
    links = link_rows(pages).groupBy("path", "target").agg(F.count("*").alias("n"))
    dead = links.join(exact, "target", "left_anti").withColumn("norm", normal_target(F.col("target"))).join(normal, "norm", "left")
    fixes = dead.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", "to"))).alias("fixes"), F.array_sort(F.flatten(F.collect_list(F.when(F.col("to").isNull(), F.array_repeat("target", F.col("n").cast("int"))).otherwise(F.array().cast("array<string>"))))).alias("ghosts"))
    return pages.join(fixes, "path").select("path", _demoted(F.col("text"), F.col("fixes")).alias("text"), "ghosts")


def deletion(rows: DataFrame, victims: DataFrame) -> DataFrame:
    """``(path, action, text, ghosts)`` of deleting the concept and entity pages ``victims(path)``: them, and the pages whose links to them turn to text."""
    gone = rows.where(F.col("folder").isin("concepts", "entities")).join(victims.select("path").distinct(), "path", "left_semi")
    left = rows.join(gone.select("path"), "path", "left_anti")
    linking = back_links(rows).join(gone.select("key"), "key", "left_semi").select(F.col("by").alias("key")).distinct()
    touched = left.join(linking, "key", "left_semi").select("path").unionByName(left.where("key = 'index'").select("path"))
    fixed = repaired(left, targets(left), touched)
    none = F.lit(None)
    return gone.select("path", F.lit("delete").alias("action"), none.cast("string").alias("text"), none.cast("array<string>").alias("ghosts")).unionByName(fixed.select("path", F.lit("modify").alias("action"), "text", "ghosts"))


def edits(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(path, text, ghosts)``: pages with a new body of ``bodies(path, body)`` under their old block, dead links as plain text."""
    new = rows.select("path", "folder", "name", "key", "stem", "block").join(bodies.select("path", F.col("body").alias("text")), "path")
    fixed = repaired(new, targets(rows), new.select("path")).select("path", F.col("text").alias("fixed"), "ghosts")
    out = new.join(fixed, "path", "left")
    return out.select("path", F.concat(F.coalesce("block", F.lit("")), F.coalesce("fixed", "text")).alias("text"), F.coalesce("ghosts", F.array().cast("array<string>")).alias("ghosts"))


def withdrawn_links(rows: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """``(path, text)``: knowledge pages that link to one of ``withdrawn(target)``, with exactly those links as plain text."""
    met = link_rows(knowledge(rows)).join(withdrawn.select("target").distinct(), "target", "left_semi")
    fixes = met.groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("target", F.lit(None).cast("string").alias("to")))).alias("fixes"))
    return rows.join(fixes, "path").select("path", _demoted(F.col("text"), F.col("fixes")).alias("text"))


def affected(rows: DataFrame, source: str) -> DataFrame:
    """``(path, left)``: knowledge pages whose ``sources`` name ``source`` and how many others stay."""
    items = fm.list_value(F.col("block"), "sources")
    return knowledge(rows).withColumn("items", items).where(F.array_contains("items", source)).select("path", (F.size("items") - 1).alias("left"))


def without_document(rows: DataFrame, source: str, keep_empty: bool = False) -> DataFrame:
    """``(path, action, text)``: knowledge pages of ``source`` without it, deleted where it was the last one unless ``keep_empty``."""
    text, empty = fm.without_source(F.col("text"), F.lit(source))
    names = knowledge(rows).where(F.array_contains(fm.list_value(F.col("block"), "sources"), source))
    cut = names.select("path", text.alias("cut"), empty.alias("empty"))
    gone = F.lit(False) if keep_empty else F.col("empty")
    return cut.select("path", F.when(gone, "DELETE").otherwise("MODIFY").alias("action"), F.when(~gone, F.col("cut")).alias("text"))
