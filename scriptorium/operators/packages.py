"""Rules for skill packages and slide decks, as rows of issues."""

from __future__ import annotations

import ast
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scriptorium.functions import frontmatter as fm

# Limits and names that a skill must keep to.
SKILL_BYTES, REFERENCE_BYTES, NAME_CHARS, DESCRIPTION_CHARS, SHORT_DESCRIPTION = 50 * 1024, 100 * 1024, 64, 1024, 20
SKILL_NAME = "^[a-z0-9]+(-[a-z0-9]+)*$"
SKILL_KEYS = ("name", "description", "license", "allowed-tools", "metadata", "compatibility")
FOREIGN = r"(?i)\[\[(concepts|summaries|sources)/[^\]]+\]\]"
REFERENCE = r"(?i)\[\[references/([a-z0-9._/-]+)\]\]"
# Limits of a deck.
DECK_BYTES, LEAST_SLIDES, FEW_SLIDES, MANY_SLIDES = 2 * 1024 * 1024, 5, 8, 15


def _bytes(text: Column) -> Column:
    return F.octet_length(text)


@F.pandas_udf(ArrayType(StringType()))
def foreign_imports(source: pd.Series) -> pd.Series:
    """Top modules that a script imports from outside the standard library, sorted; null if it can't be parsed."""

    def one(text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return None
        names = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
        names |= {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module and not n.level}
        return sorted({n.split(".")[0] for n in names} - set(sys.stdlib_module_names))

    return source.map(one)


def skill_issues(files: DataFrame, strict: bool = False) -> DataFrame:
    """``(skill, level, issue, subject)`` of the files ``(skill, path, text)`` of skill folders; a skill without issues has no row.

    Levels are ``error`` and ``warning``.  A folder without a SKILL.md, or whose
    SKILL.md has no front matter or a broken one, gets that issue and no more
    about its fields.
    """
    main = files.where("path = 'SKILL.md'").withColumn("block", fm.parts(F.coalesce("text", F.lit("")))[0])
    body = fm.parts(F.coalesce("text", F.lit("")))[1]
    name, text = fm.scalar(F.col("block"), "name"), fm.scalar(F.col("block"), "description")
    inner = F.regexp_replace(F.substring("block", F.lit(4), F.length("block")), r"(?s)\n---[^\n]*\n?$", "")
    keys = F.regexp_extract_all(inner, F.lit(r"(?m)^([A-Za-z_][\w-]*):"), F.lit(1))
    extra = F.array_sort(F.array_distinct(F.array_except(keys, F.array(*[F.lit(k) for k in SKILL_KEYS]))))
    sound = F.col("block").isNotNull() & fm.fault(F.col("block")).isNull()
    absent = lambda v, k: sound & v.isNull() & ~F.coalesce(F.rlike("block", F.lit(rf"(?m)^{k}:[ \t]*\S")), F.lit(False))
    unread = lambda v, k: sound & v.isNull() & F.rlike("block", F.lit(rf"(?m)^{k}:[ \t]*\S"))
    rules = [
        ("error", "size", _bytes(F.col("text")) > SKILL_BYTES, F.lit(None)),
        ("error", "no front matter", F.col("block").isNull(), F.lit(None)),
        ("error", "broken front matter", F.col("block").isNotNull() & ~sound, fm.fault(F.col("block"))),
        ("warning", "unknown keys", sound & (F.size(extra) > 0), F.array_join(extra, ",")),
        ("error", "name missing", absent(name, "name") | (sound & (name == "")), F.lit(None)),
        ("error", "name no text", unread(name, "name"), F.lit(None)),
        ("error", "name differs", sound & (name != "") & (name != F.col("skill")), name),
        ("error", "name form", sound & (name != "") & (~F.rlike(name, F.lit(SKILL_NAME)) | (F.length(name) > NAME_CHARS)), name),
        ("error", "description missing", absent(text, "description") | (sound & (text == "")), F.lit(None)),
        ("error", "description no text", unread(text, "description"), F.lit(None)),
        ("error", "description long", sound & (F.length(text) > DESCRIPTION_CHARS), F.lit(None)),
        ("warning", "description short", sound & (text != "") & (F.length(text) < SHORT_DESCRIPTION), F.lit(None)),
        ("error", "description brackets", sound & F.rlike(text, F.lit("[<>]")), F.lit(None)),
        ("error", "description foreign link", sound & F.rlike(text, F.lit(FOREIGN)), F.lit(None)),
        ("error", "body foreign link", sound & F.rlike(body, F.lit(FOREIGN)), F.lit(None)),
    ]
    row = lambda level, issue, subject: F.struct(F.lit(level).alias("level"), F.lit(issue).alias("issue"), subject.cast("string").alias("subject"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), row(*names, subject)) for *names, broken, subject in rules]))
    out = main.select("skill", F.explode(found).alias("i")).select("skill", "i.*")

    linked = main.where(sound).select("skill", F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))).alias("link")).distinct()
    climbs = F.rlike("link", F.lit(r"(^|/)\.\.(/|$)"))
    target = F.concat(F.lit("references/"), F.when(F.rlike("link", F.lit(r"(?i)\.md$")), F.col("link")).otherwise(F.concat("link", F.lit(".md"))))
    there = files.select("skill", F.col("path").alias("target"))
    issue = lambda level, name, subject: (F.lit(level).alias("level"), F.lit(name).alias("issue"), subject)
    outside = linked.where(climbs).select("skill", *issue("error", "reference outside", F.col("link").alias("subject")))
    lost = linked.where(~climbs).withColumn("target", target).join(there, ["skill", "target"], "left_anti").select("skill", *issue("error", "reference missing", F.col("target").alias("subject")))
    references = files.where(F.rlike("path", F.lit(r"^references/.*\.md$")))
    large = references.where(_bytes(F.col("text")) > REFERENCE_BYTES).select("skill", *issue("error", "reference size", F.col("path").alias("subject")))
    foreign = references.where(F.rlike("text", F.lit(FOREIGN))).select("skill", *issue("error", "reference foreign link", F.col("path").alias("subject")))
    bare = files.select("skill").distinct().join(main.select("skill"), "skill", "left_anti").select("skill", *issue("error", "no SKILL.md", F.lit(None).cast("string").alias("subject")))
    out = out.unionByName(outside).unionByName(lost).unionByName(large).unionByName(foreign).unionByName(bare)
    if strict:
        scripts = files.where(F.rlike("path", F.lit(r"^scripts/.*\.py$"))).withColumn("names", foreign_imports("text")).where(F.size("names") > 0)
        out = out.unionByName(scripts.select("skill", *issue("warning", "imports", F.concat_ws(": ", "path", F.array_join("names", ",")).alias("subject"))))
    return out


class _Slides(HTMLParser):
    def __init__(self, attribute: str):
        super().__init__()
        self.attribute, self.kinds, self.outside = attribute, [], []

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "").strip() for k, v in attrs}
        if tag == "section" and "slide" in a.get("class", "").split():
            self.kinds.append(a.get(self.attribute, ""))
        address = a.get({"link": "href", "script": "src", "img": "src"}.get(tag, ""), "")
        if address.startswith(("http://", "https://", "//")):
            self.outside.append(f"{tag} {address}")


def slides(attribute: str = "data-type"):
    """A function of a deck's HTML: its slides' kinds in order and what it loads from outside."""

    @F.pandas_udf("kinds array<string>, outside array<string>")
    def read(page: pd.Series) -> pd.DataFrame:
        rows = []
        for text in page:
            reader = _Slides(attribute)
            reader.feed(text or "")
            reader.close()
            rows.append({"kinds": reader.kinds, "outside": reader.outside})
        return pd.DataFrame(rows, columns=["kinds", "outside"])

    return read


def longest_run(kinds: Column) -> Column:
    """The most equal kinds in a row; a blank one ends a run and makes none."""
    start = F.struct(F.lit(0).alias("run"), F.lit("").alias("last"), F.lit(0).alias("most"))

    def step(a: Column, k: Column) -> Column:
        run = F.when(k == "", 0).when(k == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(run.alias("run"), k.alias("last"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(kinds, start, step, lambda a: a["most"])


def deck_issues(decks: DataFrame, required: list[str] | None = None, allowed: list[str] | None = None, least_kinds: int | None = None, longest: int | None = None, attribute: str | None = None) -> DataFrame:
    """``(deck, level, issue, subject)`` of ``decks(deck, html)``; rules on kinds only where ``attribute`` names them."""
    seen = decks.withColumn("s", slides(attribute or "")("html")).select("deck", "html", "s.kinds", "s.outside").withColumn("n", F.size("kinds"))
    distinct = F.array_except(F.array_distinct("kinds"), F.array(F.lit("")))
    names = lambda xs: F.array(*[F.lit(x) for x in xs or []]).cast("array<string>")
    rules = [
        ("error", "no page", F.col("html").isNull(), F.lit(None)),
        ("warning", "size", _bytes(F.col("html")) > DECK_BYTES, F.lit(None)),
        ("error", "few slides", F.col("html").isNotNull() & (F.col("n") < LEAST_SLIDES), F.col("n")),
        ("error", "outside references", F.size("outside") > 0, F.array_join(F.slice("outside", 1, 3), ", ")),
        ("warning", "slide count", (F.col("n") > 0) & ~F.col("n").between(FEW_SLIDES, MANY_SLIDES), F.col("n")),
    ]
    if attribute:
        lost, odd = F.array_except(names(required), F.col("kinds")), F.array_sort(F.array_except(distinct, names(allowed)))
        blank = F.size(F.filter("kinds", lambda k: k == ""))
        rules += [("error", "kind missing", F.size(lost) > 0, F.array_join(lost, ",")), ("error", "blank kind", blank > 0, blank)]
        rules += [("error", "unknown kind", F.size(odd) > 0, F.array_join(odd, ","))] if allowed else []
        rules += [("warning", "few kinds", (F.col("n") > 0) & (F.size(distinct) < least_kinds), F.size(distinct))] if least_kinds is not None else []
        rules += [("warning", "long run", longest_run(F.col("kinds")) > longest, longest_run(F.col("kinds")))] if longest is not None else []
    row = lambda level, issue, subject: F.struct(F.lit(level).alias("level"), F.lit(issue).alias("issue"), subject.cast("string").alias("subject"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), row(*at, subject)) for *at, broken, subject in rules]))
    return seen.select("deck", F.explode(found).alias("i")).select("deck", "i.*")
