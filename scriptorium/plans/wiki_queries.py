"""Queries over a wiki derived from the documents: a page for each, with front matter and links, and an index.

The tables hold no wiki, so paths, links and fields follow from ``doc_id``; the
SQL states what must come out by arithmetic, not by reading the pages again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import frontmatter as fm
from scriptorium.functions.text import let
from scriptorium.operators import wiki
from scriptorium.plans.registry import query
from scriptorium.sources import table

INDEX = "# Index\n- [[summaries/d0]] d2\n- [[concepts/d1]]\n- [[concepts/d999999]]\n- [[/concepts/d1/]]\n"


def _folder(i: Column) -> Column:
    return F.when(i % 3 == 0, "summaries").when(i % 3 == 1, "concepts").otherwise("entities")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def pages(spark, d: str) -> DataFrame:
    """``(path, text)``: a page for each document, an index, and a generated page."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = max(1, docs.count())
    i = F.col("doc_id")
    kind = F.when(i % 4 == 1, "type: 5\n").otherwise('type: "Concept"\n')
    about = F.when(i % 6 == 2, "").otherwise(_text('description: "Text ', i, '"\n'))
    odd = F.when(i % 25 == 7, "title: a: b\n").otherwise("")
    sources = F.when(i % 8 == 0, _text('sources: ["s', i % 10, '.pdf"]\n')).otherwise(_text('sources: ["s', i % 10, '.pdf", "t.pdf"]\n'))
    j, k = (i * 7 + 3) % n, (i * 11) % (2 * n)
    links = F.when(i % 5 == 0, "").otherwise(_text("[[", _folder(j), "/D", j, "|an alias]] [[concepts/gone-", i % 9, "]] [[d", k, "]]"))
    made = docs.select(_text(_folder(i), "/d", i, ".md").alias("path"), F.concat(F.lit("---\n"), kind, about, odd, sources, F.lit("---\n\n"), _text("# d", i, "\n"), links, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    others = spark.createDataFrame([("index.md", INDEX), ("log.md", "[[nowhere]]"), ("reports/r.md", "[[nowhere]]")], "path string, text string")
    return made.unionByName(others)


def rows(spark, d: str) -> DataFrame:
    return wiki.parsed(pages(spark, d))


_W = """
n AS (SELECT greatest(1, count(*)) AS n FROM documents),
w AS (SELECT doc_id AS i, n, CASE doc_id % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'concepts' ELSE 'entities' END AS folder, folder || '/d' || doc_id AS key, (doc_id * 7 + 3) % n AS j, (doc_id * 11) % (2 * n) AS k FROM documents, n),
fj AS (SELECT *, CASE j % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'concepts' ELSE 'entities' END AS jfolder, jfolder || '/D' || j AS jkey, i % 5 <> 0 AS linked, j IN (SELECT doc_id FROM documents) AS jlive FROM w)
"""
_BROKEN = """
broken AS (SELECT key || '.md' AS path, jkey AS target FROM fj WHERE linked UNION ALL SELECT key || '.md', 'concepts/gone-' || (i % 9) FROM fj WHERE linked
  UNION ALL SELECT key || '.md', 'd' || k FROM fj WHERE linked AND k NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'index.md', t FROM (VALUES ('summaries/d0', 0), ('concepts/d1', 1), ('concepts/d999999', 999999), ('/concepts/d1/', 1)) x(t, i) WHERE i NOT IN (SELECT doc_id FROM documents))
"""
_INDEX_SQL = INDEX.lower().replace("\n", "' || chr(10) || '")
_SYNC = f"""
sync AS (SELECT 'missing page' AS issue, t AS subject FROM (VALUES ('summaries/d0', 0), ('concepts/d1', 1), ('concepts/d999999', 999999), ('/concepts/d1/', 1)) x(t, i) WHERE i NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'not mentioned', key || '.md' FROM w WHERE i NOT IN (0, 1, 999999) AND NOT contains('{_INDEX_SQL}', 'd' || i))
"""
_MISSING = "missing AS (SELECT key || '.md' AS path, 'type' AS field FROM w WHERE i % 4 = 1 UNION ALL SELECT key || '.md', 'description' FROM w WHERE i % 6 = 2)"
_FAULT = "fault AS (SELECT key || '.md' AS path, 'colon in a plain value' AS fault FROM w WHERE i % 25 = 7)"


@query(f"WITH {_W}, {_BROKEN} SELECT * FROM broken")
def wiki_broken_links(spark, d):
    """Links of pages that name neither a page nor a stem."""
    return wiki.broken(rows(spark, d))


@query(f"WITH {_W}, {_SYNC} SELECT * FROM sync")
def index_sync(spark, d):
    """The index against the pages, both ways."""
    return wiki.index_issues(rows(spark, d))


@query(f"WITH {_W}, {_FAULT} SELECT * FROM fault")
def invalid_front_matter(spark, d):
    return wiki.invalid_front(rows(spark, d))


@query(f"WITH {_W}, {_MISSING} SELECT * FROM missing")
def missing_fields(spark, d):
    return wiki.missing_fields(rows(spark, d))


@query(f"""
WITH {_W}, {_BROKEN}, {_SYNC}, {_MISSING}, {_FAULT},
named AS (SELECT DISTINCT 'd' || k AS stem FROM fj WHERE linked UNION SELECT 'd0' UNION SELECT 'd1' UNION SELECT 'd999999'),
orphan AS (SELECT key FROM fj WHERE NOT linked AND ('d' || i) NOT IN (SELECT 'd' || k FROM fj WHERE linked) AND key NOT IN ('summaries/d0', 'concepts/d1', 'concepts/d999999'))
SELECT 'broken link' AS "check", path AS subject, target AS detail FROM broken UNION ALL SELECT 'orphan', key || '.md', NULL FROM orphan
UNION ALL SELECT 'missing entry', 'f' || doc_id || '.pdf', NULL FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT 'index', subject, issue FROM sync UNION ALL SELECT 'front matter', path, fault FROM fault UNION ALL SELECT 'missing field', path, field FROM missing
""")
def structural_lint(spark, d):
    """All six checks as one table; a source file belongs to each document, a summary only to every third."""
    files = table(spark, d, "documents").select(_text("f", F.col("doc_id"), ".pdf").alias("name"), _text("d", F.col("doc_id")).alias("stem"))
    return wiki.structural_lint(rows(spark, d), files)


@query("WITH " + _W + " SELECT lower(jkey) AS key, key AS by FROM fj WHERE linked AND jlive AND j <> i")
def back_links(spark, d):
    return wiki.back_links(rows(spark, d))


@query(f"""
WITH {_W}, e AS (SELECT DISTINCT key, lower(jkey) AS "to" FROM fj WHERE linked AND jlive AND j <> i)
SELECT key, coalesce((SELECT array_to_string(list_sort(list("to")), ',') FROM e WHERE e.key = w.key), '') AS outlinks, coalesce((SELECT array_to_string(list_sort(list(e.key)), ',') FROM e WHERE e."to" = w.key), '') AS backlinks FROM w
""")
def page_context(spark, d):
    """What each page links to and what links to it."""
    return wiki.page_context(rows(spark, d)).select("key", F.array_join("outlinks", ",").alias("outlinks"), F.array_join("backlinks", ",").alias("backlinks"))


_GHOSTS = "array_to_string(list_sort(CASE WHEN {live} THEN [] ELSE [jkey] END || ['concepts/gone-' || (i % 9), 'd' || k]), ',')"
_FIXED = "'# d' || i || chr(10) || CASE WHEN {live} THEN '[[' || lower(jkey) || '|an alias]]' ELSE 'an alias' END || ' gone ' || (i % 9) || ' d' || k || chr(10)"


@query(f"WITH {_W} SELECT key || '.md' AS path, {_GHOSTS.format(live='jlive')} AS ghosts, {_FIXED.format(live='jlive')} AS head FROM fj WHERE linked UNION ALL SELECT 'index.md', array_to_string(list_sort(list(t)), ','), '' FROM (VALUES ('summaries/d0', 0), ('concepts/d1', 1), ('concepts/d999999', 999999), ('/concepts/d1/', -1)) x(t, i) WHERE i NOT IN (SELECT doc_id FROM documents) HAVING count(*) > 0")
def link_repair(spark, d):
    """Pages with their dead links rewritten or turned to text; the head of the new body and the dead targets."""
    all_ = rows(spark, d)
    fixed = wiki.repaired(all_, wiki.targets(all_))
    body = fm.parts(F.col("text"))[1]
    head = F.when(F.col("path") == "index.md", "").otherwise(F.regexp_extract(body, r"\A\n(# [^\n]*\n[^\n]*\n)", 1))
    return fixed.select("path", F.array_join("ghosts", ",").alias("ghosts"), head.alias("head"))


@query(f"""
WITH {_W}, gone AS (SELECT * FROM w WHERE i % 7 = 1 AND folder <> 'summaries'), g AS (SELECT *, j IN (SELECT i FROM gone) AS hit FROM fj)
SELECT key || '.md' AS path, 'delete' AS action, CAST(NULL AS VARCHAR) AS ghosts FROM gone
UNION ALL SELECT key || '.md', 'modify', {_GHOSTS.format(live='false')} FROM g WHERE linked AND jlive AND hit AND j <> i AND i NOT IN (SELECT i FROM gone)
UNION ALL SELECT 'index.md', 'modify', array_to_string(list_sort(list(t)), ',') FROM (VALUES ('summaries/d0', 0), ('concepts/d1', 1), ('concepts/d999999', 999999), ('/concepts/d1/', -1)) x(t, i) WHERE i NOT IN (SELECT doc_id FROM documents) OR i IN (SELECT i FROM gone) HAVING count(*) > 0
""")
def page_deletion(spark, d):
    """Deleting every seventh concept or entity page: what goes, and which pages lose links."""
    all_ = rows(spark, d)
    i = F.regexp_extract("stem", "^d([0-9]+)$", 1).try_cast("long")
    plan = wiki.deletion(all_, all_.where(i % 7 == 1).select("path"))
    return plan.select("path", "action", F.array_join("ghosts", ",").alias("ghosts"))


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), w AS (SELECT doc_id AS i, CASE doc_id % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'concepts' ELSE 'entities' END || '/d' || doc_id AS key FROM documents WHERE doc_id % 9 = 4)
SELECT key || '.md' AS path, 'New text of [[' || key || ']], not there.' AS body, 'x/not-there' AS ghosts FROM w
""")
def page_edit(spark, d):
    """New bodies under the old front matter."""
    all_ = rows(spark, d)
    i = F.regexp_extract("stem", "^d([0-9]+)$", 1).try_cast("long")
    bodies = all_.where(i % 9 == 4).select("path", F.concat(F.lit("New text of [["), F.col("key"), F.lit("]], [[x/not-there]].")).alias("body"))
    block, body = fm.parts(F.col("text"))
    return wiki.edits(all_, bodies).where(block.isNotNull()).select("path", body.alias("body"), F.array_join("ghosts", ",").alias("ghosts"))


@query(f"WITH {_W} SELECT key || '.md' AS path, '# d' || i || chr(10) || '[[' || jkey || '|an alias]] gone ' || (i % 9) || ' [[d' || k || ']]' || chr(10) AS head FROM fj WHERE linked AND i % 9 < 3")
def withdrawn_links(spark, d):
    """Links to three withdrawn targets as plain text; all other dead links stay."""
    gone = spark.createDataFrame([("concepts/gone-0",), ("concepts/gone-1",), ("concepts/gone-2",)], "target string")
    body = fm.parts(F.col("text"))[1]
    return wiki.withdrawn_links(rows(spark, d), gone).select("path", F.regexp_extract(body, r"\A\n(# [^\n]*\n[^\n]*\n)", 1).alias("head"))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'concepts' ELSE 'entities' END || '/d' || doc_id || '.md' AS path, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE 1 END AS \"left\" FROM documents WHERE doc_id % 10 = 3")
def affected_pages(spark, d):
    return wiki.affected(rows(spark, d), "s3.pdf")


@query("""
SELECT CASE doc_id % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'concepts' ELSE 'entities' END || '/d' || doc_id || '.md' AS path, CASE WHEN doc_id % 8 = 0 THEN 'DELETE' ELSE 'MODIFY' END AS action, CASE WHEN doc_id % 8 <> 0 THEN 't.pdf' END AS sources
FROM documents WHERE doc_id % 10 = 4
""")
def document_removal(spark, d):
    """Pages of one source without it; those that have no other go."""
    out = wiki.without_document(rows(spark, d), "s4.pdf")
    return out.select("path", "action", F.array_join(fm.list_value(fm.parts(F.col("text"))[0], "sources"), ",").alias("sources"))


@query("""
SELECT CASE doc_id % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'concepts' ELSE 'entities' END || '/d' || doc_id AS key,
  CASE WHEN doc_id % 4 <> 1 THEN 'Concept' END AS type, CASE WHEN doc_id % 6 <> 2 THEN 'Text ' || doc_id END AS description, 's' || (doc_id % 10) || '.pdf' || CASE WHEN doc_id % 8 = 0 THEN '' ELSE ',t.pdf' END AS sources, sha256(chr(10) || '# d' || doc_id) AS head
FROM documents
""")
def front_fields(spark, d):
    """The fields of each page's front matter, and the start of its body."""
    read = wiki.knowledge(rows(spark, d))
    return read.select("key", fm.scalar(F.col("block"), "type").alias("type"), fm.scalar(F.col("block"), "description").alias("description"), F.array_join(fm.list_value(F.col("block"), "sources"), ",").alias("sources"), F.sha2(F.regexp_extract("body", r"\A(\n[^\n]*)", 1), 256).alias("head"))


@query("""
SELECT CASE doc_id % 3 WHEN 0 THEN 'summaries' WHEN 1 THEN 'concepts' ELSE 'entities' END || '/d' || doc_id AS key,
  '---' || chr(10) || CASE WHEN doc_id % 4 = 1 THEN 'type: 5' ELSE 'type: "Concept"' END || chr(10) || CASE WHEN doc_id % 6 = 2 THEN '' ELSE 'description: "New \\"' || doc_id || '\\""' || chr(10) END || CASE WHEN doc_id % 25 = 7 THEN 'title: a: b' || chr(10) ELSE '' END ||
  'sources: ["n.pdf", "s' || (doc_id % 10) || '.pdf"' || CASE WHEN doc_id % 8 = 0 THEN '' ELSE ', "t.pdf"' END || ']' || chr(10) || '---' || chr(10) AS block
FROM documents
""")
def front_rewrite(spark, d):
    """Front matter with a new description where there was one, and another source put first."""
    read = wiki.knowledge(rows(spark, d)).withColumn("i", F.substring("stem", 2, 20))
    told = F.rlike("block", F.lit("(?m)^description:"))
    block = F.when(told, fm.set_line(F.col("block"), "description", F.concat(F.lit('New "'), F.col("i"), F.lit('"')))).otherwise(F.col("block"))
    added = let(F.concat(block, F.col("body")), lambda t: fm.with_source(t, F.lit("n.pdf")))
    return read.select("key", let(added, lambda t: fm.parts(t)[0]).alias("block"))
