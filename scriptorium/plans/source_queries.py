"""Queries over units, trees, windows and text functions, derived from the lines of the documents and the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import checks
from scriptorium.functions import markdown as md
from scriptorium.functions import text as T
from scriptorium.operators import blocks, sequences, tree, units
from scriptorium.plans.catalogue import LINES
from scriptorium.plans.registry import query
from scriptorium.sources import office, table


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _lines(spark, d) -> DataFrame:
    return blocks.line_blocks(_docs(spark, d)).select("doc_id", "ord", "text")


def _level():
    """Short lines count as headings of three levels."""
    return F.when(F.length("text") < 40, 1 + F.col("ord") % 3)


_HEADS = f"""
{LINES}, h AS (SELECT doc_id, ord, text, CASE WHEN length(text) < 40 THEN 1 + ord % 3 END AS level FROM line),
p AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER w AS p1, max(CASE WHEN level = 2 THEN ord END) OVER w AS p2, max(CASE WHEN level = 3 THEN ord END) OVER w AS p3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
path AS (SELECT *, concat_ws(',', p1, CASE WHEN p2 > coalesce(p1, -1) THEN p2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN p3 END) AS open FROM p)
"""


@query(f"WITH {_HEADS} SELECT doc_id, ord, open FROM path")
def heading_paths(spark, d):
    """The open headings above each line."""
    return units.heading_paths(_lines(spark, d), _level(), F.col("text")).select("doc_id", "ord", F.array_join("heading_ords", ",").alias("open"))


@query(f"""
WITH {_HEADS}, s AS (SELECT *, unnest(range(0, length(text), 150)) AS a, lag(CASE WHEN text <> '' THEN right(text, 128) END) OVER w AS prev, lead(CASE WHEN text <> '' THEN left(text, 128) END) OVER w AS next FROM path WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, CAST(a AS INTEGER) AS start, CAST(least(a + 150, length(text)) AS INTEGER) AS "end", CASE WHEN open = '' THEN 0 ELSE len(string_split(open, ',')) END AS headings, sha256(substring(text, a + 1, 150)) AS digest,
  CASE WHEN a > 0 THEN substring(text, greatest(1, a - 127), least(128, a)) ELSE prev END AS before, CASE WHEN a + 150 < length(text) THEN substring(text, a + 151, 128) ELSE next END AS after
FROM s
""")
def source_units(spark, d):
    """Lines cut to spans that fit, with their headings and neighbours."""
    made = units.source_units(_lines(spark, d), 150, _level(), F.col("text"))
    return made.select("doc_id", "ord", "start", "end", F.size("headings").alias("headings"), F.sha2("text", 256).alias("digest"), "before", "after")


@query(r"""
WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
s AS (SELECT doc_id, 0 AS a, 0 AS b, n FROM t
  UNION ALL SELECT doc_id, b, CASE WHEN b + 900 >= n THEN n WHEN nl > 450 THEN b + nl + 1 ELSE b + 900 END, n
  FROM (SELECT s.doc_id, s.b, s.n, 899 - strpos(reverse(substring(t.text, s.b + 1, 900)), chr(10)) + CASE WHEN contains(substring(t.text, s.b + 1, 900), chr(10)) THEN 1 ELSE -2000 END AS nl FROM s JOIN t USING (doc_id) WHERE s.b < s.n) x)
SELECT doc_id, a AS start, b AS "end" FROM s WHERE b > a
""")
def text_spans(spark, d):
    """Whole texts in spans of at most 900 characters, cut after a line where one ends past the half."""
    cut = _docs(spark, d).select("doc_id", F.explode(units.spans(900)("text")).alias("s"))
    return cut.select("doc_id", "s.start", "s.end")


@query(f"WITH {LINES}, k AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM line) SELECT doc_id, ord, CASE WHEN n > 1 THEN CASE WHEN k > n // 2 THEN 1 ELSE 0 END END AS half FROM k")
def batch_halves(spark, d):
    return units.halved(_lines(spark, d).select("doc_id", "ord"), "doc_id", "ord")


@query("""
WITH t AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS h, reverse(substring(text, 1, length(text) // 2)) AS r FROM documents WHERE length(text) >= 2),
m AS (SELECT *, CASE WHEN strpos(r, chr(10)) > 0 AND h - strpos(r, chr(10)) > h // 2 THEN h - strpos(r, chr(10)) + 1 ELSE h END AS m FROM t),
p AS (SELECT doc_id, text, n, 0 AS part, 0 AS a, m AS b FROM m UNION ALL SELECT doc_id, text, n, 1, m, n FROM m)
SELECT doc_id AS id, part, a AS start, b AS "end", sha256(substring(text, a + 1, b - a)) AS digest, CASE WHEN a > 0 THEN length(substring(text, greatest(0, a - 128) + 1, least(a, 128))) END AS before, CASE WHEN b < n THEN substring(text, b + 1, 128) END AS after FROM p
""")
def span_halves(spark, d):
    """Every text as two spans with what stands on both sides."""
    made = units.split_spans(_docs(spark, d).select(F.col("doc_id").alias("id"), F.lit(0).alias("start"), "text"))
    return made.select("id", "part", "start", "end", F.sha2("text", 256).alias("digest"), F.length("before").alias("before"), "after")


@query("""
WITH t AS (SELECT doc_id, text, source || ' ' || lang AS c, (doc_id * 37) % (length(text) + length(source || ' ' || lang) + 3) AS s FROM documents),
w AS (SELECT doc_id, length(text) AS n, length(c) AS m, s, length(substring(text, least(s, length(text)) + 1, 200)) AS a, text, c FROM t WHERE s <= length(text) + length(c))
SELECT doc_id, s AS start, a AS chars, length(substring(c, greatest(0, s - n) + 1, 200 - a)) AS context_chars, greatest(0, s - n) AS context_start, s + a + length(substring(c, greatest(0, s - n) + 1, 200 - a)) >= n + m AS complete,
  CASE WHEN s + a + length(substring(c, greatest(0, s - n) + 1, 200 - a)) < n + m THEN s + a + length(substring(c, greatest(0, s - n) + 1, 200 - a)) END AS next_start
FROM w
""")
def original_window(spark, d):
    """A window of 200 characters over text and context from a cursor of each document."""
    context = F.concat_ws(" ", "source", "lang")
    read = _docs(spark, d).withColumn("start", (F.col("doc_id") * 37 % (F.length("text") + F.length(context) + 3)).cast("int"))
    made = read.withColumn("w", units.window(F.col("text"), context, F.col("start"), 200)).where("w is not null")
    return made.select("doc_id", "start", F.length("w.text").alias("chars"), F.length("w.context").alias("context_chars"), "w.context_start", "w.complete", "w.next_start")


@query("""
WITH r AS (SELECT conv_id AS batch, turn AS ord, conv_id * 7 + turn AS id, length(text) % 50 AS "offset", CASE WHEN turn = 3 THEN 0 ELSE 3000 + turn END AS "limit" FROM conversations),
k AS (SELECT *, row_number() OVER w AS k, sum("limit") OVER w AS total FROM r WINDOW w AS (PARTITION BY batch ORDER BY ord)),
j AS (SELECT k.*, d.text AS t, d.doc_id FROM k LEFT JOIN documents d ON d.doc_id = k.id)
SELECT batch, ord, CASE WHEN k > 4 OR total > 16000 THEN 'too_many' WHEN t IS NULL THEN 'not_found' WHEN "limit" < 1 OR "offset" > length(t) THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN k <= 4 AND total <= 16000 AND "limit" >= 1 AND "offset" <= length(t) THEN sha256(substring(t, "offset" + 1, "limit")) END AS digest, CASE WHEN k <= 4 AND total <= 16000 AND "limit" >= 1 AND "offset" + "limit" < length(t) THEN "offset" + "limit" END AS next_offset
FROM j
""")
def read_batches(spark, d):
    """Up to four reads a conversation, each with its own error."""
    c = table(spark, d, "conversations")
    limit = F.when(F.col("turn") == 3, 0).otherwise(3000 + F.col("turn")).cast("int")
    requests = c.select(F.col("conv_id").alias("batch"), F.col("turn").alias("ord"), (F.col("conv_id") * 7 + F.col("turn")).alias("id"), (F.length("text") % 50).alias("offset"), limit.alias("limit"))
    read = units.read_batch(requests, _docs(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return read.select("batch", "ord", "status", F.sha2("text", 256).alias("digest"), "next_offset")


@query()
def topic_windows(spark, d):
    """The chunks of long texts that hold most words of a topic; a greedy pick, held against a plain loop in the tests."""
    return units.existing_windows(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "the first results of a long report", 1000)


@query()
def title_passages(spark, d):
    """The lines of each document that fit a small budget, ranked by a title's words; a greedy pick, held against a plain loop in the tests."""
    rows = _lines(spark, d).select(F.col("doc_id").alias("topic"), "ord", (F.col("ord") % 4).alias("scope"), "text", F.concat(F.lit("part "), (F.col("ord") % 4).cast("string")).alias("headings"))
    return units.bounded_passages(rows, "The first results", 600)


_TREE = f"""
{LINES}, h AS (SELECT doc_id, ord, text, CASE WHEN length(text) < 40 THEN 1 + ord % 3 END AS level, max(ord + 1) OVER (PARTITION BY doc_id) AS total FROM line),
s AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS INTEGER) AS node, ord AS start, coalesce(level, 1) AS level, total FROM h WHERE ord = 0 OR level IS NOT NULL),
tree AS (SELECT doc_id, 0 AS node, CAST(NULL AS BIGINT) AS parent, 0 AS start, max(total) AS "end", 0 AS level FROM h GROUP BY doc_id
  UNION ALL SELECT a.doc_id, a.node, (SELECT coalesce(max(b.node), 0) FROM s b WHERE b.doc_id = a.doc_id AND b.node < a.node AND b.level < a.level), a.start, coalesce((SELECT min(b.start) FROM s b WHERE b.doc_id = a.doc_id AND b.node > a.node AND b.level <= a.level), a.total), a.level FROM s a)
"""


def _tree(spark, d) -> DataFrame:
    return tree.basic_tree(_lines(spark, d), _level())


@query(f"WITH {_TREE} SELECT doc_id, node, CAST(parent AS INTEGER) AS parent, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", CAST(level AS INTEGER) AS level FROM tree")
def basic_tree(spark, d):
    """Nested nodes over the lines: levels, parents and ranges."""
    return _tree(spark, d).select("doc_id", "node", "parent", "start", "end", "level")


@query(f"""
WITH {_TREE} SELECT doc_id, node, 'range' AS fault FROM tree WHERE node = 1 AND doc_id % 10 = 3
UNION ALL SELECT doc_id, node, 'parent' FROM tree WHERE node > 0 AND doc_id % 10 = 4 AND parent = 1
""")
def node_faults(spark, d):
    """Trees with a range past the end in some documents and a lost parent in others."""
    made = _tree(spark, d).select("doc_id", "node", "parent", "start", F.when((F.col("node") == 1) & (F.col("doc_id") % 10 == 3), 10**6).otherwise(F.col("end")).alias("end"))
    lost = made.withColumn("parent", F.when((F.col("doc_id") % 10 == 4) & (F.col("parent") == 1), 10**6).otherwise(F.col("parent")))
    totals = _lines(spark, d).groupBy("doc_id").agg((F.max("ord") + 1).alias("total"))
    found = tree.node_faults(lost, totals)
    # A child of the widened node lies inside it, so only the two kinds of faults remain.
    return found.where("fault in ('range', 'parent')")


@query(f"""
WITH RECURSIVE {_TREE}, walk AS (SELECT doc_id, node, 1 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.node, w.depth + 1 FROM walk w JOIN tree t ON t.doc_id = w.doc_id AND t.parent = w.node)
SELECT doc_id, node, depth, node + 1 AS place FROM walk
""")
def tree_preorder(spark, d):
    """Depth and place of each node in a walk; nodes are numbered by start, which is that order."""
    return tree.preorder(_tree(spark, d)).select("doc_id", "node", "depth", "place")


@query("""
WITH RECURSIVE s AS (SELECT doc_id AS style, CASE WHEN doc_id % 11 = 10 THEN doc_id ELSE doc_id // 2 END AS parent, CASE WHEN doc_id % 13 = 5 THEN doc_id % 9 + 1 END AS level FROM documents),
r AS (SELECT style, parent, level, 0 AS hops FROM s UNION ALL SELECT r.style, s.parent, s.level, hops + 1 FROM r JOIN s ON s.style = r.parent WHERE r.level IS NULL AND hops < 32)
SELECT style, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY style
""")
def style_levels(spark, d):
    """Levels inherited along chains of styles, some of which end in a circle."""
    i = F.col("doc_id")
    styles = _docs(spark, d).select(i.alias("style"), F.when(i % 11 == 10, i).otherwise(F.floor(i / 2)).alias("parent"), F.when(i % 13 == 5, (i % 9).cast("int")).alias("level"))
    return tree.style_levels(styles)


@query(f"""
WITH {LINES}, m AS (SELECT doc_id, ord, length(text) - length(replace(text, '|', '')) AS n FROM line WHERE contains(text, '|'))
SELECT doc_id, CAST(sum(n) AS BIGINT) AS markers, sha256('[' || array_to_string(list('[' || ord || ',' || n || ']' ORDER BY ord), ',') || ']') AS digest FROM m GROUP BY doc_id
""")
def marker_digest(spark, d):
    return tree.marker_digest(_lines(spark, d), r"\|")


@query(f"WITH {LINES} SELECT doc_id, sha256(array_to_string(list('<a id=\"block-' || substring(sha256(doc_id || '/' || ord), 1, 12) || '\"></a>' || chr(10) || chr(10) || text ORDER BY ord), chr(10) || chr(10))) AS digest FROM line GROUP BY doc_id")
def snapshot(spark, d):
    """One Markdown text for each document, with an anchor before each line."""
    made = _lines(spark, d).withColumn("block_id", F.substring(F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("ord").cast("string")), 256), 1, 12))
    return office.snapshot_markdown(made).select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {LINES}, p AS (SELECT doc_id, ord, CASE WHEN ord % 3 = 2 THEN '' ELSE trim(text) END AS c FROM line) SELECT doc_id, count(*) AS pages, sha256(coalesce(array_to_string(list(c ORDER BY ord) FILTER (WHERE c <> ''), chr(10) || chr(10) || '---' || chr(10) || chr(10)), '')) AS digest FROM p GROUP BY doc_id")
def joined_pages(spark, d):
    """Lines as the pages of a saved document, every third one empty."""
    made = _lines(spark, d).select("doc_id", F.col("ord").alias("page"), F.when(F.col("ord") % 3 == 2, "").otherwise(F.col("text")).alias("content"))
    return office.document_text(made).select("doc_id", "pages", F.sha2("text", 256).alias("digest"))


@query(f"WITH {LINES} SELECT doc_id, sha256(array_to_string(list('[Page ' || (ord + 1) || ']' || chr(10) || text || CASE WHEN ord % 2 = 0 THEN chr(10) || 'Images: i' || ord || '.png' ELSE '' END ORDER BY ord), chr(10) || chr(10))) AS digest FROM line WHERE ord + 1 IN (2, 3, 4, 7) GROUP BY doc_id")
def page_contents(spark, d):
    """The pages ``2-4,7`` of each document with their images."""
    images = F.when(F.col("ord") % 2 == 0, F.array(F.concat(F.lit("i"), F.col("ord").cast("string"), F.lit(".png")))).otherwise(F.array().cast("array<string>"))
    made = _lines(spark, d).select("doc_id", (F.col("ord") + 1).alias("page"), F.col("text").alias("content"), images.alias("images"))
    return office.page_contents(made, T.page_ranges(F.lit("2-4,7"))).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""
SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN 'A' || CASE WHEN turn % 2 = 0 THEN 'B ' || text ELSE '' END WHEN turn % 3 = 1 THEN text || ' `<think>`' ELSE text END) AS shown FROM conversations
""")
def visible_answers(spark, d):
    """Turns with reasoning around parts of them: nested, unfinished, and in code."""
    t = F.col("turn")
    said = F.when((t % 3 == 0) & (t % 2 == 0), F.concat(F.lit("A<think>x<ANALYSIS>y</analysis>z</think>B "), "text")).when(t % 3 == 0, F.concat(F.lit("A< reasoning >"), "text")).when(t % 3 == 1, F.concat("text", F.lit(" `<think>`"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", md.visible_answer(said).alias("shown"))


@query("""
WITH c AS (SELECT doc_id, '[evidence:' || substring(sha256(source || '/' || doc_id), 1, 16) || ']' AS m FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'See (' || doc_id || ') and `' || m || '`.' ELSE 'See ' || m || ' and `' || m || '`.' END AS text FROM c
""")
def cited_answers(spark, d):
    """Citation markers replaced where their target is known, not in code."""
    mark = T.short_citation(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    known = F.when(F.col("doc_id") % 3 == 0, F.array(F.array(F.col("m"), F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(")"))))).otherwise(F.array().cast("array<array<string>>"))
    made = _docs(spark, d).withColumn("m", mark).withColumn("answer", F.concat(F.lit("See "), "m", F.lit(" and `"), "m", F.lit("`.")))
    return made.select("doc_id", md.render_citations(F.col("answer"), known).alias("text"))


@query("SELECT doc_id, sha256('### d' || doc_id || chr(10) || '```' || chr(10) || '# x' || chr(10) || '```' || chr(10) || '### Under' || chr(10) || text_) AS digest FROM (SELECT doc_id, 'end ' || lang AS text_ FROM documents)")
def local_headings(spark, d):
    made = _docs(spark, d).select("doc_id", F.concat(F.lit("# d"), F.col("doc_id").cast("string"), F.lit("\n```\n# x\n```\nUnder\n=====\nend "), "lang").alias("t"))
    return made.select("doc_id", F.sha2(md.local_headings("t"), 256).alias("digest"))


@query("WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM e GROUP BY page_id")
def page_links(spark, d):
    """Links of each page's HTML, read by a parser."""
    found = table(spark, d, "pages").select("page_id", F.explode(md.link_targets("html")).alias("href"))
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sources/d ' || doc_id || '.md' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE NULL END AS path, CASE doc_id % 4 WHEN 0 THEN 'q=1' WHEN 1 THEN '' END AS query, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'block-' || doc_id END AS fragment FROM documents
""")
def source_links(spark, d):
    """Links of answers as places in sources; others are null."""
    i = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a/../sources/d%20"), i, F.lit(".md?q=1"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("x#block-"), i)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("http://a/sources/"), i)).otherwise(F.concat(F.lit("other/"), i))
    return _docs(spark, d).select("doc_id", md.source_place(link).alias("p")).select("doc_id", "p.path", "p.query", "p.fragment")


@query("""
WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages), s AS (SELECT page_id, title, substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM t)
SELECT page_id, CASE WHEN slug = '' THEN substring(sha256(title), 1, 12) ELSE slug END AS slug FROM s
""")
def title_slugs(spark, d):
    """File names of all pages by their titles, cut names and titles without letters too."""
    from scriptorium.sources.pages import page_title

    return table(spark, d, "pages").select("page_id", md.slug(page_title(F.col("html"))).alias("slug"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)([^?#]*)', 1) AS host, regexp_extract(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '([^/]*)$', 1) AS last FROM pages),
s AS (SELECT page_id, regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'Final report (' || page_id || ')' WHEN last <> '' THEN last ELSE host END, '(?i)\.pdf$', '') AS s FROM u)
SELECT page_id, substring(trim(regexp_replace(regexp_replace(s, '[^A-Za-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '-._'), 1, 80) || '.pdf' AS name FROM s
""")
def download_names(spark, d):
    """PDF names of pages, by a header for every third one."""
    header = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("attachment; filename*=UTF-8''Final%20report%20%28"), F.col("page_id").cast("string"), F.lit("%29.pdf; filename=\"x.pdf\"")))
    return table(spark, d, "pages").select("page_id", T.download_name(F.col("url"), header).alias("name"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Plan ' || doc_id WHEN 1 THEN 'Plan ' || doc_id WHEN 2 THEN 'Plan ' || doc_id WHEN 3 THEN 'Plan ' || doc_id ELSE 'copy of' END AS label FROM documents")
def document_labels(spark, d):
    """Names with copy marks of several kinds."""
    i = F.col("doc_id").cast("string")
    kinds = ["Copy of Plan %s.pdf", "a/Plan %s-copy-2.docx", "Plan %s（副本 3）.md", "Plan %s [copy].txt"]
    name = F.lit("copy of.pdf")
    for k, form in enumerate(kinds):
        name = F.when(F.col("doc_id") % 5 == k, F.replace(F.lit(form), F.lit("%s"), i)).otherwise(name)
    return _docs(spark, d).select("doc_id", T.document_label(name).alias("label"))


_ADDRESS = "CASE WHEN doc_id % 7 = 0 THEN 'XFE1' WHEN doc_id % 7 = 1 THEN 'a1' ELSE chr(CAST(65 + doc_id % 26 AS INTEGER)) || (1 + doc_id % 30) END"


@query(f"""
WITH c AS (SELECT doc_id, {_ADDRESS} AS a, doc_id % 7 AS k, doc_id % 26 + 1 AS col, 1 + doc_id % 30 AS row FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'sheet' WHEN k < 2 THEN 'cell' WHEN doc_id % 4 = 1 THEN 'range' WHEN doc_id % 4 = 2 AND (col > 10 OR row > 20) THEN 'outside' END AS fault FROM c
""")
def sheet_faults(spark, d):
    """Worksheet places with malformed cells, ranges and sheets."""
    i = F.col("doc_id")
    address = F.when(i % 7 == 0, "XFE1").when(i % 7 == 1, "a1").otherwise(F.concat(F.char(65 + i % 26), (1 + i % 30).cast("string")))
    region = F.when(i % 4 == 1, "A1-B2").when(i % 4 == 2, "A1:J20")
    return _docs(spark, d).select("doc_id", checks.sheet_fault(F.when(i % 9 != 0, F.lit("S")), F.lit(1), address, region).alias("fault"))


@query("""
SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'kind' WHEN 2 THEN 'field' WHEN 3 THEN 'page' WHEN 4 THEN 'position' WHEN 5 THEN 'box' WHEN 6 THEN 'slide' WHEN 7 THEN 'attachment' END AS fault FROM documents
""")
def location_faults(spark, d):
    """Places of every kind of fault, and sound ones."""
    i = F.col("doc_id")
    forms = ['{"kind":"pdf","page":1%s,"bbox":[0,0.5,1,2]}', '{"kind":"odt"}', '{"kind":"text","line":1,"colour":2}', '{"kind":"pdf"}', '{"kind":"docx","paragraph":0}', '{"kind":"pdf","page":2,"bbox":[3,0,1,2]}', '{"kind":"pptx"}', '{"kind":"docx","attachment":{"part":"a","name":"","blob":"x","position":{}}}']
    place = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        place = F.when(i % 8 == k, F.replace(F.lit(form), F.lit("%s"), i.cast("string"))).otherwise(place)
    return _docs(spark, d).select("doc_id", checks.location_fault(place).alias("fault"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 3 THEN 'count' WHEN event_id % 11 = 4 THEN 'timeout' WHEN event_id % 11 = 5 THEN 'usage' END AS fault,
  CAST(value AS BIGINT) + 100 <= 150 AND CAST(floor(value) AS BIGINT) > 0 AND CAST(floor(value) AS BIGINT) + 100 <= 150 AS admitted FROM (SELECT event_id, floor(value) AS value FROM events)
""")
def request_checks(spark, d):
    """Requests that break a rule, and whether they fit their context."""
    i, n = F.col("event_id"), F.floor("value").cast("long")
    usage = F.when(i % 11 == 5, F.create_map(F.lit("input"), n)).when(i % 2 == 0, F.create_map(F.lit("input"), n, F.lit("output"), n))
    fault = checks.request_fault(F.lit("facts"), [F.when(i % 11 == 3, F.lit(-1).cast("long")).otherwise(n)], F.when(i % 11 == 4, 0.0).otherwise(F.lit(30.0)), usage)
    return table(spark, d, "events").select("event_id", fault.alias("fault"), checks.admitted(n, F.lit(100).cast("long"), F.lit(150).cast("long")).alias("admitted"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"a":"x","n":' || doc_id || '}' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE '[' || doc_id || ']' END AS value FROM documents
""")
def strict_answers(spark, d):
    """Answers as canonical JSON: fences off, repeated keys and bare values refused."""
    i = F.col("doc_id").cast("string")
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('```json\n{"n": '), i, F.lit(', "a": "x"}\n```'))).when(F.col("doc_id") % 4 == 1, F.lit('{"a":1,"a":2}')).when(F.col("doc_id") % 4 == 2, i).otherwise(F.concat(F.lit("["), i, F.lit("]")))
    return _docs(spark, d).select("doc_id", checks.strict_json(said).alias("value"))


@query("SELECT doc_id, array_to_string(['u' || doc_id, '[\"v\",{\"w\":\"x\"}]', 'v', 'x'], '/') AS strings FROM documents")
def observed_strings(spark, d):
    said = F.to_json(F.struct(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("a"), F.lit('["v",{"w":"x"}]').alias("b"), F.lit(1).alias("c")))
    return _docs(spark, d).select("doc_id", F.array_join(checks.observed_strings(said), "/").alias("strings"))


@query("WITH f AS (SELECT source, lang, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY source, lang) SELECT source, lang, 's' || row_number() OVER (ORDER BY first) AS label, n FROM f")
def scope_groups(spark, d):
    """Documents grouped by source and language, numbered by first appearance."""
    from scriptorium.operators import status

    return status.scope_groups(_docs(spark, d), ["source", "lang"], "doc_id").select("source", "lang", "label", F.size("occurrences").cast("long").alias("n"))


@query("WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text), l AS (SELECT text, 'r' || row_number() OVER (ORDER BY first) AS label FROM f) SELECT doc_id, label FROM documents JOIN l USING (text)")
def encoded_identities(spark, d):
    """Texts replaced by labels in order of first use."""
    from scriptorium.operators import status

    wire, _ = status.encoded(_docs(spark, d).select("doc_id", F.sha2("text", 256).alias("identity")), "identity", "doc_id")
    return wire.select("doc_id", F.col("identity").alias("label"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events")
def numbered_events(spark, d):
    """Places in one order over the whole table, counted by ranges."""
    return sequences.numbered(table(spark, d, "events").select("event_id"), "event_id").select("event_id", F.col("place").cast("long").alias("place"))
