"""Queries over topics, sections, owned ranges, caches and proposals, derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import blocks, knowledge, search
from scriptorium.plans.catalogue import LINES
from scriptorium.plans.registry import query
from scriptorium.plans.source_queries import _TREE, _tree
from scriptorium.sources import table


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _id(prefix: str):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"))


def _groups(spark, d) -> DataFrame:
    """A group for each document with its first line and a bucket as labels; its members are its words' initials."""
    i = F.col("doc_id")
    labels = F.array(F.concat(F.lit(" Line "), F.split_part("text", F.lit("\n"), F.lit(1))), F.concat(F.lit("BUCKET "), F.floor(i / 7).cast("string")), F.lit(""))
    return _docs(spark, d).select(i.alias("group"), labels.alias("labels"), F.concat(F.lit("concepts/p"), (i % 9).cast("string")).alias("path"), F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda k: F.concat(_id("m"), F.lit("-"), k.cast("string"))).alias("members"))


@query()
def topic_clusters(spark, d):
    """Groups that share a label directly or through others; held against a plain union in the tests."""
    return knowledge.label_clusters(_groups(spark, d).select("group", "labels"))


@query("""
WITH RECURSIVE g AS (SELECT doc_id AS "group", doc_id // 7 AS cluster, 'concepts/p' || (doc_id % 9) AS path, doc_id % 4 + 1 AS n FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY path, "group") AS k FROM g WHERE cluster IN (SELECT cluster FROM g GROUP BY cluster HAVING count(*) > 1)),
f AS (SELECT cluster, "group", k, n AS total, 0 AS w FROM o WHERE k = 1
  UNION ALL SELECT o.cluster, o."group", o.k, CASE WHEN f.total + o.n > 6 THEN o.n ELSE f.total + o.n END, CASE WHEN f.total + o.n > 6 THEN f.w + 1 ELSE f.w END FROM f JOIN o ON o.cluster = f.cluster AND o.k = f.k + 1)
SELECT cluster, "group", CAST(w AS INTEGER) AS "window" FROM f
""")
def candidate_windows(spark, d):
    """The windows of each cluster of seven, in order."""
    groups = _groups(spark, d)
    clusters = groups.select("group", F.floor(F.col("group") / 7).alias("cluster"))
    return knowledge.candidate_windows(groups, clusters, 6).select("cluster", "group", "window")


@query()
def reconciled_topics(spark, d):
    """Topics of the documents' first words that share a label or a path, merged within windows of twelve members; a plain version says the same in the tests."""
    docs = _docs(spark, d).where("text is not null")
    head = F.lower(F.regexp_extract("text", r"(\w+)", 1))
    groups = docs.select(F.col("doc_id").alias("group"), F.concat(F.lit("concepts/"), head).alias("path"), head.alias("name"), F.array(F.concat_ws(" ", head, "lang")).alias("labels"), F.array(_id("m")).alias("members"))

    def merged(rows):
        """Windows of one path become one group; others can't be decided."""
        one = rows.groupBy("cluster", "window").agg(F.min("path").alias("path"), F.max("path").alias("last"), F.min("name").alias("name"), F.array_sort(F.flatten(F.collect_list("members"))).alias("members"))
        return one.where("path = last")

    return knowledge.reconciled(groups, 12, merged).select("path", "name", F.size("members").alias("n"), F.sha2(F.array_join(F.array_sort("members"), ","), 256).alias("digest"))


@query("SELECT 'm' || doc_id || '-' || 0 AS member, 1 AS n_before, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_after FROM documents WHERE doc_id % 5 < 2")
def member_balance(spark, d):
    """Members that a reconciliation has lost or doubled."""
    i = F.col("doc_id")
    before = _docs(spark, d).select("doc_id", F.array(F.concat(_id("m"), F.lit("-0"))).alias("members"))
    after = before.where(i % 5 != 0).unionByName(before.where(i % 5 == 1))
    return knowledge.members_conserved(before, after)


@query("""
WITH t AS (SELECT 'concepts/p' || (doc_id % 40) AS path, 'm' || doc_id AS m FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY m) AS k FROM t)
SELECT m, CASE WHEN k = 1 THEN path ELSE path || '-' || substring(sha256(m), 1, 12) END AS name FROM k
""")
def topic_paths(spark, d):
    """Paths of topics that collide."""
    topics = _docs(spark, d).select(F.concat(F.lit("concepts/p"), (F.col("doc_id") % 40).cast("string")).alias("path"), F.array(_id("m")).alias("members"))
    return knowledge.unique_paths(topics).select(F.get("members", F.lit(0)).alias("m"), "name")


@query("""
SELECT doc_id, '# I' || chr(10) || '## Documents' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '- [[a]] new' || chr(10) || '- [[b]]' WHEN doc_id % 3 = 1 THEN '- [[a]] new' || chr(10) || '- [[c]]' ELSE '- [[b]]' END || chr(10) || '## Concepts ' || chr(10) || '- [[a]]' AS text FROM documents
""")
def catalogue_entries(spark, d):
    """Entries of a catalogue's section replaced, put first, or removed; the same link in another section stays."""
    k = F.col("doc_id") % 3
    body = F.when(k == 0, "- [[a]] old\n- [[b]]").when(k == 1, "- [[c]]").otherwise("- [[a]]\n- [[b]]")
    made = _docs(spark, d).select("doc_id", F.concat(F.lit("# I\n## Documents\n"), body, F.lit("\n## Concepts \n- [[a]]")).alias("t"))
    mark = F.lit("- [[a]]")
    return made.select("doc_id", F.when(k < 2, knowledge.upsert_entry(F.col("t"), "## Documents", mark, F.lit("- [[a]] new"))).otherwise(knowledge.remove_entry(F.col("t"), "## Documents", mark)).alias("text"))


@query("""
WITH e AS (SELECT 'Documents' AS h, 1 AS p, 'summaries/d' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS link, lang AS kind, 'chars ' || n_chars AS brief FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'Concepts', 2, 'concepts/d' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), NULL, NULL FROM documents WHERE doc_id % 2 = 1),
s AS (SELECT h, p, '## ' || h || chr(10) || array_to_string(list('- [[' || link || ']]' || coalesce(' (' || kind || ')', '') || coalesce(' — ' || brief, '') ORDER BY link), chr(10)) AS t FROM e GROUP BY h, p)
SELECT sha256(array_to_string(list(t ORDER BY p), chr(10) || chr(10))) AS digest FROM s
""")
def catalogue_text(spark, d):
    """The whole catalogue of documents and concepts as one text."""
    i, name = F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0")
    none = F.lit(None).cast("string")
    entries = _docs(spark, d).select(F.when(i % 2 == 0, "Documents").otherwise("Concepts").alias("heading"), F.concat(F.when(i % 2 == 0, "summaries/d").otherwise("concepts/d"), name).alias("link"), F.when(i % 2 == 0, F.col("lang")).otherwise(none).alias("kind"), F.when(i % 2 == 0, F.concat(F.lit("chars "), F.col("n_chars").cast("string"))).otherwise(none).alias("brief"))
    return knowledge.catalogue_text(entries, ["Documents", "Concepts"]).select(F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a<!-- source:x -->x<!-- /source:x -->  c' WHEN 1 THEN 'plain' ELSE NULL END AS text FROM documents")
def withdrawn_ranges(spark, d):
    """Texts without the range of one owner; repeated and nested ranges are refused."""
    k = F.col("doc_id") % 4
    other = "a<!-- source:x -->x<!-- /source:x --> "
    text = F.when(k == 0, other + "<!-- source:s -->b<!-- /source:s --> c").when(k == 1, "plain").when(k == 2, "<!-- source:s -->b<!-- /source:s --><!-- source:s --><!-- /source:s -->").otherwise("<!-- source:s --><!-- source:x --><!-- /source:x --><!-- /source:s -->")
    return _docs(spark, d).select("doc_id", knowledge.without_range(text, F.lit("s")).alias("text"))


@query("SELECT doc_id % 20 AS batch, doc_id AS ord, doc_id % 17 <> 3 AS ok FROM documents")
def split_retries(spark, d):
    """Batches with a row that always fails are halved until only that row is left."""
    work = _docs(spark, d).select((F.col("doc_id") % 20).cast("string").alias("batch"), F.col("doc_id").alias("ord"))
    done, failed = knowledge.split_retry(work, lambda b: b.groupBy("batch").agg(F.bool_and(F.col("ord") % 17 != 3).alias("ok")))
    out = done.withColumn("ok", F.lit(True)).unionByName(failed.withColumn("ok", F.lit(False)))
    return out.select(F.split_part("batch", F.lit("/"), F.lit(1)).cast("long").alias("batch"), "ord", "ok")


@query("SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN 'r' || length(text) END AS result FROM documents")
def checkpoint_reuse(spark, d):
    """Results kept by content, found again for every text of that content."""
    docs = _docs(spark, d).select("doc_id", "text")
    held = docs.where(F.length("text") % 3 == 0).select(F.sha2("text", 256).alias("key"), F.concat(F.lit("r"), F.length("text").cast("string")).alias("result"))
    found, _ = knowledge.cached(docs, held, F.sha2("text", 256))
    return found.select("doc_id", "result")


@query("""
SELECT source AS proposal, CASE WHEN bool_or(doc_id % 31 = 4) THEN 'input_conflict' WHEN bool_or(doc_id % 29 = 5) THEN 'needs_acceptance' ELSE 'published' END AS state FROM documents GROUP BY source
""")
def publications(spark, d):
    """Proposals whose pages have changed meanwhile, or are protected."""
    i = F.col("doc_id")
    docs = _docs(spark, d)
    asked = docs.select(F.col("source").alias("proposal"), _id("p").alias("path"), F.when(i % 31 == 4, "old").when(i % 6 != 0, F.sha2("text", 256)).alias("before"), (i % 29 == 5).alias("protected"))
    return knowledge.publication(asked, docs.where((i % 6 != 0)).select(_id("p").alias("path"), F.sha2("text", 256).alias("digest")))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1 +1,2 @@' || chr(10) || ' a' || chr(10) || '+' || lang || chr(10) WHEN 1 THEN '' END AS diff FROM documents")
def proposal_diffs(spark, d):
    """Differences of pages, none where they are equal, an error where they are too long."""
    k = F.col("doc_id") % 3
    new = F.when(k == 0, F.concat(F.lit("a\n"), "lang", F.lit("\n"))).when(k == 1, "a\n").otherwise(F.expr("repeat('b\n', 200)"))
    return _docs(spark, d).select("doc_id", knowledge.page_diffs(300)(F.lit("a\n"), new).alias("diff"))


@query("SELECT doc_id % 50 AS doc_id, count(*) AS n, sha256(string_agg(stage || '/' || reason, ',' ORDER BY stage, reason)) AS digest FROM (SELECT doc_id, lang AS stage, source AS reason FROM documents) GROUP BY doc_id % 50")
def omission_lists(spark, d):
    """Omissions in order, repeats kept."""
    rows = _docs(spark, d).select((F.col("doc_id") % 50).alias("doc_id"), F.col("lang").alias("stage"), F.col("source").alias("reason"), F.array(F.lit("i")).alias("items"))
    listed = knowledge.omission_rows(rows)
    return listed.select("doc_id", F.size("omissions").cast("long").alias("n"), F.sha2(F.array_join(F.transform("omissions", lambda o: F.concat_ws("/", o["stage"], o["reason"])), ","), 256).alias("digest"))


@query(f"""
WITH {LINES}, f AS (SELECT doc_id, ord, text, CASE WHEN ord % 4 = 0 THEN left(text, 20) WHEN ord % 4 = 1 THEN 'nowhere to be found' END AS q, CASE WHEN ord % 4 = 2 THEN 'said why' END AS reason FROM line)
SELECT doc_id, ord, CASE WHEN ord % 4 = 3 THEN 'no reason' WHEN ord % 4 = 2 AND regexp_matches(text, '(?i)\\d|\\b(must|shall|should|required|never|only)\\b') THEN 'binding text without facts' WHEN ord % 4 = 1 THEN 'quote'
  WHEN ord % 4 = 0 AND (q = '' OR contains(substring(text, 2), q)) THEN 'quote' END AS fault FROM f
""")
def unit_faults(spark, d):
    """Lines as units: a quote of theirs, one of nowhere, none with a reason, none without."""
    k = F.col("ord") % 4
    none = F.array().cast("array<string>")
    facts = F.when(k == 0, F.array(F.left("text", F.lit(20)))).when(k == 1, F.array(F.lit("nowhere to be found"))).otherwise(none)
    rows = blocks.line_blocks(_docs(spark, d))
    return rows.select("doc_id", "ord", knowledge.unit_fault(F.col("text"), facts, F.when(k == 2, "said why"), F.lit(True)).alias("fault"))


@query(f"""
WITH {_TREE}, hit AS (SELECT doc_id, ord FROM line WHERE contains(replace(lower(text), 'ß', 'ss'), 'sse')), first AS (SELECT hit.doc_id, hit.ord, min(node) AS node FROM hit JOIN tree t ON t.doc_id = hit.doc_id AND t.node > 0 AND hit.ord >= t.start AND hit.ord < t."end" GROUP BY ALL)
SELECT doc_id, ord, CAST(node AS INTEGER) AS node, CAST(ord - start AS INTEGER) AS "offset" FROM first JOIN tree USING (doc_id, node)
""")
def hit_places(spark, d):
    """Hits of a literal with the first of the nested nodes around them and how far they lie in it."""
    rows = blocks.line_blocks(_docs(spark, d))
    hits = search.literal_hits(rows, "ßE").select("doc_id", "ord")
    return knowledge.node_hits(hits, _tree(spark, d).where("node > 0")).select("doc_id", "ord", "node", "offset")


@query("SELECT 's' || doc_id AS source_id, 'v' || doc_id AS version_id, 'p' || doc_id AS parse_id, 't' || doc_id AS tree_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def source_snapshot(spark, d):
    """Sources whose version, parse and tree belong together."""
    docs, i = _docs(spark, d), F.col("doc_id")
    registry = docs.select(_id("s").alias("source_id"), _id("v").alias("version_id"))
    versions = docs.select(_id("v").alias("version_id"), F.when(i % 3 == 0, F.lit("s-other")).otherwise(_id("s")).alias("source_id"))
    parses = docs.select(_id("p").alias("parse_id"), _id("v").alias("version_id"), (i % 5 != 0).alias("selected"))
    return knowledge.snapshot(registry, versions, parses, docs.where(i % 7 != 0).select(_id("t").alias("tree_id"), _id("p").alias("parse_id")))


@query("SELECT doc_id AS ord FROM documents WHERE doc_id % 4 = 1 OR doc_id % 4 = 2 ORDER BY doc_id LIMIT 1")
def path_lookup(spark, d):
    """The first row with a path in any of its three columns (one row is the feature)."""
    i = F.col("doc_id")
    rows = _docs(spark, d).select(i.alias("ord"), F.when(i % 4 == 1, "x").alias("path"), F.when(i % 4 == 2, "x").alias("raw_path"), _id("o").alias("origin"))
    return knowledge.by_path(rows, "x").select("ord")


@query("SELECT doc_id FROM documents WHERE doc_id % 6 < 2")
def legacy_names(spark, d):
    """Rows without a path whose stem is the same in compatible form."""
    i = F.col("doc_id")
    rows = _docs(spark, d).select("doc_id", F.when(i % 6 == 2, "p").alias("path"), F.when(i % 6 < 3, "Ｐlan.pdf").otherwise("Plan b.pdf").alias("name"))
    return knowledge.legacy_stem(rows, "Plan").select("doc_id")


@query("SELECT source AS plan, 'l' || (doc_id % 5) AS label, 'm' || (doc_id % 5) AS member FROM documents")
def plan_members(spark, d):
    """Labels of a plan as their members."""
    k = (F.col("doc_id") % 5).cast("string")
    topics = spark.range(5).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"))
    return knowledge.known_labels(_docs(spark, d).select(F.col("source").alias("plan"), F.concat(F.lit("l"), k).alias("label")), topics)


@query("SELECT 'p' || doc_id AS target FROM documents WHERE doc_id % 4 <> 0 UNION SELECT 'p' || doc_id FROM documents WHERE doc_id % 6 = 0")
def accepted_targets(spark, d):
    """Targets that links may name once failed groups are out."""
    docs, i = _docs(spark, d).select(_id("p").alias("path"), "doc_id"), F.col("doc_id")
    _, targets = knowledge.accepted_groups(docs.select("path"), docs.where(i % 4 == 0).select("path"), docs.where(i % 6 == 0).select(F.col("path").alias("target")))
    return targets


@query("SELECT doc_id, sha256('{\"headings\":[\"' || lang || '\"],\"kind\":\"paragraph\",\"text\":\"' || source || '\"}') AS key FROM documents")
def semantic_keys(spark, d):
    """Keys of units that say the same, wherever they stand."""
    return _docs(spark, d).select("doc_id", knowledge.semantic_key({"text": F.col("source"), "kind": F.lit("paragraph"), "headings": F.array("lang")}).alias("key"))
