"""Queries over sources, tasks, histories, packages and file events, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import checks
from scriptorium.operators import packages, status
from scriptorium.plans.registry import query
from scriptorium.sources import office, table
from scriptorium.streaming import watch


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _id(prefix: str):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"))


@query("""
WITH r AS (SELECT 's' || doc_id AS source_id, 'd' || doc_id AS name, CASE doc_id % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'short' ELSE 'raw' END AS type FROM documents WHERE doc_id % 4 <> 1),
s AS (SELECT 's' || doc_id AS source_id, 'file:' || doc_id AS origin, CASE doc_id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'parsing' END AS state FROM documents WHERE doc_id % 6 <> 2)
SELECT coalesce(r.source_id, s.source_id) AS source_id, coalesce(name, origin) AS name, coalesce(type, 'raw') AS type, coalesce(state, 'complete') AS state FROM r FULL JOIN s ON r.source_id = s.source_id WHERE r.source_id IS NOT NULL OR state <> 'complete'
""")
def source_inventory(spark, d):
    """Registered documents and unfinished sources; complete sources that are no longer registered are gone."""
    docs, i = _docs(spark, d), F.col("doc_id")
    registry = docs.where(i % 4 != 1).select(_id("s").alias("source_id"), _id("d").alias("name"), F.when(i % 3 == 0, "long_pdf").when(i % 3 == 1, "docx").otherwise("").alias("type"))
    sources = docs.where(i % 6 != 2).select(_id("s").alias("source_id"), _id("file:").alias("origin"), F.when(i % 5 == 0, "complete").when(i % 5 == 1, "failed").otherwise("parsing").alias("state"))
    return status.inventory(registry, sources)


@query("""
WITH o AS (SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS runs, round(sum(value), 4) AS charged, CAST(sum(event_id % 2) AS BIGINT) AS unknown, count(*) FILTER (WHERE event_type = 'click') AS open_jobs FROM events GROUP BY user_id)
SELECT user_id AS source_id, state, runs, charged, unknown, open_jobs FROM o
""")
def source_status(spark, d):
    """Each source with its newest outcome, its usage and its open jobs."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "source_id")
    outcomes = e.select("source_id", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    used = e.select("source_id", F.col("value").alias("charged"), (F.col("event_id") % 2).alias("unknown"))
    jobs = e.select("source_id", F.when(F.col("event_type") == "click", "running").otherwise("succeeded").alias("state"))
    return status.source_status(e.select("source_id"), outcomes, used, jobs)


@query("""
SELECT user_id, CASE WHEN GROUPING(inc) = 0 THEN CAST(inc AS VARCHAR) END AS included, count(*) AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, bool_and(event_id % 50 <> 7) AS complete
FROM (SELECT *, event_id % 3 = 0 AS inc FROM events) GROUP BY GROUPING SETS ((user_id, inc), (user_id))
""")
def navigation_usage(spark, d):
    """Requests by source and whether they count into a compilation, and over both."""
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 3 == 0).alias("included"), F.floor("value").cast("long").alias("tokens"), (F.col("event_id") % 50 != 7).alias("complete"))
    return status.usage_rollup(e, "user_id", "included")


@query("SELECT event_type AS folder, count(*) AS files, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM events GROUP BY event_type")
def folder_counts(spark, d):
    """Files by folder and the newest change."""
    return status.folder_counts(table(spark, d, "events").select(F.col("event_type").alias("folder"), F.col("ts").cast("timestamp").alias("changed")))


@query("SELECT user_id AS task, count(*) AS total, count(*) FILTER (WHERE event_id % 5 = 0) AS succeeded, count(*) FILTER (WHERE event_id % 5 = 1) AS skipped, count(*) FILTER (WHERE event_id % 5 = 2) AS failed, count(*) FILTER (WHERE event_id % 5 > 2) AS unfinished FROM events GROUP BY user_id")
def task_counts(spark, d):
    """Unit results by task; the unfinished ones have no status."""
    k = F.col("event_id") % 5
    return status.status_counts(table(spark, d, "events").select(F.col("user_id").alias("task"), F.when(k == 0, "succeeded").when(k == 1, "skipped").when(k == 2, "failed").alias("status")), "task")


@query("""
WITH t AS (SELECT conv_id AS task, CASE conv_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' ELSE 'queued' END AS state, conv_id % 3 AS done FROM (SELECT DISTINCT conv_id FROM conversations)),
u AS (SELECT conv_id AS task, turn AS ord, (conv_id + turn) % 17 AS source_id FROM conversations),
l AS (SELECT DISTINCT source_id, task, state FROM u JOIN t USING (task) WHERE state <> 'failed' AND ord >= done)
SELECT source_id, task, state FROM l QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY state = 'running' DESC, task DESC) = 1
""")
def active_tasks(spark, d):
    """The task that works on each source, or will."""
    c, k = table(spark, d, "conversations"), F.col("conv_id") % 4
    tasks = c.select(F.col("conv_id").alias("task")).distinct().withColumn("seq", F.col("task")).withColumn("done", F.col("task") % 3)
    tasks = tasks.withColumn("state", F.when(F.col("task") % 4 == 0, "running").when(F.col("task") % 4 == 2, "failed").otherwise("queued"))
    return status.active_task(tasks, c.select(F.col("conv_id").alias("task"), F.col("turn").alias("ord"), ((F.col("conv_id") + F.col("turn")) % 17).alias("source_id")))


_QUALITY = "q AS (SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 'verified' ELSE 'needs_review' END AS status, CASE doc_id % 4 WHEN 0 THEN 'image_ocr: notice' WHEN 1 THEN 'x position_unavailable' ELSE 'plain' END AS reason FROM labels)"


def _quality(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "labels").select("doc_id", "toxic", F.when(F.col("quality") == 1, "verified").otherwise("needs_review").alias("status"), F.when(i % 4 == 0, "image_ocr: notice").when(i % 4 == 1, "x position_unavailable").otherwise("plain").alias("reason"))


@query(f"WITH {_QUALITY} SELECT doc_id, reason FROM q WHERE status = 'needs_review' OR doc_id % 4 < 2")
def review_gaps(spark, d):
    return status.review_gaps(_quality(spark, d), "image_ocr", "position_unavailable").select("doc_id", "reason")


@query(f"""
WITH {_QUALITY}, g AS (SELECT doc_id, reason FROM q WHERE status = 'needs_review'), p AS (SELECT doc_id, turn_ * 100 AS start, turn_ * 100 + 50 AS "end" FROM documents, (VALUES (0), (1), (2)) v(turn_) WHERE (doc_id + turn_) % 3 = 0 AND doc_id % 2 = 0)
SELECT doc_id AS source_id, 0 AS block, p.start, p."end", reason FROM g LEFT JOIN p USING (doc_id)
""")
def source_issues(spark, d):
    """Review rows with the pending ranges of their block."""
    gaps = _quality(spark, d).where("status = 'needs_review'").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("block"), "reason")
    ranges = _docs(spark, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("block"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return status.issues(gaps, ranges.select("source_id", "block", (F.col("k") * 100).alias("start"), (F.col("k") * 100 + 50).alias("end"), F.when((F.col("source_id") + F.col("k")) % 3 == 0, "pending").otherwise("verified").alias("status")))


@query("SELECT source AS parse_id, bool_and(l.quality = 1 OR l.doc_id % 2 = 0) AS complete FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def complete_parses(spark, d):
    """Parses whose rows are all verified or confirmed."""
    rows = _quality(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id").select(F.col("source").alias("parse_id"), F.col("doc_id").alias("item"), "status")
    return status.complete_parses(rows, rows.where("item % 2 = 0").select("parse_id", "item"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN doc_id % 8 = 1 WHEN 2 THEN trim(text, chr(32)) <> '' ELSE false END AS readable FROM documents
""")
def readable_documents(spark, d):
    """Documents with text left beside placeholders; images count only with a transcription."""
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    kind = F.when(i % 4 == 1, "image").otherwise("paragraph")
    text = F.when(i % 4 == 0, "![x](asset:1) [missing image]").when(i % 4 == 1, "![x](asset:1) words").when(i % 4 == 2, F.col("text")).otherwise("")
    rows = _docs(spark, d).select("doc_id", F.lit(0).alias("ord"), kind.alias("kind"), text.alias("text"), F.when(i % 4 == 1, F.array(F.lit("1"))).otherwise(none).alias("assets"))
    return status.readable(rows, rows.where("doc_id % 8 = 1").select("doc_id", F.lit("1").alias("asset")), r"\[missing image\]")


@query("SELECT CASE WHEN count(*) = 0 THEN 'not_found' WHEN count(*) > 1 THEN 'multiple' ELSE 'ready' END AS state, count(*) AS n, coalesce(array_to_string(list_sort(list('h' || doc_id)), ','), '') AS hashes FROM documents WHERE contains('doc-' || doc_id || '.pdf', '-17')")
def recompilation_choice(spark, d):
    """Documents that a part of a name selects."""
    registry = _docs(spark, d).select(_id("h").alias("hash"), F.concat(_id("doc-"), F.lit(".pdf")).alias("name"), _id("n").alias("doc_name"))
    return status.selection(registry, "-17").select("state", "n", F.array_join("hashes", ",").alias("hashes"))


@query("WITH r AS (SELECT 'r' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, left(text, 16000) AS p, length(text) > 16000 AS cut FROM documents WHERE source = 'src1' AND doc_id % 2 = 0) SELECT id, sha256(p) AS preview, cut, (SELECT count(*) FROM r) AS total, CASE WHEN 30 < (SELECT count(*) FROM r) THEN CAST(30 AS BIGINT) END AS next_offset FROM r ORDER BY id LIMIT 20 OFFSET 10")
def stored_artifacts(spark, d):
    """A page of the records of one stage (the page is the feature)."""
    records = _docs(spark, d).select(F.concat(F.lit("r"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), "source", F.when(F.col("doc_id") % 2 == 0, "facts").otherwise("plan").alias("stage"), F.col("text").alias("content"))
    return status.stored_artifacts(records, {"source": "src1"}, "facts", 10, 20).withColumn("preview", F.sha2("preview", 256))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'facts' WHEN 1 THEN 'plan' WHEN 2 THEN 'generation' WHEN 3 THEN 'review' ELSE 'other' END AS stage FROM documents")
def record_stages(spark, d):
    i = F.col("doc_id") % 5
    record = F.when(i == 0, '{"facts":[],"title":"t"}').when(i == 1, '{"groups":[]}').when(i == 2, '{"title":"t","content":"c"}').when(i == 3, '{"verdict":"supported"}').otherwise('{"title":"t"}')
    return _docs(spark, d).select("doc_id", status.record_stage(record).alias("stage"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 6 <> 1")
def history_cleanup(spark, d):
    """Objects without the previewed ones, if nothing changed since."""
    objects = _docs(spark, d).select(F.col("doc_id").alias("id"))
    seen = objects.agg(status.state_digest(objects).alias("d")).first()["d"]
    return status.cleanup(objects, objects.where("id % 6 = 1"), seen)


@query("SELECT lang AS name, max(doc_id % 40) AS n, count(DISTINCT doc_id % 40) AS saved FROM documents WHERE doc_id % 3 <> 0 GROUP BY lang")
def saved_iterations(spark, d):
    """Iterations by number; other folders don't count."""
    saved = _docs(spark, d).select(F.col("lang").alias("name"), F.concat(F.when(F.col("doc_id") % 3 == 0, "draft-").otherwise("iteration-"), (F.col("doc_id") % 40).cast("string")).alias("folder"))
    return status.iterations(saved).groupBy("name").agg(F.max("n").cast("long").alias("n"), F.countDistinct("n").alias("saved"))


@query("SELECT max(doc_id % 40) + 1 AS next, 'en' AS name FROM documents WHERE lang = 'en'")
def next_iteration(spark, d):
    saved = _docs(spark, d).select(F.col("lang").alias("name"), F.concat(F.lit("iteration-"), (F.col("doc_id") % 40).cast("string")).alias("folder"))
    return status.next_iteration(saved, "en")


@query("""
SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 10 = 6 THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN doc_id % 10 = 3 THEN 1 WHEN doc_id % 10 = 6 THEN -1 ELSE 0 END * len(string_split(text, chr(10))) + CASE WHEN doc_id % 4 = 0 AND doc_id % 10 <> 6 THEN 1 ELSE 0 END AS lines
FROM documents WHERE doc_id % 10 IN (3, 6) OR doc_id % 4 = 0
""")
def iteration_diff(spark, d):
    """Files added, removed and changed between two iterations, and their lines."""
    docs = _docs(spark, d).select("doc_id", _id("d").alias("path"), "text")
    after = docs.where("doc_id % 10 <> 6").select("path", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")).alias("text"))
    return status.file_changes(docs.where("doc_id % 10 <> 3").select("path", "text"), after)


@query("""
WITH p AS (SELECT doc_id % 4 AS root, 'f' || doc_id AS folder, CASE WHEN doc_id % 5 = 0 THEN 'f' || doc_id ELSE 'n' || (doc_id % 90) END AS name, CASE WHEN doc_id % 7 = 0 THEN '' ELSE trim(left(text, 1024)) END AS t, doc_id FROM documents)
SELECT name, arg_min(sha256(left(t, 1024)), (root, folder)) AS digest, arg_min('p' || doc_id, (root, folder)) AS path FROM p WHERE t <> '' GROUP BY name
""")
def skill_packages(spark, d):
    """Packages by ordered roots; the first of a name wins."""
    i = F.col("doc_id")
    rows = _docs(spark, d).select((i % 4).alias("root"), _id("f").alias("folder"), F.when(i % 5 != 0, F.concat(F.lit("n"), (i % 90).cast("string"))).alias("name"), F.when(i % 7 == 0, "").otherwise(F.left("text", F.lit(1024))).alias("description"), _id("p").alias("path"))
    return status.skills(rows).select("name", F.sha2("description", 256).alias("digest"), "path")


@query("""
WITH s AS (SELECT doc_id, 'skill-' || doc_id AS skill FROM documents), i AS (
  SELECT skill, 'error' AS level, 'no front matter' AS issue, CAST(NULL AS VARCHAR) AS subject FROM s WHERE doc_id % 10 = 0
  UNION ALL SELECT skill, 'error', 'name differs', 'Other Name' FROM s WHERE doc_id % 10 = 1 UNION ALL SELECT skill, 'error', 'name form', 'Other Name' FROM s WHERE doc_id % 10 = 1
  UNION ALL SELECT skill, 'warning', 'description short', NULL FROM s WHERE doc_id % 10 = 2 UNION ALL SELECT skill, 'error', 'description missing', NULL FROM s WHERE doc_id % 10 = 3
  UNION ALL SELECT skill, 'error', 'body foreign link', NULL FROM s WHERE doc_id % 10 = 4 UNION ALL SELECT skill, 'error', 'reference missing', 'references/gone.md' FROM s WHERE doc_id % 10 = 5
  UNION ALL SELECT skill, 'error', 'reference outside', '../up' FROM s WHERE doc_id % 10 = 6 UNION ALL SELECT skill, 'warning', 'unknown keys', 'colour' FROM s WHERE doc_id % 10 = 7
  UNION ALL SELECT skill, 'warning', 'imports', 'scripts/run.py: requests' FROM s WHERE doc_id % 10 = 8 UNION ALL SELECT skill, 'error', 'no SKILL.md', NULL FROM s WHERE doc_id % 10 = 9)
SELECT * FROM i
""")
def skill_issues(spark, d):
    """A skill for each document, with ten kinds of faults."""
    i, skill = F.col("doc_id") % 10, _id("skill-")
    about = F.when(i == 2, 'description: "Short"\n').when(i == 3, "").otherwise('description: "A skill that is long enough to say"\n')
    name = F.when(i == 1, F.lit("Other Name")).otherwise(skill)
    head = F.concat(F.lit("---\nname: "), name, F.lit("\n"), about, F.when(i == 7, "colour: red\n").otherwise(""), F.lit("---\n"))
    body = F.when(i == 4, "see [[concepts/x]]").when(i == 5, "see [[references/gone]]").when(i == 6, "see [[references/../up]]").otherwise("see [[references/there]]")
    docs = _docs(spark, d)
    main = docs.where(i != 9).select(skill.alias("skill"), F.lit("SKILL.md").alias("path"), F.when(i == 0, "plain").otherwise(F.concat(head, body)).alias("text"))
    others = docs.select(skill.alias("skill"), F.lit("references/there.md").alias("path"), F.lit("text").alias("text"))
    scripts = docs.select(skill.alias("skill"), F.lit("scripts/run.py").alias("path"), F.when(i == 8, "import os, requests.api").otherwise("from . import x\nimport json").alias("text"))
    return packages.skill_issues(main.unionByName(others).unionByName(scripts), strict=True)


@query("""
WITH k AS (SELECT doc_id, 'deck-' || doc_id AS deck, doc_id % 12 + 1 AS n FROM documents)
SELECT deck, 'error' AS level, 'few slides' AS issue, CAST(n AS VARCHAR) AS subject FROM k WHERE n < 5 UNION ALL SELECT deck, 'warning', 'slide count', CAST(n AS VARCHAR) FROM k WHERE n < 8
UNION ALL SELECT deck, 'error', 'outside references', 'img https://a/b.png' FROM k WHERE doc_id % 7 = 0
UNION ALL SELECT deck, 'error', 'kind missing', 'closing' FROM k UNION ALL SELECT deck, 'error', 'unknown kind', 'odd' FROM k WHERE n > 3
UNION ALL SELECT deck, 'warning', 'few kinds', CAST(CASE WHEN n > 3 THEN 3 WHEN n > 1 THEN 2 ELSE 1 END AS VARCHAR) FROM k WHERE n <= 12
UNION ALL SELECT deck, 'warning', 'long run', CAST(least(n - 1, 2) AS VARCHAR) FROM k WHERE n >= 3
""")
def deck_issues(spark, d):
    """A deck for each document: a cover, two chapters, then one odd kind and covers and odd ones in turn."""
    i = F.col("doc_id")
    kind = lambda k: F.when(k == 0, "cover").when(k < 3, "chapter").when(k % 2 == 1, "odd").otherwise("cover")
    slides = F.array_join(F.transform(F.sequence(F.lit(0), (i % 12).cast("int")), lambda k: F.concat(F.lit('<section class="slide x" data-type="'), kind(k), F.lit('">a</section>'))), "")
    html = F.concat(slides, F.when(i % 7 == 0, '<img src="https://a/b.png"><img src="c.png">').otherwise(""))
    return packages.deck_issues(_docs(spark, d).select(_id("deck-").alias("deck"), html.alias("html")), ["cover", "closing"], ["cover", "chapter", "closing"], 4, 1, "data-type")


@query("SELECT event_type, event_id, seq FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE seq >= greatest(50, n - 199) AND seq < greatest(50, n - 199) + 30")
def watch_replay(spark, d):
    """Thirty kept events of each kind from number 50 on (the bound is the feature)."""
    return watch.replay(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 50, 30)


@query("""
WITH e AS (SELECT 'p' || (event_id % 400) AS path, ts, event_id // 3000 AS stamp, sha256('c' || (event_id % 390)) AS digest FROM events),
l AS (SELECT path, arg_max(stamp, ts) AS stamp, arg_max(digest, ts) AS digest FROM e GROUP BY path),
c AS (SELECT *, CASE WHEN stamp IS DISTINCT FROM lag(stamp) OVER (PARTITION BY path ORDER BY ts) THEN ts END AS moved FROM e),
s AS (SELECT l.path, l.stamp, l.digest FROM l JOIN (SELECT path, max(moved) AS since FROM c GROUP BY path) m USING (path) WHERE epoch((SELECT max(ts) FROM events)) - epoch(since) >= 86400 * 3)
SELECT min(path) AS path, arg_min(stamp, path) AS stamp, digest FROM s WHERE digest NOT IN (SELECT sha256('c' || i) FROM range(0, 390, 10) r(i)) GROUP BY digest
""")
def settled_files(spark, d):
    """Files that haven't changed for three days and whose content is new."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    rows = e.select(F.concat(F.lit("p"), (i % 400).cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("at"), F.floor(i / 3000).alias("stamp"), F.sha2(F.concat(F.lit("c"), (i % 390).cast("string")), 256).alias("digest"))
    now = e.agg(F.max("ts").cast("timestamp").cast("string").alias("m")).first()["m"]
    taken = spark.range(0, 390, 10).select(F.sha2(F.concat(F.lit("c"), F.col("id").cast("string")), 256).alias("digest"))
    return watch.settled(rows, taken, now, 86400 * 3)


@query("""
WITH r AS (SELECT event_id % 300 AS task, event_id AS seq, event_id % 7 < 5 AS b FROM events), f AS (SELECT task, min(seq) AS first, arg_min(b, seq) AS binding FROM r GROUP BY task)
SELECT task, seq, CASE WHEN seq = first THEN 'accepted' WHEN b = binding THEN 'repeated' ELSE 'refused' END AS verdict FROM r JOIN f USING (task)
""")
def task_submissions(spark, d):
    i = F.col("event_id")
    return watch.submissions(table(spark, d, "events").select((i % 300).alias("task"), i.alias("seq"), (i % 7 < 5).alias("binding")))


@query("SELECT event_id, CASE WHEN k <= 4 THEN 'running' ELSE 'queued' END AS state, CASE WHEN k > 4 THEN k - 4 END AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)")
def task_queue(spark, d):
    """Four tasks of each user run, the others wait in order."""
    return watch.queue_places(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 4).select("event_id", "state", "place")


@query("""
WITH f AS (SELECT conv_id AS task, turn AS number, 'x' || repeat('ab', turn + 20) || chr(10) AS c FROM conversations), j AS (SELECT task, array_to_string(list(c ORDER BY number), '') AS whole FROM f GROUP BY task)
SELECT task, right(whole, 120) AS text FROM j
""")
def task_logs(spark, d):
    """The last 120 bytes of each task's log files together."""
    made = F.concat(F.lit("x"), F.expr("repeat('ab', cast(turn + 20 as int))"), F.lit("\n"))
    return watch.log_tail(table(spark, d, "conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("number"), made.alias("content")), 120)


@query("SELECT conv_id AS session, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def chat_turns(spark, d):
    """Recorded turns, every one sent twice."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")
    return watch.recorded_turns(c.unionByName(c)).select("session", "seq", "turn")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN NULL ELSE sha256('# Saved content entry 1' || chr(10) || chr(10) || 'a' || doc_id || chr(10) || chr(10) || '![saved figure](i.png)' || chr(10) || chr(10) || '# Saved content entry 3' || chr(10) || chr(10) || 'b') END AS digest FROM documents
""")
def saved_entries(spark, d):
    """Saved page arrays as texts; repeated and invalid pages give none."""
    i = F.col("doc_id")
    saved = F.concat(F.lit('[{"page":1,"content":"a'), i.cast("string"), F.lit('","images":[{"path":"i.png"}]},{"page":'), F.when(i % 4 == 1, "1").when(i % 4 == 2, "0").otherwise("3"), F.lit(',"content":"b"}]'))
    return _docs(spark, d).select("doc_id", F.sha2(office.saved_pages_text(saved), 256).alias("digest"))


@query("SELECT * FROM (SELECT doc_id AS seq, source AS index_id, lang AS profile, sha256(text) AS metadata_sha256 FROM documents WHERE source = 'src2' AND lang = 'en' ORDER BY doc_id DESC LIMIT 1)")
def newest_binding(spark, d):
    """The newest binding of an index and profile (one row is the feature)."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("seq"), F.col("source").alias("index_id"), F.col("lang").alias("profile"), F.col("text").alias("metadata"))
    return office.binding_inventory(office.binding_lookup(rows, index_id="src2", profile="en"))


@query("""
WITH f AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'output/k' || (doc_id % 20) || '/f' || doc_id WHEN 1 THEN 'reports/r' || doc_id WHEN 2 THEN 'output/o' || doc_id ELSE 'wiki/w' || doc_id END AS path, doc_id FROM documents)
SELECT 'output/k' || (doc_id % 20) AS name, 'folder' AS kind, count(*) AS files FROM f WHERE doc_id % 4 = 0 GROUP BY 1 UNION ALL SELECT path, 'file', 1 FROM f WHERE doc_id % 4 IN (1, 2)
""")
def artifact_listing(spark, d):
    """Folders of the output, then loose files of the folders of results."""
    i = F.col("doc_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("output/k"), (i % 20).cast("string"), _id("/f"))).when(i % 4 == 1, _id("reports/r")).when(i % 4 == 2, _id("output/o")).otherwise(_id("wiki/w"))
    return office.listing(_docs(spark, d).select(path.alias("path")))


@query("SELECT sha256(text) AS asset, 'images/a/' || sha256(text) || '.png' AS path FROM documents WHERE doc_id % 3 = 0 GROUP BY text")
def published_images(spark, d):
    """Images named by their content; others are none."""
    i, h = F.col("doc_id"), F.sha2("text", 256)
    names = F.concat(F.when(i % 2 == 0, "images/a/").otherwise("images/b/"), F.when(i % 3 == 0, h).otherwise(F.sha2(h, 256)), F.when(i % 3 == 1, ".txt").otherwise(".png"))
    files = _docs(spark, d).select(names.alias("path"), F.col("text").cast("binary").alias("content"))
    every = files.unionByName(files.select(F.replace("path", F.lit("/b/"), F.lit("/a/")).alias("path"), "content"))
    return status.published_images(every, _docs(spark, d).select(h.alias("asset")))


@query("SELECT doc_id, CAST(greatest(0, least(40, 32, doc_id % 60 - 4)) AS BIGINT) AS requests, CAST(greatest(0, least(300000, 262144, doc_id * 100)) AS BIGINT) AS tokens FROM documents")
def optional_allowances(spark, d):
    i = F.col("doc_id")
    a = checks.optional_allowance(F.lit(40), F.lit(300000), F.lit(200.0), i % 60, i * 1000)
    return _docs(spark, d).select("doc_id", a.alias("a")).select("doc_id", "a.requests", "a.tokens")


@query("SELECT doc_id, CASE WHEN doc_id % 50 + 10 <= 100 THEN array_to_string([doc_id % 50 * 2.0, 20.0, (doc_id % 50 + 10) * 2.0, 100.0], ',') END AS box FROM documents")
def scaled_boxes(spark, d):
    """Raster boxes as page points; the raster has half the page's size."""
    i = (F.col("doc_id") % 50).cast("double")
    box = checks.scaled_box(F.array(i, F.lit(10.0), i + 10, F.lit(50.0)), F.lit(200.0), F.lit(400.0), F.lit(100.0), F.lit(200.0), F.lit(0))
    return _docs(spark, d).select("doc_id", F.array_join(F.transform(box, lambda x: F.round(x, 1).cast("string")), ",").alias("box"))


def _files(spark, d) -> DataFrame:
    i = F.col("doc_id")
    kinds = F.when(i % 4 == 0, ".md").when(i % 4 == 1, ".txt").when(i % 4 == 2, ".csv").otherwise(".odt")
    return _docs(spark, d).select("doc_id", F.concat(_id("raw/f"), kinds).alias("path"), F.encode(F.concat(F.lit("# H\n"), "text"), "UTF-8").alias("content"))


@query("""
WITH f AS (SELECT *, 'raw/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.csv' ELSE '.odt' END AS path FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 5 = 0))
SELECT path, 0 AS ord, CASE WHEN doc_id % 4 < 3 THEN CASE WHEN doc_id % 4 = 0 THEN 'heading' ELSE 'paragraph' END END AS kind, CASE WHEN doc_id % 4 < 3 THEN sha256('# H') END AS digest, CASE WHEN doc_id % 4 = 3 THEN 'unknown_kind' END AS error FROM f
UNION ALL SELECT path, 1, 'paragraph', sha256(text), NULL FROM f WHERE doc_id % 4 < 3 AND trim(text) <> ''
""")
def parsed_files(spark, d):
    """Files of four kinds, the contents of every fifth one parsed before; the texts hold no blank lines, so each is a heading line and a paragraph."""
    from scriptorium.sources import documents

    files = _files(spark, d)
    before = files.where("doc_id % 5 = 0").select(documents.lookup_key(F.col("content"), "1").alias("lookup_key"))
    return documents.parse_files(files.select("path", "content"), before).select("path", "ord", "kind", F.sha2("text", 256).alias("digest"), "error")


@query("""
SELECT 'raw/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.csv' ELSE '.odt' END AS path, CASE WHEN doc_id % 4 = 3 THEN 'needs_review' ELSE 'verified' END AS status, CASE WHEN doc_id % 4 = 3 THEN 'unknown_kind' END AS reason FROM documents
""")
def parse_quality(spark, d):
    from scriptorium.sources import documents

    files = _files(spark, d)
    return documents.parse_quality(files, documents.parse_files(files.select("path", "content")))


@query("""
SELECT doc_id AS ord, 'b' || doc_id AS block_id, lang AS kind, n_chars AS chars, CASE WHEN doc_id % 2 = 0 THEN 'gap' ELSE '' END AS reasons, (SELECT count(*) FROM documents) AS total, CASE WHEN 60 < (SELECT count(*) FROM documents) THEN CAST(60 AS BIGINT) END AS next_offset
FROM documents ORDER BY doc_id LIMIT 50 OFFSET 10
""")
def parse_inspection(spark, d):
    """A page of blocks with their reviews (the page is the feature)."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("ord"), _id("b").alias("block_id"), F.col("lang").alias("kind"), F.col("n_chars").alias("chars"))
    reviews = docs.where("ord % 2 = 0").select("block_id", F.lit("gap").alias("reason"))
    return status.inspect_parse(docs, reviews, 10, 50).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT doc_id AS job, coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 10 END, 0) AS pages, 4 AS done, coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 10 END, 0) >= 4 AS valid FROM documents WHERE source = 'src3'")
def source_jobs(spark, d):
    i = F.col("doc_id")
    jobs = _docs(spark, d).select(i.alias("job"), _id("v").alias("version_id"), F.when(i % 3 != 0, i % 10).alias("pages"), F.lit(4).alias("done"))
    return status.cloud_jobs(jobs, _docs(spark, d).select(_id("v").alias("version_id"), F.col("source").alias("source_id")), "src3").drop("version_id")


@query("SELECT doc_id, doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 2 = 0 AS verified FROM documents")
def job_receipts(spark, d):
    i = F.col("doc_id")
    state = F.when(i % 3 == 0, "succeeded").otherwise("running")
    return _docs(spark, d).select("doc_id", status.receipt_verified(state, i % 5, F.when(i % 2 == 0, i % 5).otherwise(-1), F.lit("d"), F.lit("d")).alias("verified"))


@query("""
SELECT user_id AS run, CASE WHEN event_id % 40 = 1 THEN '' ELSE CAST(event_id AS VARCHAR) END AS id,
  CASE WHEN event_id % 40 = 1 THEN 'identity' WHEN event_id % 40 = 2 THEN 'duration' WHEN event_id % 40 = 3 THEN 'unsettled' ELSE 'tokens' END AS fault FROM events WHERE event_id % 40 BETWEEN 1 AND 4
""")
def measurement_faults(spark, d):
    """Measured records with four kinds of faults."""
    i = F.col("event_id") % 40
    e = table(spark, d, "events")
    name = F.when(i == 1, "").otherwise(F.col("event_id").cast("string"))
    rows = e.select(F.col("user_id").alias("run"), F.lit("span").alias("kind"), name.alias("id"), F.lit("s").alias("stage"), F.when(i == 3, "open").otherwise("completed").alias("status"), F.lit(0.0).alias("started"), F.when(i == 2, float("nan")).otherwise(F.col("value")).alias("elapsed"), F.when(i == 4, -1).otherwise(1).alias("tokens"))
    return status.measurement_faults(rows)


@query("SELECT 'd' || doc_id || '.md' AS name FROM documents WHERE doc_id % 3 = 1")
def folder_files(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 3 == 1, "wiki/concepts").when(i % 3 == 2, "wiki/concepts/deep").otherwise("wiki"), _id("/d"), F.lit(".md"))
    return status.folder_files(_docs(spark, d).select(path.alias("path")), "wiki/concepts")


@query("SELECT doc_id AS node, (SELECT max(doc_id) % 7 FROM documents) AS tree_id, (SELECT count(*) FROM documents WHERE doc_id % 7 = (SELECT max(doc_id) % 7 FROM documents)) AS total FROM documents WHERE doc_id % 7 = (SELECT max(doc_id) % 7 FROM documents) ORDER BY doc_id LIMIT 20 OFFSET 5")
def navigation_page(spark, d):
    """A page of the nodes of the tree published last (the page is the feature)."""
    docs, i = _docs(spark, d), F.col("doc_id")
    published = docs.select(F.lit("s").alias("source_id"), i.alias("seq"), (i % 7).alias("tree_id"))
    return status.navigation_page(published, docs.select((i % 7).alias("tree_id"), i.alias("node")), "s", 5, 20).select("node", "tree_id", "total")
