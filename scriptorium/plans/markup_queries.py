"""Queries over Markdown: links and citations rewritten in place, pages' links read from Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import markdown as md
from scriptorium.functions import text as T
from scriptorium.operators import markup
from scriptorium.plans.registry import query
from scriptorium.sources import table


@query("""
WITH h AS (SELECT page_id, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
e AS (SELECT page_id, unnest(list_transform(hrefs, lambda x, i: {'at': i, 'href': x})) AS x FROM h)
SELECT page_id, x.at AS place, CASE WHEN x.at % 4 = 3 THEN 'code' ELSE 'link' END AS kind, CASE WHEN x.at % 4 = 3 THEN '' ELSE x.href END AS target FROM e
""")
def markdown_anchors(spark, d):
    """The anchors of each page as Markdown (plain, in brackets and a table, by reference, in code), found again in order with their targets."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    listed = F.transform(hrefs, lambda x, i: F.struct((i + 1).alias("at"), x.alias("href")))
    n = lambda x: x["at"].cast("string")
    part = lambda x: F.when(x["at"] % 4 == 0, F.concat(F.lit("An [a [b] "), n(x), F.lit("](<"), x["href"], F.lit("> \"t\")."))).when(x["at"] % 4 == 1, F.concat(F.lit("| c |\n|---|\n| [x\\|y]("), x["href"], F.lit(") |"))).when(x["at"] % 4 == 2, F.concat(F.lit("See ["), n(x), F.lit("][ref "), n(x), F.lit("].\n\n[Ref "), n(x), F.lit("]: <"), x["href"], F.lit(">"))).otherwise(F.concat(F.lit("``` `[no]("), x["href"], F.lit(")` ```")))
    made = table(spark, d, "pages").select("page_id", F.array_join(F.transform(listed, part), "\n\n").alias("text"))
    spans = F.filter(md.markdown_spans("text"), lambda s: s["kind"].isin("link", "code"))
    found = made.select("page_id", F.posexplode(spans).alias("at", "s"))
    return found.select("page_id", (F.col("at") + 1).cast("long").alias("place"), "s.kind", "s.target")


@query(r"""
WITH t AS (SELECT doc_id, text, source, lang, text || chr(10) || chr(10) AS head FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(head || 'Of [[sources/' || source || '|it]], ' || CASE WHEN lang = 'en' THEN '[[lang/EN]]' ELSE lang || ' x' END || ', `[[lang/' || lang || ']]`, \[[y]] and ![f](' || CASE WHEN doc_id % 2 = 0 THEN 'img/' || source || '.png' ELSE 'asset:none' END || ').' || chr(10)) AS digest, CAST(doc_id % 2 AS INTEGER) AS faults FROM t
""")
def normalized_links(spark, d):
    """Whole texts with links and an image after them: known targets stay or get their right form, unknown ones become words, code stays."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "source", "lang")
    name = F.when(F.col("lang") == "en", "[[lang/en]]").otherwise(F.concat(F.lit("[[lang/"), "lang", F.lit("-x]]")))
    image = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("asset:"), "source")).otherwise("asset:none")
    made = docs.select("doc_id", F.concat(F.col("text"), F.lit("\n\nOf [[Sources/"), F.upper("source"), F.lit("|it]], "), name, F.lit(", `[[lang/"), F.col("lang"), F.lit("]]`, \\[[y]] and ![f]("), image, F.lit(").\n")).alias("text"))
    targets = docs.select(F.concat(F.lit("sources/"), "source").alias("target")).distinct().union(spark.range(1).select(F.lit("lang/EN")))
    assets = docs.select(F.col("source").alias("id"), F.concat(F.lit("img/"), F.col("source"), F.lit(".png")).alias("path")).distinct()
    out = markup.normalized_links(made, targets, assets)
    return out.select("doc_id", F.sha2("new_text", 256).alias("digest"), F.size("faults").alias("faults"))


@query("""
WITH c AS (SELECT conv_id, turn, text, 'c/' || conv_id || '/' || turn AS citation, '[evidence:' || substring(sha256('c/' || conv_id || '/' || turn), 1, 16) || ']' AS m FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, sha256(text || chr(10) || chr(10) || CASE WHEN turn % 3 = 1 THEN m ELSE citation END || ' `' || m || '`') AS digest, CAST(CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS unresolved FROM c
""")
def observed_citations(spark, d):
    """Turns that cite what they have observed; in every third the citation was not observed."""
    c = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text")
    named = c.withColumn("answer", F.concat_ws("/", F.lit("c"), "conv_id", "turn")).withColumn("m", T.short_citation(F.col("answer")))
    at_form = F.when(F.col("turn") % 2 == 0, F.regexp_replace("m", "^\\[", "[@")).otherwise(F.col("m"))
    said = F.concat("text", F.lit("\n\n"), F.when(F.col("turn") % 3 == 1, F.col("m")).otherwise(at_form), F.lit(" `"), "m", F.lit("`"))
    answers = named.select("conv_id", "turn", "answer", said.alias("text"))
    seen = answers.where("turn % 3 <> 1").select("answer", F.col("answer").alias("citation"))
    return markup.cited(answers, seen).select("conv_id", "turn", F.sha2("new_text", 256).alias("digest"), F.size("unresolved").alias("unresolved"))
