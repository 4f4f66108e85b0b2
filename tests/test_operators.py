"""Literal rows for rules that the driver tables don't reach."""

import datetime

from pyspark.sql import functions as F

from scriptorium.functions import frontmatter as fm
from scriptorium.functions import text as T
from scriptorium.operators import blocks, coverage, graph, links, search, store, usage
from scriptorium.sources import pages
from scriptorium.streaming import watch


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "A__B--c/-d_/e", T.normal_target) == "a-b-c/d/e"
    assert one(spark, "see [[a|b]] and [[ c ]]", T.wikilinks) == ["a", "c"]
    assert one(spark, "é x!!y ", T.document_stem) == "é-x-y"
    assert one(spark, "a!!b", T.concept_name) == "a--b"
    assert one(spark, "!!", T.document_stem) == "document"
    assert one(spark, "HTTP://Ex.Com#f", T.url_origin) == "http://ex.com/"
    assert one(spark, "Copy of Plan (copy 2)", T.document_label) == "Plan"
    assert one(spark, "x" * 70, T.title_from) == "x" * 59 + "…"
    assert one(spark, "ﬁ", T.nfkc) == "fi"
    assert one(spark, "Straße", T.casefold) == "strasse"
    head, body = fm.parts(F.col("x"))
    assert tuple(spark.createDataFrame([("---\na: 1\n----\nb",)], "x string").select(head, body).first()) == ("---\na: 1\n----\n", "b")


def test_quotes(spark):
    rows = [("dpkg\t-i", "dpkg -i", False, None), ("a b", "a b", False, 0), ("a b", "a b", True, None), ("aa", "a", False, None), ("xay", "a", False, 1), ("", "", False, None)]
    df = spark.createDataFrame(rows, "t string, q string, c boolean, want int")
    for r in df.withColumn("got", T.unique_place(F.col("t"), F.col("q"), F.col("c"))).collect():
        assert r["got"] == r["want"], r


def test_markdown_blocks(spark):
    text = "# H\npara\nmore\n\n```\n# not\n\ncode\n```\nend"
    rows = blocks.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r["kind"], r["line"], r["text"]) for r in rows] == [("heading", 1, "# H"), ("paragraph", 2, "para\nmore"), ("code", 5, "```\n# not\n\ncode\n```"), ("paragraph", 10, "end")]


def test_coverage_drops_units_before_the_cursor(spark):
    docs = spark.createDataFrame([(1, 10), (2, 0)], "doc_id long, chars long")
    units = spark.createDataFrame([(1, 2, 5, "verified"), (1, 4, 9, "verified")], "doc_id long, start long, end long, status string")
    rows = {(r["doc_id"], r["start"], r["end"], r["status"]) for r in coverage.coverage_ranges(docs, units).collect()}
    assert rows == {(1, 0, 2, "pending"), (1, 2, 5, "verified"), (1, 5, 10, "pending"), (2, 0, 0, "pending")}


def test_links(spark):
    wiki = spark.createDataFrame([("concepts/a", ["B_c", "concepts/missing"]), ("concepts/b-c", []), ("summaries/dup", []), ("concepts/dup", ["concepts/dup"])], "path string, links array<string>")
    assert {r["target"] for r in links.broken_links(wiki).collect()} == {"B_c", "concepts/missing"}
    assert {r["path"] for r in links.orphans(wiki).collect()} == {"concepts/b-c", "summaries/dup"}
    assert links.graph_edges(wiki).count() == 0
    assert {(r["target"], r["to"]) for r in links.resolved_readings(wiki).collect()} == {("B_c", "concepts/b-c"), ("concepts/missing", None), ("concepts/dup", "concepts/dup")}


def test_graph(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("w", "x")], "src string, dst string")
    got = graph.reachable(spark.createDataFrame([("a",)], "id string"), refs, spark.createDataFrame([("w",)], "id string"))
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c", "w"]
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    assert {r["label"] for r in graph.components(edges).collect()} == {0, 30}


def test_store(spark):
    registry = spark.createDataFrame([("h1", "Paper.pdf", "paper"), ("paper", "x", "y")], "hash string, name string, doc_name string")
    assert [r["hash"] for r in store.lookup(registry, "paper").collect()] == ["paper"]
    assert [r["hash"] for r in store.lookup(registry, "PDF").collect()] == ["h1"]
    merged = spark.range(1).select(store.merge_patch(F.expr("map('a', 'x', 'b', 'y')"), F.expr("map('a', null, 'c', 'z')")).alias("m")).first()["m"]
    assert merged == {"b": "y", "c": "z"}


def test_usage(spark):
    verdicts = spark.createDataFrame([("a", True), ("a", None), ("b", None)], "k string, passed boolean")
    assert {r["k"]: (r["scored"], r["rate"]) for r in usage.rates(verdicts, "k").collect()} == {"a": (1, 1.0), "b": (0, 0.0)}


def test_search_page(spark):
    rows = spark.range(7).toDF("i")
    page = search.page(rows, ["i"], 5, 5).collect()
    assert [(r["i"], r["total"], r["next_offset"]) for r in page] == [(5, 7, None), (6, 7, None)]


def test_saved_pages(spark):
    df = spark.createDataFrame([('[{"page": "2", "content": "a"}, {"page_num": "x", "text": "b"}, {"content": " "}]',)], "json string")
    assert [tuple(r) for r in pages.page_records(df).collect()] == [(2, "a"), (2, "b")]
    assert one(spark, "<p>a &amp; b</p><script>x</script>", pages.html_text) == "a & b"


def test_stream_equals_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "b", at), (1, "a", at + datetime.timedelta(seconds=1)), (1, "a", at + datetime.timedelta(seconds=30)), (2, "c", at), (3, "end", at + datetime.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "k int, path string, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = watch.debounced(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "2 seconds", "k", delay="1 second")
    run = stream.writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {(r["k"], tuple(r["paths"])) for r in spark.table("flushed").collect()}
    assert got == {(1, ("a", "b")), (1, ("a",)), (2, ("c",))}
