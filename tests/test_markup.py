"""Scanning and rewriting Markdown: literal cases, and that bytes outside edits stay."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import markdown as md
from scriptorium.functions import markdown_scan
from scriptorium.functions import text as T
from scriptorium.operators import markup


def kinds(text):
    return [(s.kind, text[s.start : s.end], s.target) for s in markdown_scan.scan(text)[0]]


def test_inline_spans():
    assert kinds("a `b [c](d)` [e](f)") == [("code", "`b [c](d)`", ""), ("link", "[e](f)", "f")]
    assert kinds("`` a ` b `` \\[x](y) [p\\]q](r)") == [("code", "`` a ` b ``", ""), ("link", "[p\\]q](r)", "r")]
    assert kinds("[a [b] c](x(y)z)") == [("link", "[a [b] c](x(y)z)", "x(y)z")]
    assert kinds("[![i](p \"t\")](q)") == [("link", "[![i](p \"t\")](q)", "q"), ("image", "![i](p \"t\")", "p")]
    assert kinds("[a [b](c) d](e)") == [("link", "[b](c)", "c")], "links hold no links"
    assert kinds("[u](<a b> 'it') [v](c\\)d)") == [("link", "[u](<a b> 'it')", "a b"), ("link", "[v](c\\)d)", "c)d")]
    assert kinds("x [A  b][] and [a B], [t][a b], [no]\n\n[a b]: <u v>") == [("link", "[A  b][]", "u v"), ("link", "[a B]", "u v"), ("link", "[t][a b]", "u v"), ("definition", "[a b]: <u v>", "u v")]
    assert kinds("<https://a.b/c?d=&amp;> <m@n.op> <a href='z'>q</a>") == [("autolink", "<https://a.b/c?d=&amp;>", "https://a.b/c?d=&"), ("autolink", "<m@n.op>", "m@n.op"), ("tag", "<a href='z'>", ""), ("tag", "</a>", "")]
    assert kinds("[[a/b|c d]] [@evidence:12] [evidence:x]") == [("wiki", "[[a/b|c d]]", "a/b"), ("citation", "[@evidence:12]", "[evidence:12]"), ("citation", "[evidence:x]", "[evidence:x]")]
    assert kinds("a `b\nc` d `e\n\nf` g") == [("code", "`b\nc`", "")], "a span ends with its paragraph"


def test_blocks():
    assert kinds("```x\n[a](b)\n~~~\n```\n[c](d)") == [("code", "```x\n[a](b)\n~~~\n```\n", ""), ("link", "[c](d)", "d")]
    assert kinds("````\n```\n[a](b)\n````") == [("code", "````\n```\n[a](b)\n````", "")]
    assert kinds("p\n    [a](b)\n\n    [c](d)\n") == [("link", "[a](b)", "b"), ("code", "    [c](d)\n", "")]
    assert kinds("- x\n\n    [a](b)") == [("link", "[a](b)", "b")], "indented text of a list is no code"
    assert kinds("> `a\n> b` [c](d)") == [("code", "`a\n> b`", ""), ("link", "[c](d)", "d")]
    assert kinds("<script>\n[a](b)\n</script>\n[c](d)")[1:] == [("link", "[c](d)", "d")]
    assert kinds("<!-- [a](b)\n--> \n\n[c](d)")[1:] == [("link", "[c](d)", "d")]
    assert kinds("|a|b|\n|-|-|\n|`x|y`|[c\\|d](e)|\n\n|f|") == [("link", "[c\\|d](e)", "e")], "a bar parts cells, in code too"
    assert kinds("T\r\n===\r\n# [h](i)\r\n") == [("underlined", "T\r\n===\r\n", "1"), ("heading", "# [h](i)\r\n", "1"), ("link", "[h](i)", "i")]
    assert markdown_scan.scan("~~~\nx")[1] and not markdown_scan.scan("~~~\n~~~")[1]
    assert markdown_scan.scan("") == ([], False)


def test_links_and_bytes_that_stay(spark):
    rows = [
        (1, "[[Con_cepts/A]] [[gone/by-the_way]] [[x|see]]\r\n\t`[[x]]` \\[[x]]\r\n"),
        (2, "|h|\n|-|\n|[[Con_cepts/A\\|al]] [[a-b\\|c]]|\n"),
        (3, "![f](asset:1 'a \"q\"') ![g](img/two.bin) ![h](else) [![f](asset:1)](u)"),
        (None, None), (None, "[[x]]"), (None, "[[x]]"), (4, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("target", F.lit("clash")).withColumn("key", F.lit(1))
    targets = spark.createDataFrame([("con-cepts/a",), ("con-cepts/a",)], "target string")
    assets = spark.createDataFrame([("1", "img/one.png"), ("2", "img/two.bin")], "id string, path string")
    got = markup.normalized_links(docs, targets, assets).collect()
    assert len(got) == len(rows) and {r["target"] for r in got} == {"clash"}
    text = {r["doc_id"]: r["new_text"] for r in got if r["doc_id"]}
    assert text[1] == "[[con-cepts/a]] by the way see\r\n\t`[[x]]` \\[[x]]\r\n"
    assert text[2] == "|h|\n|-|\n|[[con-cepts/a\\|al]] c|\n"
    assert text[3] == "![f](img/one.png \"a &quot;q&quot;\") [g](img/two.bin) ![h](else) [![f](img/one.png)](u)"
    assert [r["faults"] for r in got if r["doc_id"] == 3] == [["no asset else"]]
    assert sorted(str(r["new_text"]) for r in got if r["doc_id"] is None) == ["None", "x", "x"]
    assert text[4] == ""
    only = {r["doc_id"]: r["new_text"] for r in markup.normalized_links(docs, targets.limit(0), assets, links_only=True).collect()}
    assert only[3] == rows[2][1] and only[2] == "|h|\n|-|\n|al c|\n"


def test_bytes_outside_the_links_stay(spark):
    rng = random.Random(9)
    pieces = ["[[x]]", "`a", "`", "``", "\n", "\n\n", "    ", "# ", "> ", "- ", "|", "\\", "]", "(u)", "![", "é日", "<b>", "```\n", "\r\n", "text "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    none = spark.createDataFrame([], "target string")
    got = {r["doc_id"]: r["new_text"] for r in markup.normalized_links(docs, none, spark.createDataFrame([], "id string, path string"), links_only=True).collect()}
    for i, t in enumerate(texts):
        spans = [s for s in markdown_scan.scan(t)[0] if s.kind == "wiki"]
        want = t
        for s in sorted(spans, key=lambda s: -s.start):
            assert t[s.start : s.end] == "[[x]]"
            want = want[: s.start] + "x" + want[s.end :]
        assert got[i] == want


def test_citations_of_answers(spark):
    marks = {c: spark.range(1).select(T.short_citation(F.lit(c))).first()[0] for c in ("c1", "c2")}
    text = f"{marks['c1']} `{marks['c1']}` [@{marks['c2'][1:]} [evidence:zz]\n\n|a|\n|-|\n|{marks['c1']}|"
    answers = spark.createDataFrame([(1, text), (2, text), (3, None)], "answer int, text string")
    seen = spark.createDataFrame([(1, "c1"), (1, "c1"), (1, "c2"), (2, None)], "answer int, citation string")
    got = {r["answer"]: (r["new_text"], r["unresolved"]) for r in markup.cited(answers, seen).collect()}
    assert got[1] == (f"c1 `{marks['c1']}` c2 [evidence:zz]\n\n|a|\n|-|\n|c1|", ["[evidence:zz]"])
    assert got[2][0] == text and len(got[2][1]) == 3 and got[3] == (None, [])
    pairs = F.array(*[F.array(F.lit(marks["c1"]), F.lit(v)) for v in ("p", "q")], F.array(F.lit(marks["c2"]), F.lit("r")))
    assert answers.where("answer = 1").select(md.render_citations(F.col("text"), pairs)).first()[0] == text.replace(f"[@{marks['c2'][1:]}", "r")


def test_addresses(spark):
    import posixpath
    from urllib.parse import unquote, urlsplit

    links = ["sources/a%20b.md?q=1#x", "../x/../sources/./y", "/sources//z/..", "x#block-%31", "other", "http://h/sources/a", "//h/sources", "sources/%zz", "a+b/sources", "", "mailto:sources/x", "//[/sources", "sources/../..", "sources", "#block-", "?q#block-2", "é/sources/ü#ä"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, x string").select("i", md.source_place(F.col("x")).alias("p")).orderBy("i").collect()
    for r, link in zip(got, links, strict=True):
        try:
            parts = urlsplit(link)
            path, fragment = posixpath.normpath(unquote(parts.path)), unquote(parts.fragment)
            want = None if parts.scheme or parts.netloc or not ("sources" in path.split("/") or fragment.startswith("block-")) else (path, parts.query, fragment)
        except ValueError:
            want = (link, "invalid", "")
        assert (tuple(r["p"]) if r["p"] is not None else None) == want, link
