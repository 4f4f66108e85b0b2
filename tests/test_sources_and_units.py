"""Literal rows for readers, front matter, Markdown, checks, units, trees and streams."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import checks
from scriptorium.functions import frontmatter as fm
from scriptorium.functions import markdown as md
from scriptorium.functions import text as T
from scriptorium.operators import blocks, packages, status, tree, units, wiki
from scriptorium.sources import office
from scriptorium.streaming import watch


def column(spark, values, f, kind="string"):
    """``f`` of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i")
    return [r["y"] for r in rows.collect()]


def test_names(spark):
    assert column(spark, ["Ａ_B", "ﬁ--x/-Y-", None], T.normal_target) == ["a-b", "fi-x/y", None]
    assert column(spark, ["STRAẞE", "ΣΑΣ", "ﬀ", "Abc"], T.folded) == ["STRAẞE".casefold(), "ΣΑΣ".casefold(), "ff", "abc"]
    assert column(spark, ["99999999999,3,x,99999999999999999999", "2-4,4-2,1", None], T.page_spec) == [[3, 99999999999], [1, 2, 3, 4], None]
    assert column(spark, ["2-99999999999,9"], lambda c: T.page_spec(c, F.lit(4))) == [[2, 3, 4]]
    assert column(spark, ["Plan [copy].pdf", "a/Plan-copy-2.md", "copy of.pdf", "Copy Of Plan（副本）", "Plan copying"], T.document_label) == ["Plan", "Plan", "copy of", "Plan", "Plan copying"]
    assert column(spark, ["a%20b+c.PDF", "..pdf", "x" * 90, "(1).pdf"], lambda c: T.file_name(c, ".pdf")) == ["a-b-c.pdf", "document.pdf", "x" * 80 + ".pdf", "1.pdf"]
    heads = ["a; filename*=UTF-8''x%20y.pdf; filename=\"z\"", 'filename="q r.pdf"', "filename=b.pdf; x", "inline"]
    assert column(spark, heads, T.disposition_name) == ["x y.pdf", "q r.pdf", "b.pdf", None]
    assert column(spark, ["https://u:p@a/", "HTTP://A.b/?q#f", "upload:x", "attachment:zz", "ftp://a/"], T.origin) == [None, "http://a.b/?q", "upload:x", None, None]
    assert column(spark, ["Note_1", " B ", "other", "b", "!"], lambda c: F.lit(1)) and spark.range(1).select(T.entity_types(F.array(*map(F.lit, ["Note_1", " B ", "other", "b", "!"])))).first()[0] == ["note_1", "b", "other"]


def test_front_matter(spark):
    block = '---\ntype: "A: b"\nn: 5\nname: \'it\'\'s\'\nplain: some text # note\nsources: [a.pdf, "b, c.pdf"]\nnone: ~\n---\n'
    read = spark.createDataFrame([(block + "body\n---\n",)], "t string")
    b, body = fm.parts(F.col("t"))
    assert tuple(read.select(b, body).first()) == (block, "body\n---\n")
    got = read.select(b.alias("b")).select(*[fm.scalar(F.col("b"), k).alias(k) for k in ("type", "n", "name", "plain", "none", "gone")]).first()
    assert tuple(got) == ("A: b", None, "it's", "some text", None, None)
    assert column(spark, ['k: ["a", "b, c"]\n', "k: []\n", "k: [a, 'b']\n", "k: a\n", "x: [a]\n"], lambda c: fm.list_value(c, "k")) == [["a", "b, c"], [], ["a", "b"], None, None]
    assert column(spark, ["---\na: 1\nb: 2\n---\n", "---\nb: 2\n---\n"], lambda c: fm.set_line(c, "a", F.lit('x "y" \\1'))) == ['---\na: "x \\"y\\" \\\\1"\nb: 2\n---\n'] * 2
    assert column(spark, ["---\na: 1\n---\n"], lambda c: fm.drop_line(c, "a")) == ["---\n---\n"]
    texts = ["plain", '---\nsources: ["a"]\n---\nx', "---\nt: 1\n---\nx", '---\nsources: ["s"]\n---', "---\nsources: oops\n---\n", "--- open"]
    assert column(spark, texts, lambda c: fm.with_source(c, F.lit("s"))) == ['---\nsources: ["s"]\n---\n\nplain', '---\nsources: ["s", "a"]\n---\nx', '---\nsources: ["s"]\nt: 1\n---\nx', texts[3], texts[4], texts[5]]
    cut = column(spark, ['---\nsources: ["s", "a", "s"]\n---\nx', '---\nsources: ["s"]\n---', "none"], lambda c: F.struct(*[x.alias(n) for x, n in zip(fm.without_source(c, F.lit("s")), "te", strict=True)]))
    assert [tuple(r) for r in cut] == [('---\nsources: ["a", "s"]\n---\nx', False), ("---\nsources: []\n---", True), ("none", False)]
    faults = ["---\na: b: c\n---\n", '---\na: "x\n---\n', "---\n\ta: 1\n---\n", "---\na: [1\n---\n", '---\na: "x: y"\nb: c#d: e\nl:\n  - x\n---\n', "---\nnokey\n---\n"]
    assert column(spark, faults, fm.fault) == ["colon in a plain value", "open quote", "tab", "open bracket", None, "no key"]


def test_links_of_pages(spark):
    pages = [("concepts/A-b.md", "[[Concepts/a_B]] [[concepts/x|see x]] [[gone-by/the-way]]"), ("concepts/x.md", None), ("index.md", "[[concepts/x]]"), (None, "[[concepts/x]]"), ("sources/s.md", "[[nowhere]]")]
    rows = wiki.parsed(spark.createDataFrame(pages, "path string, text string"))
    assert sorted(tuple(r) for r in wiki.broken(rows).collect()) == [("concepts/A-b.md", "Concepts/a_B"), ("concepts/A-b.md", "gone-by/the-way")]
    fixed = {r["path"]: (r["text"], r["ghosts"]) for r in wiki.repaired(rows, wiki.targets(rows)).collect()}
    assert fixed == {"concepts/A-b.md": ("[[concepts/A-b]] [[concepts/x|see x]] the way", ["gone-by/the-way"])}
    assert {tuple(r) for r in wiki.back_links(rows).collect()} == {("concepts/x", "concepts/A-b")}
    plan = {r["path"]: (r["action"], r["text"]) for r in wiki.deletion(rows, spark.createDataFrame([("concepts/x.md",)], "path string")).collect()}
    assert plan["concepts/x.md"] == ("delete", None) and plan["index.md"] == ("modify", "x")
    assert plan["concepts/A-b.md"][1] == "[[concepts/A-b]] see x the way"
    empty = rows.limit(0)
    assert wiki.structural_lint(empty, spark.createDataFrame([], "name string, stem string")).count() == 0


def test_markdown(spark):
    said = ["a<think>x<analysis>y</think>b", "`<think>` c", "d<reasoning>", "```\n<think>\n``` e", "f</think>g", None]
    assert column(spark, said, md.visible_answer) == ["ab", "`<think>` c", "d", "```\n<think>\n``` e", "fg", None]
    assert column(spark, ["# a\n## b\n```\n# c\n```\nT\n---\n### d", "```\nopen", "#x"], md.local_headings) == ["### a\n### b\n```\n# c\n```\n### T\n### d", None, "#x"]
    links = "[a](b.md \"t\") ![i](c.png) `[x](y)` <https://e.f> <a class='k' href='h'>z</a>\n```\n[n](m)\n```"
    assert column(spark, [links], md.link_targets) == [["b.md", "c.png", "https://e.f", "h"]]
    assert column(spark, ["![a](data:image/png;base64,aGk=) ![b](data:image/gif;base64,!) ![c](x.png) ![d](../y.png) ![e](https://z)"], lambda c: md.without_embedded(c, F.lit("d")))[0].startswith("![a](images/d/img_001.png) ![b](data:")
    assert column(spark, ["![c](x.png) ![d](../y.png) ![e](https://z) ![f](a/../b.png) ![c](x.png)"], md.relative_images) == [["x.png", "a/../b.png"]]
    assert column(spark, ["# T\n\n![alt](x) **b** <script>s</script>[l](m)"], md.shown_text) == ["T\n\n b l"]
    assert column(spark, [1, 4, 19, 1994], lambda c: md.ordinal(c, 2), "int") == ["i", "iv", "xix", "mcmxciv"]
    assert column(spark, [1, 26, 28], lambda c: md.ordinal(c, 1), "int") == ["a", "z", "ab"]
    assert column(spark, ["What is it?", "何?"], md.slug)[0] == "what-is-it"


def test_checks(spark):
    assert column(spark, ["A1", "XFD1048576", "XFE1", "A1048577", "a1", "AB0"], checks.cell_place) == [(1, 1), (1048576, 16384), None, None, None, None]
    places = ['{"kind":"xlsx","sheet":"S","sheet_index":1,"cell_address":"B2","cell_range":"A1:C3"}', '{"kind":"xlsx","sheet":"S","sheet_index":0}', '{"kind":"pdf","page":1,"display_bbox":[0,0,1,1]}', '{"kind":"pptx","slide":1,"notes":true}', '{"kind":"text","line":"x"}', None]
    assert column(spark, places, checks.location_fault) == [None, "worksheet", "display box", None, "position", "kind"]
    nest = lambda inner, n: inner if not n else '{"kind":"docx","attachment":{"part":"p","name":"n","blob":"%s","position":%s}}' % ("a" * 64, nest(inner, n - 1))  # noqa: E731, UP031
    page = '{"kind":"pdf","page":%d}'
    assert column(spark, [nest(page % 1, 3), nest(page % 0, 2), nest(page % 1, 9), "x"], checks.nested_location_fault) == [None, "position", "depth", "kind"]
    assert column(spark, ['```json\n{"b":1,"a":[2]}\n```', '{"a":1,"a":1}', "3", None], checks.strict_json) == ['{"a":[2],"b":1}', None, None, None]
    assert column(spark, ['{"kind":"xlsx","sheet":"S","cell_address":"B2","attachment":{"name":"n","position":{"kind":"pdf","page":3}}}'], checks.placeless) == ['{"attachment":{"name":"n","position":{"kind":"pdf"}},"kind":"xlsx","sheet":"S"}']
    turned = spark.range(1).select(checks.scaled_box(F.array(*map(F.lit, [1.0, 2.0, 3.0, 5.0])), F.lit(100.0), F.lit(200.0), F.lit(20.0), F.lit(10.0), F.lit(90))).first()[0]
    assert len(turned) == 4 and turned[0] < turned[2] and turned[1] < turned[3]
    items = "array<struct<name:string,title:string,kind:string>>"
    got = column(spark, [[(" a ", None, "Tool"), ("", "x", "tool"), ("b", "B", "odd")]], lambda c: checks.typed_items(c, ["tool"]), items)[0]
    assert [tuple(x) for x in got] == [("a", "a", "tool"), ("b", "B", "other")]


def package(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts:
            z.writestr(name, text)
    return raw.getvalue()


RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
LINK = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@pytest.fixture(scope="module")
def books(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>H2</t></is></c></row>
      <row r="2"><c r="A2"><v>3.5</v></c><c r="B2"><f>A2*2</f><v>7</v></c><c r="C2"/></row><row r="3"><c r="A3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B4"/></mergeCells></worksheet>"""
    good = package([
        ("xl/workbook.xml", f'<workbook {main} {LINK}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", RELS.format('<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>')),
        ("xl/sharedStrings.xml", f"<sst {main}><si><t>H1</t></si></sst>"),
        ("xl/worksheets/sheet1.xml", sheet),
        ("xl/worksheets/_rels/sheet1.xml.rels", RELS.format('<Relationship Id="t" Target="../tables/table1.xml"/>')),
        ("xl/tables/table1.xml", f'<table {main} displayName="T" ref="A1:B2" headerRowCount="1"/>'),
    ])
    with pytest.warns(UserWarning):
        twice = package([("a", "1"), ("a", "2")])
    return spark.createDataFrame([("good.xlsx", bytearray(good)), ("bad.xlsx", bytearray(b"no zip")), ("twice.xlsx", bytearray(twice))], "path string, content binary")


def test_xlsx(spark, books):
    rows = office.xlsx_blocks(books).orderBy("row", "col").collect()
    assert [(r["kind"], r["address"], r["text"]) for r in rows] == [("heading", None, "One"), ("table", "A1", "H1"), ("table", "B1", "H2"), ("table", "A2", "3.5"), ("table", "B2", "=A2*2"), ("table", "A3", "True")]
    a2, a3 = rows[3], rows[5]
    assert (a2["peers"], a2["first_above"], [tuple(t) for t in a2["tables"]], a2["merged"]) == (["B2: =A2*2"], "A1: H1", [("T", "A1:B2", 1)], None)
    assert a3["merged"] == "A3:B4" and a3["tables"] == []
    assert {(r["path"], r["error"]) for r in office.xlsx_cells(books).where("error is not null").collect()} == {("bad.xlsx", "not_a_package"), ("twice.xlsx", "repeated_member")}
    assert office.xlsx_blocks(books.limit(0)).count() == 0


def test_docx_and_pptx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{style and f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>"""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('h')}</w:tc></w:tr><w:tr><w:tc>{p('v')}</w:tc></w:tr></w:tbl>"
    styles = f'<w:styles {w}><w:style w:styleId="Base"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="Own"><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Loop"><w:basedOn w:val="Loop"/></w:style></w:styles>'
    doc = package([("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'Own')}{p('one', 'Loop')}{p('  ')}{table}</w:body></w:document>"), ("word/styles.xml", styles)])
    files = spark.createDataFrame([("a.docx", bytearray(doc)), ("b.docx", bytearray(b"x"))], "path string, content binary")
    rows = office.docx_blocks(files).orderBy("path", "ord").collect()
    assert [(r["kind"], r["text"]) for r in rows[:4]] == [("heading", "Title"), ("paragraph", "one"), ("table", "h"), ("table", "v")]
    assert json.loads(rows[1]["location"]) == {"kind": "docx", "paragraph": 2, "headings": ["Title"]} and rows[3]["context"] == "h" and rows[4]["error"] == "not_a_package"

    a, s = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda i, text, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="{i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    title, inner = shape(2, "Top", '<p:ph type="title"/>'), shape(4, "in")
    slide = f'<p:sld {a} {s}><p:cSld><p:spTree>{title}<p:grpSp><p:nvGrpSpPr><p:cNvPr id="3"/></p:nvGrpSpPr>{inner}</p:grpSp></p:spTree></p:cSld></p:sld>'
    deck = package([
        ("ppt/presentation.xml", f'<p:presentation {s} {LINK}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>'),
        ("ppt/_rels/presentation.xml.rels", RELS.format('<Relationship Id="r1" Target="slides/slide1.xml"/>')),
        ("ppt/slides/slide1.xml", slide),
        ("ppt/slides/_rels/slide1.xml.rels", RELS.format('<Relationship Id="n" Target="../notesSlides/n1.xml"/>')),
        ("ppt/notesSlides/n1.xml", f"<p:notes {a} {s}><a:p><a:r><a:t>note</a:t></a:r></a:p></p:notes>"),
    ])
    got = office.pptx_blocks(spark.createDataFrame([("a.pptx", bytearray(deck))], "path string, content binary")).orderBy("ord").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("heading", "Top"), ("paragraph", "in"), ("paragraph", "note")]
    assert json.loads(got[1]["location"]) == {"kind": "pptx", "slide": 1, "object_id": 4, "group_ids": [3]} and json.loads(got[2]["location"])["notes"] is True


def test_bytes_and_sinks(spark, tmp_path):
    raw = ["é".encode(), "中文".encode("gb18030"), "x".encode("utf-16"), b"a\x00b", b"\xff\xfe\x00"]
    got = column(spark, [bytearray(x) for x in raw], office.decoded_text, "binary")
    assert got == ["é", "中文", "x", None, None]
    df = spark.createDataFrame([("2024-01-02 03:04:05", "add", "a doc")], "at string, operation string, description string").withColumn("at", F.col("at").cast("timestamp"))
    office.append_log(df, f"{tmp_path}/log")
    office.append_log(df, f"{tmp_path}/log")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/log").collect()] == ["## [2024-01-02 03:04:05] add | a doc"] * 2
    table = office.write_versioned(spark.range(3).toDF("id"), str(tmp_path / "t"), "v 1")
    assert table.count() == 3
    nodes, edges = spark.createDataFrame([("a</b",)], "id string"), spark.createDataFrame([("a", "b")], "source string, target string")
    assert office.graph_page(nodes, edges, "<x>__GRAPH__</x>").first()["html"] == '<x>{"nodes":[{"id":"a<\\/b"}],"edges":[{"source":"a","target":"b"}]}</x>'


def test_units(spark):
    text = "a" * 40 + "\n" + "b" * 30 + "\n" + "c" * 80
    assert column(spark, [text, "", None, "x" * 120], lambda c: units.spans(50)(c)) == [[(0, 41), (41, 72), (72, 122), (122, 152)], [], None, [(0, 50), (50, 100), (100, 120)]]
    rows = spark.createDataFrame([(1, 0, "f() {"), (1, 1, 'g("}")'), (1, 2, "}"), (2, 0, "x"), (2, 1, "}"), (3, 0, "{ '"), (3, 1, "};")], "doc_id long, ord int, text string")
    assert [tuple(r) for r in units.enclosing_code(rows).collect()] == [(1, 2, 0)]
    rng = random.Random(5)
    vocabulary = ["report", "first", "long", "results", "other", "words", "here"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 200)))) for i in range(20)]
    topic, allowance = "First results of the report", 300
    frame = spark.createDataFrame([*texts, (99, None), (98, "ẞhort")], "id long, text string")
    for count in (units.characters, stub_tokens):
        got = {}
        for r in units.existing_windows(frame, topic, allowance, count).collect():
            got.setdefault(r["id"], []).append((r["start"], r["end"]))
        for i, t in [*texts, (98, "ẞhort")]:
            assert sorted(got.get(i, [])) == windows_of(t, topic, allowance, count), i
        assert 99 not in got


def token_stub():
    """Counts that don't add up: a token for three characters, and one for each word or part of one. Made here, so that it goes to the workers by value."""
    return lambda texts: [-(-len(t) // 3) + len(t.split()) for t in texts]


stub_tokens = token_stub()


def windows_of(text, topic, allowance, count):
    """What a reader gets who asks for the best chunk again and again until none is left."""
    if count([text])[0] <= allowance:
        return [(0, len(text))]
    left = {a: text[a : a + allowance] for a in range(0, len(text), allowance)}
    score = lambda a: sum(w in left[a].casefold() for w in set(topic.casefold().split()))
    view = []
    while left:
        best = min(left, key=lambda a: (-score(a), a))
        more = sorted([*view, (best, left.pop(best))])
        if count(["\n\n".join(f"[Existing characters {a}:{a + len(c)}]\n{c}" for a, c in more)])[0] <= allowance:
            view = more
    return [(a, a + len(c)) for a, c in view]


def test_spans_by_tokens(spark):
    rng = random.Random(12)
    texts = ["", "a", "word " * 40, "\n" * 50, None, *["".join(rng.choice(["ab ", "c", "\n", "dé "]) for _ in range(rng.randrange(120))) for _ in range(20)]]
    for limit in (1, 2, 17, 120):
        for t, spans in zip(texts, column(spark, texts, lambda c, limit=limit: units.token_spans(limit, stub_tokens)(c)), strict=True):
            want, at = [], 0
            while t is not None and at < len(t):
                fit = [n for n in range(1, len(t) - at + 1) if stub_tokens([t[at : at + n]])[0] <= limit]
                size = max(fit, default=1)
                line = t.rfind("\n", at, at + size) - at if at + size < len(t) else -1
                size = line + 1 if line > size // 2 else size
                want.append((at, at + size, bool(fit)))
                at += size
            assert (spans is None and t is None) or [tuple(x) for x in spans] == want


def test_title_passages(spark):
    rng = random.Random(6)
    rows = [(t, o, o % 3, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 9))), f"head {o % 3}") for t in range(4) for o in range(12)]
    terms, want = units.title_terms("Alpha 中文字"), []
    assert terms == sorted({"alpha", "中文", "文字"})
    for t in range(4):
        ranked = sorted((r for r in rows if r[0] == t), key=lambda r: -sum(x in f"{r[3]} {r[4]}" for x in terms))
        first, rest, seen = [], [], set()
        for r in ranked:
            (rest if r[2] in seen else first).append(r)
            seen.add(r[2])
        used, held = 0, set()
        for r in [*first, *rest]:
            cost = len(r[3]) + (0 if r[2] in held else len(r[4]))
            if used + cost <= 90:
                used += cost
                held.add(r[2])
                want.append((t, r[1]))
    got = units.bounded_passages(spark.createDataFrame(rows, "topic int, ord int, scope int, text string, headings string"), "Alpha 中文字", 90)
    assert sorted((r["topic"], r["ord"]) for r in got.collect()) == sorted(want)


def test_trees_and_blocks_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, ord int, text string")
    assert tree.basic_tree(none, F.lit(None).cast("int")).count() == 0
    assert blocks.line_blocks(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()[0]["doc_id"] == 2
    one = spark.createDataFrame([(1, 0, "# a"), (1, 1, "x"), (1, 2, "## b"), (1, 3, "# c")], "doc_id long, ord int, text string")
    level = F.when(F.startswith("text", F.lit("#")), F.length(F.regexp_extract("text", "^(#+)", 1)))
    got = [tuple(r) for r in tree.basic_tree(one, level).orderBy("node").select("node", "parent", "start", "end", "title", "preview").collect()]
    assert got == [(0, None, 0, 4, None, ""), (1, 0, 0, 3, "# a", "# a\nx"), (2, 1, 2, 3, "## b", "## b"), (3, 0, 3, 4, "# c", "# c")]
    nested = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 2, 4)], "doc_id long, node int, start int, end int")
    asked = spark.createDataFrame([(1, i) for i in (0, 3, 7, 12)], "doc_id long, ord int")
    assert sorted(tuple(r) for r in blocks.node_of_block(asked, nested).collect()) == [(1, 0, 0), (1, 3, 1), (1, 7, 0)]


def test_skills_and_decks(spark):
    files = [("ok", "SKILL.md", "---\nname: ok\ndescription: does a useful thing for you\n---\n[[references/a]]"), ("ok", "references/a.md", "x"), ("bad", "SKILL.md", "---\nname: 5\ndescription: <b>\n---\n"), ("none", "x.md", "y")]
    got = sorted(tuple(r) for r in packages.skill_issues(spark.createDataFrame(files, "skill string, path string, text string")).select("skill", "issue").collect())
    assert got == [("bad", "description brackets"), ("bad", "description short"), ("bad", "name no text"), ("none", "no SKILL.md")]
    assert column(spark, [["a", "a", "", "a"], ["", ""], ["b", "b", "b"], []], packages.longest_run, "array<string>") == [2, 0, 3, 0]
    deck = spark.createDataFrame([("d", '<section class="slide" data-type="cover"></section>' * 8), ("e", None)], "deck string, html string")
    assert sorted(tuple(r)[:3] for r in packages.deck_issues(deck).collect()) == [("e", "error", "no page")]


def test_watching(spark):
    rows = [("a", 0, "s1", "x"), ("a", 50, "s2", "y"), ("a", 60, "s2", "y"), ("b", 10, "s", "z"), ("c", 20, "s", "z"), ("d", 5, "s", "old")]
    df = spark.createDataFrame(rows, "path string, at long, stamp string, digest string").withColumn("at", F.timestamp_seconds("at"))
    taken = spark.createDataFrame([("old",)], "digest string")
    assert sorted(tuple(r) for r in watch.settled(df, taken, "1970-01-01 00:01:10", 30).collect()) == [("b", "s", "z")]
    logs = spark.createDataFrame([("t", 1, "aé"), ("t", 2, "bc")], "task string, number int, content string")
    assert [r["text"] for r in watch.log_tail(logs, 3).collect()] == ["bc"], "a split character goes"


def test_status(spark):
    objects = spark.createDataFrame([(i,) for i in range(5)], "id long")
    with pytest.raises(Exception, match="changed since"):
        status.cleanup(objects, objects.where("id = 1"), "another").collect()
    registry = spark.createDataFrame([("h1", "a.pdf", "a"), ("h2", "b.pdf", "b")], "hash string, name string, doc_name string")
    states = [status.selection(registry, *x).first()["state"] for x in ((None, False), ("a.pdf", True), ("a.pdf", False), (".pdf", False), ("zz", False), (None, True))]
    assert states == ["invalid", "invalid", "ready", "multiple", "not_found", "ready"]
    assert status.selection(registry.limit(0), None, True).first()["state"] == "empty"


def test_topics(spark):
    from scriptorium.operators import knowledge

    rng = random.Random(8)
    rows = [(i, [f"L{rng.randrange(30)}" if rng.random() < 0.6 else f"own {i}", " ", None]) for i in range(60)] + [(60, []), (61, ["ｌ1"])]
    clusters = {i: {i} for i, _ in rows}
    forms = {i: {"l1" if x == "ｌ1" else x.lower() for x in labels if x and x.strip()} for i, labels in rows}
    for a in forms:
        for b in forms:
            if forms[a] & forms[b] and clusters[a] is not clusters[b]:
                clusters[a] |= clusters[b]
                for c in clusters[a]:
                    clusters[c] = clusters[a]
    got = knowledge.label_clusters(spark.createDataFrame(rows, "group long, labels array<string>")).collect()
    assert {r["group"]: r["cluster"] for r in got} == {i: min(c) for i, c in clusters.items()}
    texts = ["x<!-- source:s -->y<!-- /source:s -->z", "<!-- source:a --><!-- source:s -->y<!-- /source:s --><!-- /source:a -->", "<!-- /source:s --><!-- source:s -->", "none", None]
    assert column(spark, texts, lambda c: knowledge.without_range(c, F.lit("s"))) == ["xz", None, None, "none", None]
    assert column(spark, ["a\n## H\n- x\n## K\n- x", "no"], lambda c: knowledge.upsert_entry(c, "## K", F.lit("- y"), F.lit("- y 1"))) == ["a\n## H\n- x\n## K\n- y 1\n- x", "no"]
    with pytest.raises(Exception, match="unknown label"):
        knowledge.known_labels(spark.createDataFrame([("p", "z")], "plan string, label string"), spark.createDataFrame([("a", "m")], "label string, member string")).collect()
