"""Office packages (zipped XML) and plain bytes as rows of blocks.

Readers take ``(path, content)`` tables such as ``spark.read.format("binaryFile")``
gives and run file by file in Arrow batches; what relates cells to each other
is DataFrame work.  A file that can't be read gives one row with ``error`` set.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions.checks import cell_place

# Limits of a package and the namespaces of its parts.
MEMBER_BYTES, PACKAGE_BYTES, MEMBERS, DEPTH = 128 << 20, 512 << 20, 4096, 8
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BLOCK = "path string, ord int, kind string, text string, location string, context string, error string"


class PackageError(ValueError):
    """A package that must not be opened."""


def checked(content: bytes) -> zipfile.ZipFile:
    """The package, unless members repeat, are encrypted, or are too many or too large."""
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as exc:
        raise PackageError("not_a_package") from exc
    members = package.infolist()
    names = [m.filename for m in members]
    if len(set(names)) < len(names):
        raise PackageError("repeated_member")
    if any(m.flag_bits & 1 for m in members):
        raise PackageError("encrypted")
    if len(members) > MEMBERS or sum(m.file_size for m in members) > PACKAGE_BYTES or any(m.file_size > MEMBER_BYTES for m in members):
        raise PackageError("too_large")
    return package


@F.pandas_udf(StringType())
def package_fault(content: pd.Series) -> pd.Series:
    """Why a package must not be opened, null if it may."""

    def one(raw):
        try:
            checked(bytes(raw))
        except PackageError as exc:
            return str(exc)
        return None

    return content.map(one)


def _xml(package: zipfile.ZipFile, name: str):
    raw = package.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise PackageError("entities")
    return ElementTree.fromstring(raw)


def _relations(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    try:
        rows = _xml(package, f"{folder}/_rels/{name}.rels").iter(f"{RELATION}Relationship")
    except KeyError:
        return {}
    inside = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): inside(r.get("Target")) for r in rows if r.get("TargetMode") != "External"}


def _joined(node, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter(tag))


def _sheets(package: zipfile.ZipFile) -> Iterator[dict]:
    book, to = _xml(package, "xl/workbook.xml"), _relations(package, "xl/workbook.xml")
    shared = [_joined(s, f"{SHEET}t") for s in _xml(package, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in package.namelist() else []
    for number, sheet in enumerate(book.iter(f"{SHEET}sheet"), 1):
        name, part = sheet.get("name"), to[sheet.get(f"{LINK}id")]
        page = _xml(package, part)
        tables = [t for p in _relations(package, part).values() if "/tables/" in p for t in [_xml(package, p)]]
        yield {"sheet": name, "sheet_index": number, "address": None, "value": name, "formula": False,
               "merged": [m.get("ref") for m in page.iter(f"{SHEET}mergeCell")],
               "tables": [{"name": t.get("displayName"), "ref": t.get("ref"), "headers": int(t.get("headerRowCount", "1"))} for t in tables]}
        for cell in page.iter(f"{SHEET}c"):
            raw, formula = cell.find(f"{SHEET}v"), cell.find(f"{SHEET}f")
            kind = cell.get("t")
            value = f"={formula.text}" if formula is not None and formula.text else None
            if value is None and kind == "inlineStr":
                value = _joined(cell, f"{SHEET}t")
            elif value is None and raw is not None and raw.text is not None:
                value = shared[int(raw.text)] if kind == "s" else {"1": "True", "0": "False"}.get(raw.text, raw.text) if kind == "b" else raw.text
            if value is not None:
                yield {"sheet": name, "sheet_index": number, "address": cell.get("r"), "value": value, "formula": formula is not None, "merged": None, "tables": None}


_CELL = "path string, sheet string, sheet_index int, address string, value string, formula boolean, merged array<string>, tables array<struct<name:string,ref:string,headers:int>>, error string"


def xlsx_cells(files: DataFrame) -> DataFrame:
    """A row for each sheet (no address; its merged ranges and tables) and each cell that holds a value."""
    names = [f.split()[0] for f in _CELL.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [{"path": path, "error": None, **r} for r in _sheets(checked(bytes(content)))]
                except (PackageError, KeyError, ElementTree.ParseError, ValueError, IndexError) as exc:
                    rows = [{n: None for n in names} | {"path": path, "error": str(exc) if isinstance(exc, PackageError) else "unreadable"}]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"sheet_index": "Int32", "formula": "boolean"})

    return files.select("path", "content").mapInPandas(read, _CELL)


def _corners(ref: Column) -> Column:
    return F.struct(cell_place(F.split_part(ref, F.lit(":"), F.lit(1))).alias("low"), cell_place(F.element_at(F.split(ref, ":"), -1)).alias("high"))


def xlsx_blocks(files: DataFrame) -> DataFrame:
    """``(path, sheet_index, sheet, row, col, kind, address, text, peers, first_above, merged, tables)``: a heading for each sheet, then a block for each cell by row and column.

    ``peers`` are the other cells of the row, ``first_above`` is the first cell
    of the column if it lies above, ``merged`` the merged range and ``tables``
    the declared tables (with their column's header) around a cell.
    """
    cells = xlsx_cells(files).where("error is null")
    place = cell_place(F.col("address"))
    own = cells.where("address is not null").withColumn("p", place).select("path", "sheet_index", "sheet", F.col("p.row").alias("row"), F.col("p.col").alias("col"), "address", "value")
    row = Window.partitionBy("path", "sheet_index", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    column = Window.partitionBy("path", "sheet_index", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    said = F.concat(F.col("address"), F.lit(": "), F.col("value"))
    near = own.withColumn("peers", F.collect_list(said).over(row)).withColumn("_first", F.first(F.struct("row", said.alias("said"))).over(column))
    near = near.withColumn("peers", F.filter("peers", lambda x: x != F.concat(F.col("address"), F.lit(": "), F.col("value")))).withColumn("first_above", F.when(F.col("_first.row") < F.col("row"), F.col("_first.said"))).drop("_first")
    sheets = cells.where("address is null")
    inside = lambda b: F.col("row").between(b["low"]["row"], b["high"]["row"]) & F.col("col").between(b["low"]["col"], b["high"]["col"])
    # A sheet's own ranges come with its row: an equal join on the sheet, then a filter of that sheet's list.
    ranges = sheets.select("path", "sheet_index", "merged", "tables")
    held = near.join(ranges, ["path", "sheet_index"])
    merged = F.get(F.filter("merged", lambda r: inside(_corners(r))), F.lit(0))
    within = F.transform(F.filter("tables", lambda t: inside(_corners(t["ref"]))), lambda t: F.struct(t["name"].alias("name"), t["ref"].alias("ref"), F.when((t["headers"] > 0) & (F.col("row") > _corners(t["ref"])["low"]["row"]), _corners(t["ref"])["low"]["row"]).alias("header_row")))
    blocks = held.select("path", "sheet_index", "sheet", "row", "col", F.lit("table").alias("kind"), "address", F.col("value").alias("text"), "peers", "first_above", merged.alias("merged"), within.alias("tables"))
    none = F.lit(None)
    heads = sheets.select("path", "sheet_index", "sheet", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("heading").alias("kind"), none.cast("string").alias("address"), F.col("sheet").alias("text"), F.array().cast("array<string>").alias("peers"), none.cast("string").alias("first_above"), none.cast("string").alias("merged"), F.array().cast("array<struct<name:string,ref:string,header_row:int>>").alias("tables"))
    return heads.unionByName(blocks)


def _word_rows(package: zipfile.ZipFile) -> Iterator[dict]:
    levels: dict[str, tuple] = {}
    if "word/styles.xml" in package.namelist():
        for s in _xml(package, "word/styles.xml").iter(f"{WORD}style"):
            outline, based = s.find(f"{WORD}pPr/{WORD}outlineLvl"), s.find(f"{WORD}basedOn")
            levels[s.get(f"{WORD}styleId")] = (None if outline is None else int(outline.get(f"{WORD}val")), None if based is None else based.get(f"{WORD}val"))

    def outline(p) -> int | None:
        own = p.find(f"{WORD}pPr/{WORD}outlineLvl")
        if own is not None:
            return int(own.get(f"{WORD}val"))
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        name, seen = None if style is None else style.get(f"{WORD}val"), set()
        while name in levels and name not in seen and len(seen) < 32:
            seen.add(name)
            if levels[name][0] is not None:
                return levels[name][0]
            name = levels[name][1]
        return None

    stack: list[tuple[int, str]] = []
    paragraph = table = 0
    for child in _xml(package, "word/document.xml").find(f"{WORD}body"):
        if child.tag == f"{WORD}p":
            paragraph += 1
            text, level = _joined(child, f"{WORD}t"), outline(child)
            if not text.strip():
                continue
            kind = "heading" if level is not None and level < 9 else "paragraph"
            if kind == "heading":
                stack = [s for s in stack if s[0] < level] + [(level, text)]
            where = {"kind": "docx", "paragraph": paragraph, "headings": [t for _, t in stack]}
            yield {"kind": kind, "text": text, "location": where | ({"heading_level": level + 1} if kind == "heading" else {}), "context": ""}
        elif child.tag == f"{WORD}tbl":
            table += 1
            rows = [[_joined(c, f"{WORD}t") for c in r.findall(f"{WORD}tc")] for r in child.findall(f"{WORD}tr")]
            for i, row in enumerate(rows, 1):
                for j, text in enumerate(row, 1):
                    if text.strip():
                        yield {"kind": "table", "text": text, "location": {"kind": "docx", "table": table, "row": i, "cell": j, "headings": [t for _, t in stack]}, "context": " | ".join(rows[0]) if i > 1 else ""}


def _slide_rows(package: zipfile.ZipFile) -> Iterator[dict]:
    to = _relations(package, "ppt/presentation.xml")
    for number, entry in enumerate(_xml(package, "ppt/presentation.xml").iter(f"{SLIDE}sldId"), 1):
        part = to[entry.get(f"{LINK}id")]

        def shapes(tree, groups, number=number):
            for s in tree:
                if s.tag == f"{SLIDE}grpSp":
                    own = s.find(f"{SLIDE}nvGrpSpPr/{SLIDE}cNvPr")
                    yield from shapes(s, [*groups, int(own.get("id"))])
                    continue
                own, place = s.find(f".//{SLIDE}cNvPr"), s.find(f".//{SLIDE}nvPr/{SLIDE}ph")
                where = {"kind": "pptx", "slide": number} | ({"object_id": int(own.get("id"))} if own is not None else {}) | ({"group_ids": groups} if groups else {})
                for i, row in enumerate(s.iter(f"{DRAW}tr"), 1):
                    for j, cell in enumerate(row.findall(f"{DRAW}tc"), 1):
                        if (text := "\n".join(_joined(p, f"{DRAW}t") for p in cell.iter(f"{DRAW}p"))).strip():
                            yield {"kind": "table", "text": text, "location": where | {"row": i, "cell": j}, "context": ""}
                if s.tag == f"{SLIDE}sp" and (text := "\n".join(_joined(p, f"{DRAW}t") for p in s.iter(f"{DRAW}p"))).strip():
                    role = None if place is None else place.get("type", "obj")
                    yield {"kind": "heading" if role in ("title", "ctrTitle") else "paragraph", "text": text, "location": where | ({"placeholder_type": role} if role else {}), "context": ""}

        yield from shapes(_xml(package, part).find(f"{SLIDE}cSld/{SLIDE}spTree"), [])
        for notes in (p for p in _relations(package, part).values() if "/notesSlides/" in p):
            text = "\n".join(_joined(p, f"{DRAW}t") for p in _xml(package, notes).iter(f"{DRAW}p"))
            if text.strip():
                yield {"kind": "paragraph", "text": text, "location": {"kind": "pptx", "slide": number, "notes": True}, "context": ""}


def _read(files: DataFrame, rows) -> DataFrame:
    names = [f.split()[0] for f in BLOCK.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = [{"path": path, "ord": i, "error": None, **r, "location": json.dumps(r["location"], ensure_ascii=False)} for i, r in enumerate(rows(checked(bytes(content))))]
                except (PackageError, KeyError, AttributeError, ElementTree.ParseError, ValueError) as exc:
                    found = [{n: None for n in names} | {"path": path, "ord": 0, "error": str(exc) if isinstance(exc, PackageError) else "unreadable"}]
                if found:
                    yield pd.DataFrame(found, columns=names)

    return files.select("path", "content").mapInPandas(read, BLOCK)


def docx_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs, headings (by outline level, inherited along styles) and table cells in document order, each under its headings."""
    return _read(files, _word_rows)


def pptx_blocks(files: DataFrame) -> DataFrame:
    """Shapes of every slide, those in groups too, tables by cell, and notes."""
    return _read(files, _slide_rows)


@F.pandas_udf(StringType())
def _other_text(content: pd.Series) -> pd.Series:
    """Text of bytes that aren't plain UTF-8, null for null."""

    def one(raw):
        if raw is None:
            return None
        raw = bytes(raw)
        marked = raw[:2] in (b"\xff\xfe", b"\xfe\xff")
        for name in ("utf-16",) if marked else ("utf-8-sig", "gb18030"):
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            if marked or "\x00" not in text:
                return text
        return None

    return content.map(one)


def decoded_text(content: Column | str) -> Column:
    """Text of bytes: UTF-16 by its mark, else UTF-8, else GB 18030; null if none fits or a NUL is left. Only what isn't plain UTF-8 leaves the JVM."""
    raw = F.col(content) if isinstance(content, str) else content
    text = F.coalesce(raw.cast("string"), F.lit(""))
    plain = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00"))
    bare = F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return F.coalesce(_other_text(F.when(~plain, raw)), F.when(plain, bare))


_SAVED = "array<struct<page:string,content:string,images:array<struct<path:string>>>>"


def saved_pages_text(saved: Column) -> Column:
    """A saved page array in JSON as one text, each entry under a heading and its image references after it; null for invalid, repeated or missing pages."""
    rows = F.from_json(saved, _SAVED)
    number = lambda r: F.when(F.rlike(r["page"], F.lit("^[1-9][0-9]*$")), r["page"])
    images = lambda r: F.transform(F.coalesce(r["images"]["path"], F.array().cast("array<string>")), lambda p: F.when((p != "") & ~F.rlike(p, F.lit(r"[\n\r()]")), F.concat(F.lit("![saved figure]("), p, F.lit(")"))))
    entry = lambda r: F.concat_ws("\n\n", F.concat(F.lit("# Saved content entry "), number(r), F.lit("\n\n"), r["content"]), images(r))
    broken = F.exists(rows, lambda r: number(r).isNull() | r["content"].isNull() | F.exists(images(r), lambda i: i.isNull()))
    pages = F.transform(rows, number)
    return F.when((F.size(rows) > 0) & ~broken & (F.size(F.array_distinct(pages)) == F.size(pages)), F.array_join(F.transform(rows, entry), "\n\n"))


def snapshot_markdown(blocks: DataFrame) -> DataFrame:
    """``(doc_id, text)``: blocks ``(doc_id, ord, block_id, text)`` in order, each under its anchor."""
    one = F.concat(F.lit('<a id="block-'), F.col("block_id"), F.lit('"></a>\n\n'), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("ord", one.alias("md"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["md"]), "\n\n").alias("text"))


def document_text(contents: DataFrame) -> DataFrame:
    """``(doc_id, pages, text)`` of ``(doc_id, page, content)``: contents by page with a thematic break between, blank ones left out."""
    rows = F.array_sort(F.collect_list(F.struct("page", "content")))
    filled = F.filter(F.transform(rows, lambda r: F.trim(r["content"])), lambda c: c != "")
    return contents.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_join(filled, "\n\n---\n\n").alias("text"))


def page_contents(contents: DataFrame, wanted: Column) -> DataFrame:
    """``(doc_id, text)``: the pages of ``(doc_id, page, content, images)`` that are in ``wanted`` (ranges, as ``page_ranges`` gives), each under its mark and with its images."""
    shown = F.concat_ws("\n", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]")), "content", F.when(F.size("images") > 0, F.concat(F.lit("Images: "), F.array_join("images", ", "))))
    rows = F.array_sort(F.collect_list(F.struct("page", shown.alias("t"))))
    return contents.where(F.exists(wanted, lambda r: F.col("page").between(r["first"], r["last"]))).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("text"))


def binding_lookup(bindings: DataFrame, **keys: str | None) -> DataFrame:
    """``bindings(seq, …)`` filtered by the keys given; with any key only the newest row."""
    wanted = {k: v for k, v in keys.items() if v is not None}
    found = bindings
    for k, v in wanted.items():
        found = found.where(F.col(k) == v)
    return found.orderBy(F.desc("seq")).limit(1) if wanted else found


def binding_inventory(bindings: DataFrame) -> DataFrame:
    """Every binding with a digest in place of its metadata."""
    return bindings.select(*[c for c in bindings.columns if c != "metadata"], F.sha2("metadata", 256).alias("metadata_sha256"))


def write_versioned(df: DataFrame, folder: str, version: str) -> DataFrame:
    """Write a table to a folder of its own version and read it back; readers of other versions see nothing of it until their pointer moves."""
    path = f"{folder.rstrip('/')}/v={re.sub(r'[^A-Za-z0-9._-]', '-', version)}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_log(df: DataFrame, folder: str) -> None:
    """Append ``(at, operation, description)`` as lines ``## [time] operation | description``."""
    line = F.concat(F.lit("## ["), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.col("operation"), F.lit(" | "), F.col("description"))
    df.select(line.alias("value")).write.mode("append").text(folder)


def graph_page(nodes: DataFrame, edges: DataFrame, template: str, mark: str = "__GRAPH__") -> DataFrame:
    """One row ``html``: the graph's JSON in a template, ``</`` escaped. The page holds the whole graph, as its reader does."""
    listed = nodes.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*nodes.columns)))).alias("n")).join(edges.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*edges.columns)))).alias("e")))
    graph = F.replace(F.concat(F.lit('{"nodes":'), F.col("n"), F.lit(',"edges":'), F.col("e"), F.lit("}")), F.lit("</"), F.lit("<\\/"))
    before, after = template.split(mark)
    return listed.select(F.concat(F.lit(before), graph, F.lit(after)).alias("html"))


def listing(files: DataFrame, outputs: str = "output", others: tuple[str, ...] = ("output", "reports", "explorations")) -> DataFrame:
    """``(name, kind, files)`` of ``files(path)``: folders of the output first, then loose files of the named folders."""
    parts = F.split("path", "/")
    top, deep = F.get(parts, F.lit(0)), F.size(parts)
    folders = files.where((top == outputs) & (deep > 2)).groupBy(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("name")).agg(F.lit("folder").alias("kind"), F.count("*").alias("files"))
    loose = files.where(top.isin(*others) & (deep == 2)).select(F.col("path").alias("name"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("files"))
    return folders.unionByName(loose)
