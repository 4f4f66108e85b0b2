"""Markdown text outside code: answers, citations, headings, images and links.

What stands where comes from ``markdown_scan``, as an Arrow-batched function of one
column; edits are spliced in at those places.  Nulls stay null.
"""

from __future__ import annotations

import base64
import binascii
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from scriptorium.functions import markdown_scan
from scriptorium.functions.text import let

#: Names of reasoning envelopes.
ENVELOPES = ("think", "thinking", "analysis", "reasoning")

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), *[StructField(n, StringType()) for n in ("target", "label", "title")], StructField("cell", BooleanType())]))
EDITS = "array<struct<start:int,end:int,value:string>>"


def _mapped(fn):
    return lambda s: s.map(lambda t: None if t is None else fn(t))


@F.pandas_udf(SPANS)
def markdown_spans(text: pd.Series) -> pd.Series:
    """Kinds and places of what a Markdown text holds: code, raw, heading, underlined, definition, tag, autolink, link, image, wiki, citation."""
    return _mapped(lambda t: [s._asdict() for s in markdown_scan.scan(t)[0]])(text)


@F.pandas_udf(StringType())
def spliced(text: pd.Series, edits: pd.Series) -> pd.Series:
    """The text with ``edits``, an array of ``(start, end, value)``, put in; all other characters stay."""

    def one(t, e):
        return None if t is None else markdown_scan.spliced(t, [(x["start"], x["end"], x["value"]) for x in (e if e is not None else [])])

    return pd.Series([one(t, e) for t, e in zip(text, edits, strict=True)], dtype=object)


def _envelopes(text: str) -> str:
    """Each tag of an envelope moves a depth; text of depth 0 stays. An end tag closes all that was opened after its own begin tag."""
    tags = [(s, re.fullmatch(r"<\s*(/?)\s*(\w+)\s*>", s.label)) for s in markdown_scan.scan(text)[0] if s.kind == "tag"]
    depth_of: list[str] = []
    hidden, begun = [], 0
    for span, m in tags:
        if m is None or m[2].lower() not in ENVELOPES:
            continue
        was, name = bool(depth_of), m[2].lower()
        if m[1]:
            depth_of = depth_of[: depth_of.index(name)] if name in depth_of else depth_of
        else:
            depth_of = [*depth_of, name]
        if not was:
            begun = span.start
        if not depth_of:
            hidden.append((begun, span.end, ""))
    return markdown_scan.spliced(text, [*hidden, *([(begun, len(text), "")] if depth_of else [])]).strip()


@F.pandas_udf(StringType())
def visible_answer(text: pd.Series) -> pd.Series:
    """The text without reasoning envelopes, nested and unfinished ones too, outside code."""
    return _mapped(_envelopes)(text)


def citation_markers(text: Column) -> Column:
    """Citation markers outside code, in order, each in its short form."""
    return F.transform(F.filter(markdown_spans(text), lambda s: s["kind"] == "citation"), lambda s: s["target"])


@F.pandas_udf(StringType())
def render_citations(text: pd.Series, bindings: pd.Series) -> pd.Series:
    """Markers outside code replaced as ``bindings`` (``[marker, citation]`` pairs) says; unknown ones and markers bound to several citations stay."""

    def edits(spans, pairs):
        for s in spans:
            to = {c for m, c in pairs if m == s.target} if s.kind == "citation" else ()
            if len(to) == 1:
                yield s.start, s.end, max(to).replace("|", "\\|") if s.cell else max(to)

    def one(t, pairs):
        return None if t is None else markdown_scan.spliced(t, list(edits(markdown_scan.scan(t)[0], pairs if pairs is not None else [])))

    return pd.Series([one(t, b) for t, b in zip(text, bindings, strict=True)], dtype=object)


def _third_level(text: str) -> str | None:
    spans, still_open = markdown_scan.scan(text)
    edits = [(s.start, s.start + int(s.target), "###") for s in spans if s.kind == "heading" and s.target in "12"]
    for s in spans:
        if s.kind == "underlined":
            # The last line above the rule is the heading; the rule and its break go.
            above = text.rfind("\n", 0, int(s.label) - 1) + 1
            above += len(text[above:]) - len(text[above:].lstrip(" \t"))
            edits += [(above, above, "### "), (int(s.label), s.end, "")]
    return None if still_open else markdown_scan.spliced(text, edits).strip()


@F.pandas_udf(StringType())
def local_headings(content: pd.Series) -> pd.Series:
    """First and second level headings, underlined ones too, as third level outside fences; null if a fence stays open."""
    return _mapped(_third_level)(content)


class _Attributes(HTMLParser):
    """Addresses that the anchors and images of a piece of HTML name."""

    FIELDS = {"a": "href", "img": "src"}

    def __init__(self, piece: str):
        super().__init__()
        self.found: list[str] = []
        self.feed(piece)
        self.close()

    def handle_starttag(self, tag, attrs):
        address = dict(attrs).get(self.FIELDS.get(tag, ""))
        if address:
            self.found.append(address)


def _addresses(text: str) -> list[str]:
    out = []
    for s in markdown_scan.scan(text)[0]:
        if s.kind in ("link", "image", "autolink"):
            out.append(s.target)
        elif s.kind in ("tag", "raw"):
            out += _Attributes(text[s.start : s.end]).found
    return out


@F.pandas_udf(ArrayType(StringType()))
def link_targets(text: pd.Series) -> pd.Series:
    """Targets of Markdown links and images, of autolinks and of HTML anchors and images, outside code, in order."""
    return _mapped(_addresses)(text)


#: Tags whose contents nobody sees.
UNSEEN = re.compile(r"<(script|style)\b[^>]*>[\s\S]*?(?:</\1\s*>|\Z)", re.I)


def _readable(text: str) -> str:
    """Labels instead of links, code without its marks, nothing of images and tags; then marks of lines and emphasis off."""
    spans = markdown_scan.scan(text)[0]
    edits = [(m.start(), m.end(), "") for m in UNSEEN.finditer(text)]
    for s in spans:
        if s.kind in ("image", "tag", "raw", "definition"):
            edits.append((s.start, s.end, ""))
        elif s.kind == "link":
            inner = s.start + 1
            edits += [(s.start, inner, ""), (inner + len(s.label), s.end, "")]
        elif s.kind == "autolink":
            edits.append((s.start, s.end, s.target))
        elif s.kind == "code" and s.label:
            edits.append((s.start, s.end, s.label))
        elif s.kind == "heading":
            edits.append((s.start, s.start + int(s.target) + 1, ""))
        elif s.kind == "underlined":
            edits.append((int(s.label), s.end, ""))
    plain = markdown_scan.spliced(text, edits)
    lines = (line for line in plain.split("\n") if not re.match(r"[ \t]*(```|~~~)", line) and not ("-" in line and markdown_scan.DELIMITER.fullmatch(line)))
    stripped = (re.sub(r"[*_`|]", "", re.sub(r"^\s{0,3}(>\s?|[-*+]\s+)", "", line)) for line in lines)
    return "\n".join(stripped).strip()


@F.pandas_udf(StringType())
def shown_text(text: pd.Series) -> pd.Series:
    """Visible text of Markdown: no image descriptions, markup, scripts or styles."""
    return _mapped(_readable)(text)


#: The parts of an address: scheme, host, path, query, fragment.
ADDRESS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def _decoded_part(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def tidy_path(path: Column) -> Column:
    """A path without empty, ``.`` and undone parts; ``.`` for nothing, leading ``..`` of a relative path stay."""
    rooted = F.startswith(path, F.lit("/"))

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = F.when(last.isNull(), F.when(rooted, kept).otherwise(F.array_append(kept, part))).when(last == "..", F.array_append(kept, part)).otherwise(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        return F.when((part == "") | (part == "."), kept).when(part == "..", back).otherwise(F.array_append(kept, part))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def source_place(link: Column) -> Column:
    """A link to a source as path, query and fragment, each decoded by itself; nulls for links elsewhere. A host with an open bracket gives the link with the query ``invalid``."""
    part = lambda i: F.regexp_extract(link, ADDRESS, i)
    broken = F.contains(part(2), F.lit("[")) != F.contains(part(2), F.lit("]"))
    here = (part(1) == "") & ~F.rlike(link, F.lit(r"^[^/?#]*//")) | (part(1) == "") & (part(2) == "")
    path, fragment = tidy_path(_decoded_part(part(3))), _decoded_part(part(5))
    row = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("path", "query", "fragment"), strict=True)])
    inner = let(path, lambda p: let(fragment, lambda f: F.when(F.array_contains(F.split(p, "/"), "sources") | F.startswith(f, F.lit("block-")), row(p, part(4), f))))
    return F.when(broken, row(link, F.lit("invalid"), F.lit(""))).when(here, inner)


def _decoded(data: str) -> bytes | None:
    try:
        return base64.b64decode(data, validate=True)
    except (binascii.Error, ValueError):
        return None


_EMBEDDED = r"!\[([^\]]*)\]\(data:image/([^;]+);base64,([^)]+)\)"


@F.pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("content", BinaryType())])))
def embedded_images(text: pd.Series) -> pd.Series:
    """Decoded images of data addresses, numbered in order; ones that don't decode are left out."""

    def found(t: str):
        good = [(m[2], raw) for m in re.finditer(_EMBEDDED, t) if (raw := _decoded(m[3])) is not None]
        return [{"name": f"img_{i:03d}.{kind}", "content": raw} for i, (kind, raw) in enumerate(good, 1)]

    return _mapped(found)(text)


@F.pandas_udf(StringType())
def without_embedded(text: pd.Series, name: pd.Series) -> pd.Series:
    """The text with decoded images as references ``images/<name>/img_NNN.<kind>``."""

    def one(t, n):
        count = 0

        def put(m):
            nonlocal count
            if _decoded(m[3]) is None:
                return m[0]
            count += 1
            return f"![{m[1]}](images/{n}/img_{count:03d}.{m[2]})"

        return None if t is None else re.sub(_EMBEDDED, put, t)

    return pd.Series([one(t, n) for t, n in zip(text, name, strict=True)], dtype=object)


def relative_images(text: Column) -> Column:
    """Distinct local image targets that stay inside the folder, in order."""
    found = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\((?!https?://|data:)([^)]+)\)"), F.lit(1))
    depth = lambda p: F.aggregate(F.split(p, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), _step, lambda a: a["low"])

    def _step(acc: Column, part: Column) -> Column:
        at = acc["at"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(at.alias("at"), F.least(acc["low"], at).alias("low"))

    return F.array_distinct(F.filter(found, lambda p: ~F.startswith(p, F.lit("/")) & (depth(p) >= 0)))


# The numerals and their worth.
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def ordinal(number: Column, depth: int) -> Column:
    """A list number: decimal at the first level, letters at the second, Roman at the third, and so on."""
    if depth % 3 == 0:
        return number.cast("string")
    if depth % 3 == 1:
        letter = lambda i: F.char((F.lit(97) + i).cast("long"))
        return F.when(number <= 26, letter(number - 1)).otherwise(F.concat(letter(F.floor((number - 1) / 26) - 1), letter((number - 1) % 26)))
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for v, n in ROMAN])
    start = F.struct(number.cast("int").alias("left"), F.lit("").alias("out"))
    worth = lambda a, r: F.floor(a["left"] / r["v"]).cast("int")
    step = lambda a, r: F.struct((a["left"] - worth(a, r) * r["v"]).alias("left"), F.concat(a["out"], F.repeat(r["n"], worth(a, r))).alias("out"))
    return F.aggregate(table, start, step, lambda a: a["out"])


def slug(question: Column, limit: int = 60) -> Column:
    """Lower-case ASCII letters and digits of a question joined by hyphens, ``limit`` characters at most; the start of its hash if none are left."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(F.lower(question), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(clean == "", F.substring(F.sha2(question, 256), 1, 12)).otherwise(clean)
