"""Where things stand in a Markdown text: kinds with places, for edits that leave all other bytes alone.

First the lines are sorted into kinds; runs of prose lines (or single cells of a table)
are then read as one string that knows where each of its characters stands.
Places are in code points of the text.  Not read as Markdown: indented code within
lists, and what stands in script, style, pre and comment blocks.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

LINE = re.compile(r"[^\r\n]*(?:\r\n?|\n|\Z)")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})(.*)")
RULE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
HASHES = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
PREFIX = re.compile(r"(?: {0,3}>[ \t]?)*(?:[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+)*(?:[ \t]*>[ \t]?)*")
ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)")
DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
RAW_OPEN = re.compile(r" {0,3}<(?:(script|style|pre|textarea)(?=[\s>]|$)|(!--))", re.I)
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
WIKI = re.compile(r"\[\[([^\]]+)\]\]")
CITATION = re.compile(r"\[@?evidence:([^\]\r\n]+)\]")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)+)>")
TAG = re.compile(r"<(?:!--[\s\S]*?-->|/?\s*[A-Za-z][\w-]*(?:\s+[^\s\"'=<>`/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|\s*/?\s*[A-Za-z]+\s*>)")
AFTER = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.)*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?)(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)")
REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    target: str = ""
    label: str = ""
    title: str = ""
    cell: bool = False


class Prose(NamedTuple):
    """A string and the place of each of its characters."""

    text: str
    places: list[int]
    cell: bool = False


def lines_of(text: str) -> list[tuple[int, int, str]]:
    """Start, end with the break, and body of each line."""
    out = [(m.start(), m.end(), m[0].rstrip("\r\n")) for m in LINE.finditer(text) if m[0]]
    return out


def _cells(start: int, body: str) -> list[Prose]:
    """The cells of a table's row; the backslash before an escaped bar is not part of a cell."""
    out, text, places = [], [], []
    i = 0
    while i <= len(body):
        if i == len(body) or body[i] == "|":
            if "".join(text).strip():
                out.append(Prose("".join(text), places, True))
            text, places = [], []
        elif body.startswith("\\|", i):
            i += 1
            text.append("|")
            places.append(start + i)
        else:
            text.append(body[i])
            places.append(start + i)
        i += 1
    return out


def blocks(text: str) -> tuple[list[Span], list[Prose], bool]:
    """Spans of code, raw HTML, headings and definitions; prose in order; whether a fence stays open."""
    spans: list[Span] = []
    prose: list[Prose] = []
    run: list[tuple[int, str]] = []
    fence, fence_at, raw, raw_at, listed, table = "", 0, None, 0, False, False
    rows = lines_of(text)

    def flush():
        if run:
            places = [p for at, body in run for p in range(at, at + len(body) + 1)]
            prose.append(Prose("\n".join(b for _, b in run), places))
            run.clear()

    for k, (start, end, body) in enumerate(rows):
        if fence:
            m = FENCE.fullmatch(body)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                spans.append(Span("code", fence_at, end))
                fence = ""
            continue
        if raw is not None:
            if raw.search(body):
                spans.append(Span("raw", raw_at, end))
                raw = None
            continue
        if m := FENCE.fullmatch(body):
            flush()
            fence, fence_at, table = m[1], start, False
        elif m := RAW_OPEN.match(body):
            flush()
            closing = re.compile("-->" if m[2] else rf"</{m[1]}>", re.I)
            if closing.search(body, m.end()):
                spans.append(Span("raw", start, end))
            else:
                raw, raw_at = closing, start
        elif not body.strip():
            flush()
            table = False
        elif not run and not listed and re.match(r" {4}|\t", body):
            spans.append(Span("code", start, end))
        elif run and len(run[-1][1].strip()) and (m := RULE.fullmatch(body)):
            first = run[0][0]
            spans.append(Span("underlined", first, end, "1" if m[1][0] == "=" else "2", label=str(start)))
            flush()
        elif m := HASHES.match(body):
            flush()
            spans.append(Span("heading", start + m.start(1), end, str(len(m[1]))))
            prose.append(Prose(body[m.end() :], list(range(start + m.end(), start + len(body)))))
        elif not run and (m := DEFINITION.fullmatch(body)):
            spans.append(Span("definition", start, end, m[2] if m[2] is not None else m[3], m[1]))
        elif table or "|" in body and k + 1 < len(rows) and "-" in rows[k + 1][2] and "|" in rows[k + 1][2] and DELIMITER.fullmatch(rows[k + 1][2]):
            flush()
            if not DELIMITER.fullmatch(body):
                prose.extend(_cells(start, body))
            table = True
        else:
            if ITEM.match(body):
                flush()
                listed = True
            elif not body[0].isspace() and not run:
                listed = False
            at = PREFIX.match(body).end()
            run.append((start + at, body[at:]))
    flush()
    if fence or raw is not None:
        spans.append(Span("code" if fence else "raw", fence_at if fence else raw_at, len(text)))
    return spans, prose, bool(fence)


def unescaped(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def _folded(label: str) -> str:
    return re.sub(r"\s+", " ", label).strip().casefold()


def inline(part: Prose, defined: dict[str, str]) -> list[Span]:
    """Spans of one piece of prose: code, tags, autolinks, links, images, wiki links and citations; what a link's label holds comes too."""
    text, found = part.text, []
    openers: list[tuple[int, bool, bool]] = []  # place, image, may still be a link
    at = lambda a, b: (part.places[a], part.places[b - 1] + 1)
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and text[i + 1] in PUNCTUATION:
            i += 2
            continue
        if c == "`":
            width = len(re.match("`+", text[i:])[0])
            closing = re.compile(rf"(?<!`)`{{{width}}}(?!`)").search(text, i + width)
            if closing:
                found.append(Span("code", *at(i, closing.end()), label=text[i + width : closing.start()], cell=part.cell))
                i = closing.end()
            else:
                i += width
            continue
        if c == "<":
            if m := AUTOLINK.match(text, i):
                found.append(Span("autolink", *at(i, m.end()), target=html.unescape(m[1]), label=m[1], cell=part.cell))
                i = m.end()
                continue
            if m := TAG.match(text, i):
                found.append(Span("tag", *at(i, m.end()), label=m[0], cell=part.cell))
                i = m.end()
                continue
        if c == "[":
            if m := WIKI.match(text, i):
                name, _, alias = m[1].partition("|")
                found.append(Span("wiki", *at(i, m.end()), target=name.strip(), label=alias.strip(), cell=part.cell))
                i = m.end()
                continue
            if m := CITATION.match(text, i):
                found.append(Span("citation", *at(i, m.end()), target=f"[evidence:{m[1]}]", label=m[0], cell=part.cell))
                i = m.end()
                continue
        if c == "!" and text.startswith("![", i):
            openers.append((i, True, True))
            i += 2
            continue
        if c == "[":
            openers.append((i, False, True))
        elif c == "]" and openers:
            begin, image, live = openers.pop()
            inner = text[begin + 1 + image : i]
            m = AFTER.match(text, i + 1) if live else None
            target = title = None
            stop = i + 1
            if m:
                target, stop = unescaped(m[1] if m[1] is not None else m[2] or ""), m.end()
                title = unescaped(next((g for g in m.groups()[2:] if g is not None), ""))
            elif live:
                ref = REFERENCE.match(text, i + 1)
                name = _folded(ref[1] if ref and ref[1] else inner)
                if name in defined:
                    target, title, stop = defined[name], "", ref.end() if ref else i + 1
            if target is not None:
                found.append(Span("image" if image else "link", *at(begin, stop), target=target, label=inner, title=title, cell=part.cell))
                if not image:
                    openers = [(p, im, ok and im) for p, im, ok in openers]
                i = stop
                continue
        i += 1
    return found


def scan(text: str) -> tuple[list[Span], bool]:
    """All spans in order of their start, the longer first; whether a fence stays open."""
    spans, prose, still_open = blocks(text)
    defined = {}
    for s in spans:
        if s.kind == "definition":
            defined.setdefault(_folded(s.label), unescaped(s.target))
    for part in prose:
        spans.extend(inline(part, defined))
    return sorted(spans, key=lambda s: (s.start, -s.end)), still_open


def spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """``text`` with the ranges of ``edits`` replaced; of overlapping ones the first, then the longest counts."""
    out, at = [], 0
    for start, end, value in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= at:
            out += [text[at:start], value]
            at = end
    return "".join([*out, text[at:]])
