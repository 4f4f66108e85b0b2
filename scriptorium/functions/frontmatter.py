"""Front matter of pages: split, read and rewrite. All stay in the JVM.

Values are read as one-line scalars and flow lists, which is all that the
engine writes; anchors, block scalars and nested maps count as no string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import let

#: Plain scalars that YAML reads as something else than a string.
NOT_TEXT = r"^(?i:|~|null|true|false|yes|no|on|off|[-+]?[0-9][0-9_]*(\.[0-9_]*)?(e[-+]?[0-9]+)?|\.nan|[-+]?\.inf|[0-9]{4}-[0-9]{2}-[0-9]{2})$"


def _end(text: Column) -> Column:
    """The length of the block of ``text``, null without one."""

    def past(close: Column) -> Column:
        after = F.position(F.lit("\n"), text, close + 1)
        return F.when(F.startswith(text, F.lit("---")) & (close > 0), F.when(after > 0, after).otherwise(F.length(text)))

    return let(F.position(F.lit("\n---"), text, F.lit(4)), past)


def parts(text: Column) -> tuple[Column, Column]:
    """Block and body, which together are the text: the block runs from a leading ``---`` through the line of the first ``\\n---``; without one it is null."""
    return F.substring(text, F.lit(1), _end(text)), let(F.coalesce(_end(text), F.lit(0)), lambda n: F.substring(text, n + 1, F.length(text)))


def _last(block: Column, key: str) -> Column:
    """The raw value of the last line of ``key``, null without one."""
    found = F.regexp_extract_all(block, F.lit(rf"(?m)^{re.escape(key)}:[ \t]*(.*)$"), F.lit(1))
    return F.trim(let(found, lambda f: F.get(f, F.size(f) - 1)))


def scalar(block: Column, key: str) -> Column:
    """The string value of ``key``; null if it is absent or no string."""

    def value(raw: Column) -> Column:
        quoted = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
        single = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
        plain = F.rtrim(F.regexp_replace(raw, r"\s#.*$", ""))
        no_text = F.rlike(raw, F.lit(r"^[\[{|>&*!%@`]")) | F.rlike(plain, F.lit(NOT_TEXT))
        is_single = F.rlike(raw, F.lit("^'.*'$")) & (F.length(raw) > 1)
        return F.when(F.startswith(raw, F.lit('"')), quoted).when(is_single, single).when(no_text, F.lit(None).cast("string")).otherwise(plain)

    return let(_last(block, key), value)


def list_value(block: Column, key: str) -> Column:
    """The strings of a flow list; null if ``key`` is absent or no list."""
    none = F.array().cast("array<string>")

    def value(raw: Column) -> Column:
        inner = F.trim(F.substring(raw, F.lit(2), F.length(raw) - 2))
        strict = F.from_json(raw, "array<string>")
        loose = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^(['\"])(.*)\\1$", "$2"))
        is_list = F.rlike(raw, F.lit(r"^\[.*\]$"))
        return F.when(is_list & (inner == ""), none).when(is_list, F.coalesce(F.when(F.size(strict) > 0, strict), loose))

    return let(_last(block, key), value)


def quoted(value: Column) -> Column:
    """The JSON string of a value."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def line(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}: "), quoted(value))


def list_line(key: str, items: Column) -> Column:
    return F.concat(F.lit(f"{key}: ["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def _with_line(block: Column, key: str, new: Column) -> Column:
    """The first line of ``key`` replaced, or the new one right after the opening."""
    found = rf"(?m)^{re.escape(key)}:.*$"
    old = F.regexp_extract(block, found, 0)
    before = F.regexp_extract(block, rf"(?sm)\A(.*?)^{re.escape(key)}:", 1)
    replaced = F.concat(before, new, F.substring(block, F.length(before) + F.length(old) + 1, F.length(block)))
    opening = F.position(F.lit("\n"), block)
    inserted = F.concat(F.substring(block, F.lit(1), opening), new, F.lit("\n"), F.substring(block, opening + 1, F.length(block)))
    return F.when(F.rlike(block, F.lit(found)), replaced).otherwise(inserted)


def set_line(block: Column, key: str, value: Column) -> Column:
    """The block with ``key`` set to a string."""
    return _with_line(block, key, line(key, value))


def drop_line(block: Column, key: str) -> Column:
    return F.regexp_replace(block, rf"(?m)^{re.escape(key)}:.*\n?", "")


def with_source(text: Column, source: Column) -> Column:
    """The text with ``source`` first in its ``sources``, unless it is there; a text without a block gets one, a malformed list stays."""
    fresh = F.concat(F.lit("---\n"), list_line("sources", F.array(source)), F.lit("\n---\n\n"), text)
    none = F.array().cast("array<string>")

    def added(block: Column) -> Column:
        def put(items: Column) -> Column:
            stays = F.array_contains(items, source) | (items.isNull() & F.rlike(block, F.lit("(?m)^sources:")))
            line = list_line("sources", F.array_prepend(F.coalesce(items, none), source))
            return F.when(F.coalesce(stays, F.lit(False)), text).otherwise(F.concat(_with_line(block, "sources", line), parts(text)[1]))

        return F.when(block.isNull(), text).otherwise(let(list_value(block, "sources"), put))

    return F.when(~F.startswith(text, F.lit("---")), fresh).otherwise(let(parts(text)[0], added))


def without_source(text: Column, source: Column) -> tuple[Column, Column]:
    """The text without the first ``source`` of its ``sources``, and whether none is left."""

    def cut(block: Column) -> Column:
        def drop(items: Column) -> Column:
            at = F.array_position(items, source)
            rest = F.filter(items, lambda x, i: i != at - 1)
            held = F.coalesce(at > 0, F.lit(False))
            new = F.when(held, F.concat(_with_line(block, "sources", list_line("sources", rest)), parts(text)[1])).otherwise(text)
            return F.struct(new.alias("text"), (held & (F.size(items) == 1)).alias("empty"))

        return let(list_value(block, "sources"), drop)

    out = let(parts(text)[0], cut)
    return out["text"], out["empty"]


def fault(block: Column) -> Column:
    """The first rule of one-line YAML that the block breaks, null if none: tab indent, bare colon in a value, open quote or open bracket."""
    inner = F.regexp_replace(F.substring(block, F.lit(4), F.length(block)), r"(?s)\n---[^\n]*\n?$", "")
    lines = F.filter(F.split(inner, "\n"), lambda x: F.trim(x) != "")
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    rules = [
        ("tab", lambda x: F.rlike(x, F.lit(r"^ *\t"))),
        ("colon in a plain value", lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][\w-]*:[ \t]+[^\s\"'\[{#|>&*!][^#]*:(\s|$)"))),
        ("open quote", lambda x: F.rlike(x, F.lit(r"^[^:\"']+:[ \t]+[\"']")) & ~F.rlike(value(x), F.lit(r"""^("([^"\\]|\\.)*"|'([^']|'')*')\s*(#.*)?$"""))),
        ("open bracket", lambda x: F.rlike(x, F.lit(r"^[^:\"']+:[ \t]+[\[{]")) & ~F.rlike(value(x), F.lit(r"[\]}]\s*(#.*)?$"))),
        ("no key", lambda x: F.rlike(x, F.lit(r"^[^\s#\-:][^:]*$"))),
    ]
    return F.coalesce(*[F.when(F.exists(lines, rule), F.lit(name)) for name, rule in rules])
