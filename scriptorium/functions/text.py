"""Text expressions. All stay in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Most characters of a session title.
TITLE_CHARS = 60


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding."""
    return text.map(lambda t: None if t is None else t.casefold())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: Catalyst may copy an expression wherever it is named, but not a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _beyond_ascii(text: Column, by) -> Column:
    """``by`` of texts with other than ASCII characters; the others never leave the JVM, but for a null in their place."""
    return F.coalesce(by(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)), text)


def composed(text: Column) -> Column:
    """NFKC of a short text."""
    return _beyond_ascii(text, nfkc)


def folded(text: Column) -> Column:
    """Full case folding: what is ASCII only by ``lower``."""
    return F.coalesce(casefold(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)), F.lower(text))


def normal_target(target: Column) -> Column:
    """A link target: NFKC, lower case, underscores as hyphens, runs of hyphens as one, none at the ends of a path segment."""
    segments = F.split(F.regexp_replace(F.lower(composed(target)), "_", "-"), "/")
    return F.array_join(F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")), "/")


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target|alias]]`` in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda t: F.trim(F.split_part(t, F.lit("|"), F.lit(1))))


def document_stem(stem: Column) -> Column:
    """Runs of other characters than word characters and hyphens as one hyphen; ``document`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(composed(stem), r"(?U)[^\w\-]+", "-"), "^-+|-+$", "")
    return F.when(clean == "", "document").otherwise(clean)


def concept_name(name: Column) -> Column:
    """Each other character than word characters and hyphens as a hyphen."""
    clean = F.regexp_replace(F.regexp_replace(composed(name), r"(?U)[^\w\-]", "-"), "^-+|-+$", "")
    return F.when(clean == "", "unnamed").otherwise(clean)


def file_name(name: Column, suffix: str) -> Column:
    """A safe ASCII file name: percent escapes decoded, its own suffix off and on again, 80 characters at most, ``document`` if none is left."""
    escaped = F.replace(name, F.lit("+"), F.lit("%2B"))  # a plus is no blank in a file name
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(escaped), name), f"(?i)\\Q{suffix}\\E$", "")
    clean = F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9._-]+", "-"), "-+", "-")
    stem = F.regexp_replace(F.substring(F.regexp_replace(clean, "^[-._]+|[-._]+$", ""), 1, 80), "[-._]+$", "")
    return F.concat(F.when(stem == "", "document").otherwise(stem), F.lit(suffix))


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition header: its extended, its quoted, else its bare form; null without one."""
    extended = F.regexp_extract(header, r"filename\*=(?:[\w-]+'[\w-]*')?([^;]+)", 1)
    quoted = F.regexp_extract(header, r'filename="([^"]+)"', 1)
    bare = F.regexp_extract(header, r"filename=([^\s;]+)", 1)
    decoded = F.trim(extended)
    decoded = F.coalesce(F.try_url_decode(F.replace(decoded, F.lit("+"), F.lit("%2B"))), decoded)
    return F.when(extended != "", decoded).when(quoted != "", quoted).when(bare != "", bare)


def download_name(url: Column, header: Column) -> Column:
    """A safe PDF name: of the header, else of the last path segment, else of the host."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    host, path = F.split_part(rest, F.lit("/"), F.lit(1)), F.regexp_extract(rest, "/(.*)$", 1)
    last = F.element_at(F.split(path, "/"), -1)
    own = F.trim(F.when(last != "", last).otherwise(host))
    return file_name(F.coalesce(F.nullif(disposition_name(header), F.lit("")), F.nullif(own, F.lit("")), F.lit("document")), ".pdf")


def url_origin(url: Column) -> Column:
    """Canonical address: scheme and host in lower case, ``/`` for no path, no fragment. Null for other schemes, no host or credentials."""
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    path, host = F.regexp_extract(url, whole, 3), F.lower(F.regexp_extract(url, whole, 2))
    scheme = F.lower(F.regexp_extract(url, whole, 1))
    query = F.regexp_extract(url, whole, 4)
    address = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return F.when(scheme.isin("http", "https") & F.rlike(host, F.lit("^[^:]")) & ~F.contains(host, F.lit("@")), address)


def origin(value: Column) -> Column:
    """The canonical origin of a source: an address, an upload, an attachment; null for anything else."""
    kept = F.rlike(value, F.lit("(?s)^upload:.")) | F.rlike(value, F.lit(r"^attachment:[0-9a-f]{32}/[0-9a-f]{64}$"))
    return F.coalesce(url_origin(value), F.when(kept, value))


def document_label(name: Column) -> Column:
    """A file name's stem without ``copy of`` before it or copy marks after it; the stem itself if nothing else is left."""
    last = F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1)
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]+$", "")
    front = F.regexp_replace(stem, r"(?iU)^copy of\s+", "")
    marks = r"(?iU)(?:[\s_-]+(?:copy|副本)(?:[\s_-]+\d+)?|\s*[（(\[]\s*(?:copy|副本)(?:\s+\d+)?\s*[）)\]])$"
    clean = F.trim(F.regexp_replace(front, marks, ""))
    return F.when(clean == "", stem).otherwise(clean)


def title_from(message: Column, limit: int = TITLE_CHARS) -> Column:
    """White space as single spaces, at most ``limit`` characters, the last an ellipsis if cut."""
    flat = F.trim(F.regexp_replace(message, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def short_citation(citation: Column) -> Column:
    return F.concat(F.lit("[evidence:"), F.substring(F.sha2(citation, 256), 1, 16), F.lit("]"))


def folded_spaces(text: Column) -> Column:
    """The three non-breaking spaces as plain ones; lengths stay."""
    return F.translate(text, "\u00a0\u2007\u202f", "   ")


def unique_place(text: Column, quote: Column, code: Column) -> Column:
    """Start of ``quote`` in ``text`` (code points from 0), null if it is absent or not unique. Code keeps its spaces."""
    t = F.when(code, text).otherwise(folded_spaces(text))
    q = F.when(code, quote).otherwise(folded_spaces(quote))
    first = F.position(q, t)
    again = F.position(q, t, first + 1)
    return F.when((F.length(q) > 0) & (first > 0) & (again == 0), first - 1)


def page_ranges(spec: Column) -> Column:
    """``3-5,7`` as pairs of first and last number; malformed parts are skipped, reversed ranges are empty, numbers begin at 1."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: F.rlike(p, F.lit(r"^\d+(-\d+)?$")))
    number = lambda p, i: F.split_part(p, F.lit("-"), F.lit(i)).try_cast("bigint")
    pairs = F.transform(parts, lambda p: F.struct(F.greatest(number(p, 1), F.lit(1)).alias("first"), number(p, -1).alias("last")))
    return F.filter(pairs, lambda r: r["first"] <= r["last"])


def page_spec(spec: Column, pages: Column | None = None) -> Column:
    """``3-5,7`` as sorted distinct positive numbers; malformed parts are skipped, reversed ranges are empty.

    With ``pages``, the number of pages there are, ranges end there, so that a
    range holds no more numbers than the document has pages.  Without it a
    number of any size counts, and a range too long for one array raises; ``page_ranges`` lists none.
    """
    ranges = page_ranges(spec)
    if pages is not None:
        ranges = F.filter(F.transform(ranges, lambda r: F.struct(r["first"].alias("first"), F.least(r["last"], pages.cast("bigint")).alias("last"))), lambda r: r["first"] <= r["last"])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"], F.lit(1).cast("bigint"))))))


def entity_types(types: Column) -> Column:
    """Lower-cased names of allowed characters, first of each kept, ``other`` last."""
    clean = F.filter(F.transform(types, lambda t: F.lower(F.trim(t))), lambda t: F.rlike(t, F.lit("^[a-z][a-z0-9_-]*$")) & (t != "other"))
    return F.array_append(F.array_distinct(clean), F.lit("other"))


def content_id(*columns: Column) -> Column:
    """SHA-256 of canonical JSON: pass the columns sorted by name; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def relative_time(at: Column, now: Column) -> Column:
    """``just now``, minutes, hours, days, else the date; seconds between two timestamps."""
    gap = F.unix_timestamp(now) - F.unix_timestamp(at)
    part = lambda n, unit: F.concat(F.floor(gap / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(gap < 60, "just now").when(gap < 3600, part(60, "m")).when(gap < 86400, part(3600, "h")).when(gap < 7 * 86400, part(86400, "d")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def remove_first(items: Column, value: Column) -> Column:
    """The array without the first occurrence of ``value`` only."""
    at = F.array_position(items, value)
    return F.when(at > 0, F.filter(items, lambda x, i: i != at - 1)).otherwise(items)
