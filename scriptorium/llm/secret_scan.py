"""Secret scans with corpus-wide ownership, on DataFrame functions alone.

Patterns give candidates in every text.  A candidate's value is hashed, and the
hashes are counted over the corpus by distinct repositories and owners: a value
that many owners share is a copied example, one that stays with few owners and
looks random is a live credential.  Known forms are always reported; bare tokens
only where ownership makes them live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

# The known forms, the group of each that holds its value, and the least length of that value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
FORMS = [("assign", ASSIGN, 3, 6), ("access", ACCESS, 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]
#: Bare tokens: long, of letters and digits mixed.
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]
#: A value of more owners or repositories than these is a copied example; a bare token needs this many digits and letters.
MAX_OWNERS = 2
MAX_REPOSITORIES = 2
MIN_MIXED = 4
_SPAN = "array<struct<start:bigint,kind_order:int,end:bigint,value:string,at:bigint,upto:bigint>>"


def running(values: Column, join, zero) -> Column:
    """Values joined from the first to each, by blocks of about the root of their number.

    ``join`` is an associative function of two columns, ``values`` an array of
    long.  A plain fold would copy its array at every step; blocks bound the
    copies of n values to n times the root of n.
    """
    zero = F.lit(zero).cast("bigint")
    none = F.array().cast("array<bigint>")

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.get(acc, F.size(acc) - 1), zero), x))))

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: fold(F.slice(v, i * width + 1, width)))

        def moved(done: Column) -> Column:
            before = fold(F.transform(done, lambda d: F.get(d, F.size(d) - 1)))
            return let(before, lambda o: F.flatten(F.transform(done, lambda d, i: let(F.coalesce(F.get(o, i - 1), zero), lambda z: F.transform(d, lambda x: join(z, x))))))

        return F.when(F.size(v) > 0, let(blocks, moved)).otherwise(none)

    return let(values, whole)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of all leftmost matches that don't overlap, of those whose value is long enough: places in code points and, as ``at`` and ``upto``, in bytes.

    ``\\G`` ties each match of the widened pattern to the end of the one before,
    so gaps and matches, which two passes collect, add up to places.
    """
    wide = rf"(?s)\G(.*?)({pattern})"
    gaps, hits = (F.regexp_extract_all(text, F.lit(wide), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))

    def spans(parts: Column) -> Column:
        size = lambda f: F.transform(parts, lambda x: (f(x["gap"]) + f(x["hit"])).cast("bigint"))
        ends = F.arrays_zip(parts.alias("p"), running(size(F.length), _sum, 0).alias("end"), running(size(F.octet_length), _sum, 0).alias("upto"))
        value = lambda hit: F.regexp_extract(hit, pattern, group - 1) if group else hit

        def one(x: Column) -> Column:
            hit = x["p"]["hit"]
            return F.struct(
                (x["end"] - F.length(hit)).alias("start"), F.lit(kind).alias("kind_order"), x["end"].alias("end"), value(hit).alias("value"),
                (x["upto"] - F.octet_length(hit)).alias("at"), x["upto"].alias("upto"),
            )

        return F.filter(F.transform(ends, one), lambda x: F.length(x["value"]) >= least)

    return let(pairs, spans)


def _none() -> Column:
    return F.array().cast(_SPAN)


def known_spans(text: Column) -> Column:
    """Spans of the known forms, by start and then kind."""
    lowered = F.lower(text)
    hints = [F.contains(lowered, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    worded = hints[0]
    for h in hints[1:]:
        worded = worded | h
    tests = [worded, F.contains(text, F.lit("AKIA")), F.rlike(text, F.lit("[0-9a-f]{24}"))]
    lists = [F.when(t, _found(text, i, p, g, n)).otherwise(_none()) for i, (t, (_, p, g, n)) in enumerate(zip(tests, FORMS, strict=True))]
    return F.array_sort(F.concat(*lists))


def _bare(text: Column) -> Column:
    mixed = lambda x: (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= MIN_MIXED) & (F.length(F.regexp_replace(x["value"], "[^A-Za-z]", "")) >= MIN_MIXED)
    return F.when(F.rlike(text, F.lit(BARE)), F.filter(_found(text, 3, BARE, 0, 20), mixed)).otherwise(_none())


def _apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of ``others``: a sweep by start with the greatest end before and the least start after."""
    far = 1 << 62
    event = lambda side: lambda x: F.struct(x["start"].alias("start"), F.lit(side).alias("side"), x["end"].alias("end"), x.alias("span"))
    events = F.array_sort(F.concat(F.transform(others, event(0)), F.transform(spans, event(1))))

    def swept(e: Column) -> Column:
        before = running(F.transform(e, lambda x: F.when(x["side"] == 0, x["end"]).otherwise(0).cast("bigint")), F.greatest, 0)
        after = F.reverse(running(F.transform(F.reverse(e), lambda x: F.when(x["side"] == 0, x["start"]).otherwise(far).cast("bigint")), F.least, far))
        seen = F.arrays_zip(e.alias("e"), before.alias("before"), after.alias("after"))
        free = F.filter(seen, lambda x: (x["e"]["side"] == 1) & (x["before"] <= x["e"]["start"]) & (x["after"] >= x["e"]["end"]))
        return F.transform(free, lambda x: x["e"]["span"])

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(events, swept)).otherwise(spans)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, found`` and the columns named in ``keep``.

    ``base`` holds the known forms; ``found`` all spans, each with ``start, end``
    (code points, end exclusive), ``kind``, the numbers of ``owners`` and
    ``repositories`` of its value and ``verdict`` (``live`` or ``example``).

    Null and empty texts have no spans.  A null owner or repository counts as one
    owner of its own.  Rows with equal ids are scanned apart; an empty table
    gives an empty result.  Values leave the first step only as SHA-256.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])]
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"), *kept)
    spanned = read.withColumn("base", known_spans(F.col("text"))).withColumn("bare", _bare(F.col("text")))
    free = _apart(F.col("bare"), F.col("base"))
    hashed = F.transform(F.concat(F.col("base"), free), lambda s: s.withField("value", F.sha2(s["value"], 256)))
    local = materialize(spanned.select("doc_id", "owner", "repository", *[f"keep_{i}" for i in range(len(kept))], F.size("base").alias("n_base"), hashed.alias("spans"), F.monotonically_increasing_id().alias("row")), "spans")

    seen = local.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    pairs = seen.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    spread = pairs.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    judged = seen.join(spread, "value").withColumn("verdict", F.when((F.col("owners") > MAX_OWNERS) | (F.col("repositories") > MAX_REPOSITORIES), "example").otherwise("live"))
    by_row = judged.where("kind_order < 3 or verdict = 'live'").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_order", "end", "owners", "repositories", "verdict", "at", "upto"))).alias("found"))
    out = local.join(by_row, "row", "left")
    base = F.slice(F.col("spans"), F.lit(1), F.col("n_base"))
    return out.select("doc_id", base.alias("base"), F.coalesce("found", F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,owners:bigint,repositories:bigint,verdict:string,at:bigint,upto:bigint>>")).alias("found"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])])


def digest(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example`` of ``scan``'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind_order"] == k)).cast("long")
    verdicts = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), verdicts("live").alias("n_live"), verdicts("example").alias("n_example"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (overlaps run together) replaced by ``mark``.

    The gaps are cut out by bytes and put together once, so the work is that of
    reading the text.
    """

    def cut(raw: Column, spans: Column, upto: Column) -> Column:
        old = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0).cast("bigint"))
        part = lambda a, n: F.decode(F.substring(raw, (a + 1).cast("int"), n.cast("int")), "UTF-8")
        gaps = F.transform(spans, lambda x, i: F.when(x["at"] >= old(i), F.concat(part(old(i), x["at"] - old(i)), F.lit(mark))).otherwise(""))
        last = F.get(upto, F.size(upto) - 1)
        return F.concat(F.array_join(gaps, ""), part(last, F.octet_length(raw) - last))

    ends = lambda spans: running(F.transform(spans, lambda x: x["upto"]), F.greatest, 0)
    whole = let(F.encode(text, "UTF-8"), lambda raw: let(found, lambda spans: let(ends(spans), lambda upto: cut(raw, spans, upto))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
