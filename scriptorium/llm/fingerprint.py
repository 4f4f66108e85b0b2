"""Document fingerprints by one-permutation MinHash, on DataFrame functions alone.

Every shingle of five words is hashed once; the low bits of the hash choose one
of BINS bins and each bin keeps its least value.  An empty bin takes the value of
a full one that its own fixed sequence of probes meets first (optimal
densification).  The low BITS bits of each bin are packed into hex digits; as
different values agree in them with chance 2**-BITS, likeness is corrected for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, partitions

BINS = 256
BITS = 8
WORDS = 5
_KEPT = 55  # bits of a value; the bin's number stands above them
_EMPTY = (1 << _KEPT) - 1


def _probe(j: int) -> tuple[int, int]:
    """Stride (odd, so that all bins are met) and start of bin ``j``'s probes, by a fixed rule."""
    x = (j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x ^= x >> 29
    return (x >> 8) % BINS | 1, (x >> 24) % BINS


_STRIDES, _STARTS = zip(*(_probe(j) for j in range(BINS)), strict=True)


def _ints(values, kind: str = "int") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """64-bit hashes of the runs of ``k`` words (not distinct); fewer words give one hash of all, none an empty array."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def rolled(h: Column) -> Column:
        runs = F.transform(F.slice(h, 1, F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(h) >= k, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def minima(hashes: Column) -> Column:
    """The least value of each bin in order of bins; an empty bin holds all ones. Empty for no hashes."""
    keyed = F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), _KEPT).bitwiseOR(F.shiftrightunsigned(h, 64 - _KEPT)))
    ends = _ints([(j << _KEPT) | _EMPTY for j in range(BINS)], "bigint")
    firsts = let(F.sort_array(F.concat(keyed, ends)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _KEPT) != F.shiftright(F.get(s, i - 1), _KEPT))))
    return F.transform(firsts, lambda x: x.bitwiseAND(F.lit(_EMPTY)))


def densified(values: Column) -> Column:
    """Low bits of each bin, empty bins filled from full ones; empty where every bin is."""

    def fill(v: Column) -> Column:
        def probed(j: Column, tries: int) -> Column:
            place = lambda t: (F.get(_ints(_STRIDES), j) * t + F.get(_ints(_STARTS), j)).bitwiseAND(F.lit(BINS - 1))
            return F.aggregate(_ints(range(tries)), F.lit(-1).cast("bigint"), lambda acc, t: F.when(acc >= 0, acc).otherwise(let(F.get(v, place(t)), lambda x: F.when(x == _EMPTY, F.lit(-1).cast("bigint")).otherwise(x))))

        def one(x: Column, j: Column) -> Column:
            near = let(probed(j, 16), lambda y: F.when(y >= 0, y).otherwise(probed(j, BINS)))
            return F.when(x != _EMPTY, x).otherwise(near).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

        return F.when(F.exists(v, lambda x: x != _EMPTY), F.transform(v, one)).otherwise(F.array().cast("array<int>"))

    return let(values, fill)


def fingerprint_bins(text: Column) -> Column:
    """The BINS low-order values of a text's fingerprint; empty for a text without words."""
    return densified(minima(shingle_hashes(F.coalesce(text, F.lit("")))))


def packed(bins: Column) -> Column:
    """Bins as hex digits, BITS bits each."""
    digits = F.array(*[F.lit(f"{i:0{BITS // 4}x}") for i in range(1 << BITS)])
    return F.array_join(F.transform(bins, lambda x: F.get(digits, x)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' bins, corrected for chance: 1 if both are empty, 0 if one is."""
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t)) / float(BINS)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint of each text in ``out_col`` (empty for null and wordless texts). ``out_col`` must be a new name."""
    return docs.withColumn(out_col, packed(fingerprint_bins(F.col(text_col).cast("string"))))


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    listed = _ints(bounds, "bigint")
    return F.aggregate(_ints(steps), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(listed, at + s - 1) < value), at + s).otherwise(at))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the next document, in descending id; after the
    last comes the first.  Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    Null texts count as empty; texts without words have an empty fingerprint
    (likeness 1 to another empty one, else 0).  Rows with equal ids follow one
    another by a hash of their texts; rows with a null id come last (in a table
    without any id the last row's next is itself).  Only the two named columns
    are read.

    The table is dealt into ranges of ids by bounds from approximate quantiles
    (their number depends on the number of partitions alone); the first rows of
    a range are also sent to the range before it, so no row of the whole is
    sorted in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = 4 * partitions(spark)
    drawn = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q"), F.max("doc_id").alias("top")).collect()[0]
    bounds = sorted({*(drawn["q"] or []), drawn["top"]} - {None})
    # Range i holds the ids above bound i - 1 up to bound i; the row of a bound also ends the range above it.
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(bounds, F.col("doc_id")))
    if bounds:
        after = let(own, lambda b: F.when(F.get(_ints(bounds, "bigint"), b) == F.col("doc_id"), F.array(F.struct(b.alias("range"), F.lit(False).alias("copy")), F.struct(((b + 1) % len(bounds)).alias("range"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(b.alias("range"), F.lit(False).alias("copy")))))
    else:
        after = F.array(F.struct(own.alias("range"), F.lit(False).alias("copy")))
    dealt = rows.withColumn("at", F.explode(after)).select("doc_id", "text", "at.range", "at.copy").withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "tie")
    texts = dealt.withColumn("next", F.coalesce(F.lead("text").over(order), "text"))
    half = F.expr("length(text) div 2")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    marked = texts.withColumn("edited", edited).select("range", "copy", "doc_id", "tie", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint_bins(F.col("text")).alias("f"), F.when(F.col("copy"), F.array().cast("array<int>")).otherwise(fingerprint_bins(F.col("edited"))).alias("e"))
    paired = marked.withColumn("g", F.coalesce(F.lead("f").over(order), "f")).where("not copy")
    return paired.select("doc_id", "n_chars", "edited_sha256", packed(F.col("f")).alias("fingerprint"), packed(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"))
