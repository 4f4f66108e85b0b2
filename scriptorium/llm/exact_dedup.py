"""Exact duplicates by progressive refinement, on DataFrame functions alone.

Texts are told apart by their length first, then by a hash of their first
characters, and only those that still share both are hashed whole.  What a level
leaves open goes to the next as a set of slots (hashes modulo a fixed number): a
table of at most SLOTS numbers, whatever the size of the corpus.  Two groups may
fall on one slot; that costs a hash and changes no result, as every level groups
by its true keys.  No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, materialize

#: Slots by which a level tells the next what is still open; a table of so many longs is broadcast at most.
SLOTS = 1 << 18
#: Characters of the second level's hash.
PREFIX = 64


def normalized(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; an ASCII text takes the engine's fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slot(slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots).cast("bigint"))


def shared_slots(rows: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """The slots of the keys that more than one row has."""
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return shared.select(slot(slots, *[F.col(k) for k in keys]).alias("slot")).distinct()


def marked(rows: DataFrame, keys: Sequence[str], found: DataFrame, slots: int, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether their keys' slot is among the ``found`` ones, which are at most ``slots`` rows."""
    named = found.select(F.col("slot").alias(f"{flag}_slot"))
    at = slot(slots, *[F.col(k) for k in keys])
    return rows.join(F.broadcast(named), at == F.col(f"{flag}_slot"), "left").withColumn(flag, F.col(f"{flag}_slot").isNotNull()).drop(f"{flag}_slot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), all_digests: bool = False, prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """One row for each row of ``docs``: ``id, keep_id, group_size, kept, digest`` and, in the struct ``carried``, the columns of ``carry``.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the
    row with the largest id is kept; of rows that repeat text and id, exactly
    one is; a row without an id is kept only where none of its group has one.
    A null text counts as empty.  ``digest`` is the SHA-256 of the normalised
    text; rows that a shorter key told apart have none unless ``all_digests``
    asks for it, and then it is a column of the last level's scan.  An empty
    table gives an empty result; columns not named are not read.

    Groups are counted with partial sums before each shuffle, so a group of a
    third of all rows sends one row a task; the last join meets narrow rows and
    may split such a group.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"), *carried)
    # Lower-casing A-Z keeps the number of bytes.
    sized = rows.withColumn("size", F.octet_length("body"))
    sizes = shared_slots(sized.select("size"), ["size"], slots)
    by_size = marked(sized, ["size"], sizes, slots, "same_size")
    start = F.when(F.col("same_size"), F.xxhash64(normalized(F.substring("body", 1, prefix))))
    begun = by_size.withColumn("start", start)
    starts = shared_slots(begun.where("same_size").select("size", "start"), ["size", "start"], slots)
    by_start = marked(begun, ["size", "start"], starts, slots, "same_start")
    is_open = F.col("same_size") & F.col("same_start")
    digest = F.unhex(F.sha2(let(F.col("body"), normalized), 256))
    hashed = by_start.select("id", *[c for c in ("carried",) if carry], "size", "start", is_open.alias("open"), (digest if all_digests else F.when(is_open, digest)).alias("digest"))
    narrow = materialize(hashed.withColumn("row_key", F.monotonically_increasing_id()), "digests")

    keys = ["size", "start", "digest"]
    groups = narrow.where("open").groupBy(*keys).agg(F.max(F.struct("id", "row_key")).alias("last"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # Written first, so that both sides of the join are dealt for it alone and a large group may be split.
    groups = materialize(groups, "groups")
    met = groups.select(*[F.col(k).alias(f"group_{k}") for k in keys], "last", "rows")
    joined = narrow.join(met, [F.col(k) == F.col(f"group_{k}") for k in keys], "left")
    alone = F.col("last").isNull()
    return joined.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row_key") == F.col("last.row_key"))).alias("kept"),
        "digest",
        *[c for c in ("carried",) if carry],
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_groups(docs, id_col, text_col, carry=docs.columns).where("kept").select("carried.*")
