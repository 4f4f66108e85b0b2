"""N-gram Jaccard self-join by vertical partitioning.

All n-grams stand in one global order: rare ones by hash, frequent ones after
them by count.  The order is cut into fragments; a document's set falls into
one segment per fragment, each fragment counts the overlap of its segments for
a pair alone, and the counts are summed per pair.

Which pairs are counted follows from the order too.  Two sets whose overlap
reaches ``o``, the least that their sizes ask for, share an n-gram that lies in
both among the first ``size - o + 1``.  So a set is posted under its first
n-grams together with the place of each, and only pairs that meet early enough
in both sets are candidates.

Documents with equal sets form one class from the start, and pairs are only
looked for between classes that aren't linked yet.  First every class meets one
centre of each of its n-grams: the class that has the n-gram earliest, thus the
least of its own before it, which in a group of edited copies is the one next
to the original.  Then the classes that are still apart from the largest
component of an n-gram meet the others.  So large groups of copies give no
square of pairs and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, release, small_batches
from .components import connected_components
from .shingles import U64, mix, shingle_sets

#: The frequent n-grams that the order names one by one: at most this many (24 bytes each reach every executor).
#: A lower bound only makes buckets larger; results stay the same.
ORDER_LIMIT = 1 << 20
#: Bits of the filter on ids of documents whose sets are fetched, 64 a word; more ids only let more pass.
FILTER_WORDS = 1 << 17
#: Rounds of pairs with centres of each n-gram at most, and the centres of each from the second round on.
STAR_ROUNDS = 3
CENTRES = 8
#: Postings of one n-gram that go to one task; an n-gram that occurs more often is dealt to several.
SALT_ROWS = 1 << 12
#: N-grams that a task holds before it counts them, and classes it remembers not to send again.
FOLD_GRAMS = 1_000_000
DONE_CLASSES = 200_000
#: Fragments of the global order.
FRAGMENTS = 4
_POSTING = "gram long, salt int, sig long, n int, pos int"


def _signature(s: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    parts = np.array([int(np.bitwise_xor.reduce(mix(s + U64(0x2545F4914F6CDD1D)))), int(np.sum(s, dtype=U64)), len(s)], U64)
    parts[:2] = mix(parts[:2] + U64(0x9E3779B97F4A7C15))
    return int(mix(np.sum(parts, dtype=U64, keepdims=True)).view(np.int64)[0])


def _local(k: int):
    """Per document its class; per task the n-grams it met at least twice."""

    def run(batches):
        seen: list[np.ndarray] = []
        held = 0
        grams, counts = np.zeros(0, U64), np.zeros(0, np.int64)  # those met at least twice in one fold, sorted

        def fold():
            nonlocal held, grams, counts
            if seen:
                met = np.concatenate(seen)
                seen.clear()
                held = 0
                met.sort()
                first = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
                width = np.diff(first, append=len(met))
                twice = width > 1
                both, added = np.concatenate([grams, met[first[twice]]]), np.concatenate([counts, width[twice]])
                del met
                by = np.argsort(both, kind="stable")
                both, added = both[by], added[by]
                first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
                grams, counts = both[first], np.add.reduceat(added, first) if len(first) else added

        for batch in batches:
            sizes, signs = [], []
            for _, sets in shingle_sets(batch.column("text"), k):
                for s in sets:
                    sizes.append(len(s))
                    signs.append(_signature(s) if len(s) else 0)
                    seen.append(s)
                    held += len(s)
                if held > FOLD_GRAMS:
                    fold()
            n = len(sizes)
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["id", "n", "sig", "gram", "count"])
        fold()
        for i in range(0, len(grams), 50_000):
            part = len(grams[i : i + 50_000])
            yield pa.record_batch([pa.nulls(part, pa.int64()), pa.nulls(part, pa.int64()), pa.nulls(part, pa.int64()), pa.array(grams[i : i + 50_000].view(np.int64)), pa.array(counts[i : i + 50_000])], names=["id", "n", "sig", "gram", "count"])

    return run


class Order:
    """Positions in the global order: 0 for rare n-grams, else 1 and up by count."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        by = np.argsort(grams)
        self.grams = grams[by]
        rank = np.empty(len(grams), np.int64)
        rank[np.lexsort((grams, counts))] = np.arange(1, len(grams) + 1)
        self.rank = rank[by]
        self.parts = (counts[by] // SALT_ROWS + 1).astype(np.int32)

    def _at(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each n-gram in the table, and whether it is there."""
        at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
        return at, self.grams[at] == s

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(s), np.int64)
        at, named = self._at(s)
        return np.where(named, self.rank[at], 0)

    def sort(self, s: np.ndarray) -> np.ndarray:
        """``s`` (ascending) in the global order."""
        return s[np.argsort(self.of(s), kind="stable")]

    def salt(self, s: np.ndarray, sign: int) -> np.ndarray:
        """The part of each n-gram's postings that a class goes to; -1 where all are one part."""
        if not len(self.grams):
            return np.full(len(s), -1, np.int32)
        at, named = self._at(s)
        parts = np.where(named, self.parts[at], 1)
        return np.where(parts > 1, (sign & 0x7FFFFFFF) % parts, -1).astype(np.int32)


def _prefixes(k: int, num: int, den: int, order):
    """Each class under the first n-grams of its set: as many as any partner can ask for."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            # A slice of texts at a time, so that a run of long ones makes no large batch.
            for _, sets in shingle_sets(batch.column("text"), k):
                grams, salts, signs, sizes, places = [], [], [], [], []
                for s in sets:
                    if not len(s):
                        continue
                    sign = _signature(s)
                    if sign in done:
                        continue
                    if len(done) < DONE_CLASSES:
                        done.add(sign)
                    top = order.value.sort(s)[: len(s) + num * len(s) // -den + 1]
                    grams.append(top)
                    salts.append(order.value.salt(top, sign))
                    signs.append(np.full(len(top), sign, np.int64))
                    sizes.append(np.full(len(top), len(s), np.int32))
                    places.append(np.arange(len(top), dtype=np.int32))
                if grams:
                    flat = [np.concatenate(x) for x in (grams, salts, signs, sizes, places)]
                    flat[0] = flat[0].view(np.int64)
                    yield pa.record_batch([pa.array(x) for x in flat], names=["gram", "salt", "sig", "n", "pos"])

    return run


def _shared(batches):
    """Of rows sorted by (gram, salt, sig): one of each class, without n-grams that have a single class; dealt ones all stay."""
    last = None  # the row that may still belong to a group that goes on, and whether its group has had another class
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if not len(rows[0]):
            continue
        mixed = False
        if last is not None:
            rows, mixed = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last[0], rows, strict=True)], last[1]
        gram, salt, sig = rows[:3]
        new_group = np.r_[True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])]
        new_class = new_group | np.r_[True, sig[1:] != sig[:-1]]
        ends = np.r_[new_class[1:], False]  # the last row of each class but the last one, which is held back
        group = np.cumsum(new_group) - 1
        classes = np.bincount(group, new_class)
        classes[0] += mixed
        keep = ends & ((classes[group] > 1) | (salt >= 0))
        # A class that ends a batch is out with the next one, where its group counts as mixed.
        if keep.any():
            yield pa.record_batch([pa.array(x[keep]) for x in (gram, sig, rows[3], rows[4])], names=["gram", "sig", "n", "pos"])
        last = [x[-1] for x in rows], bool(classes[-1] > 1)
    if last is not None and (last[1] or last[0][1] >= 0):
        yield pa.record_batch([pa.array(np.array([last[0][i]], t)) for i, t in ((0, np.int64), (2, np.int64), (3, np.int32), (4, np.int32))], names=["gram", "sig", "n", "pos"])


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    h = mix(ids.view(U64)) % U64(len(bits) * 64)
    return (bits[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1)


def _segments(k: int, order, wanted, fragments: int, by_sign: bool = False):
    """Sets of the documents whose id, or with ``by_sign`` whose class, passes the filter, cut by fragment."""

    def run(batches):
        bits = wanted.value
        step = U64((1 << 64) // max(1, fragments - 1)) if fragments > 1 else U64(0)
        for batch in batches:
            passed = np.arange(batch.num_rows) if by_sign else np.flatnonzero(_passes(bits, batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)))
            if not len(passed):
                continue
            for _, sets in shingle_sets(batch.column("text").take(pa.array(passed)), k):
                signs, frags, parts = [], [], []
                for s in sets:
                    if not len(s):
                        continue
                    sign = _signature(s)
                    if by_sign and not _passes(bits, np.array([sign], np.int64))[0]:
                        continue
                    rank = order.value.of(s)
                    rare = s[rank == 0]
                    pieces = np.split(rare, np.searchsorted(rare, [step * U64(i) for i in range(1, fragments - 1)])) if fragments > 1 else [s]
                    if fragments > 1:
                        pieces.append(s[rank > 0])
                    for f, piece in enumerate(pieces):
                        if len(piece):
                            signs.append(sign)
                            frags.append(f)
                            parts.append(piece.view(np.int64))
                if parts:
                    flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
                    yield pa.record_batch([pa.array(signs, pa.int64()), pa.array(frags, pa.int32()), flat], names=["sig", "frag", "grams"])

    return run


def _id_filter(ids: DataFrame):
    """Bits set for each id of ``ids(id)``: at most FILTER_WORDS rows reach the driver, whatever the input."""
    size = FILTER_WORDS * 64

    def slots(batches):
        for batch in batches:
            x = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            yield pa.record_batch([pa.array((mix(x) % U64(size)).astype(np.int64))], names=["h"])

    rows = ids.mapInArrow(slots, "h long").groupBy(F.expr("h div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, U64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    return out


def _linked(pairs: DataFrame, segments: DataFrame, num: int, den: int, fragments: int) -> DataFrame:
    """The pairs ``(a, na, b, nb)`` whose overlap, counted by fragment and summed, reaches the threshold.

    A set may stand in ``segments`` more than once; each fragment of a pair counts once.
    """
    one = segments.select(F.col("sig").alias("a"), "frag", F.col("grams").alias("ga"))
    two = segments.select(F.col("sig").alias("b"), "frag", F.col("grams").alias("gb"))
    parts = pairs.withColumn("frag", F.explode(F.array(*[F.lit(i) for i in range(fragments)])))
    both = parts.join(one, ["a", "frag"]).join(two, ["b", "frag"])
    partial = both.select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("ga", "gb")).cast("long").alias("c"))
    overlap = partial.groupBy("a", "b", "na", "nb", "frag").agg(F.max("c").alias("c")).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return overlap.where(F.col("c") >= _overlap(F.col("na"), F.col("nb"), num, den)).select("a", "b")


def _overlap(na: Column, nb: Column, num: int, den: int) -> Column:
    """The least overlap of linked sets of these sizes: (na + nb) num / (num + den), rounded up, in whole numbers."""
    up = (na.cast("long") + nb) * num + (num + den - 1)
    return ((up - up % (num + den)) / (num + den)).cast("long")


def _early(x: str, y: str, num: int, den: int) -> Column:
    """Whether the n-gram lies in both sets among those of which linked sets share one; sizes too unlike never fit."""
    need = _overlap(F.col(f"n{x}"), F.col(f"n{y}"), num, den)
    return (F.col(f"pos{x}") + need <= F.col(f"n{x}")) & (F.col(f"pos{y}") + need <= F.col(f"n{y}"))


def _side(members: DataFrame, x: str) -> DataFrame:
    return members.select("gram", F.col("sig").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "pos", "label")])


def _pairs(joined: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, na, b, nb)``, the smaller class first, of rows with the sides ``x`` and ``y``."""
    swap = F.col("x") < F.col("y")
    first = F.when(swap, F.col("nx")).otherwise(F.col("ny"))
    second = F.when(swap, F.col("ny")).otherwise(F.col("nx"))
    return joined.select(F.least("x", "y").alias("a"), first.alias("na"), F.greatest("x", "y").alias("b"), second.alias("nb")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows ``(gram, sig, n, pos, label)`` of n-grams whose classes lie in more than one component."""
    named = labels.select(F.col("node").alias("sig"), F.col("label").alias("known"))
    tagged = members.join(named, "sig", "left").withColumn("label", F.coalesce("known", "sig")).drop("known")
    apart = tagged.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("gram")
    return materialize(tagged.join(apart, "gram", "left_semi").select("gram", "sig", "n", "pos", "label"), "open")


def _with_centres(tagged: DataFrame, centres: int, num: int, den: int) -> DataFrame:
    """Pairs of each class with the ``centres`` classes that have its n-gram at the earliest share of their sets."""
    rank = F.struct((F.col("pos") / F.col("n")).alias("share"), F.xxhash64("sig").alias("h"), "sig", "n", "pos", "label")
    if centres == 1:
        found = tagged.groupBy("gram").agg(F.min(rank).alias("c")).select("gram", "c.*")
    else:
        place = F.row_number().over(Window.partitionBy("gram").orderBy(F.col("pos") / F.col("n"), F.xxhash64("sig"), "sig"))
        found = tagged.withColumn("place", place).where(F.col("place") <= centres)
    star = _side(tagged, "x").join(_side(found, "y"), "gram")
    return _pairs(star.where((F.col("labelx") != F.col("labely")) & _early("x", "y", num, den)))


def _rest(tagged: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs that meet early enough and lie in different components: one side is always outside its n-gram's largest."""
    sizes = tagged.groupBy("gram", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("gram").agg(F.max(F.struct("m", "label")).alias("l")).select("gram", F.col("l.label").alias("major"))
    few = _side(tagged, "x").join(largest, "gram").where("labelx != major")
    joined = few.join(_side(tagged, "y"), "gram")
    once = (F.col("labely") == F.col("major")) | (F.col("x") < F.col("y"))
    return _pairs(joined.where((F.col("labelx") != F.col("labely")) & once & _early("x", "y", num, den)))


def jaccard_components(docs: DataFrame, id_col: str, text_col: str, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of ``k``-word
    shingles is at least ``num / den``; ``component_id`` is the smallest id
    reachable by links, itself included.

    Null and wordless texts have an empty set and link with nothing.  Rows with
    equal texts link, ids that repeat count once each.  A row with a null id
    keeps a null id; its component is the smallest id it reaches, null if there
    is none.  An empty table gives an empty result.  Only the two named columns
    are read, so other columns may have any names.
    """
    spark: SparkSession = docs.sparkSession
    width = partitions(spark)
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    local = materialize(texts.mapInArrow(_local(k), "id long, n long, sig long, gram long, count long"), "local")
    own = local.where("n is not null").select("id", "n", "sig")
    often = local.where("gram is not null").groupBy("gram").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "gram").limit(ORDER_LIMIT).toArrow()
    order = spark.sparkContext.broadcast(Order(often.column("gram").to_numpy().view(U64), often.column("count").to_numpy()))

    postings = texts.select("text").mapInArrow(_prefixes(k, num, den, order), _POSTING)
    dealt = postings.repartition(width, "gram", "salt").sortWithinPartitions("gram", "salt", "sig")
    members = materialize(dealt.mapInArrow(_shared, "gram long, sig long, n int, pos int"), "members")
    classes = own.where("n > 0").groupBy("sig").agg(F.min("id").alias("least_id"))
    nameless = own.where("id is null and n > 0").limit(1).count() > 0

    def fetched(signs: DataFrame) -> DataFrame:
        asked = classes.join(signs.distinct(), "sig", "left_semi")
        kinds = "sig long, frag int, grams array<long>"
        wanted = spark.sparkContext.broadcast(_id_filter(asked.where("least_id is not null").select(F.col("least_id").alias("id"))))
        sets = texts.where("id is not null").mapInArrow(_segments(k, order, wanted, FRAGMENTS), kinds)
        if nameless:  # Classes without any id are found by their signature, one set of each.
            unnamed = spark.sparkContext.broadcast(_id_filter(asked.where("least_id is null").select(F.col("sig").alias("id"))))
            sets = sets.unionByName(texts.where("id is null").mapInArrow(_segments(k, order, unnamed, FRAGMENTS, by_sign=True), kinds).dropDuplicates(["sig", "frag"]))
        return materialize(sets, "segments")

    tested: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame | None:
        """Links among the pairs that no earlier round has counted; None if there are no such pairs."""
        for old in tested:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs.select("a", "na", "b", "nb"), "pairs")
        tested.append(pairs)
        if pairs.limit(1).count() == 0:
            return None
        segments = fetched(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")))
        out = materialize(_linked(pairs, segments, num, den, FRAGMENTS), "links")
        release(segments)
        return out if out.limit(1).count() else None

    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, label long")
    tagged = members.withColumn("label", F.col("sig"))
    opened: list[DataFrame] = []
    for turn in range(STAR_ROUNDS):
        found = linked(_with_centres(tagged, CENTRES if turn else 1, num, den))
        if found is None:
            break
        links = links.unionByName(found)
        labels = connected_components(links)
        tagged = _open(members, labels)
        opened.append(tagged)
    rest = linked(_rest(tagged, num, den))
    if rest is not None:
        labels = connected_components(links.unionByName(rest))
    release(members, *opened, *tested)

    # The smallest id of each component of classes.
    known = classes.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = known.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_class = known.join(least, "label").select("sig", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return own.join(by_class, (own.sig == by_class.sig) & (own.n > 0), "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
