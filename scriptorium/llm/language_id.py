"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter: each slot of one table holds a bit per language, and
the bitwise AND of an n-gram's slots gives all languages that (seem to) contain
it.  A document's n-grams are looked up at once, the bits are counted per
language, each count is corrected for that language's false positives, and the
largest decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches
from .shingles import U64, mix

UNDETERMINED = "und"
#: Learning reads about this many rows of each language at most, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Slots of the table for each n-gram that it holds, 8 bytes each per 64 languages; their number is a power of two.
SLOTS_A_GRAM = 16
HASHES = 3
NGRAM = 3
#: An n-gram belongs to a language where it is met in at least MIN_COUNT places
#: and at least SHARE times as often as in the language that has it most often.
MIN_COUNT = 3
SHARE = 0.25

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Each code point, or a space where it isn't a letter."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 32, np.uint32)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = [i for i in range(0x110000) if chr(i).isalpha()]
        _letters = table
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of all texts, the text of each, and whether each text has a letter.

    Letters are lower-cased, all else is a gap; an n-gram may begin or end with
    one gap but has a letter between.
    """
    parts = [t.lower().encode("utf-32-le", "replace") for t in texts]
    points = _letter_table()[np.frombuffer(b" \0\0\0".join([b"", *parts, b""]), np.uint32)]
    ends = np.cumsum([len(p) // 4 + 1 for p in parts])
    n = len(points) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(texts), bool)
    inner = np.flatnonzero(points[1 : 1 + n] != 32)
    code = points[inner].astype(U64)
    for i in range(1, NGRAM):
        code = code * U64(0x110000) + points[inner + i]
    owner = np.searchsorted(ends, inner + 1, "left")
    return mix(code), owner, np.bincount(owner, minlength=len(texts)).astype(bool)


def _slices(texts: list[str], limit: int = 1 << 18):
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class LanguageFilter:
    """The table, the languages of its bits, and their false-positive rates."""

    def __init__(self, languages: list[str], hashes: np.ndarray, masks: np.ndarray):
        """``masks[i, w]`` has bit ``b`` set where n-gram ``i`` belongs to language ``64 w + b``."""
        self.languages = languages
        self.slots = 1 << max(10, (SLOTS_A_GRAM * len(hashes)).bit_length())
        self.table = np.zeros((max(1, -(-len(languages) // 64)), self.slots), U64)
        for slot in self._slots(hashes):
            for w in range(len(self.table)):
                np.bitwise_or.at(self.table[w], slot, masks[:, w])
        full = [np.count_nonzero((self.table[i >> 6] >> U64(i & 63)) & U64(1)) / self.slots for i in range(len(languages))]
        self.false_positive = np.array(full) ** HASHES

    def _slots(self, hashes: np.ndarray) -> list[np.ndarray]:
        one, two = hashes & U64(0xFFFFFFFF), (hashes >> U64(32)) | U64(1)
        return [((one + two * U64(i)) & U64(self.slots - 1)).astype(np.int64) for i in range(HASHES)]

    def judge(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, score and the share of n-grams that the language has, for each text."""
        hashes, owner, lettered = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.zeros((len(texts), len(self.languages)))
        slots = self._slots(hashes)
        for w in range(len(self.table)):
            found = self.table[w][slots[0]]
            for s in slots[1:]:
                found = found & self.table[w][s]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits[:, i] = np.bincount(owner, weights=((found >> U64(i & 63)) & U64(1)).astype(float), minlength=len(texts))
        f = self.false_positive
        hits = np.clip((hits - total[:, None] * f) / np.maximum(1e-9, 1 - f), 0, None)
        out = []
        for i in range(len(texts)):
            if not lettered[i] or not self.languages:
                out.append((UNDETERMINED, 0.0, 0.0))
                continue
            row = hits[i]
            best = int(np.argmax(row))
            rest = float(np.delete(row, best).max()) if len(row) > 1 else 0.0
            top = float(row[best])
            out.append((self.languages[best], top / (top + rest) if top > 0 else 0.0, min(1.0, top / total[i])))
        return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageFilter:
    """Learn the filter from rows with a text and a language.

    Counts every language's rows over the whole table and reads about
    ``sample_rows`` of each, by a hash of the id.  Languages are few: their names
    and counts reach the driver, as do all n-grams that belong to a language;
    the sample bounds their number, and the table is sized by it.  An empty
    table gives a filter that knows no language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros(0, U64), np.zeros((0, 1), U64))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_rows / sizes[k]))])
    chosen = rows.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < F.element_at(share, F.col("lang"))).select("text", "lang")
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        held: dict[int, dict[int, int]] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in _slices(texts):
                hashes, owner, _ = grams(texts[a:b])
                of = np.array([number[x] for x in langs[a:b]])[owner] if len(owner) else owner
                for k in np.unique(of).tolist():
                    values, counts = np.unique(hashes[of == k], return_counts=True)
                    mine = held.setdefault(k, {})
                    for v, c in zip(values.view(np.int64).tolist(), counts.tolist(), strict=True):
                        mine[v] = mine.get(v, 0) + c
        for k, mine in held.items():
            yield pa.record_batch([pa.array([k] * len(mine), pa.int32()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["k", "gram", "n"])

    counts = chosen.mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilter(languages, np.zeros(0, U64), np.zeros((0, max(1, -(-len(languages) // 64))), U64))
    total = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))])
    rates = counts.withColumn("rate", F.col("n") / F.element_at(total, F.col("k")))
    by_gram = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("all"))
    kept = by_gram.select("gram", F.expr(f"transform(filter(all, x -> x.rate >= {SHARE} * top), x -> x.k)").alias("ks")).toArrow()
    masks = np.zeros((len(kept), max(1, -(-len(languages) // 64))), U64)
    for i, ks in enumerate(kept.column("ks").to_pylist()):
        for k in ks:
            masks[i, k >> 6] |= U64(1) << U64(k & 63)
    return LanguageFilter(languages, kept.column("gram").to_numpy().view(U64), masks)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col(lang, score, share)``.

    ``lang`` is a learned value, or ``und`` where the text is null, has no letter
    or nothing was learned; ``score`` is the share of the best language in the
    corrected counts of the best two; ``share`` is the corrected share of the
    text's n-grams that the language has.  ``out_col`` must be a new name.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("share", pa.float64())])

    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _slices([t or "" for t in texts]):
                out += shared.value.judge([t or "" for t in texts[a:b]])
            judged = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)] if out else [pa.array([], f.type) for f in kind], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], judged], names=[*batch.schema.names[:-1], out_col])

    judged = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("share", DoubleType())])
    schema = StructType([*docs.schema.fields, StructField(out_col, judged)])
    text = F.col(text_col).cast("string")
    return docs.select("*", text.alias(out_col)).mapInArrow(run, schema)


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
