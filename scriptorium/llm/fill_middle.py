"""Fill-in-the-middle forms of documents, over an index of distinct texts.

A text's units are runs of A-Z and a-z and single other characters.  The places
where units begin, and the text's end, form a rising list, kept as an Elias-Fano
code: low bits packed, high bits in unary.  A cut is one select on that code.

The list of a text that several rows share is computed once: rows are grouped by
the text itself, the lists are written, and rows meet their list by hash and text,
so content is compared byte by byte.  A text that no other row has is the only
member of its group and needs no meeting; a table of at most SLOTS hash slots
tells which texts may be shared.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from .common import let, materialize
from .exact_dedup import SLOTS, marked, shared_slots

PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"
_HEAD = struct.Struct("<qB")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def unit_bounds(data: np.ndarray) -> np.ndarray:
    """Code-point places where the units of a UTF-8 text begin, and its length in code points."""
    heads = (data & 0xC0) != 0x80
    low = data | 32
    letters = (low >= 97) & (low <= 122)
    begins = heads.copy()
    begins[1:] &= ~(letters[1:] & letters[:-1])
    at = np.cumsum(heads, dtype=np.int64)
    return np.append(at[begins] - 1, at[-1] if len(at) else 0)


def encode(values: np.ndarray) -> bytes:
    """The Elias-Fano code of a rising list that isn't empty: its length and low width, low bits, high bits."""
    m = len(values)
    width = max(0, int(values[-1] // m).bit_length() - 1)
    low = (values[:, None] >> np.arange(width)) & 1
    high = np.zeros((int(values[-1]) >> width) + m, np.uint8)
    high[(values >> width) + np.arange(m)] = 1
    return _HEAD.pack(m, width) + np.packbits(low.astype(np.uint8), axis=None, bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(code: bytes, places: list[int]) -> list[int]:
    """The values at ``places`` of a coded list."""
    m, width = _HEAD.unpack_from(code)
    low_bytes = (m * width + 7) // 8
    low, high = code[_HEAD.size : _HEAD.size + low_bytes], np.frombuffer(code, np.uint8, offset=_HEAD.size + low_bytes)
    met = np.cumsum(_ONES[high])
    out = []
    for i in places:
        byte = int(np.searchsorted(met, i + 1))
        within = i - (int(met[byte - 1]) if byte else 0)
        bit = byte * 8 + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[within])
        first = i * width
        chunk = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little") >> first % 8
        out.append(bit - i << width | chunk & (1 << width) - 1)
    return out


@F.arrow_udf(StructType().add("n", LongType()).add("code", BinaryType()))
def unit_list(texts: pa.Array) -> pa.Array:
    """Number of units and coded bounds of each text."""
    counts, codes = [], []
    for text in texts:
        bounds = unit_bounds(np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8))
        counts.append(len(bounds) - 1)
        codes.append(encode(bounds))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(codes, pa.binary())], ["n", "code"])


@F.arrow_udf(StructType().add("start", LongType()).add("end", LongType()))
def cut_places(codes: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Characters before the smaller and before the larger of two unit numbers."""
    found = [select(c, sorted((a, b))) for c, a, b in zip(codes.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["start", "end"])


def draws(doc_id: Column, seed: int) -> Column:
    """Four numbers of 32 bits drawn for an id; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return let(digest, lambda d: F.array(*[F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]))


def indexed(docs: DataFrame, text_col: str, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``units``, a struct of the number of units and the code of their bounds. ``text_col`` must not be null."""
    rows = docs.withColumn("text_hash", F.xxhash64(text_col))
    found = materialize(shared_slots(rows.select("text_hash"), ["text_hash"], slots), "shared")
    dealt = marked(rows, ["text_hash"], found, slots, "shared")
    single = dealt.where("not shared").withColumn("units", unit_list(F.col(text_col)))
    several = dealt.where("shared")
    index = several.groupBy(F.col("text_hash").alias("index_hash"), F.col(text_col).alias("index_text")).agg(F.count(F.lit(1)).alias("copies"))
    index = materialize(index.select("index_hash", "index_text", unit_list(F.col("index_text")).alias("units")), "index")
    met = several.join(index, (F.col("text_hash") == F.col("index_hash")) & (F.col(text_col) == F.col("index_text")))
    return single.unionByName(met.drop("index_hash", "index_text")).drop("text_hash", "shared")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20, slots: int = SLOTS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, text, n, form, prefix_chars, middle_chars, output``.

    The prefix ends after the smaller of two seeded unit numbers, the middle
    after the larger.  ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100
    of these with the suffix first.  Empty and null texts, and texts that hold
    one of the marks, stay plain, with no cut.  Rows that repeat an id draw alike;
    rows without an id draw as an empty one.  An empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    listed = indexed(rows, "text", slots)
    drawn = listed.withColumn("h", draws(F.col("doc_id"), seed)).withColumn("n", F.col("units.n"))
    marks = F.col("text").contains(PREFIX_MARK) | F.col("text").contains(SUFFIX_MARK) | F.col("text").contains(MIDDLE_MARK)
    plain = (F.col("text") == "") | marks | (F.get("h", 2) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("h", 3) % 100 < spm_rate, "spm").otherwise("psm")
    cut = drawn.withColumn("form", form).withColumn("cut", cut_places(F.col("units.code"), F.get("h", 0) % (F.col("n") + 1), F.get("h", 1) % (F.col("n") + 1)))
    start, middle = F.col("cut.start"), F.col("cut.end") - F.col("cut.start")

    def part(begin: Column, length: Column) -> Column:
        return F.substring("text", begin.cast("int"), length.cast("int"))

    pieces = {"prefix": part(F.lit(1), start), "middle": part(start + 1, middle), "suffix": part(F.col("cut.end") + 1, F.length("text"))}
    psm = F.concat(F.lit(PREFIX_MARK), pieces["prefix"], F.lit(SUFFIX_MARK), pieces["suffix"], F.lit(MIDDLE_MARK), pieces["middle"])
    spm = F.concat(F.lit(SUFFIX_MARK), pieces["suffix"], F.lit(PREFIX_MARK), pieces["prefix"], F.lit(MIDDLE_MARK), pieces["middle"])
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    known = F.col("form") != "plain"
    return cut.select("doc_id", "text", "n", "form", F.when(known, start).alias("prefix_chars"), F.when(known, middle).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: what stands between the marks, put in order again. A rearranged text holds no mark of its own."""
    between = let(F.split(output, "<[PSM]>", -1), lambda x: F.when(form == "psm", F.concat(F.get(x, 1), F.get(x, 3), F.get(x, 2))).otherwise(F.concat(F.get(x, 2), F.get(x, 3), F.get(x, 1))))
    return F.when(form == "plain", output).otherwise(between)
