"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut where no piece of the vocabulary can span (before a run of spaces,
around symbols that no longer piece holds), so the parts are encoded apart and
each distinct part once a task.  All distinct parts of a slice form one flat
array of symbols: each round finds the best-scored pair of each part, merges its
leftmost occurrence in all parts at once and closes the gaps, until no pair is
left.  That is the order in which the library's queue merges, so ids are equal.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
#: Characters handled in one flat array, and distinct parts that a task remembers.
SLICE_CHARS = 1 << 18
MEMORY = 200_000
#: Longer parts are merged with a queue, as rounds would grow with the square.
LONG_PART = 2048
_NONE = np.int64(1 << 40)


def _fields(b: bytes):
    """Number, wire type and value of each field of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key = shift = 0
        while True:
            c = b[i]
            i += 1
            key |= (c & 127) << shift
            shift += 7
            if c < 128:
                break
        if key & 7 == 0:
            value = shift = 0
            while True:
                c = b[i]
                i += 1
                value |= (c & 127) << shift
                shift += 7
                if c < 128:
                    break
            yield key >> 3, value
        else:
            if key & 7 == 2:
                n = shift = 0
                while True:
                    c = b[i]
                    i += 1
                    n |= (c & 127) << shift
                    shift += 7
                    if c < 128:
                        break
            else:
                n = {5: 4, 1: 8}[key & 7]
            yield key >> 3, b[i : i + n]
            i += n


class PieceModel:
    """Encoder and decoder of one BPE model with byte fallback and identity normalisation."""

    def __init__(self, raw: bytes):
        pieces, trainer, normal = [], {}, {}
        for f, v in _fields(raw):
            if f == 1:
                x = dict(_fields(v))
                pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, 1)))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normal = dict(_fields(v))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and leading spaces are known")
        if normal.get(2, b"") or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models without normalisation are known")
        if any(t in (4, 5) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not known")
        self.dummy = bool(normal.get(3, 1))
        self.size = len(pieces)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.types = [t for _, _, t in pieces]
        self.text = [p.replace(SPACE, " ") if t == 1 else "" for p, _, t in pieces]
        self.raw_bytes = {i: b for b, i in self.byte_ids.items()}
        known = {p: i for i, (p, _, t) in enumerate(pieces) if t == 1}
        self._symbols(known, [s for _, s, _ in pieces])
        self.names = [str(i) for i in range(self.size)]

    def _symbols(self, known: dict[str, int], scores: list[float]) -> None:
        chars = sorted({c for p in known for c in p})
        ids, n = dict(known), self.size
        for c in chars:
            if c not in ids:
                ids[c] = n
                n += 1
        self.other = n  # a character that no piece holds
        self.width = n + 1
        levels = {s: r for r, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
        pairs = {}
        for p, i in known.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (levels[scores[i]], i)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.fromiter((v[0] for v in pairs.values()), np.int64, len(pairs))[by]
        self.merged = np.fromiter((v[1] for v in pairs.values()), np.int64, len(pairs))[by]
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c in chars:
            self.of_char[ord(c)] = ids[c]
        inner = {c for p in known if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in known):
            raise ValueError("a piece holds a space after other characters")
        cuts = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        self.parts = re.compile(f"[{cuts}]| *[^ {cuts}]+| +" if cuts else " *[^ ]+| +").findall
        self.at_hand: dict[str, tuple[str, str]] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the pairs, -1 if it doesn't merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _rounds(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All merges of all parts: symbols left, the place each began at, and its part."""
        part = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        place = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pair = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            pair[:-1] = np.where(part[:-1] == part[1:], self._rank(symbols[:-1], symbols[1:]), -1)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            n = len(symbols)
            rank = np.where(pair >= 0, self.ranks[pair] * n + np.arange(n), _NONE * n)
            best = np.minimum.reduceat(rank, first)
            live = best < _NONE * n
            if not live.all():
                going = np.repeat(live, np.diff(np.r_[first, n]))
                done.append((symbols[~going], place[~going], part[~going]))
                old = np.cumsum(going) - 1
                at = old[(best[live] % n)]
                symbols, place, part, pair = symbols[going], place[going], part[going], pair[going]
                if not len(symbols):
                    break
            else:
                at = best % n
            symbols[at] = self.merged[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, place, part, pair = symbols[keep], place[keep], part[keep], pair[keep]
            at = moved[at]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(symbols) - 1)
                pair[i] = np.where((j > i) & (part[i] == part[j]), self._rank(symbols[i], symbols[j]), -1)
        if not done:
            return symbols, place, part
        symbols, place, part = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(place, kind="stable")
        return symbols[by], place[by], part[by]

    def _queued(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same merges of one long part, with a queue."""
        n = len(symbols)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True)) if not hasattr(self, "table") else self.table
        self.table = table
        queue = []

        def push(i, j):
            if i >= 0 and j >= 0 and (x := table.get(symbols[i] * self.width + symbols[j])):
                heapq.heappush(queue, (x[0], i, j, symbols[i], symbols[j], x[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while queue:
            _, i, j, a, b, to = heapq.heappop(queue)
            if not (alive[i] and alive[j]) or symbols[i] != a or symbols[j] != b or right[i] != j:
                continue
            symbols[i] = to
            alive[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        at = [i for i in range(n) if alive[i]]
        return [symbols[i] for i in at], at

    def _encode_parts(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in parts]
        short = [i for i, p in enumerate(parts) if len(p) <= LONG_PART]
        flat = "".join(parts[i] for i in short)
        if flat:
            points = np.frombuffer(flat.replace(" ", SPACE).encode("utf-32-le"), np.uint32)
            starts = np.cumsum([0, *(len(parts[i]) for i in short)])
            symbols, place, part = self._rounds(self.of_char[points].astype(np.int64), starts)
            ends = np.searchsorted(part, np.arange(len(short)), "right").tolist()
            listed, begin = symbols.tolist(), 0
            strange = set(part[symbols >= self.size].tolist())
            for k, end in enumerate(ends):
                ids = listed[begin:end]
                out[short[k]] = self._bytes(ids, points[place[begin:end]]) if k in strange else ids
                begin = end
        for i, p in enumerate(parts):
            if len(p) > LONG_PART:
                points = np.frombuffer(p.replace(" ", SPACE).encode("utf-32-le"), np.uint32)
                ids, at = self._queued(self.of_char[points].tolist())
                out[i] = self._bytes(ids, points[at])
        return out

    def _bytes(self, ids: list[int], points: np.ndarray) -> list[int]:
        out = []
        for i, c in zip(ids, points.tolist(), strict=True):
            if i < self.size:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in chr(c).encode())
        return out

    def _text(self, ids: list[int]) -> str:
        """Text of ids without the care for the first space."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.raw_bytes:
                run.append(self.raw_bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.text[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The parts of each text; afterwards every part is at hand, encoded and decoded."""
        lists = [self.parts((" " if self.dummy else "") + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.at_hand) > MEMORY:
            self.at_hand.clear()
        new = list({w for words in lists for w in words} - self.at_hand.keys())
        for w, ids in zip(new, self._encode_parts(new), strict=True):
            self.at_hand[w] = (",".join([self.names[i] for i in ids]), self._text(ids))
        return lists

    def digests(self, texts: list[str]):
        """For each text: ids joined by commas, and the text decoded from the ids."""
        for words in self.learn(texts):
            found = [self.at_hand[w] for w in words]
            text = "".join([x[1] for x in found])
            yield ",".join([x[0] for x in found]), text[1:] if self.dummy and text[:1] == " " else text

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for i in ids.split(",")] if ids else [] for ids, _ in self.digests(texts)]

    def decode(self, ids: list[int]) -> str:
        text = self._text(ids)
        return text[1:] if self.dummy and ids and self.types[ids[0]] == 1 and text[:1] == " " else text


def _slices(texts: list[str]):
    """Bounds of runs of texts with a bounded number of characters; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def load_model(path: str) -> bytes:
    """The model file: a fixed size, whatever the input."""
    with open(path, "rb") as f:
        return f.read()


class _Held:
    """One model a worker."""

    raw: bytes | None = None
    model: PieceModel | None = None

    @classmethod
    def get(cls, raw: bytes) -> PieceModel:
        if cls.model is None or cls.raw != raw:
            cls.model, cls.raw = PieceModel(raw), raw
        return cls.model


def encoder(spark, model_path: str):
    """A column function: text to ids (array of int). A null text counts as empty."""
    shared = spark.sparkContext.broadcast(load_model(model_path))

    def run(text: pd.Series) -> pd.Series:
        model, texts, out = _Held.get(shared.value), [t or "" for t in text], []
        for a, b in _slices(texts):
            out += model.encode(texts[a:b])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")


def decoder(spark, model_path: str):
    """A column function: ids to text. Null ids give an empty text."""
    shared = spark.sparkContext.broadcast(load_model(model_path))

    def run(ids: pd.Series) -> pd.Series:
        model = _Held.get(shared.value)
        return pd.Series([model.decode([int(i) for i in x]) if x is not None else "" for x in ids], dtype=object)

    return F.pandas_udf(run, "string")


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs``.

    Encodes the whole text (null: empty, no ids) without begin or end ids and
    decodes the ids.  ``ids_sha256`` is of the decimal ids joined by commas,
    ``decoded_sha256`` of the decoded text in UTF-8.  Ids may be null or repeat;
    an empty table gives an empty result; only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        model = _Held.get(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, one, two = [], [], []
            for a, b in _slices(texts):
                for ids, text in model.digests(texts[a:b]):
                    counts.append(ids.count(",") + 1 if ids else 0)
                    one.append(hashlib.sha256(ids.encode()).hexdigest())
                    two.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ids_column(spark, model_path: str, text: Column) -> Column:
    return encoder(spark, model_path)(text)
