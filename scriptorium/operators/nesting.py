"""What stands open where, by one walk over sorted rows with a stack: any level, any depth."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(rows: DataFrame, key: str, order: str, level: Column, label: Column | None = None) -> DataFrame:
    """``(key, order, above, until, path, labels)`` of rows whose ``level`` is not null.

    A row closes those before it of its level and deeper.  ``above`` is the
    order of the row it then stands under, ``until`` that of the row that closes it
    (null at the end), ``path`` the orders of all that are open there, its own
    last, and ``labels`` their labels.  Rows of a key are sorted by Spark and read
    in batches; only the open ones are held.
    """
    label = F.lit(None).cast("string") if label is None else label.cast("string")
    narrow = rows.select(F.col(key), F.col(order), level.cast("int").alias("_level"), label.alias("_label")).where("_level is not null")
    kinds = {c: narrow.schema[c].dataType.simpleString() for c in (key, order)}
    names = [key, order, "above", "until", "path", "labels"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []  # key, order, level, label of what is open
        types = None

        def batch(out):
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [types[0], types[1], types[1], types[1], pa.list_(types[1]), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        def close(until):
            k, o, _, _ = stack[-1]
            row = (k, o, stack[-2][1] if len(stack) > 1 else None, until, [s[1] for s in stack], [s[3] for s in stack])
            stack.pop()
            return row

        for b in batches:
            types = [b.schema.field(i).type for i in (0, 1)]
            out = []
            for k, o, depth, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                while stack and stack[-1][0] != k:
                    out.append(close(None))
                while stack and stack[-1][2] >= depth:
                    out.append(close(o))
                stack.append((k, o, depth, text))
            yield batch(out)
        out = []
        while stack:
            out.append(close(None))
        if out:
            yield batch(out)

    dealt = narrow.repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(walk, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, above {kinds[order]}, until {kinds[order]}, path array<{kinds[order]}>, labels array<string>")
