"""Streams with keyed state and timers: settled files, lasting numbers, task queues.

Events of a key are held until the watermark has passed them and then taken in
order of their time, so the result doesn't depend on how the stream was cut into
batches, on the order within the allowed delay, or on a restart.  What a key
holds is its machine's state and the events of one delay, in chunks dealt by
time: a worker has one chunk in memory, not all events of a key, and a machine's
state is read and written once a chunk, not once an event.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from scriptorium.operators.graph import shared_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are taken in or given out at once; a key that holds more has them dealt by time, at first into so many spans.
CHUNK, SPANS = 32_768, 256


class InOrder(StatefulProcessor):
    """Gives the rows of a key to ``take`` in order of ``at_ms`` and ``tie``, each once the watermark has passed it.

    A row is a list: ``at_ms``, ``tie`` and the texts of ``columns``.  ``load()`` reads the machine's state and ``save()``
    writes it; between them ``take(row)`` and ``until(now)`` give output rows without the key, and ``due()`` names the
    next moment at which ``until`` has something to say, or None.

    Few rows are held as one span; more are dealt into spans of one ``width`` of time, each in parts as they came.
    """

    columns: tuple[str, ...] = ()
    output: tuple[str, ...]
    chunk, cuts = CHUNK, SPANS

    def init(self, handle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "width bigint, span array<bigint>, parts array<int>, n bigint")
        self.held = handle.getMapState("held", "span bigint, part int", "rows string")
        self.open(handle)

    def open(self, handle) -> None:
        """Opens the machine's own state."""

    def load(self, key) -> None:
        raise NotImplementedError

    def save(self) -> None:
        raise NotImplementedError

    def take(self, row: list) -> Iterator[tuple]:
        raise NotImplementedError

    def until(self, now: int) -> Iterator[tuple]:
        return iter(())

    def due(self) -> int | None:
        return None

    def _wake(self, at: int | None) -> None:
        if at is not None:
            self.handle.registerTimer(at)

    def _known(self) -> tuple[int, dict[int, int], int]:
        """The width of a span (0: all in one), the parts of each span and the number of rows held."""
        width, span, parts, n = self.spans.get() or (0, [], [], 0)
        return width, dict(zip(span, parts, strict=True)), n

    def _note(self, width: int, parts: dict[int, int], n: int) -> None:
        if parts:
            self.spans.update((width, list(parts), list(parts.values()), n))
        else:
            self.spans.clear()

    def _taken(self, span: int, parts: dict[int, int]) -> list[list]:
        """The rows of a span, which is no longer held."""
        rows = []
        for part in range(parts.pop(span)):
            rows += json.loads(self.held.getValue((span, part))[0])
            self.held.removeKey((span, part))
        return rows

    def _hold(self, rows: list[list], width: int, parts: dict[int, int], n: int) -> tuple[int, int]:
        """Holds the rows too; gives the width and the number of rows then."""
        if not width and n + len(rows) > self.chunk:
            rows = rows + (self._taken(0, parts) if parts else [])
            times = [r[0] for r in rows]
            width, n = max(1, (max(times) - min(times)) // self.cuts), 0
        dealt: dict[int, list] = {}
        for r in rows:
            dealt.setdefault(r[0] // width if width else 0, []).append(r)
        for span, some in dealt.items():
            part = parts.get(span, 0)
            self.held.updateValue((span, part), (json.dumps(some, ensure_ascii=False),))
            parts[span] = part + 1
        return width, n + len(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        width, parts, n = self._known()
        new, first = [], None
        for some in rows:
            columns = [[None if v is None or v != v else v for v in some[c].tolist()] for c in ("at_ms", "tie", *self.columns)]
            new += map(list, zip(*columns, strict=True))
            least = min(columns[0])
            first = least if first is None else min(first, least)
            if len(new) >= self.chunk:
                width, n = self._hold(new, width, parts, n)
                new = []
        if new:
            width, n = self._hold(new, width, parts, n)
        self._note(width, parts, n)
        self._wake(first)  # the later ones are named when this one has been taken
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        width, parts, n = self._known()
        self.load(key)
        out: list[tuple] = []
        wake = None
        for span in sorted(parts):
            if width and span * width > now:
                wake = span * width
                break
            rows = self._taken(span, parts)
            n -= len(rows)
            later = [r for r in rows if r[0] > now]
            for r in sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], r[1] or "")):
                out += self.until(r[0])
                out += self.take(r)
                if len(out) >= self.chunk:
                    yield self._told(key, out)
                    out = []
            if later:
                width, n = self._hold(later, width, parts, n)
                wake = min(r[0] for r in later)
                break
        out += self.until(now + 1)
        self.save()
        self._note(width, parts, n)
        self._wake(wake)
        self._wake(self.due())
        if out:
            yield self._told(key, out)

    def _told(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=list(self.output))


class Settling(InOrder):
    """A file whose stamp has stood for ``debounce_ms`` is settled; it is told once for each content."""

    columns = ("stamp", "digest")
    output = ("path", "stamp", "digest", "settled_ms")

    def __init__(self, debounce_ms: int):
        self.debounce_ms = debounce_ms

    def open(self, handle) -> None:
        self.run = handle.getValueState("run", "stamp string, digest string, since bigint, open boolean, told string")

    def load(self, key) -> None:
        self.now = self.before = self.run.get()

    def save(self) -> None:
        if self.now is not None and self.now != self.before:
            self.run.update(self.now)

    def take(self, row) -> Iterator[tuple]:
        at, _, stamp, digest = row
        if self.now is None or self.now[0] != stamp:
            self.now = (stamp, digest, at, True, None if self.now is None else self.now[4])
        return iter(())

    def until(self, now: int) -> Iterator[tuple]:
        if self.now is None or not self.now[3] or self.now[2] + self.debounce_ms >= now:
            return
        stamp, digest, since, _, told = self.now
        self.now = (stamp, digest, since, False, digest)
        if told != digest:
            yield stamp, digest, since + self.debounce_ms

    def due(self) -> int | None:
        return self.now[2] + self.debounce_ms if self.now is not None and self.now[3] else None


class Numbering(InOrder):
    """Each event of a key gets the next number, which it keeps for good."""

    output = ("key", "seq", "event", "at_ms")

    def open(self, handle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def load(self, key) -> None:
        self.n = (self.count.get() or (0,))[0]

    def save(self) -> None:
        self.count.update((self.n,))

    def take(self, row) -> Iterator[tuple]:
        self.n += 1
        yield self.n, row[1], row[0]


class Queue(InOrder):
    """Tasks of a queue: ``running`` at most at a time, the others in order of submission.

    A task submitted again with its binding is ``repeated``, with another one
    ``refused``; one that ends makes room for the next.  What isn't running can't end: ``unknown``.
    """

    columns = ("task", "command", "binding")
    output = ("queue", "at_ms", "cause", "task", "event")

    def __init__(self, running: int):
        self.running = running

    def open(self, handle) -> None:
        self.tasks = handle.getMapState("tasks", "task string", "binding string, state string")
        self.waiting = handle.getMapState("waiting", "place bigint", "task string")
        self.line = handle.getValueState("line", "busy int, first bigint, next bigint")

    def load(self, key) -> None:
        line = self.line.get()
        self.new = line is None  # then no task is known yet, and none need be looked up
        self.busy, self.first, self.next = line or (0, 0, 0)
        self.seen: dict[str, Any] = {}
        self.changed: set[str] = set()
        self.queued: dict[int, str] = {}

    def save(self) -> None:
        for task in self.changed:
            self.tasks.updateValue((task,), self.seen[task])
        for place, task in self.queued.items():
            self.waiting.updateValue((place,), (task,))
        self.line.update((self.busy, self.first, self.next))
        self.new, self.seen, self.changed, self.queued = False, {}, set(), {}

    def _state(self, task: str):
        if task not in self.seen:
            known = None if self.new else self.tasks.getValue((task,))
            self.seen[task] = None if known is None else tuple(known)
        return self.seen[task]

    def _set(self, task: str, binding, state: str) -> None:
        self.seen[task] = (binding, state)
        self.changed.add(task)

    def _next(self) -> str | None:
        """The task that has waited longest, which waits no longer."""
        if self.first == self.next:
            return None
        place, self.first = self.first, self.first + 1
        if place in self.queued:
            return self.queued.pop(place)
        task = self.waiting.getValue((place,))[0]
        self.waiting.removeKey((place,))
        return task

    def take(self, row) -> Iterator[tuple]:
        at, tie, task, command, binding = row
        if len(self.seen) >= self.chunk:
            self.save()
        known = self._state(task)
        if command == "submit":
            if known is not None:
                yield at, tie, task, "repeated" if known[0] == binding else "refused"
                return
            start = self.busy < self.running
            self._set(task, binding, "running" if start else "queued")
            if start:
                self.busy += 1
            else:
                self.queued[self.next] = task
                self.next += 1
            yield at, tie, task, "started" if start else "queued"
        elif known is None or known[1] != "running":
            yield at, tie, task, "unknown"
        else:
            self._set(task, known[0], "ended")
            yield at, tie, task, "ended"
            first = self._next()
            if first is None:
                self.busy -= 1
                return
            self._set(first, self._state(first)[0], "running")
            yield at, tie, first, "started"


def _timed(events: DataFrame, at: str, delay: str) -> DataFrame:
    timed = events.where(F.col(at).isNotNull()).withColumn("at", F.col(at).cast("timestamp"))
    return timed.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))


def settled_stream(events: DataFrame, debounce_ms: int, delay: str, at: str = "ts") -> DataFrame:
    """Stream ``(path, stamp, digest, settled_ms)`` of a stream ``(path, ts, stamp, digest)``.

    A stamp that no other followed within ``debounce_ms`` is settled at the end of
    that time; told are only contents other than the path's last one told.  Rows
    without a time or path take no part; repeated rows change nothing.
    """
    rows = _timed(events.where("path is not null"), at, delay)
    tie = F.concat_ws("\u001f", F.col("stamp").cast("string"), "digest")
    shaped = rows.select("path", "at", "at_ms", tie.alias("tie"), F.col("stamp").cast("string").alias("stamp"), "digest")
    return shaped.groupBy("path").transformWithStateInPandas(Settling(debounce_ms), "path string, stamp string, digest string, settled_ms bigint", "Append", "EventTime")


def numbered_stream(events: DataFrame, key: str, event: str, delay: str, at: str = "ts") -> DataFrame:
    """Stream ``(key, seq, event, at_ms)``: the events of each key, numbered from 1 in order of time (ties by ``event``) for good."""
    shaped = _timed(events, at, delay).select(F.col(key).cast("string").alias("key"), "at", "at_ms", F.col(event).cast("string").alias("tie"))
    return shaped.groupBy("key").transformWithStateInPandas(Numbering(), "key string, seq bigint, event string, at_ms bigint", "Append", "EventTime")


def task_stream(commands: DataFrame, running: int, delay: str, at: str = "ts") -> DataFrame:
    """Stream ``(queue, at_ms, cause, task, event)`` of a stream ``(queue, ts, id, task, command, binding)`` of the commands submit and end."""
    shaped = _timed(commands.where("task is not null"), at, delay).select("queue", "at", "at_ms", F.col("id").cast("string").alias("tie"), F.col("task").cast("string").alias("task"), "command", F.col("binding").cast("string").alias("binding"))
    return shaped.groupBy("queue").transformWithStateInPandas(Queue(running), "queue string, at_ms bigint, cause string, task string, event string", "Append", "EventTime")


def replayed(numbered: DataFrame, since: int, most: int, size: int) -> DataFrame:
    """Of ``numbered(key, seq, …)``, the first ``most`` of each key from the number ``since`` on that are among its last ``size``."""
    first = F.greatest(F.lit(since), F.max("seq").over(Window.partitionBy("key")) - size + 1)
    return numbered.withColumn("_first", first).where((F.col("seq") >= F.col("_first")) & (F.col("seq") < F.col("_first") + most)).drop("_first")


def drained(spark: SparkSession, stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives the table it has written; the same folders again take up where it stopped.

    Both folders are shared ones of the cluster by default.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{base}/out", checkpoint or f"{base}/checkpoint"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def file_stream(spark: SparkSession, path: str, select: Callable[[DataFrame], DataFrame], files: int = 64) -> DataFrame:
    """A stream over the Parquet file or files at ``path``, at most ``files`` of them a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    # A pattern may stand for a single file; a plain path must be a folder.
    return select(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{{{name}}}"))
