"""Findings of round 3: titles with blanks at their ends, sessions dealt by time, state in chunks, lines without their texts in Python."""

import collections
import json
import random

import duckdb


def test_slugs_of_blank_ended_titles(spark, tmp_path):
    """A title without letters is named by the hash of all of it, the blank at its end too."""
    from scriptorium.plans import registry

    titles = ["Ç Ç ", " Ç Ç", "Ç Ç", "", " ", " A b ", "x" * 59 + " y", None]
    rows = [(i, None if t is None else f"<html><title>{t}</title>") for i, t in enumerate(titles)] + [(99, "no title")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["slug"] for r in registry.queries()["title_slugs"](spark, str(tmp_path)).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(duckdb.sql(registry.oracle_sql()["title_slugs"]).fetchall())
    assert len({got[0], got[1], got[2]}) == 3


def test_sessions_of_a_table_are_dealt_by_time(spark):
    """As by session windows, over gaps of exactly the length, window bounds, null keys and paths; no key's events are sorted in one task."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from scriptorium.streaming import watch

    rng, t0 = random.Random(3), datetime(2024, 1, 1)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 1, 59_999_999, 60_000_000, 60_000_001, 10_000_000, 200_000_000])
        rows.append((rng.choice(["a", "a", "b", None]), t0 + timedelta(microseconds=at), rng.choice(["p", "q", None, f"r{i}"])))
    events = spark.createDataFrame(rows + [("a", None, "lost")], "k string, ts timestamp, path string")
    want = []
    for k in ("a", "b", None):
        mine, runs = sorted((r for r in rows if r[0] == k), key=lambda r: r[1]), []
        for r in mine:
            if runs and r[1] - runs[-1][-1][1] < timedelta(minutes=1):
                runs[-1].append(r)
            else:
                runs.append([r])
        want += [(k, g[0][1], g[-1][1] + timedelta(minutes=1), len(g), sorted({r[2] for r in g} - {None})) for g in runs]
    found = watch.debounced(events, "1 minute", "k")
    order = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted(want, key=order)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SessionsExec" not in plan and "UpdatingSessions" not in plan and "MergingSessions" not in plan
    assert found.select(F.sum("events")).first()[0] == 600


def _python_inputs(df):
    """The arguments of the Python functions in a plan, resolved, without their columns' numbers."""
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", line) for line in plan.splitlines() if "ArrowEvalPython" in line]


def test_lines_leave_their_texts_in_the_jvm(spark):
    """Places in code points, whatever the lines; Python gets sizes of lines."""
    from scriptorium.operators import blocks

    texts = ["", "\n", "a\nb", "é\n中文😀\n\nx\r\ny", None, "long " * 1000 + "\n" + "z" * 70_000, "\n" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, t in enumerate(texts):
        at = 0
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            want.append((i, n, line, at, at + len(line)))
            at += len(line) + 1
    found = blocks.line_blocks(docs)
    assert sorted(map(tuple, found.collect())) == want
    assert found.schema["start"].dataType.typeName() == found.schema["end"].dataType.typeName() == "long"
    [call] = _python_inputs(found)
    assert "transform(split(" in call, "the argument is made of sizes"


def test_only_other_bytes_are_decoded_in_python(spark):
    """As Python decodes, for bytes of all kinds; Python gets null for plain UTF-8."""
    from pyspark.sql import functions as F

    from scriptorium.sources import office

    def plain(raw):
        raw = b"" if raw is None else raw
        marked = raw[:2] in (b"\xff\xfe", b"\xfe\xff")
        for name in ("utf-16",) if marked else ("utf-8-sig", "gb18030"):
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            if marked or "\x00" not in text:
                return text
        return None

    raws = [None, b"", b"a", "é中😀".encode(), b"\xef\xbb\xbfx", b"\xef\xbb\xbf", b"\xef\xbb\xbf\xef\xbb\xbfx", b"a\x00b", "中文".encode("gb18030"), "x\x00".encode("utf-16"), "😀".encode("utf-16-be"), b"\xff\xfe\x00", b"\xed\xa0\x80", b"\xc0\x80", b"\xf5\x80\x80\x80", b"\xff", b"\x81", b"\xef\xbb"]
    df = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raws)], "i int, content binary")
    got = df.select("i", office.decoded_text("content").alias("t"))
    assert [r["t"] for r in got.orderBy("i").collect()] == [plain(r) for r in raws]
    [call] = _python_inputs(got)
    assert "CASE WHEN" in call or "if" in call.lower(), "plain texts are null there"
    assert df.where("i > 0").select(office.decoded_text(F.col("content")).alias("t")).where("t is null").count() == sum(plain(r) is None for r in raws)


class _Value:
    def __init__(self, calls):
        self.v, self.calls = None, calls

    def get(self):
        self.calls["value"] += 1
        return self.v

    def update(self, v):
        self.calls["value"] += 1
        self.v = v

    def clear(self):
        self.v = None


class _Map(dict):
    def __init__(self, calls):
        super().__init__()
        self.calls, self.longest = calls, 0

    def getValue(self, k):
        self.calls["map"] += 1
        return self.get(k)

    def updateValue(self, k, v):
        self.calls["map"] += 1
        self[k] = v

    def removeKey(self, k):
        self.calls["map"] += 1
        del self[k]


class _Handle:
    """The state of one key, and its timers."""

    def __init__(self):
        self.calls, self.timers, self.maps = collections.Counter(), set(), {}

    def getValueState(self, *_):
        return _Value(self.calls)

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map(self.calls))

    def registerTimer(self, at):
        self.timers.add(at)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def _played(machine, batches, chunk):
    """Output rows over batches ``(watermark, rows)``, the most rows given at once, the most taken from one span, and the handle."""
    import pandas as pd

    handle, out, most, spans = _Handle(), [], 0, []
    machine.chunk, machine.cuts = chunk, 8
    machine.init(handle)
    taken = machine._taken
    machine._taken = lambda *a: spans.append(taken(*a)) or spans[-1]
    names = ["at_ms", "tie", *machine.columns]
    for now, rows in batches:
        frames = [pd.DataFrame(rows[i : i + 7], columns=names) for i in range(0, len(rows), 7)]
        if frames:
            list(machine.handleInputRows(("k",), iter(frames), _Clock(now)))
        while due := sorted(t for t in handle.timers if t <= now):
            for df in machine.handleExpiredTimer(("k",), _Clock(now), None):
                out += list(df.itertuples(index=False, name=None))
                most = max(most, len(df))
            handle.timers.discard(due[0])
    return out, most, max(map(len, spans)), handle


def test_held_events_are_taken_span_by_span(spark):
    """Many events of one key: no more than a span of them, and no more than a chunk of rows given, in memory; whatever the batches."""
    from scriptorium.streaming import stateful

    rng = random.Random(5)
    rows = [(rng.randrange(1_000_000), f"e{i}") for i in range(3_000)]
    for cut in ([3_000], [1_000, 1_001, 2_900, 3_000], list(range(10, 3_001, 10))):
        batches, at = [], 0
        for k, end in enumerate(cut):
            # A watermark that has passed some of the rows that have come, and none of those that come later.
            later = min((r[0] for r in rows[end:]), default=900_001)
            batches.append((later - 1 if k < len(cut) - 1 else 900_000, rows[at:end]))
            at = end
        got, most, span, handle = _played(stateful.Numbering(), batches, 100)
        order = sorted(r for r in rows if r[0] <= 900_000)
        assert got == [("k", n, e, t) for n, (t, e) in enumerate(order, 1)]
        assert most <= 100 and span < 600
        held = sum(len(json.loads(v[0])) for v in handle.maps["held"].values())
        assert held == len(rows) - len(order) and min(handle.timers) > 900_000


def test_state_of_a_key_is_read_once_for_many_events(spark):
    """A thousand events of a file or a queue cost few calls of the state, not some for each."""
    from scriptorium.streaming import stateful

    rng = random.Random(6)
    rows = [(i * 10, f"{i:05d}", f"s{rng.randrange(2)}", f"d{rng.randrange(2)}") for i in range(1_000)]
    got, _, _, handle = _played(stateful.Settling(15), [(20_000, rows)], 5_000)
    assert got and handle.calls["value"] + handle.calls["map"] < 20
    rows = [(i * 10, f"{i:05d}", f"t{rng.randrange(40)}", rng.choice(["submit", "end"]), "b") for i in range(1_000)]
    got, _, _, handle = _played(stateful.Queue(2), [(20_000, rows)], 5_000)
    assert len(got) >= 1_000 and handle.calls["value"] + handle.calls["map"] < 100
    small = _played(stateful.Queue(2), [(2_000, rows[:300]), (20_000, rows[300:])], 10)
    assert small[0] == got, "the same with little at once, waiting tasks and states in the store"
