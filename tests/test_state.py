"""Streams with state: equal to a plain machine whatever the batches are, a restart included."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.streaming import stateful

EVENTS = "path string, ts timestamp, stamp string, digest string, id long, queue string, task string, command string, binding string"


@pytest.fixture(scope="module")
def rows():
    """Rows in files; times are out of order within a file, never by more than 40 s."""
    rng = random.Random(4)
    out = []
    for i in range(400):
        at = 1_000 + i * 5 + rng.randrange(-20, 20)
        stamp = f"s{rng.randrange(3)}"
        out.append((f"p{rng.randrange(6)}", at, stamp, f"d{rng.randrange(4)}", i, f"q{rng.randrange(2)}", f"t{rng.randrange(40)}", rng.choice(["submit", "submit", "end"]), f"b{rng.randrange(5) // 4}"))
    return out


def written(spark, rows, folder, part):
    df = spark.createDataFrame([(p, t, *x) for p, t, *x in rows], EVENTS.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{part}")


@pytest.fixture(scope="module")
def folders(spark, rows, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("stream"))
    for k in range(4):
        written(spark, rows[k * 100 : k * 100 + 100], base, f"k={k}")
    return base


def runs(spark, folders, make, tmp_path):
    """The table of a stream stopped after two files and taken up again, and that of one run with all in one batch."""
    def over(names, out, files=1):
        schema = spark.read.parquet(folders).drop("k").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folders}/{names}")
        return stateful.drained(spark, make(stream), f"{out}/out", f"{out}/checkpoint")

    over("k=[01]", f"{tmp_path}/a")
    # The second run has the same query over more files, as if they had come since.
    again = over("k=[0123]", f"{tmp_path}/a")
    once = over("k=[0123]", f"{tmp_path}/b", 4)
    got = sorted(map(tuple, again.collect()))
    assert got == sorted(map(tuple, once.collect())) and got
    return got


def passed(rows, delay):
    """Rows that the last watermark has passed, in order."""
    mark = (max(r[1] for r in rows) - delay) * 1000
    return mark, sorted((r for r in rows if r[1] * 1000 <= mark), key=lambda r: r[1])


def test_settled_stream(spark, rows, folders, tmp_path):
    got = runs(spark, folders, lambda s: stateful.settled_stream(s, 20_000, "60 seconds"), tmp_path)
    mark, order = passed(rows, 60)
    want = []
    for p in sorted({r[0] for r in rows}):
        mine = sorted((r for r in order if r[0] == p), key=lambda r: (r[1], f"{r[2]}\x1f{r[3]}"))
        runs_, told = [], None
        for r in mine:
            if not runs_ or runs_[-1][0] != r[2]:
                runs_.append((r[2], r[3], r[1] * 1000))
        for k, (stamp, digest, since) in enumerate(runs_):
            end = runs_[k + 1][2] if k + 1 < len(runs_) else mark + 1
            if since + 20_000 < end and digest != told:
                told = digest
                want.append((p, stamp, digest, since + 20_000))
    assert got == sorted(want)


def test_lasting_numbers(spark, rows, folders, tmp_path):
    got = runs(spark, folders, lambda s: stateful.numbered_stream(s, "queue", "id", "60 seconds"), tmp_path)
    want = []
    for q in ("q0", "q1"):
        mine = sorted((r for r in passed(rows, 60)[1] if r[5] == q), key=lambda r: (r[1], str(r[4])))
        want += [(q, k, str(r[4]), r[1] * 1000) for k, r in enumerate(mine, 1)]
    assert got == sorted(want)
    table = spark.createDataFrame(got, "key string, seq long, event string, at_ms long")
    last = max(s for q, s, *_ in got if q == "q0")
    seen = sorted(r["seq"] for r in stateful.replayed(table, 5, 7, 30).where("key = 'q0'").collect())
    assert seen == list(range(last - 29, last - 22)), "what has left the buffer is passed over and numbers stay"


def test_task_stream(spark, rows, folders, tmp_path):
    got = runs(spark, folders, lambda s: stateful.task_stream(s, 2, "60 seconds"), tmp_path)
    want = []
    for q in ("q0", "q1"):
        tasks, waiting, busy = {}, [], 0
        for r in sorted((r for r in passed(rows, 60)[1] if r[5] == q), key=lambda r: (r[1], str(r[4]))):
            say = lambda task, event, r=r: want.append((q, r[1] * 1000, str(r[4]), task, event))
            task, command, binding = r[6:]
            if command == "submit" and task in tasks:
                say(task, "repeated" if tasks[task][0] == binding else "refused")
            elif command == "submit" and busy < 2:
                busy += 1
                tasks[task] = (binding, "running")
                say(task, "started")
            elif command == "submit":
                tasks[task] = (binding, "queued")
                waiting.append(task)
                say(task, "queued")
            elif tasks.get(task, ("", ""))[1] != "running":
                say(task, "unknown")
            else:
                tasks[task] = (tasks[task][0], "ended")
                say(task, "ended")
                if waiting:
                    tasks[waiting[0]] = (tasks[waiting[0]][0], "running")
                    say(waiting.pop(0), "started")
                else:
                    busy -= 1
    assert got == sorted(want) and {e for *_, e in want} == {"started", "queued", "repeated", "refused", "ended", "unknown"}
