"""Topics reconciled in windows, against a plain version; no member is lost and no path is given twice."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import knowledge

KIND = "group long, path string, name string, labels array<string>, members array<string>"


def digest(members, turn):
    text = json.dumps(sorted(members), separators=(",", ":"))
    return hashlib.sha256((text if turn == 0 else f"[{text},{turn}]").encode()).hexdigest()[:12]


def plain(rows, most, resolve, existing=frozenset()):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    marks = {}
    for g, path, _, labels, _ in rows:
        for mark in {("path", path), *(" ".join(x.split()).lower() for x in labels if x.strip())}:
            a, b = find(g), find(marks.setdefault(mark, g))
            parent[max(a, b)] = min(a, b)
    clusters = {}
    for r in rows:
        clusters.setdefault(find(r[0]), []).append(r)
    out = []
    for rs in clusters.values():
        windows = [[]]
        for r in sorted(rs, key=lambda r: (r[1], r[0])):
            if windows[-1] and sum(len(x[4]) for x in windows[-1]) + len(r[4]) > most:
                windows.append([])
            windows[-1].append(r)
        for w in windows:
            done = resolve(w) if len(w) > 1 else None
            out += done if done is not None else [(r[1], r[2], r[4]) for r in w]
    out.sort(key=lambda g: json.dumps(sorted(g[2]), separators=(",", ":")))
    taken, left = {}, []
    for path, name, members in out:
        if path in taken:
            left.append((path, name, members))
        else:
            taken[path] = (name, members)
    turn = 0
    while left:
        again = []
        for path, name, members in left:
            new = f"{name[:100]}-{digest(members, turn)}"
            to = f"{path.split('/')[0]}/{new}"
            if to in taken or to in existing:
                again.append((path, name, members))
            else:
                taken[to] = (new, members)
        left, turn = again, turn + 1
    return sorted((p, n, sorted(m)) for p, (n, m) in taken.items())


def test_reconciled_against_plain(spark):
    rng = random.Random(14)
    rows = []
    for i in range(150):
        p = f"p{rng.randrange(12)}" if i < 90 else f"q{i}"
        labels = [f"L  {rng.randrange(60)}", " "] if rng.random() < 0.4 else []
        rows.append((i, f"concepts/{p}", p, labels, [f"m{i}-{k}" for k in range(rng.randint(1, 4))]))
    merge = lambda w: [(w[0][1], w[0][2], [m for r in w for m in r[4]])] if len({r[1] for r in w}) == 1 else None

    def merged(df):
        one = df.groupBy("cluster", "window").agg(F.min("path").alias("path"), F.max("path").alias("last"), F.min("name").alias("name"), F.flatten(F.collect_list("members")).alias("members"))
        return one.where("path = last")

    first = plain(rows, 9, merge)
    existing = {p for p, *_ in first if "-" in p.split("/")[1]}
    for pages in (set(), set(sorted(existing)[::2])):
        held = spark.createDataFrame([(p,) for p in sorted(pages)], "path string")
        got = knowledge.reconciled(spark.createDataFrame(rows, KIND).repartition(5), 9, merged, held).collect()
        want = plain(rows, 9, merge, pages)
        assert sorted((r["path"], r["name"], sorted(r["members"])) for r in got) == want
        assert len({r["path"] for r in got}) == len(got)
    assert existing, "some paths collide"


def test_lost_members_are_refused(spark):
    rows = [(1, "a/x", "x", [], ["m"]), (2, "a/x", "x", None, ["n"])]
    df = spark.createDataFrame(rows, KIND)
    with pytest.raises(ValueError, match="member"):
        knowledge.reconciled(df, 9, lambda w: w.groupBy("cluster", "window").agg(F.min("path").alias("path"), F.min("name").alias("name"), F.min("members").alias("members")))
    assert knowledge.reconciled(df.limit(0), 9, lambda w: w).count() == 0
