"""Windows with unknowns and open issues, against plain loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from scriptorium.operators import coverage, issues
from scriptorium.plans import registry

RANGES = "doc_id long, start long, end long, status string, extra int"


def plain_window(doc, start, end, ranges):
    start = 0 if start is None else start
    if end is None or end <= start:
        return "unknown", None, None, None
    n = dict.fromkeys(coverage.STATUSES, 0)
    for d, s, e, status, _ in ranges:
        if d == doc and d is not None and status in n and s is not None and e is not None:
            n[status] += max(0, min(e, end) - max(s, start))
    open_ = end - start - sum(n.values())
    return "unknown" if open_ else "pending" if n["pending"] else "complete", *n.values()


def test_known_windows_against_a_loop(spark):
    r = random.Random(3)
    near = lambda: r.choice([0, 5, 4095, 4096, 4097, 9000]) + r.randrange(40)
    ranges = [(r.choice([1, 2, None]), near(), near(), r.choice([*coverage.STATUSES, "other", None]), 1) for _ in range(150)]
    ranges += [(3, 0, 10, "verified", 1), (3, 10, 20, "pending", 1), (3, 20, 30, "no_facts", 1), (3, None, 4, "verified", 1)]
    windows = [(r.choice([1, 2, None]), near(), near()) for _ in range(80)]
    windows += [(3, 0, 30), (3, 0, 10), (3, 0, 10), (3, 0, 31), (3, None, 10), (3, 4, None), (3, 4, 4), (4, 0, 5)]
    got = coverage.known_windows(spark.createDataFrame(ranges, RANGES), spark.createDataFrame(windows, "doc_id long, start long, end long"))
    rows = [(x.doc_id, x.start, x.end, x.status, x.verified, x.no_facts, x.pending) for x in got.collect()]
    want = [(d, s or 0, e, *plain_window(d, s, e, ranges)) for d, s, e in windows]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    by = {(x.start, x.end): (x.status, x.unknown) for x in got.where("doc_id = 3").collect()}
    assert by[0, 30] == ("pending", 0) and by[0, 10] == ("complete", 0) and by[0, 31] == ("unknown", 1) and by[4, 4][0] == "unknown"


def test_a_long_document_and_no_ranges(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 7).alias("end"), F.when(F.col("id") % 2 == 0, "verified").otherwise("no_facts").alias("status"))
    whole = coverage.known_windows(lines, lines.select("doc_id", "start", (F.col("start") + 70).alias("end")))
    found = {x.status: (x.n, x.v) for x in whole.groupBy("status").agg(F.count("*").alias("n"), F.sum("verified").alias("v")).collect()}
    assert found["complete"] == (n - 9, (n - 9) * 35) and found["unknown"][0] == 9
    none = coverage.known_windows(lines.limit(0), lines.limit(2).select("doc_id", "start", "end")).collect()
    assert [(x.status, x.unknown) for x in none] == [("unknown", 7)] * 2
    both = coverage.overlaps(lines, lines.select("doc_id", (F.col("start") + 3).alias("start"), (F.col("end") + 3).alias("end"), F.lit(1).alias("k")), ["doc_id"])
    assert both.count() == 2 * n - 1 and both.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == 7 * n - 3


def plain_issues(pending, omissions, topics, members):
    out = []
    linked = set()
    for source, stage, reason, item in sorted(set(omissions), key=repr):
        spans = set()
        for d, b, s, e, _ in pending:
            if d != source or source is None:
                continue
            if stage == "facts" and b == item:
                spans.add((b, s, e))
            named = {t for m, target, t in members if m == source and target == item} if stage == "generation" else None
            for td, t, key, tb, ts, te in topics:
                if td == source and tb == b and (t in named if named is not None else key == item) and max(s, ts) < min(e, te):
                    spans.add((b, max(s, ts), min(e, te)))
        linked |= {(source, *x) for x in spans}
        out += [(source, reason, stage, item, *x) for x in spans or [(None, None, None)]]
    return out + [(d, why, "", "", b, s, e) for d, b, s, e, why in set(pending) if (d, b, s, e) not in linked]


def test_source_issues_against_a_loop(spark):
    r = random.Random(8)
    pending = [(d, str(b), at * 3000, at * 3000 + r.randrange(1, 2900), "later") for d in (1, 2) for b in (0, 1) for at in range(6) if r.random() < 0.7]
    topics = [(r.randrange(1, 4), t := r.choice("abcd"), "#" + t, str(r.randrange(2)), s := r.randrange(15000), s + r.choice([0, 5, 4096, 12000])) for _ in range(60)]
    members = [(1, "concepts/x", "a"), (1, "concepts/x", "b"), (2, "concepts/x", "c"), (1, "concepts/x", "a")]
    omissions = [(1, "planning", "no_path", "#a"), (1, "planning", "no_path", "#a"), (1, "facts", "no_room", "1"), (2, "generation", "no_page", "concepts/x"), (1, "generation", "no_page", "concepts/x"), (2, "planning", "no_path", "#z"), (3, "planning", "no_path", "#b"), (None, "facts", "no_room", "0"), (2, "facts", "no_room", None), (1, "generation", "no_page", "#a")]
    shapes = "source_id long, block string, start long, end long, reason string", "source_id long, stage string, reason string, item string", "source_id long, topic string, topic_id string, block string, start long, end long", "source_id long, target string, topic string"
    tables = [spark.createDataFrame(x, y) for x, y in zip((pending, omissions, topics, members), shapes, strict=True)]
    got = sorted(repr(tuple(x)) for x in issues.source_issues(*tables).collect())
    assert got == sorted(map(repr, plain_issues(pending, omissions, topics, members)))
    assets = spark.createDataFrame([(1, "i1", "0", 9, "pending", "pending"), (1, "i2", "1", 8, "available", "pending"), (1, "i3", "1", 8, "available", "available")], "source_id long, asset string, block string, chars long, transcription string, understanding string")
    faults = spark.createDataFrame([(1, None), (2, "garbled")], "source_id long, reason string")
    more = [tuple(x) for x in issues.source_issues(*[t.limit(0) for t in tables], assets, faults).collect()]
    assert sorted(more, key=repr) == sorted([(1, "image_content_requires_ocr", "parsing", "i1", "0", 0, 9), (1, "image_understanding_pending", "parsing", "i2", "1", 0, 8), (1, "quality_incomplete", "parsing", "", None, None, None), (2, "garbled", "parsing", "", None, None, None)], key=repr)


@pytest.mark.parametrize("name", ["coverage_known", "omission_issues"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = found.fetchall()
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert len(want) > 100 and sorted(repr(tuple(x)) for x in got.select(*names).collect()) == sorted(map(repr, want))
