"""Texts that are empty or missing: the coverage queries against their SQL, and an empty block with and without a unit."""

import duckdb
import pytest

from scriptorium.operators import coverage
from scriptorium.plans import registry

PLAIN = [(1, "ab cd\nefghijkl m\nxx", "en", "s", 19), (2, "a\nlonger line\nb\nc", "fr", "s", 17), (3, "\n", "en", "s", 1), (4, "\n\n\n", None, None, 3)]
EMPTY = [(5, "", "en", "s", 0), (6, "", "fr", "s", 0)]
MISSING = [(7, None, "en", "s", 0), (8, None, "fr", "s", None), (9, None, "en", "s", 7), (10, None, "fr", "s", 500)]


def held_against_sql(spark, at, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    found = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = found.fetchall()
    got = registry.queries()[name](spark, str(at)).select(*names).collect()
    assert want and sorted(repr(tuple(x)) for x in got) == sorted(map(repr, want))


def test_an_empty_block_is_pending_only_without_a_unit(spark):
    docs = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, chars long")
    units = spark.createDataFrame([(1, 0, 0, "verified")], "doc_id long, start long, end long, status string")
    ranges = coverage.coverage_ranges(docs, units)
    assert {tuple(r) for r in ranges.collect()} == {(1, 0, 0, "verified"), (2, 0, 0, "pending")}
    assert {tuple(r) for r in coverage.valid_cover(ranges, docs).collect()} == {(1, True, True), (2, True, False)}


@pytest.mark.parametrize("name", ["coverage_ranges", "coverage_window"])
@pytest.mark.parametrize("odd", [EMPTY, MISSING], ids=["empty", "missing"])
def test_ranges_equal_their_sql(spark, tmp_path, name, odd):
    # Where the stated size is less than what was read, there is no tail.
    held_against_sql(spark, tmp_path, name, PLAIN + odd + [(11, "a\nb\nc", "en", "s", 0), (12, "a\nb\nc", "en", "s", None), (13, "c" * 150, "en", "s", 400)])


@pytest.mark.parametrize("odd", [EMPTY, MISSING, [(11, "a\nb\nc", "en", "s", 0), (12, "a\nb", "en", "s", None), (13, "abc\nbdd\nc", "fr", "s", 3), (14, "abc\n", "fr", "s", 30), (15, "a\nb\nc\nd\nefg", "fr", "s", 4)]], ids=["empty", "missing", "sizes"])
def test_valid_covers_equal_their_sql(spark, tmp_path, odd):
    held_against_sql(spark, tmp_path, "coverage_valid", PLAIN + odd)


@pytest.mark.parametrize("odd", [EMPTY, MISSING], ids=["empty", "missing"])
def test_issues_equal_their_sql(spark, tmp_path, odd):
    held_against_sql(spark, tmp_path, "omission_issues", PLAIN + odd + [(11, "a\n\nb", "en", "s", 0)])
