"""Exact copies, fill-in-middle forms and whitening against brute force, edge cases included."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import exact_dedup, fill_middle, queries, whitening

DATA = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.queries()[name](spark, DATA)
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(got.columns)
    mine = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert mine == sorted(res.fetchall(), key=repr) and mine


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_fill_in_middle"])
def test_queries_equal_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    same_rows(spark, name)


def text_rows():
    rng = random.Random(5)
    long = "Aß<日" * 40_000
    start = "same start " * 20
    texts = [None, "", "", " ", "Ab", "aB", "ab", "ÄB", "äb", "Äb", "K", "k", "K", long, long.lower().replace("ß", "ß"), long + "x", start + "a", start + "A", start + "b", start + "c"]
    texts += [rng.choice(["one TWO", "One two", "two one", "", None, "x" * 63 + "y", "X" * 63 + "Y", "x" * 63 + "z"]) for _ in range(200)]
    rows = [(i - 3, t, "s", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "ab", "s", "clash"), (None, "only here", None, None), (None, "only here", None, None), (None, None, None, None)]


def test_exact_groups_against_brute_force(spark):
    rows = text_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, kept string").repartition(7)
    got = exact_dedup.exact_groups(docs, carry=["text", "kept"]).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    for r in got:
        ids = groups[low(r["carried"]["text"])]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        assert not r["kept"] or r["id"] == best
        assert r["digest"] is None or bytes(r["digest"]) == hashlib.sha256(low(r["carried"]["text"]).encode()).digest()
    kept = [low(r["carried"]["text"]) for r in got if r["kept"]]
    assert sorted(kept) == sorted(groups), "exactly one row of each group stays"
    assert {low(r["carried"]["text"]) for r in got if r["digest"] is not None} >= {t for t, ids in groups.items() if len(ids) > 1}
    few = sum(r["digest"] is not None for r in got)
    assert few < len(rows), "texts told apart by length or start are not hashed whole"


def test_exact_groups_with_one_slot_and_empty_tables(spark):
    """With one slot every row stays open to the last level; the groups are the same."""
    rows = text_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string")
    key = lambda r: (repr(r["id"]), r["keep_id"], r["group_size"])
    one = sorted(map(key, exact_dedup.exact_groups(docs, slots=1).collect()), key=repr)
    assert one == sorted(map(key, exact_dedup.exact_groups(docs).collect()), key=repr)
    none = docs.limit(0)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.deduplicated(none).columns == docs.columns
    assert fill_middle.fill_in_middle(none).count() == 0
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and stay.count() == len({low(t) for _, t, *_ in rows})


def test_elias_fano_codes():
    rng = random.Random(1)
    for text in ["", "a", "ab c", "日本 x", "a" * 5000, "." * 5000, *["".join(rng.choice("ab ß.") for _ in range(rng.randint(1, 300))) for _ in range(60)]]:
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
        want = [0]
        for u in units:
            want.append(want[-1] + len(u))
        bounds = fill_middle.unit_bounds(np.frombuffer(text.encode(), np.uint8))
        assert bounds.tolist() == want
        assert fill_middle.select(fill_middle.encode(bounds), list(range(len(want)))) == want


def brute_form(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, text, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, text, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, text, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("slots", [1, 1 << 10])
def test_forms_against_brute_force(spark, slots):
    """With one slot every text goes through the shared index."""
    rows = [*text_rows(), (900, "has <P> mark", None, None), (901, "<<S", None, None), *[(1000 + i, "P>a<P" * (i % 7) + ">", None, None) for i in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, units string").repartition(5)
    made = fill_middle.fill_in_middle(docs, slots=slots)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in got)
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted((brute_form(i, t) for i, t, *_ in rows), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def brute_whitening(vectors):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted({tuple(v) for v in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    y = ((fit * n - sums) / n).astype(float)
    e, axes = np.linalg.eigh(y.T @ y / n)
    t = np.array(x, object) * n - sums
    return n, (t**2).sum(axis=1), (t / n).astype(float), e[::-1], axes[:, ::-1]


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 8, 33):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        want = np.sort(10.0 ** rng.uniform(-6, 3, d))[::-1]
        values, axes = whitening.jacobi((m := q * want @ q.T) / 2 + m.T / 2)
        assert np.allclose(values, want, rtol=1e-6, atol=1e-12) and np.allclose(axes.T @ axes, np.eye(d), atol=1e-12)
        assert np.allclose(axes * values @ axes.T, m, atol=1e-9)
    assert whitening.jacobi(np.diag([1.0, 3.0, 2.0]))[0].tolist() == [3.0, 2.0, 1.0]
    scaled = np.diag([1e8, 1.0, 1e-8]) @ np.array([[1, 0.1, 0.2], [0.1, 1, 0.3], [0.2, 0.3, 1]]) @ np.diag([1e8, 1.0, 1e-8])
    values, _ = whitening.jacobi(scaled)
    assert np.isclose(np.prod(values / [1e16, 1.0, 1e-16]), np.linalg.det(np.array([[1, 0.1, 0.2], [0.1, 1, 0.3], [0.2, 0.3, 1]])), rtol=1e-10), "graded matrices keep small eigenvalues to full precision"


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 0.1).round(3).tolist()
    rows = [(i, v, 1.0) for i, v in enumerate([*vectors, *vectors[:40], *[vectors[0]] * 100])]
    bad = [(900, None, 1.0), (901, [None] + vectors[0][1:], 1.0), (902, [float("nan")] + vectors[0][1:], 1.0), (903, [float("inf")] + vectors[0][1:], 1.0), (904, [1.0], 1.0), (905, [], 1.0)]
    repeated = [(None, vectors[3], 1.0), rows[5]]
    table = spark.createDataFrame([*rows, *bad, *repeated], "vec_id long, embedding array<double>, whitened double").repartition(6)
    got = whitening.whiten(table).collect()
    good = [*rows, *repeated]
    assert len(got) == len(good)
    n, deviation, y, e, axes = brute_whitening([v for _, v, _ in good])
    want = {i: (int(s), v @ axes[:, :16] / np.sqrt(e[:16])) for (i, _, _), s, v in zip(good, deviation, y, strict=True)}
    signs = None
    for r in got:
        s, w = want[r["id"]]
        signs = np.sign(np.array(r["whitened"]) * w) if signs is None and np.abs(w).min() > 1e-3 else signs
        assert r["n"] == n and r["deviation"] == s and np.allclose(np.abs(r["whitened"]), np.abs(w), atol=1e-7)
        assert np.allclose(r["explained"], e[:16] / e.sum(), rtol=1e-9) and r["identity_error"] < 1e-9
    assert all(np.allclose(np.array(r["whitened"]), want[r["id"]][1] * signs, atol=1e-7) for r in got), "one sign a component for all rows"


def test_whitening_of_few_and_odd_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, []), (3, [None])])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, [None, None], [0.0, 0.0], None)] * 2
    flat = whitening.whiten(frame([(1, [0.0, 5.0]), (2, [1.0, 5.0])])).collect()
    assert sorted(round(r["whitened"][0], 9) for r in flat) == [-1.0, 1.0] and all(r["whitened"][1] is None and r["explained"] == [1.0, 0.0] for r in flat)
    huge = whitening.whiten(frame([(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert {r["id"]: r["deviation"] for r in huge}[3] is not None and {r["id"]: r["deviation"] for r in huge}[1] is None


def test_whitening_query_over_the_table(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    good = {i: v for i, v in vectors.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    n, deviation, y, e, axes = brute_whitening(list(good.values()))
    got = queries.op12_whitening(spark, DATA).toPandas().sort_values(["vec_id", "component"])
    assert got.groupby("vec_id").size().to_dict() == {i: min(16, len(e)) for i in good}
    place = {i: k for k, i in enumerate(good)}
    w = y @ axes[:, :16] / np.sqrt(e[:16])
    for r in got.itertuples():
        k, c = place[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == deviation[k] and abs(abs(r.whitened) - abs(w[k, c])) < 1e-6 and abs(r.explained / (e[c] / e.sum()) - 1) < 1e-6
    assert got["identity_error"].max() < 1e-8
