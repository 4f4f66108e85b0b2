"""Depth, nulls and sizes that earlier caps left out."""

import random

from pyspark.sql import functions as F

from scriptorium.operators import knowledge, sequences, tree, units


def brute_tree(levels):
    """Parent (1-based, 0 for none) and end of each heading by looking at all others."""
    out = []
    for i, x in enumerate(levels):
        above = [j for j in range(i) if levels[j] < x]
        after = [j for j in range(i + 1, len(levels)) if levels[j] <= x]
        out.append((above[-1] + 1 if above else 0, after[0] if after else len(levels)))
    return out


def test_trees_of_any_level(spark):
    rng = random.Random(2)
    docs = {d: [rng.randint(1, 12) for _ in range(rng.randint(1, 40))] for d in range(12)} | {99: list(range(1, 301))}
    rows = [(d, o, f"{x}") for d, levels in docs.items() for o, x in enumerate(levels)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, text string").repartition(5)
    level = F.col("text").cast("int")
    got = {}
    for r in tree.basic_tree(df, level).where("node > 0").collect():
        got.setdefault(r["doc_id"], {})[r["node"]] = (r["parent"], r["end"])
    for d, levels in docs.items():
        assert [got[d][k + 1] for k in range(len(levels))] == brute_tree(levels)
    paths = units.heading_paths(df, level, F.concat(F.lit("t"), "text")).collect()
    for r in paths:
        levels, want = docs[r["doc_id"]], []
        for j in range(r["ord"], -1, -1):
            if not want or levels[j] < levels[want[0]]:
                want.insert(0, j)
        assert r["heading_ords"] == want and r["headings"] == [f"t{levels[j]}" for j in want]


def test_paths_before_the_first_heading(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "# a"), (1, 2, "y"), (None, 0, "# n"), (None, 1, "z")], "doc_id long, ord int, text string")
    level = F.when(F.startswith("text", F.lit("#")), 9)
    got = {(r["doc_id"], r["ord"]): r["heading_ords"] for r in units.heading_paths(df, level, F.col("text")).collect()}
    assert got[1, 0] == [] and got[1, 2] == [1]


def test_preorder_of_a_long_chain_and_odd_parents(spark):
    rng = random.Random(3)
    chain = [(1, i, i - 1 if i else None) for i in range(1000)]
    bushy = [(2, 0, None)] + [(2, i, rng.randrange(i)) for i in range(1, 200)]
    odd = [(3, 0, None), (3, 1, 2), (3, 2, 1), (3, 3, 2), (3, 4, 77), (3, 5, 0), (3, 6, 6)]
    rows = [*chain, *bushy, *odd]
    rng.shuffle(rows)
    got = {(r["doc_id"], r["node"]): (r["depth"], r["place"]) for r in tree.preorder(spark.createDataFrame(rows, "doc_id long, node int, parent int")).collect()}
    assert [got[1, i] for i in range(1000)] == [(i + 1, i + 1) for i in range(1000)]
    kids, order = {}, []
    for _, n, p in bushy:
        kids.setdefault(p, []).append(n)
    todo = [(0, 1)]
    while todo:
        n, depth = todo.pop()
        order.append((n, depth))
        todo += [(k, depth + 1) for k in sorted(kids.get(n, []), reverse=True)]
    assert [got[2, n] for n, _ in order] == [(depth, k) for k, (_, depth) in enumerate(order, 1)]
    assert {n: v for (d, n), v in got.items() if d == 3} == {0: (1, 1), 5: (2, 2)}, "cycles, what hangs on them and unknown parents have no place"
    assert tree.preorder(spark.createDataFrame([], "doc_id long, node int, parent int")).count() == 0


def test_retries_lose_nothing(spark):
    rows = [("a", i) for i in range(40)] + [("b", i) for i in range(7)] + [("c", 0)]
    work = spark.createDataFrame(rows, "batch string, ord long")
    bad = [3, 4, 39]
    done, failed = knowledge.split_retry(work, lambda b: b.groupBy("batch").agg((~F.bool_or(F.col("ord").isin(bad))).alias("ok")))
    name = lambda r: (r["batch"].split("/")[0], r["ord"])
    assert sorted(map(name, failed.collect())) == [("a", 3), ("a", 4), ("a", 39), ("b", 3), ("b", 4)]
    assert sorted(map(name, [*done.collect(), *failed.collect()])) == sorted(rows)


def test_numbers_of_any_order(spark):
    values = ["b", None, "a", "c", None, *["d"] * 50]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k string, i int").repartition(3)
    got = sorted(sequences.numbered(df, "k").collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, len(values) + 1))
    assert [r["k"] for r in got] == ["a", "b", "c", *["d"] * 50, None, None]
    assert sequences.numbered(df.limit(0), "k").count() == 0


def test_results_of_one_key(spark):
    work = spark.createDataFrame([("x",), ("y",)], "t string")
    old = spark.createDataFrame([("x", "r1", 1), ("x", "r0", 2), ("x", None, 3)], "key string, result string, at int")
    assert {r["t"]: r["result"] for r in knowledge.cached(work, old, F.col("t"))[0].collect()} == {"x": "r0", "y": None}
    assert {r["t"]: r["result"] for r in knowledge.cached(work, old.drop("at"), F.col("t"))[0].collect()} == {"x": "r1", "y": None}


def test_first_node_around_a_hit(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 6), (1, 1, 1, 5), (1, 2, 2, 3), (1, 3, 6, 9), (1, 4, 7, 8)], "doc_id long, node int, start int, end int")
    hits = spark.createDataFrame([(1, 2), (1, 5), (1, 7), (1, 9)], "doc_id long, ord int")
    assert sorted(tuple(r)[0:4] for r in knowledge.node_hits(hits, nodes).select("ord", "node", "offset").collect() if r["node"] is not None) == [(2, 0, 2), (5, 0, 5), (7, 3, 1)]
