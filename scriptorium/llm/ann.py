"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

A graph of each vector's nearest known vectors starts from leaves of random
hyperplane trees and is improved in rounds: around each vector its neighbours
and the vectors that name it are compared with one another (a Spark join of
neighbours of neighbours), and each keeps its best.  A query then walks the
graph greedily from its own place with a beam.  Graph and walk use coarse
8-bit copies of the vectors; the scores of what was found are exact.

Equal vectors form one node, so a vector that fills a third of the table is one
place in the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Neighbours each vector keeps, and how many vectors that name it join a round.
NEIGHBOURS = 40
BACK = 24
TREES = 20
LEAF = 256
LEAF_NEIGHBOURS = 16
ROUNDS = 7
#: The descent ends once less than this share of all neighbours changes in a round.
DELTA = 0.01
#: Of the walk: candidates kept, places left at once, steps.
POOL = 96
BEAM = 32
STEPS = 4


def _pack(x: np.ndarray) -> list[bytes]:
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    scale = np.where(scale > 0, scale, 1).astype(np.float32)
    codes = np.rint(x / scale).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, codes, strict=True)]


def _unpack(column: pa.Array) -> np.ndarray:
    """Rows of codes of one width to a float matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def _groups(batches, key: str):
    """Whole groups of rows sorted by ``key``, as record batches that hold several groups each."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
        if cut:
            yield table.slice(0, cut).to_batches()[0]
        rest = table.slice(cut).combine_chunks().to_batches()[0]
    if rest is not None:
        yield rest


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _leaf_edges(k: int):
    def run(batches):
        for batch in _groups(batches, "leaf"):
            leaf, node, x = batch.column("leaf").to_numpy(), batch.column("node").to_numpy(), _unpack(batch.column("code"))
            ones, twos, sims = [], [], []
            for a, b in _bounds(leaf):
                if b - a < 2:
                    continue
                s = x[a:b] @ x[a:b].T
                np.fill_diagonal(s, -np.inf)
                m = min(k, b - a - 1)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                ones.append(np.repeat(node[a:b], m))
                twos.append(node[a:b][top].ravel())
                sims.append(np.take_along_axis(s, top, 1).ravel())
            if ones:
                yield pa.record_batch([pa.array(np.concatenate(ones)), pa.array(np.concatenate(twos)), pa.array(np.concatenate(sims).astype(np.float32))], names=["node", "nbr", "sim"])

    return run


def _compare(batches):
    """Around each centre: pairs of members, one of them new, that would better either's list."""
    for batch in _groups(batches, "c"):
        c, m, fresh, least, x = (batch.column(n).to_numpy(zero_copy_only=False) if n != "code" else _unpack(batch.column(n)) for n in ("c", "m", "fresh", "least", "code"))
        ones, twos, sims = [], [], []
        for a, b in _bounds(c):
            f = fresh[a:b]
            if b - a < 2 or not f.any():
                continue
            s = x[a:b] @ x[a:b].T
            ok = (f[:, None] | f[None, :]) & (s > least[a:b, None])
            np.fill_diagonal(ok, False)
            i, j = np.nonzero(ok)
            ones.append(m[a:b][i])
            twos.append(m[a:b][j])
            sims.append(s[i, j])
        if ones:
            yield pa.record_batch([pa.array(np.concatenate(ones)), pa.array(np.concatenate(twos)), pa.array(np.concatenate(sims).astype(np.float32))], names=["node", "nbr", "sim"])


def _top(edges: DataFrame, key: str, k: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc("sim"), "nbr")
    return edges.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place")


def build_graph(nodes: DataFrame, dimensions: int, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """``(node, nbr, sim)``: near neighbours of each row of ``nodes(node, code)``, by NN-descent."""
    spark = nodes.sparkSession
    width = partitions(spark)
    total = nodes.count()
    bits = max(0, round(np.log2(max(1, total) / LEAF)))
    planes = np.random.default_rng(seed).standard_normal((TREES, bits, dimensions)).astype(np.float32) if bits else None

    def leaves(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpack(batch.column("code"))
            for t in range(TREES if bits else 1):
                code = np.full(len(x), t, np.int64)
                for i in range(bits):
                    code = code * 2 + (x @ planes[t, i] > 0)
                yield pa.record_batch([pa.array(code + (t << 40)), batch.column("node"), batch.column("code")], names=["leaf", "node", "code"])

    placed = nodes.mapInArrow(leaves, "leaf long, node long, code binary")
    # An uneven leaf is cut into blocks of about LEAF.
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("node", "leaf"), F.greatest(F.lit(1), F.round(F.col("n") / LEAF).cast("long")))
    placed = placed.join(sizes, "leaf").select(F.xxhash64("leaf", block).alias("leaf"), "node", "code")
    first = placed.repartition(width, "leaf").sortWithinPartitions("leaf").mapInArrow(_leaf_edges(LEAF_NEIGHBOURS if bits else k), "node long, nbr long, sim float")
    edges = materialize(_top(first.groupBy("node", "nbr").agg(F.max("sim").alias("sim")), "node", k).withColumn("fresh", F.lit(True)), "graph")
    for turn in range(rounds):
        least = edges.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(float("-inf")).cast("float")).alias("least"))
        back = edges.select(F.col("nbr").alias("c"), F.col("node").alias("m"), "fresh")
        back = back.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("fresh"), F.xxhash64("m", F.lit(turn))))).where(F.col("place") <= BACK).drop("place")
        around = edges.select(F.col("node").alias("c"), F.col("nbr").alias("m"), "fresh").unionByName(back).groupBy("c", "m").agg(F.max("fresh").alias("fresh"))
        known = nodes.join(least, "node", "left").select(F.col("node").alias("m"), "code", F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"))
        found = around.join(known, "m").select("c", "m", "fresh", "least", "code").repartition(width, "c").sortWithinPartitions("c").mapInArrow(_compare, "node long, nbr long, sim float")
        merged = edges.select("node", "nbr", "sim", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True))).groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        edges = materialize(_top(merged, "node", k), "graph")
        spark.sparkContext._jvm.System.gc()  # lets go of the last round's shuffle files
        if edges.where("fresh").count() <= DELTA * total * k:
            break
    return edges.select("node", "nbr", "sim")


def _score_codes(batches):
    """Rows of a query: its own code first (place 0), then candidates."""
    for batch in _groups(batches, "q"):
        q, nbr, own, x = batch.column("q").to_numpy(), batch.column("nbr").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), _unpack(batch.column("code"))
        sims = np.empty(len(q), np.float32)
        for a, b in _bounds(q):
            sims[a:b] = x[a:b] @ x[a]
        keep = np.flatnonzero(~own.astype(bool))
        if len(keep):
            yield pa.record_batch([pa.array(q[keep]), pa.array(nbr[keep]), pa.array(sims[keep])], names=["q", "nbr", "sim"])


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, pool: int = POOL, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """``(q, nbr, sim)``: for each node in ``queries(q)`` the best nodes of a greedy walk from its own place."""
    width = partitions(nodes.sparkSession)
    edges = materialize(graph.select("node", "nbr").unionByName(_top(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim"), "node", NEIGHBOURS).select("node", "nbr")).distinct(), "adjacent")
    coded = nodes.select(F.col("node").alias("nbr"), "code")
    own = queries.join(nodes, queries.q == nodes.node).select("q", F.col("q").alias("nbr"), F.lit(True).alias("own"), "code")
    held = materialize(queries.join(graph, queries.q == graph.node).select("q", "nbr", "sim", F.lit(False).alias("left")), "pool")
    for _ in range(steps):
        turn = _top(held.where("not left"), "q", beam).select("q", F.col("nbr").alias("at"))
        reached = turn.join(edges.select(F.col("node").alias("at"), "nbr"), "at").select("q", "nbr").where("q != nbr").distinct()
        reached = reached.join(held.select("q", "nbr"), ["q", "nbr"], "left_anti").join(coded, "nbr").select("q", "nbr", F.lit(False).alias("own"), "code")
        scored = own.unionByName(reached).repartition(width, "q").sortWithinPartitions("q", F.desc("own")).mapInArrow(_score_codes, "q long, nbr long, sim float")
        gone = turn.select("q", F.col("at").alias("nbr"), F.lit(True).alias("now"))
        old = held.join(gone, ["q", "nbr"], "left").select("q", "nbr", "sim", (F.col("left") | F.coalesce("now", F.lit(False))).alias("left"))
        held = materialize(_top(old.unionByName(scored.withColumn("left", F.lit(False))), "q", pool), "pool")
    return held.select("q", "nbr", "sim")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` near rows of each query row.

    ``is_query`` is a condition on the column ``vec_id``.  Candidates are all
    rows but the query's own; the score is the inner product of the original
    vectors in double precision, ties go to the smaller id.  Rows with a null id
    and vectors that are null, empty, zero, or hold null or non-finite
    components take no part; neither do vectors of another length than most
    (the more frequent length; ties: the longer).  An id that repeats counts
    once for each different vector.  A table without usable vectors gives an
    empty result.  Only the two named columns are read.
    """
    spark = vectors.sparkSession
    width = partitions(spark)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    raw = raw.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = raw.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes[0]["d"]
    rows = raw.where(F.size("v") == d).withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.reverse("v")).alias("b"))).withColumn("asks", is_query)
    # Of each group of equal vectors the k + 1 smallest ids can be among a result's first k.
    firsts = rows.select("h", "vec_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    nodes = rows.groupBy("h").agg(F.min("vec_id").alias("node"), F.min_by("v", "vec_id").alias("v"), F.max(F.col("asks").cast("int")).alias("asks"))
    # The least id of a group may repeat in another one, so nodes are numbered.
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(-1, d)
                yield pa.record_batch([batch.column("node"), pa.array(_pack(x), pa.binary())], names=["node", "code"])

    coded = materialize(nodes.select("node", "v").mapInArrow(encode, "node long, code binary"), "codes")
    graph = build_graph(coded, d)
    asked = nodes.where("asks = 1").select(F.col("node").alias("q"))
    found = search_graph(coded, graph, asked).select("q", "nbr").unionByName(asked.select("q", F.col("q").alias("nbr")))

    left = nodes.select(F.col("node").alias("q"), F.col("v").alias("vq"))
    right = nodes.select(F.col("node").alias("nbr"), F.col("v").alias("vn"))

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).flatten().to_numpy().reshape(-1, d) for c in ("vq", "vn"))
                yield pa.record_batch([batch.column("q"), batch.column("nbr"), pa.array(np.einsum("ij,ij->i", a, b))], names=["q", "nbr", "score"])

    scored = found.join(left, "q").join(right, "nbr").select("q", "nbr", "vq", "vn").mapInArrow(exact, "q long, nbr long, score double")
    ids = nodes.select("node", "h").join(firsts.select("h", "vec_id", "place"), "h").select(F.col("node").alias("nbr"), "vec_id", "place")
    # A query takes the first k + 1 ids over its nodes in order of score; the ids of the best nodes suffice.
    listed = scored.join(ids, "nbr").select("q", "vec_id", "score")
    short = listed.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1).drop("place")
    askers = rows.where("asks").select("h", F.col("vec_id").alias("query_id")).distinct().join(nodes.select("h", F.col("node").alias("q")), "h").select("q", "query_id")
    pairs = askers.join(short, "q").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
