"""Exact top-k inner products by block-at-a-time pruning.

Vector components are terms with whole weights. Rows are put into an order in which similar vectors stand together (nearest
of some pivots, fitted on a bounded sample; the order only decides how much is pruned), cut into groups of ranges and those
into blocks. Each block keeps a forward index (a matrix of weights) and the largest and smallest weight of every term, and
so does each group. The sum over a query's terms of weight times that maximum (minimum, for negative weights) bounds every
score in a range.

A query visits groups in the order of their bounds, in waves: first the best, then four, sixteen and so on, as long as a
bound reaches its k-th score so far (at equal scores: as long as a smaller id is there). Inside a group its blocks are taken
the same way, and scored as matrix products of the queries that still want the block. What is never visited cannot matter,
so results are exact. Queries meet a group in batches of bounded size; only scalars, a bounded sample and nothing of the rows
reach the driver.

Weights are ``floor(scale * x)``; weights and scores beyond a long are its limits (equal then, so the smaller id is first). Vectors
that are NULL or hold NULL, NaN or infinite components, and rows without an id, take no part. Vectors of different
lengths are compared over the terms both have; an empty one scores 0. Rows that repeat an id are rows of their own: each
is a candidate for the others. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.session import cut

K, SCALE, EVERY = 20, 64, 20
GROUP, BLOCK, QUERIES = 4096, 256, 2048
#: Bytes of a matrix of vectors in one task.
BYTES = 32 << 20
#: Group bounds a query is compared with at once.
SUMMARIES = 4096
SAMPLE, PIVOTS, ROUNDS = 2048, 64, 6
WAVES = 4
SEED = 42
LOWEST = -(1 << 63)


def weighted(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(u, id, v): whole weights; ``u`` numbers the rows."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"))
    held = held.where(F.col("id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad))
    return cut(held.select(F.monotonically_increasing_id().alias("u"), "id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v")))


def matrix(rows: list, dims: int | None = None) -> np.ndarray:
    dims = max(map(len, rows), default=0) if dims is None else dims
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: as doubles where these are exact, else as longs, else as Python's integers."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * n
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T if most < 2**62 else a.astype(object) @ b.astype(object).T


def saturated(x: np.ndarray) -> np.ndarray:
    return np.clip(x, LOWEST, -LOWEST - 1).astype(np.int64) if x.dtype == object else x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return saturated(exact(a, b))


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Summed term maxima: no vector of a range scores more with a query."""
    return saturated(exact(np.maximum(queries, 0), most) + exact(np.minimum(queries, 0), least))


def pivots(held: DataFrame, n: int) -> np.ndarray:
    """Means of groups of similar vectors, from at most ``SAMPLE`` rows with the smallest hashes."""
    rows = held.orderBy(F.xxhash64("u"), "u").limit(SAMPLE).select("v").collect()
    x = matrix([r["v"] for r in rows]).astype(float)
    if not len(x):
        return x
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, c)[0]
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c[np.lexsort(c.T[::-1])] if c.shape[1] else c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


BLOCKS = "g int, b int, ids binary, us binary, w binary, dims int, most array<long>, least array<long>"


def indexed(held: DataFrame, group: int, block: int) -> DataFrame:
    """``BLOCKS``: the forward index of each block, written once."""
    n = held.count()
    centres = pivots(held, PIVOTS)

    def keyed(batches):
        for b in batches:
            v = b.column(2).to_pylist()
            x = matrix([r[: centres.shape[1]] for r in v], centres.shape[1])
            p, d = nearest(x.astype(float), centres)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p, pa.int32()), pa.array(d)], names=["u", "id", "v", "p", "d"])

    near = held.mapInArrow(keyed, "u long, id long, v array<long>, p int, d double")
    ranged = near.repartitionByRange(max(1, -(-n // group)), "p", "d", "id", "u").sortWithinPartitions("p", "d", "id", "u")
    ranged = ranged.select("u", "id", "v", F.spark_partition_id().alias("g"))

    def blocked(batches):
        u, ids, v, at = [], [], [], 0

        def made(g: int) -> pa.RecordBatch:
            w = matrix(v)
            cols = [[g], [at], [np.array(ids, "<i8").tobytes()], [np.array(u, "<i8").tobytes()], [w.astype("<i8").tobytes()], [w.shape[1]], [w.max(axis=0).tolist()], [w.min(axis=0).tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        g = None
        for b in batches:
            for x, i, w, g in zip(*[b.column(c).to_pylist() for c in range(4)]):  # noqa: B007
                u.append(x), ids.append(i), v.append(w)
                if len(u) == block:
                    yield made(g)
                    u, ids, v, at = [], [], [], at + 1
        if u:
            yield made(g)

    return cut(ranged.mapInArrow(blocked, BLOCKS))


def summaries(blocks: DataFrame) -> DataFrame:
    """(chunk, g, most, least, first): per group its term maxima and minima and its smallest id."""

    def merged(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        dims = max(r["dims"] for r in rows)
        # blocks that lack a term hold vectors that weigh 0 there
        most, least = matrix([r["most"] for r in rows], dims).max(axis=0), matrix([r["least"] for r in rows], dims).min(axis=0)
        first = min(int(np.frombuffer(r["ids"], "<i8").min()) for r in rows)
        return pa.table({"chunk": pa.array([rows[0]["g"] // SUMMARIES], pa.int32()), "g": pa.array([rows[0]["g"]], pa.int32()), "most": pa.array([most.tolist()], pa.list_(pa.int64())), "least": pa.array([least.tolist()], pa.list_(pa.int64())), "first": pa.array([first], pa.int64())})

    return cut(blocks.select("g", "ids", "dims", "most", "least").groupBy("g").applyInArrow(merged, "chunk int, g int, most array<long>, least array<long>, first long"))


def meet(asked: DataFrame, table: DataFrame, key: str, batch: int, scored: Callable, kinds: str) -> DataFrame:
    """``scored`` on every (batch of queries, rows of ``table`` under the same key)."""
    batches = asked.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("batches"))
    batches = cut(batches)
    left = asked.join(batches, key).withColumn("batch", F.pmod(F.xxhash64("q"), F.col("batches")).cast("int")).drop("batches")
    right = table.join(batches, key).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")
    return left.groupBy(key, "batch").cogroup(right.groupBy(key, "batch")).applyInArrow(scored, kinds)


FOUND = "q long, id long, score long"


def empty(kinds: str) -> pa.Table:
    of = {"long": pa.int64(), "int": pa.int32()}
    return pa.Table.from_arrays([pa.array([], of[f.split()[1]]) for f in kinds.split(", ")], names=[f.split()[0] for f in kinds.split(", ")])


def reaches(bound: np.ndarray, first: np.ndarray, score: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Could a range with this bound and smallest id hold something better than the k-th found so far?"""
    return (bound > score) | ((bound == score) & (first < id_))


def in_group(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Score a batch of queries (q, v, score, id: what the k-th has so far) against one group."""

    def scored(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not len(asked) or not len(table):
            return empty(FOUND)
        q = asked.column("q").to_numpy()
        queries = matrix(asked.column("v").to_pylist())
        kth, kth_id = asked.column("score").to_numpy().copy(), asked.column("id").to_numpy().copy()
        rows = sorted(table.to_pylist(), key=lambda r: r["b"])
        upper = bounds(queries, matrix([r["most"] for r in rows]), matrix([r["least"] for r in rows]))
        ids = [np.frombuffer(r["ids"], "<i8") for r in rows]
        us = [np.frombuffer(r["us"], "<i8") for r in rows]
        first = np.array([i.min() for i in ids])
        top = np.full((len(q), k), LOWEST)
        top_id = np.full((len(q), k), np.iinfo(np.int64).max)
        held = np.zeros((len(q), k), bool)
        order = np.argsort(~upper, axis=1, kind="stable")
        for step in range(len(rows)):
            block = order[:, step]
            bound = upper[np.arange(len(q)), block]
            if (bound < kth).all():  # at equal bounds a later block may hold smaller ids
                break
            want = reaches(bound, first[block], kth, kth_id)
            for b in np.unique(block[want]):
                at = np.flatnonzero(want & (block == b))
                w = np.frombuffer(rows[b]["w"], "<i8").reshape(len(ids[b]), rows[b]["dims"])
                got = product(queries[at], w)
                good = reaches(got, ids[b][None, :], kth[at][:, None], kth_id[at][:, None]) & (us[b][None, :] != q[at][:, None])
                some = good.any(axis=1)
                at, got, good = at[some], got[some], good[some]
                if not len(at):
                    continue
                score = np.concatenate([top[at], np.where(good, got, LOWEST)], axis=1)
                id_ = np.concatenate([top_id[at], np.where(good, ids[b][None, :], np.iinfo(np.int64).max)], axis=1)
                real = np.concatenate([held[at], good], axis=1)
                best = np.lexsort((id_, ~score, ~real), axis=1)[:, :k]
                top[at], top_id[at], held[at] = (np.take_along_axis(x, best, axis=1) for x in (score, id_, real))
                full = held[at, k - 1]
                better = full & ((top[at, k - 1] > kth[at]) | ((top[at, k - 1] == kth[at]) & (top_id[at, k - 1] < kth_id[at])))
                kth[at[better]], kth_id[at[better]] = top[at[better], k - 1], top_id[at[better], k - 1]
        return pa.table({"q": pa.array(np.broadcast_to(q[:, None], held.shape)[held]), "id": pa.array(top_id[held]), "score": pa.array(top[held])})

    return scored


def worth(n: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(q, g, bound, place): the groups that still can matter to a query, the best first; the ``n`` best of a chunk, or all."""

    def listed(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not len(asked) or not len(table):
            return empty("q long, g int, bound long")
        q, g = asked.column("q").to_numpy(), table.column("g").to_numpy()
        upper = bounds(matrix(asked.column("v").to_pylist()), matrix(table.column("most").to_pylist()), matrix(table.column("least").to_pylist()))
        want = reaches(upper, table.column("first").to_numpy()[None, :], asked.column("score").to_numpy()[:, None], asked.column("id").to_numpy()[:, None])
        if n is not None:
            place = np.argsort(np.argsort(~upper, axis=1, kind="stable"), axis=1)
            want &= place < n
        row, col = np.nonzero(want)
        return pa.table({"q": pa.array(q[row]), "g": pa.array(g[col], pa.int32()), "bound": pa.array(upper[row, col])})

    return listed


def kept(found: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rank): the k best of each query."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    return cut(found.withColumn("rank", rank).where(F.col("rank") <= k))


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k best other rows for every row that ``is_query`` (a condition on ``id``) picks."""
    held = weighted(rows, key, vector, scale)
    dims = held.agg(F.max(F.size("v")).alias("d")).first()["d"] or 1
    fits = max(1, BYTES // (8 * max(dims, 1)))
    blocks = indexed(held, min(group, fits), min(block, fits))
    groups = summaries(blocks)
    chunks = (groups.agg(F.max("g").alias("g")).first()["g"] or 0) // SUMMARIES + 1
    batch = min(QUERIES, fits)
    lowest = {"score": F.lit(LOWEST).cast("long"), "id": F.lit((1 << 63) - 1).cast("long")}
    queries = cut(held.where(is_query).select(F.col("u").alias("q"), F.col("id").alias("query_id"), "v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    # the first wave: the one group with the largest bound
    listed = meet(queries.select("q", "v", *[c.alias(n) for n, c in lowest.items()], every), groups, "chunk", batch, worth(1), "q long, g int, bound long")
    first = cut(listed.groupBy("q").agg(F.max_by("g", F.struct("bound", "g")).alias("g")))
    tops = kept(meet(first.join(queries.select("q", "v"), "q").withColumns(lowest), blocks, "g", batch, in_group(k), FOUND), k)
    # what else can matter, in the order of the bounds
    last = lambda found: found.groupBy("q").agg(F.max(F.when(F.col("rank") == k, F.struct("score", "id"))).alias("last"))
    known = lambda found: queries.select("q", "v").join(last(found), "q", "left").select("q", "v", F.coalesce("last.score", lowest["score"]).alias("score"), F.coalesce("last.id", lowest["id"]).alias("id"))
    rest = meet(known(tops).select("*", every), groups, "chunk", batch, worth(None), "q long, g int, bound long")
    rest = rest.join(first, ["q", "g"], "left_anti")
    rest = cut(rest.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "g"))))
    lo, size = 1, WAVES
    most = rest.agg(F.max("place").alias("n")).first()["n"] or 0
    while lo <= most:
        now = rest.where((F.col("place") >= lo) & (F.col("place") < lo + size)).join(known(tops), "q").where(F.col("bound") >= F.col("score"))
        more = meet(now.select("q", "g", "v", "score", "id"), blocks, "g", batch, in_group(k), FOUND)
        tops = kept(tops.select("q", "id", "score").unionByName(more), k)
        lo, size = lo + size, size * WAVES
    return tops.join(queries.select("q", "query_id"), "q").select("query_id", "rank", F.col("id").alias(key), "score")
