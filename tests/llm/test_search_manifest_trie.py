"""Top-k search, Merkle manifest and prefix trie against brute force, with their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.llm import merkle, topk, trie
from twinloom.llm.slots import Slots

FOLDER = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


# ---- top-k search
def brute_topk(rows, every=20, k=20):
    least, most = -(1 << 63), (1 << 63) - 1
    held = [(i, [max(least, min(most, math.floor(64 * float(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(held):
        if i % every == 0:
            found = sorted((-max(least, min(most, sum(x * y for x, y in zip(v, w)))), j) for b, (j, w) in enumerate(held) if b != a)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return ordered(out)


@pytest.mark.parametrize(("group", "block"), [(4096, 256), (30, 4)])
def test_topk_odd_vectors(spark, group, block):
    """Ragged, empty and huge vectors, repeated ids, a vector that many rows hold, and rows that take no part."""
    rng = np.random.default_rng(1)
    rows = [(int(i) // 2 * 2 if i % 3 else int(i), [float(x) for x in rng.normal(size=int(rng.integers(0, 6))) * 10.0 ** int(rng.integers(0, 4))]) for i in range(120)]
    rows += [(20, [1.0, 2.0])] * 60 + [(1000 + i, [1.0, 2.0]) for i in range(60)]
    rows += [(None, [1.0]), (3, None), (40, [None, 1.0]), (40, [float("nan")]), (60, [float("inf")]), (60, [1e30, -1e30]), (80, [3e17, 3e17])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, u int")
    got = topk.search(df, F.col("id") % 20 == 0, group=group, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert ordered(got.collect()) == brute_topk(rows)


def test_topk_given_table(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    want = brute_topk([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert ordered(topk.search(df, F.col("id") % 20 == 0, group=60, block=9).collect()) == want
    assert topk.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")  # fewer than k
    assert topk.search(few, F.col("id") % 20 == 0).count() == 2


def test_bounds_prune(spark):
    """Well separated clusters: most groups are never scored."""
    rng = np.random.default_rng(2)
    rows = [(c * 100 + i, (np.eye(16)[c] * 8 + rng.normal(size=16) / 50).tolist()) for c in range(16) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = topk.weighted(df, "vec_id", "embedding", 64)
    groups = topk.summaries(topk.indexed(held, 100, 20)).collect()
    most, least = topk.matrix([g["most"] for g in groups]), topk.matrix([g["least"] for g in groups])
    x = topk.matrix([r["v"] for r in held.collect()])
    upper, score = topk.bounds(x, most, least), np.sort(x @ x.T, axis=1)[:, -21]
    assert (upper >= (x @ x.T).max()).sum() < upper.size and (upper >= score[:, None]).mean() < 0.5
    assert ordered(topk.search(df, F.col("id") % 20 == 0, group=100, block=20).collect()) == brute_topk(rows)


# ---- Merkle manifest
def H(parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at - at % 16 : at - at % 16 + 16]
        out.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        at //= 16
    return out


def brute_manifest(rows):
    by = {}
    for r in rows:
        v = [r[k] for k in ("doc_id", "source", "lang", "n_chars", "text")]
        low = None if v[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in v[4])
        other = H(map(cell, [*v[:4], low])) if v[0] is not None and zlib.crc32(str(v[0]).encode()) % 5 == 0 else None
        by.setdefault(v[1], []).append((v[0] is not None, v[0] or 0, H(map(cell, v)), other, v[0]))
    by = {s: sorted(x, key=lambda y: y[:3]) for s, x in by.items()}
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in by[s]]) for s in by}
    top = brute_tree([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, x in enumerate(by[s]):
            way, digest = steps(trees[s], at) + steps(top, i), x[3] or x[2]
            for a, others in way:
                digest = H([*others[:a], digest, *others[a:]])
            out.append((x[4], x[2], trees[s][-1][0], top[-1][0], H(["".join(o) for _, o in way]), digest, digest == top[-1][0]))
    return ordered(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = merkle.manifest(df, merkle.fifth)
    assert ordered(got.collect()) == brute_manifest(df.collect())
    assert merkle.manifest(df.limit(0)).count() == 0


def test_manifest_odd_rows(spark):
    """Shared, NULL, negative and far ids, rows alike by thousands, NULL and empty cells, many sources, clashing names."""
    rnd = random.Random(1)
    rows = [
        (rnd.choice([None, 7, 7, 5000, rnd.randrange(-(10**6), 10**6), rnd.randrange(0, 9000), (1 << 62) + rnd.randrange(9)]), rnd.choice(["Aa", None, "b C", "", "É" * 50_000 if i == 3 else "x"]), "en", rnd.choice([None, "s", "s", "s", "t", "é", f"n{rnd.randrange(30)}"]), rnd.choice([None, 3]))
        for i in range(6000)
    ] + [(7, "same TEXT", "x", "s", 1)] * 3000
    df = spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows], f"{DOCS}, s int, leaf string, m double")
    assert ordered(merkle.manifest(df, merkle.fifth).collect()) == brute_manifest(df.collect())


@pytest.mark.parametrize("n", [1, 2, 16, 17, 4096, 4097])
def test_manifest_sizes(spark, n):
    """A lone leaf, full runs, a last run of one, and a source that is longer than one array of slots."""
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("T").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    assert ordered(merkle.manifest(df, merkle.fifth).collect()) == brute_manifest(df.collect())


def test_rank_queries():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.001, 0.5, 1.0):
        bits = rng.random(merkle.SPAN) < share
        assert (merkle.unpacked(merkle.packed(bits)) == bits).all()
        at = rng.integers(0, merkle.SPAN, 500)
        assert merkle.ranks(*merkle.directory(bits), at).tolist() == [int(bits[:i].sum()) for i in at]


# ---- prefix trie
def brute_trie(rows):
    said = lambda r, t: (r, hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest(), t)
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, *said(role or "", text or "")))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, kids, out = {}, {}, []
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
        ends = ",".join(map(str, sorted(c for c in members[p] if full[c] == list(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


CHATS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("options", [{}, {"piece": 2, "depth": 3, "shard_nodes": 20}])
def test_trie_odd_conversations(spark, options):
    """NULLs anywhere, ties, repeated rows, turnless conversations, negative ids, a long conversation, a hot first turn."""
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(-120, 420)]), rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b é", None, "", "\U0001f600"])) for _ in range(900)]
    rows += [(c, 0, "system", "hot") for c in range(1000, 1300)] + [(5000, i, "user", f"t{i % 7}") for i in range(40)] + [(5101, i, "user", f"t{i % 7}") for i in range(40)] + [(1, 1, "user", "x" * 50_000)] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{CHATS}, c int, k string")
    assert ordered(trie.report(df, **options).collect()) == brute_trie(rows)


def test_trie_given_table(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    got = trie.report(df)
    assert ordered(got.collect()) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert trie.report(df.limit(0)).count() == 0
    assert [tuple(r) for r in trie.report(spark.createDataFrame([(None, 1, "a", "b")], CHATS)).collect()] == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, (n, 2), np.uint64)
        table = Slots(keys)
        assert sorted(table.find(keys).tolist()) == list(range(n))
        assert (table.find(rng.integers(0, 1 << 63, (500, 2), np.uint64)) == -1).all()
    with pytest.raises(ValueError, match="twice"):
        Slots(np.array([[1, 2], [1, 2], [3, 4]], np.uint64))
