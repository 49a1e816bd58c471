"""The trie of conversation prefixes, with what sharing them saves.

Turns are reduced to digests first, so texts are read once and never shuffled. The turns of a conversation are chained to
one digest per prefix; distinct digests are the nodes, counted with map-side sums, and an independent second hash tells
whether two different prefixes ever met in one digest (then the job stops).

Sums over subtrees: the trie is cut into pieces wherever the number of members falls below a power of ``PIECE`` (and every
``DEPTH`` turns), so a piece holds ``PIECE`` disjoint runs at most at any depth, however often a first turn or a whole
conversation is repeated. Many pieces are one shard. A shard gives its digests slots by a minimal perfect hash
(``slots``, every look-up verified), scatters counts into flat arrays, finds each node's parent slot and adds up in
depth order. Totals of a piece go to the parent of its top, which lies in a later round; the rounds are few (one per
power of ``PIECE``, and one per ``DEPTH`` turns of the longest conversation).

The ids that end at a node are joined in ranges of ids and hashed by streaming over the ranges, so a node at which a third
of all conversations end is no group in memory. The turns of one conversation are read in order by one task, as a stream.

NULL turns come first, ties stand by role and digest, NULL roles and texts are empty. Rows without a conversation id belong
to no conversation. Rows that repeat are turns of their own. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.llm.slots import Slots, numbers
from twinloom.session import cut, width

PIECE = 2048
DEPTH = 4096
SHARD_NODES = 1 << 16
ROOT = bytes(16)
#: Bytes of ids hashed at a time.
TEXT = 1 << 16
LENT, BLOCK = 6, 100


def digested(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, k, e, x, n): turns numbered from 1 with a digest, a second hash and the code points of the text."""
    held = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    said = F.concat(F.octet_length("r").cast("string"), F.lit(":"), F.col("r"), F.col("t"))
    held = held.select("c", "o", "r", F.unhex(F.sha2(said.cast("binary"), 256)).alias("e"), F.xxhash64("r", "t").alias("x"), F.length("t").alias("n"))
    return cut(held.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.col("o").asc_nulls_first(), "r", "e"))).select("c", "k", "e", "x", "n"))


def lent(conv: Column, most: int = LENT) -> Column:
    """How many turns a conversation takes over."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(most)).cast("int")


def rebuilt(turns: DataFrame, most: int = LENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, empty): every conversation with the first turns of the one that opens its block of ids and then its own later
    turns, in the order of (c, part, k); and the ids of those left without a turn."""
    c = F.col("c")
    first = turns.where((c % block == 0) & (F.col("k") < most)).groupBy(c.alias("donor")).agg(F.sort_array(F.collect_list(F.struct("k", "e", "x", "n"))).alias("head"))
    convs = turns.groupBy("c").agg(F.max("k").alias("own")).withColumn("h", lent(c, most)).withColumn("donor", c - c % block)
    convs = cut(convs.join(first, "donor", "left").select("c", "own", "h", F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), F.lit(1), F.col("h")).alias("head")))
    taken = convs.select("c", F.explode("head").alias("s")).select("c", F.lit(0).alias("part"), "s.*")
    own = turns.where(F.col("k") > lent(c, most)).select("c", F.lit(1).alias("part"), "k", "e", "x", "n")
    empty = convs.where((F.size("head") == 0) & (F.col("own") <= F.col("h"))).select("c")
    return taken.union(own), empty


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, g, up, x, n, last): one row per prefix of each conversation; ``g`` is its digest, ``up`` that of the prefix
    before, ``x`` another hash of the last turn, which plays no part in ``g``."""
    placed = rows.repartition("c").sortWithinPartitions("c", "part", "k").select("c", "e", "x", "n")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "d", "g", "up", "x", "n", "last"]
        conv = depth = held = None
        digest = ROOT

        def made(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(list(col), k) for col, k in zip(zip(*out), kinds)], names=names)

        for b in batches:
            out = []
            for c, e, x, n in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if held:
                    out.append((*held, c != conv))
                if c != conv:
                    conv, depth, digest = c, 0, ROOT
                up, digest, depth = digest, hashlib.sha256(digest + e).digest()[:16], depth + 1
                held = (c, depth, digest, up, x, n)
            if out:
                yield made(out)
        if held:
            yield made([(*held, True)])

    return cut(placed.mapInArrow(chained, "c long, d long, g binary, up binary, x long, n int, last boolean"))


def counted(paths: DataFrame, empty: DataFrame) -> DataFrame:
    """(g, up, d, conv, members, n): the nodes, the root among them."""
    one = F.struct("d", "up", "x", "n")
    nodes = paths.groupBy("g").agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("members"), F.min(one).alias("lo"), F.max(one).alias("hi"))
    sure = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast(nodes.schema["lo"].dataType))
    nodes = nodes.withColumn("one", sure).select("g", "one.up", "one.d", "conv", "members", "one.n")
    every = paths.where("d = 1").select("c").union(empty)
    root = every.agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("members")).where("members > 0")
    root = root.select(F.lit(ROOT).alias("g"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("d"), "conv", "members", F.lit(0).alias("n"))
    return cut(nodes.union(root))


def level(members: str, piece: int) -> Column:
    """0 up to ``piece`` members, 1 up to its square, and so on."""
    steps, bound = F.lit(0), piece
    while bound < 1 << 62:
        steps = steps + (F.col(members) > bound).cast("int")
        bound *= piece
    return steps


def pieced(paths: DataFrame, nodes: DataFrame, piece: int, depth: int) -> DataFrame:
    """``nodes`` with ``level``, ``band`` and ``top``: the digest of the node that opens its piece. A piece is found on the path
    of the node's smallest member, where level or band change."""
    held = nodes.withColumn("level", level("members", piece)).withColumn("band", F.floor(F.col("d") / depth))
    large = held.where("level > 0").select("g", "level")
    own = large.select(F.col("g").alias("_g"), F.col("level").alias("lg"))
    over = large.select(F.col("g").alias("_u"), F.col("level").alias("lu"))
    # only rows below a large node, or at a band's start, can open a piece
    below = paths.select("c", "d", "g", "up").join(over, F.col("up") == F.col("_u"), "left").where((F.col("lu") > 0) | (F.col("d") % depth == 0))
    below = below.join(own, F.col("g") == F.col("_g"), "left").select("c", F.floor(F.col("d") / depth).alias("band"), "d", "g", F.coalesce("lg", F.lit(0)).alias("level"), F.coalesce("lu", F.lit(0)).alias("lu"))
    opens = below.where((F.col("level") != F.col("lu")) | (F.col("d") % depth == 0))
    opens = opens.select(F.col("c").alias("conv"), "level", "band", F.col("g").alias("top"))
    return cut(held.join(opens, ["conv", "level", "band"], "left").withColumn("top", F.coalesce("top", F.lit(ROOT))))


SUMMED = "g binary, up binary, d long, conv long, members long, parent long, children long, leaves long, saved long"


def summed(shard: pa.Table) -> pa.Table:
    """One shard: slots, scattered counts, sums in depth order. ``parent`` is the parent's smallest member, NULL at the top
    of a piece."""
    col = lambda name: shard.column(name).combine_chunks()
    digests = numbers(col("g").to_pylist())
    slots = Slots(digests)
    at = slots.find(digests)
    n = len(at)

    def scattered(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = col(name).to_numpy(zero_copy_only=False)
        return out

    depth, members, conv = scattered("d"), scattered("members"), scattered("conv")
    children, leaves = scattered("more_children"), scattered("more_leaves")
    saved = scattered("more_saved") + (members - 1) * scattered("n")
    parent = np.full(n, -1, np.int64)
    parent[at] = slots.find(numbers([u or b"\xff" * 16 for u in col("up").to_pylist()]))
    inside = np.flatnonzero(parent >= 0)
    children += np.bincount(parent[inside], minlength=n)
    leaves[children == 0] = 1
    order = inside[np.argsort(-depth[inside], kind="stable")]
    for same in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[same], leaves[same])
        np.add.at(saved, parent[same], saved[same])
    above = parent[at]
    of_parent = pa.array(np.where(above >= 0, conv[above], 0), mask=above < 0)
    sums = [pa.array(a[at]) for a in (children, leaves, saved)]
    return pa.Table.from_arrays([col("g"), col("up"), col("d"), col("conv"), col("members"), of_parent, *sums], names=[f.split()[0] for f in SUMMED.split(", ")])


def accumulated(placed: DataFrame, shard_nodes: int) -> DataFrame:
    """``SUMMED`` for all nodes, round by round: what lies deeper or has fewer members comes first."""
    rounds = sorted(((r["level"], r["band"], r["n"]) for r in placed.groupBy("level", "band").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda r: (r[0], -r[1]))
    spark, done = placed.sparkSession, []
    sums = [F.sum(c).alias(f"more_{c}") for c in ("children", "leaves", "saved")]
    for lvl, band, n in rounds:
        part = placed.where((F.col("level") == lvl) & (F.col("band") == band))
        if done:
            tops = [d.where(F.col("parent").isNull() & F.col("up").isNotNull()).select(F.col("up").alias("g"), F.lit(1).cast("long").alias("children"), "leaves", "saved") for d in done]
            given = tops[0]
            for t in tops[1:]:
                given = given.union(t)
            part = part.join(given.groupBy("g").agg(*sums), "g", "left")
        else:
            part = part.withColumns({f"more_{c}": F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        part = part.withColumns({f"more_{c}": F.coalesce(f"more_{c}", F.lit(0)) for c in ("children", "leaves", "saved")})
        shards = max(width(spark), -(-n // shard_nodes))
        part = part.withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards))).drop("level", "band", "top")
        done.append(cut(part.groupBy("shard").applyInArrow(summed, SUMMED)))
    out = done[0] if done else spark.createDataFrame([], SUMMED)
    for d in done[1:]:
        out = out.union(d)
    return out


def ended(paths: DataFrame, empty: DataFrame) -> DataFrame:
    """(g, ends): SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined."""
    last = paths.where("last").select("g", "c").union(empty.select(F.lit(ROOT).alias("g"), "c"))
    # every range of ids gives a node one piece of text or a few; the ranges are even, as an id ends once
    ranged = last.repartitionByRange(width(last.sparkSession), "c").sortWithinPartitions("g", "c")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0
        for b in batches:
            out = []
            for g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (g != node or size >= TEXT):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                node = g
                ids.append(c)
                size += 12
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out)], names=["g", "c", "t"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["g", "c", "t"])

    texts = ranged.mapInArrow(joined, "g binary, c long, t string").repartition("g").sortWithinPartitions("g", "c")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for b in batches:
            out = []
            for g, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if g != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = g, hashlib.sha256(t.encode())
                else:
                    state.update(b"," + t.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out)], names=["g", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["g", "ends"])

    return texts.mapInArrow(hashed, "g binary, ends string")


def nodes(rows: DataFrame, empty: DataFrame, piece: int = PIECE, depth: int = DEPTH, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per node of the trie of ``rows`` (c, part, k, e, x, n: turns in the order of part and k) and of the
    conversations ``empty`` (c) without turns."""
    paths = prefixes(rows)
    all_ = counted(paths, empty)
    sums = accumulated(pieced(paths, all_, piece, depth), shard_nodes)
    tops = sums.where("parent is null and up is not null").select("g", "up")
    over = tops.join(all_.select(F.col("g").alias("up"), F.col("conv").alias("over")), "up").select("g", "over")
    out = sums.join(over, "g", "left").join(ended(paths, empty), "g", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent", "over").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )


def report(conversations: DataFrame, **options) -> DataFrame:
    """The nodes of the rebuilt conversations."""
    return nodes(*rebuilt(digested(conversations)), **options)
