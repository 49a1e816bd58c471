"""A Merkle manifest of documents, with leaf places from bitmaps instead of a sort.

Leaves: every document is hashed where it lies; from then on only digests move.

Places: ids are split into chunks of ``SPAN``. Each task turns the ids it sees into partial bitmaps, one per (source, chunk),
packed when sparse; they are merged by chunk, and a chunk's popcount directory (set bits before each word) answers rank
queries. Chunk totals, summed across chunks, give where a chunk starts. A leaf's place is that start plus its rank in the
chunk; no rows are sorted. Ids that several rows share count as often as they occur, and those rows follow each other by
leaf digest (numbered in slices of the digest, rows alike in every column counted once), so an id that a third of all rows
hold is spread too.

Levels: places cut each source into runs of ``RUN`` = 16^3 leaves. A run is one array of slots that pieces are written into by
place; its three levels are reduced in one task. The tops of the runs are the slots of the next, shorter tree, and so on;
the subroots of the sources, placed by name, are the slots of the last tree. Each tree hands every slot the siblings on its
way up, so proofs need no look-up by node. Digests are hashed as hex text.

NULL cells are ``-``. A NULL source is a source of its own and first, NULL ids come first in their source. Rows that repeat
are leaves of their own. Other columns are not read and may have any name. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.functions.ordered import SLICE, cumulate, with_range_slice
from twinloom.session import cut, width

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPAN_BITS = 14
SPAN = 1 << SPAN_BITS
FAN, LEVELS = 16, 3
RUN = FAN**LEVELS
WIDE = 32
#: Rows of one id and digest prefix are numbered together; rows written out per piece when all are alike.
PREFIX, ALIKE = 3, 1024


def encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]).cast("binary"), 256)


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, fields: tuple[str, ...], key: str, source: str, tampered: Callable[[Column], Column] | None, text: str) -> DataFrame:
    """(s, id, leaf, other, m): distinct leaves and how often each occurs. ``s`` names the source, NULL first; ``other`` is the
    digest of the tampered row where the row is one of those."""
    cols = {f: docs[f"`{f}`"] for f in fields}
    name = F.coalesce(F.concat(F.lit("1"), cols[source].cast("string")), F.lit("0"))
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered(cols[key]), leaf([lowered(cols[f]) if f == text else cols[f] for f in fields]))
    held = docs.select(name.alias("s"), cols[key].cast("long").alias("id"), F.unhex(leaf(list(cols.values()))).alias("leaf"), F.unhex(other).alias("other"))
    return cut(held.groupBy("s", "id", "leaf").agg(F.first("other").alias("other"), F.count(F.lit(1)).alias("m")))


def chunk(id_: Column) -> Column:
    """The chunk of an id; NULL ids have one of their own before all others."""
    return F.coalesce(F.shiftright(id_, SPAN_BITS), F.lit(-(1 << 62)))


def packed(bits: np.ndarray) -> bytes:
    """A bitmap as sorted 16-bit places while these are shorter, else as bits."""
    at = np.flatnonzero(bits)
    return b"\0" + at.astype("<u2").tobytes() if 2 * len(at) < SPAN // 8 else b"\1" + np.packbits(bits).tobytes()


def unpacked(held: bytes) -> np.ndarray:
    bits = np.zeros(SPAN, bool)
    if held[0]:
        bits[:] = np.unpackbits(np.frombuffer(held, np.uint8, offset=1))
    else:
        bits[np.frombuffer(held, "<u2", offset=1)] = True
    return bits


def directory(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a bitmap and how many bits are set before each: what rank queries read."""
    words = np.packbits(bits, bitorder="little").view("<u8")
    return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])


def ranks(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits below each place."""
    below = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return before[at >> 6] + np.bitwise_count(below)


def bitmaps(ids: DataFrame) -> DataFrame:
    """(s, c, bits): merged bitmaps of (s, c, lo)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b]).group_by(["s", "c"]).aggregate([("lo", "list")])
            out = []
            for at in table.column("lo_list").to_pylist():
                bits = np.zeros(SPAN, bool)
                bits[at] = True
                out.append(packed(bits))
            yield pa.RecordBatch.from_arrays([table.column("s").combine_chunks(), table.column("c").combine_chunks(), pa.array(out, pa.binary())], names=["s", "c", "bits"])

    def merged(part: pa.Table) -> pa.Table:
        bits = np.zeros(SPAN, bool)
        for held in part.column("bits").to_pylist():
            bits |= unpacked(held)
        return pa.table({"s": part.column("s")[:1], "c": part.column("c")[:1], "bits": pa.array([packed(bits)], pa.binary())})

    kinds = "s string, c long, bits binary"
    return ids.mapInArrow(partial, kinds).groupBy("s", "c").applyInArrow(merged, kinds)


def first_places(mine: pa.Table, table: pa.Table) -> np.ndarray:
    """Where the ids ``lo`` of a chunk start in their source: the chunk's start, the rank, and what ids shared below add."""
    at = mine.column("lo").to_numpy()
    rank = ranks(*directory(unpacked(table.column("bits")[0].as_py())), at).astype(np.int64)
    more = sorted((x["lo"], x["w"] - 1) for x in table.column("more")[0].as_py() or [])
    added = np.cumsum([0, *(w for _, w in more)])
    return table.column("start")[0].as_py() + rank + added[np.searchsorted([lo for lo, _ in more], at)]


PIECES = "s string, run long, at array<int>, id array<long>, leaf binary, other binary"


def placed(found: DataFrame) -> DataFrame:
    """``PIECES``: leaves with their places, cut by run. ``at`` is the slot in the run."""
    low = F.coalesce(F.col("id").bitwiseAND(F.lit(SPAN - 1)), F.lit(0)).cast("int")
    rows = found.select("s", chunk(F.col("id")).alias("c"), low.alias("lo"), "id", "leaf", "other", "m")
    held = cut(bitmaps(rows.select("s", "c", "lo")))
    # ids that several rows share: how many rows, and where each leaf stands among them
    shared = rows.groupBy("s", "c", "lo").agg(F.sum("m").alias("w")).where("w > 1")
    shared = cut(shared)
    more = shared.groupBy("s", "c").agg(F.collect_list(F.struct("lo", F.col("w").cast("long").alias("w"))).alias("more"))
    held = held.join(more, ["s", "c"], "left")
    set_bits = F.when(F.hex(F.substring("bits", 1, 1)) == "00", F.expr("(octet_length(bits) - 1) / 2").cast("long")).otherwise(ones(F.col("bits")))
    extra = F.aggregate(F.coalesce("more", F.array().cast("array<struct<lo:int,w:long>>")), F.lit(0).cast("long"), lambda a, x: a + x["w"] - 1)
    starts = cut(held.select("s", "c", (set_bits + extra).alias("n")))
    starts = cumulate(with_range_slice(starts, "c"), ["s"], ["c"], {"upto": "n"}).select("s", "c", (F.col("upto") - F.col("n")).alias("start"))
    held = cut(held.join(starts, ["s", "c"]))
    twice = rows.join(shared.select("s", "c", "lo", "w"), ["s", "c", "lo"])
    once = rows.join(shared.select("s", "c", "lo"), ["s", "c", "lo"], "left_anti").select("s", "c", "lo", "id", "leaf", "other")

    def queried(mine: pa.Table, table: pa.Table) -> pa.Table:
        """The places of one chunk's leaves, cut by run; a chunk is consecutive, so its pieces are few."""
        if not len(mine):
            return pa.Table.from_arrays([pa.array([], pa.string()), *[pa.array([], k) for k in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary())]], names=[f.split()[0] for f in PIECES.split(", ")])
        return pieces(mine.column("s")[0].as_py(), first_places(mine, table), mine)

    out = once.groupBy("s", "c").cogroup(held.groupBy("s", "c")).applyInArrow(queried, PIECES)
    if shared.isEmpty():
        return out
    return out.union(repeated(twice, held))


def ones(bits: Column) -> Column:
    """How many bits are set after the first byte, by eight bytes at a time."""
    words = F.transform(F.sequence(F.lit(0), F.lit(SPAN // 64 - 1)), lambda i: F.bit_count(F.conv(F.hex(F.substring(bits, i * 8 + 2, F.lit(8))), 16, -10).cast("long")))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x)


def pieces(source: str, place: np.ndarray, mine: pa.Table) -> pa.Table:
    none = bytes(WIDE)
    leaf_, other, ids = mine.column("leaf").to_pylist(), mine.column("other").to_pylist(), mine.column("id").to_pylist()
    out = []
    for run in np.unique(place // RUN):
        i = np.flatnonzero(place // RUN == run)
        out.append((source, int(run), (place[i] % RUN).tolist(), [ids[j] for j in i], b"".join(leaf_[j] for j in i), b"".join(other[j] or none for j in i)))
    cols = list(zip(*out))
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in PIECES.split(", ")])


def repeated(twice: DataFrame, held: DataFrame) -> DataFrame:
    """``PIECES`` of ids that several rows share: (s, c, lo, id, leaf, other, m), numbered by leaf digest in slices of its prefix."""
    sliced = twice.withColumn(SLICE, F.substring(F.hex("leaf"), 1, PREFIX))
    upto = cumulate(sliced, ["s", "c", "lo"], ["leaf"], {"upto": "m"})
    # where the id starts: a rank query on its chunk
    asked = cut(twice.select("s", "c", "lo").distinct())

    def queried(mine: pa.Table, table: pa.Table) -> pa.Table:
        if not len(mine):
            return pa.table({"s": pa.array([], pa.string()), "c": pa.array([], pa.int64()), "lo": pa.array([], pa.int32()), "from": pa.array([], pa.int64())})
        return pa.table({"s": mine.column("s"), "c": mine.column("c"), "lo": mine.column("lo"), "from": pa.array(first_places(mine, table))})

    from_ = asked.groupBy("s", "c").cogroup(held.groupBy("s", "c")).applyInArrow(queried, "s string, c long, lo int, from long")
    rows = upto.join(from_, ["s", "c", "lo"])
    first = F.col("from") + F.col("upto") - F.col("m")
    # rows alike: as many pieces as needed, dealt out before they are written out
    steps = rows.select("s", "id", "leaf", "other", first.alias("first"), (first + F.col("m")).alias("end"), F.explode(F.sequence(first - first % ALIKE, first + F.col("m") - 1, F.lit(ALIKE).cast("long"))).alias("block"))
    steps = steps.repartition(width(twice.sparkSession), "s", "block")
    places = steps.select("s", "id", "leaf", "other", F.sequence(F.greatest("first", "block"), F.least(F.col("end"), F.col("block") + ALIKE) - 1).alias("places"), "block")
    times = F.size("places")
    return places.select(
        "s", F.floor(F.col("block") / RUN).alias("run"), F.transform("places", lambda p: (p % RUN).cast("int")).alias("at"),
        F.array_repeat("id", times).alias("id"), F.unhex(F.repeat(F.hex("leaf"), times)).alias("leaf"),
        F.unhex(F.repeat(F.coalesce(F.hex("other"), F.lit("00" * WIDE)), times)).alias("other"),
    )


# ---- trees: an array of slots is reduced by runs of FAN; digests are hashed as hex text
def hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(slots: list[str], whole: bool) -> list[list[str]]:
    """The levels above the slots, these first. A ``whole`` tree is reduced to one node, a run of a larger one by ``LEVELS``."""
    out = [slots]
    while len(out[-1]) > 1 if whole else len(out) <= LEVELS:
        now = out[-1]
        out.append([hashed(now[i : i + FAN]) for i in range(0, len(now), FAN)])
    return out


def way(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """(place in its run, siblings) of slot ``at`` at each level on its way to the top."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[at - at % FAN : at - at % FAN + FAN]
        out.append((at % FAN, run[: at % FAN] + run[at % FAN + 1 :]))
        at //= FAN
    return out


def folded(digest: str, steps: list[tuple[int, list[str]]]) -> str:
    for at, others in steps:
        digest = hashed([*others[:at], digest, *others[at:]])
    return digest


WAY = "array<struct<at:int,others:array<string>>>"


def grown(nodes: DataFrame) -> DataFrame:
    """(tree, place, up, top): for each of (tree, place, node) the siblings on its way to the top of its tree, which is ``top``.
    Each round turns runs of ``RUN`` slots into one; the rounds are as many as the longest tree needs."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))

    def one(part: pa.Table) -> pa.Table:
        n, place = part.column("n")[0].as_py(), part.column("place").to_numpy()
        slots = [""] * len(place)
        for at, node in zip((place % RUN).tolist(), part.column("node").to_pylist()):
            slots[at] = node
        levels = reduced(slots, n <= RUN)
        ways = [[{"at": a, "others": o} for a, o in way(levels, int(p % RUN))] for p in place]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
        return pa.table({"tree": part.column("tree"), "place": part.column("place"), "up": pa.array(ways, kind), "top": pa.array([levels[-1][0]] * len(place)), "last": pa.array([n <= RUN] * len(place))})

    sized = cut(nodes.join(sizes, "tree").withColumn("run", F.floor(F.col("place") / RUN)))
    out = cut(sized.groupBy("tree", "run").applyInArrow(one, f"tree string, place long, up {WAY}, top string, last boolean"))
    rest = out.where("not last")
    if rest.isEmpty():
        return out.drop("last")
    tops = rest.where(F.col("place") % RUN == 0).select("tree", F.floor(F.col("place") / RUN).alias("place"), F.col("top").alias("node"))
    above = grown(tops).select("tree", F.col("place").alias("run"), F.col("up").alias("further"), F.col("top").alias("root"))
    longer = out.withColumn("run", F.floor(F.col("place") / RUN)).join(above, ["tree", "run"], "left")
    far = longer.select("tree", "place", F.when(F.col("last"), F.col("up")).otherwise(F.concat("up", F.coalesce("further", F.array().cast(WAY)))).alias("up"), F.when(F.col("last"), F.col("top")).otherwise(F.col("root")).alias("top"))
    return cut(far)


def manifest(docs: DataFrame, tampered: Callable[[Column], Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document. ``tampered`` says by key which
    rows have had their text lower-cased before ``folded_root`` is worked out."""
    parts = placed(leaves(docs, fields, key, source, tampered, text))
    runs = cut(parts.groupBy("s", "run").applyInArrow(gathered, "s string, run long, id array<long>, leaf binary, other binary"))
    counts = runs.groupBy("s").agg(F.sum(F.size("id")).alias("n"))
    # a source of one run is finished there; the runs of others are the slots of the next tree
    tops = cut(runs.join(counts, "s").mapInArrow(topped, "tree string, place long, node string, whole boolean"))
    several = tops.where("not whole").select("tree", "place", "node")
    trees = grown(several).select(F.col("tree").alias("s"), F.col("place").alias("run"), "up", F.col("top").alias("subroot"))
    alone = tops.where("whole").select(F.col("tree").alias("s"), F.lit(0).cast("long").alias("run"), F.array().cast(WAY).alias("up"), F.col("node").alias("subroot"))
    ways = cut(trees.union(alone))
    roots = ways.where("run = 0").select("s", "subroot")
    ranked = cumulate(with_range_slice(roots.withColumn("one", F.lit(1).cast("long")), "s"), [], ["s"], {"rank": "one"})
    last = grown(ranked.select(F.lit("").alias("tree"), (F.col("rank") - 1).alias("place"), F.col("subroot").alias("node")))
    last = last.join(ranked.select("s", (F.col("rank") - 1).alias("place")), "place").select("s", F.col("up").alias("last"), F.col("top").alias("root"))
    paths = ways.join(last, "s").join(counts, "s").select("s", "run", F.concat("up", "last").alias("up"), "subroot", "root", (F.col("n") <= RUN).alias("whole"))
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = runs.join(paths, ["s", "run"]).select("id", "leaf", "other", "up", "subroot", "root", "whole").mapInArrow(proofs, kinds)
    return out.withColumnRenamed("doc_id", key)


def gathered(part: pa.Table) -> pa.Table:
    """One run: the pieces written into arrays of slots by place."""
    size = sum(len(a) for a in part.column("at").to_pylist())
    ids, leaf_, other = [None] * size, np.zeros((size, WIDE), np.uint8), np.zeros((size, WIDE), np.uint8)
    for at, i, a, b in zip(*[part.column(c).to_pylist() for c in ("at", "id", "leaf", "other")]):
        leaf_[at] = np.frombuffer(a, np.uint8).reshape(-1, WIDE)
        other[at] = np.frombuffer(b, np.uint8).reshape(-1, WIDE)
        for place, x in zip(at, i):
            ids[place] = x
    return pa.table({"s": part.column("s")[:1], "run": part.column("run")[:1], "id": pa.array([ids], pa.list_(pa.int64())), "leaf": pa.array([leaf_.tobytes()], pa.binary()), "other": pa.array([other.tobytes()], pa.binary())})


def digests(held: bytes) -> list[str]:
    text = held.hex()
    return [text[i : i + 2 * WIDE] for i in range(0, len(text), 2 * WIDE)]


def topped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for s, run, leaf_, n in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("s", "run", "leaf", "n")]):
            out.append((s, run, reduced(digests(leaf_), n <= RUN)[-1][0], n <= RUN))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["tree", "place", "node", "whole"])


def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of a run with their proofs; a row at a time, as a run has thousands."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for b in batches:
        for r in b.to_pylist():
            leaves_, others = digests(r["leaf"]), digests(r["other"])
            levels = reduced(leaves_, r["whole"])
            further = [(x["at"], x["others"]) for x in r["up"]]
            above = "".join("".join(o) for _, o in further).encode()
            proof, fold = [], []
            for at, (one, two) in enumerate(zip(leaves_, others)):
                steps = way(levels, at)
                proof.append(hashlib.sha256("".join("".join(o) for _, o in steps).encode() + above).hexdigest())
                fold.append(folded(one if two == "00" * WIDE else two, [*steps, *further]))
            n = len(leaves_)
            cols = [pa.array(r["id"], pa.int64()), pa.array(leaves_), pa.array([r["subroot"]] * n), pa.array([r["root"]] * n), pa.array(proof), pa.array(fold), pa.array([f == r["root"] for f in fold])]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def fifth(id_: Column) -> Column:
    """Rows tampered with in the registered query."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0
