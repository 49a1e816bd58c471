"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of ``WINDOW`` words (a shorter item: itself) must not occur in a document. A window is a set of word
shingles. Shingles are ordered by how often they occur in all documents, and since containment is exact, the prefix that
a match cannot do without is one shingle: the window's rarest. A first pass counts the windows' shingles over the corpus
(a window with a shingle that never occurs is out); a second pass looks up each document's shingles among the prefixes,
places the window by the shingle's offset, drops placements that stick out of the document, and compares all words.

Documents never move: both passes run where they are read, and only counts per shingle are shuffled. Items that are alike
count once and are sent to the tasks in blocks of about ``BLOCK_BYTES`` of text (a longer item is a block of its own); usual
benchmarks are one block. If there are more, documents are written once with row numbers, and each block is read, sent,
used and dropped before the next: a pass writes the hits of the documents it hit, and these are merged by row in the end.

NULL and empty texts have no words and no hits; an item without words has no windows; equal items all count; an empty
benchmark leaves every document clean. Rows that repeat are judged each. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinloom.session import cut

WINDOW = 10
SHINGLE = 5
BLOCK_BYTES = 8 << 20
#: A-Z to a-z; ASCII that is no letter or digit to space; all else is part of a word.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words; runs with a word outside the items (0) have the number 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = ids.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    good = np.ones(n, bool)
    for k in range(size):
        part = u[k : k + n]
        out = (out ^ part) * FACTOR + (out >> np.uint64(29))
        good &= part > 0
    return np.where(good, out | np.uint64(1), np.uint64(0))


class Items:
    """One block of items: word numbers, the windows as word numbers, and their shingles."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows.setdefault(ids[at : at + WINDOW], set()).add(name)
        self.windows = [np.array(w, np.int64) for w in windows]
        self.names = [sorted(x) for x in windows.values()]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.shingles = {k: np.unique(np.concatenate([codes(w, k) for w in self.windows if min(SHINGLE, len(w)) == k])) for k in self.sizes}
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def numbers(self, text: bytes) -> np.ndarray:
        ws = words(text)
        return np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int64, len(ws))

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle as its prefix."""
        kept: dict[int, list[tuple[int, int, int]]] = {k: [] for k in self.sizes}
        for i, w in enumerate(self.windows):
            k = min(SHINGLE, len(w))
            ranked = [(counts.get((k, int(c)), 0), int(c), at) for at, c in enumerate(codes(w, k))]
            n, c, at = min(ranked)
            if min(ranked)[0]:
                kept[k].append((c, at, i))
        for k, rows in kept.items():
            rows.sort()
            self.prefix[k] = tuple(np.array([r[j] for r in rows], t) for j, t in enumerate((np.uint64, np.int64, np.int64)))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words of a document lie in a window's occurrence, and the items they come from."""
        hit, found = np.zeros(len(ids) + 1, np.int64), set()
        for k in self.sizes:
            keys, offsets, numbers = self.prefix[k]
            here = codes(ids, k)
            at = np.flatnonzero(here)
            if not len(at) or not len(keys):
                continue
            lo, hi = np.searchsorted(keys, here[at]), np.searchsorted(keys, here[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for j in range(a, b):
                    w, start = self.windows[numbers[j]], p - int(offsets[j])
                    if 0 <= start <= len(ids) - len(w) and (ids[start : start + len(w)] == w).all():
                        hit[start] += 1
                        hit[start + len(w)] -= 1
                        found.update(self.names[numbers[j]])
        return np.cumsum(hit[:-1]) > 0, found


def counted(docs: DataFrame, text: str, items: Items) -> dict[tuple[int, int], int]:
    """How often each shingle of the items occurs in all documents. One row per shingle reaches the driver: at most the
    words of a block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        sums = {k: np.zeros(len(s), np.int64) for k, s in held.shingles.items()}
        for b in batches:
            for t in b.column(0).to_pylist():
                ids = held.numbers(t)
                if not ids.any():
                    continue
                for k, s in held.shingles.items():
                    here = codes(ids, k)
                    here = here[here > 0]
                    at = np.minimum(np.searchsorted(s, here), len(s) - 1)
                    np.add.at(sums[k], at[s[at] == here], 1)
        for k, s in held.shingles.items():
            i = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i, pa.int64()), pa.array(sums[k][i])], names=["k", "i", "n"])

    body = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    rows = body.mapInArrow(seen, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
    return {(r["k"], int(items.shingles[r["k"]][r["i"]])): r["n"] for r in rows}


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[Items]:
    """The different items in blocks by hash, one at a time: what the driver holds is one block."""
    held = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    held = cut(held.where(F.octet_length("t") > 0).distinct())
    total = held.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = -(-2 * total // most) if total > most else 1
    for k in range(n):
        part = held if n == 1 else held.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = Items([(r["i"], bytes(r["t"])) for r in part.collect()])
        if got.windows:
            yield got


FOUND = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items:array<string>,spans:binary>"


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` under the column names c0, c1, ... and ``dec``: n_words, n_hit, n_items, items (sorted)."""
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = f"c{docs.columns.index(text)}"
    none = F.struct(n_words(F.coalesce(F.col(body), F.lit(""))).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(b"").alias("spans"))
    queue = blocks(benchmark, item, item_text, most)
    block, following = next(queue, None), next(queue, None)
    if block is None:
        return flat.withColumn("dec", none)
    if following is None:
        return passed(flat, body, block, False)
    held = cut(flat.withColumn("row", F.monotonically_increasing_id()))
    narrow, hits = held.select("row", body), []
    while block is not None:
        hits.append(cut(passed(narrow, body, block, True).select("row", "dec")))
        block, following = following, next(queue, None)
    every = hits[0]
    for h in hits[1:]:
        every = every.union(h)
    merged = every.groupBy("row").applyInArrow(joined, f"row long, dec {FOUND}").withColumnRenamed("row", "at")
    return held.join(merged, F.col("row") == F.col("at"), "left").select(*flat.columns, F.coalesce("dec", none).alias("dec"))


def joined(part: pa.Table) -> pa.Table:
    """What the passes found in one document: one row per block that hit it."""
    rows = part.column("dec").to_pylist()
    bits = np.bitwise_or.reduce([np.frombuffer(r["spans"], np.uint8) for r in rows])
    items = sorted(set().union(*(r["items"] for r in rows)))
    out = {"n_words": rows[0]["n_words"], "n_hit": int(np.bitwise_count(bits).sum()), "n_items": len(items), "items": items, "spans": bits.tobytes()}
    return pa.table({"row": part.column("row")[:1], "dec": pa.array([out], part.schema.field("dec").type)})


def n_words(body: Column) -> Column:
    """Words of a text no item was compared with."""
    return F.regexp_count(body, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def passed(docs: DataFrame, text: str, items: Items, hit_only: bool) -> DataFrame:
    """One pass: ``docs`` with ``dec``, each document compared with one block of items; with ``hit_only`` those it hits."""
    items.choose(counted(docs, text, items))
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.binary())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            out = []
            for t in texts:
                ids = held.numbers(t or b"")
                hit, found = held.hits(ids)
                out.append({"n_words": len(ids), "n_hit": int(hit.sum()), "n_items": len(found), "items": sorted(found), "spans": np.packbits(hit).tobytes() if hit_only else b""})
            b = b.append_column("dec", pa.array(out, kind))
            yield b.filter(pa.array([bool(r["n_hit"]) for r in out], pa.bool_())) if hit_only else b

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(compared, f"{columns}, dec {FOUND}")


def judged(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    held = marked(docs.select(key, text), benchmark, text, **options)
    names = F.sha2(F.array_join("dec.items", ",").cast("binary"), 256)
    return held.select(F.col("c0").alias(key), "dec.n_words", "dec.n_hit", "dec.n_items", names.alias("items_sha256"), (F.col("dec.n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that no item occurs in."""
    return marked(docs, benchmark, text, **options).where(F.col("dec.n_hit") == 0).drop("dec").toDF(*docs.columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
