"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into ``most // 2 + 1`` segments. Two fingerprints within ``most`` bits agree up to
``most // segments`` (at most one) bits in some segment, so each segment has a table of its values: a fingerprint looks
up, per segment, the small ball around its own value, fetches the matches and compares all 64 bits. As links have no
direction, a differing bit is only looked up from the side that holds the one, which halves the ball: for two bits some 34
lookups and two table rows a fingerprint.

A segment value that more than ``BUCKET`` fingerprints share (near copies of one text) is hot. Fingerprints that meet at
a hot value are compared by whole-value balls instead: one side lists all values within ``most // 2`` bits, the other
within the rest. Whatever meets at a value is within ``most`` bits, so the smallest of a bucket stands for the others and
no pairs are listed; such a bucket holds no more than a ball. Nothing is capped. Spark sizes look-ups and balls as if each
fingerprint were one row, so joins with them are told to shuffle; else they might be sent whole to the driver and all tasks.

Equal fingerprints count once, so a group of copies of any size is one row here. Fingerprints are computed once and
written; only they, not the texts, are shuffled. NULL and empty texts have the fingerprint zero. NULL ids are linked like
others; a component of NULL ids only has the id NULL. Repeated rows are one component. Long texts are hashed in pieces of
bounded size. Other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.llm.common import same, whole
from twinloom.llm.components import components
from twinloom.session import cut

SHINGLE = 3
SEED = 42
MOST_BITS = 2
BITS = 64
BUCKET = 16
PIECE = 1 << 15
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of the word shingles of a text in UTF-8."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        got = digest(b" ".join(words), SEED)
        return got - (1 << 64) if got >> 63 else got
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + SHINGLE - 1]
        line = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` and ``fp`` of every document; texts stay in their tasks."""
    held = docs.select(F.struct(*keep).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fingerprint(t) for t in b.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k"), made], names=["k", "fp"])

    kept = held.schema["k"].dataType.simpleString()
    return held.mapInArrow(hashed, f"k {kept}, fp long").select("k.*", "fp")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def segments(most: int) -> list[int]:
    """Masks of the segments for a limit of ``most`` bits: neighbours differ by one bit at most in some segment."""
    n = most // 2 + 1
    ends = [BITS * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]


def ball(value: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` bits."""
    flips = [signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    return F.transform(F.array(*[F.lit(m) for m in flips]), lambda m: value.bitwiseXOR(m))


def lookups(value: Column, mask: int, radius: int) -> Column:
    """The segment's own value and, for a radius of one, those with one of its ones turned off."""
    own = value.bitwiseAND(F.lit(signed(mask)))
    ones = [F.lit(signed(1 << i)) for i in range(BITS) if mask >> i & 1]
    lower = F.transform(F.filter(F.array(*ones), lambda m: own.bitwiseAND(m) != 0), lambda m: own.bitwiseXOR(m))
    return F.concat(F.array(own), lower) if radius else F.array(own)


def links(distinct: DataFrame, most: int = MOST_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): fingerprints of ``distinct`` (column ``fp``) within ``most`` bits; enough links for whole components."""
    masks = segments(most)
    radius = most // len(masks)
    fp = F.col("fp")
    table = distinct.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(signed(m))) for m in masks])).alias("segment", "value"))
    probes = distinct.select("fp", F.posexplode(F.array(*[lookups(fp, m, radius) for m in masks])).alias("segment", "values"))
    probes = probes.select("segment", F.explode("values").alias("value"), fp.alias("a"))
    hot = cut(table.groupBy("segment", "value").count().where(F.col("count") > bucket).select("segment", "value"))
    found = table.join(hot, ["segment", "value"], "left_anti").join(probes.hint("merge"), ["segment", "value"])
    found = found.where((fp != F.col("a")) & (F.bit_count(fp.bitwiseXOR(F.col("a"))) <= most)).select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    if hot.isEmpty():
        return found.distinct()
    crowded = cut(probes.join(hot, ["segment", "value"], "left_semi").select(F.col("a").alias("fp")).distinct())
    near, far = ball(fp, most // 2), ball(fp, most - most // 2)
    listed = crowded.select("fp", F.explode(far).alias("key"))
    if most % 2:  # only what lies in the smaller ball may stand for a bucket
        least = crowded.select(F.explode(near).alias("key"), fp.alias("a")).groupBy("key").agg(F.min("a").alias("a"))
        listed = listed.join(least.hint("merge"), "key")
    else:
        listed = listed.withColumn("a", F.min("fp").over(Window.partitionBy("key")))
    stars = listed.where(fp != F.col("a")).select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return found.union(stars).distinct()


def grouped(prints: DataFrame, least: Column, most: int = MOST_BITS) -> DataFrame:
    """(fp, first): the smallest ``least`` of the component of each fingerprint; NULLs don't count."""
    held = cut(prints.groupBy("fp").agg(F.min(least).alias("first")))
    roots = components(links(held.select("fp"), most))
    rooted = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(firsts, "root").select("fp", "first")


def classed(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """(key, fingerprint, component_id) of every document."""
    prints = cut(fingerprints(docs, text, [F.col(key).alias("id")]))
    # each fingerprint is there; a left join never sends ``prints`` to all tasks, whose repeated values make a small file
    out = prints.join(grouped(prints, F.col("id"), most), "fp", "left")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def tagged(docs: DataFrame) -> Column:
    """A hash of the whole row; columns that hold maps are hashed as JSON."""
    held = [F.to_json(F.struct(docs[f"`{f.name}`"])) if "map<" in f.dataType.simpleString() else docs[f"`{f.name}`"] for f in docs.schema.fields]
    return F.xxhash64(*held)


def remaining(docs: DataFrame, prints: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` that ``first`` (column ``first``) names, each once; ``prints`` has ``o`` of every row. Rows and
    names are kept in structs of their own, so columns of ``docs`` may have any name."""
    first = cut(first.select(F.col("first.id").alias("i"), F.col("first.tag").alias("g")).distinct())
    # rows alike in every column share key and tag: one of them stays
    alike = prints.groupBy("o.id", "o.tag").count().where("count > 1")
    alike = alike.join(first, same(F.col("id"), F.col("i")) & (F.col("tag") == F.col("g")), "left_semi")
    held = docs.select(whole(docs).alias("row"), tagged(docs).alias("t"))
    kept = held.join(first, same(F.col("row")[key], F.col("i")) & (F.col("t") == F.col("g")), "left_semi")
    if not alike.isEmpty():
        kept = kept.withColumn("k", F.col("row")[key]).dropDuplicates(["k", "t"])
    return kept.select("row.*")


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """One document of each group, with all its columns: the smallest key (NULL only if there is no other; equal keys: the
    smallest hash of the row). Only ids and fingerprints are grouped; the texts of those that go are never moved twice."""
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("id"), tagged(docs).alias("tag"))
    prints = cut(fingerprints(docs, text, [order.alias("o")]))
    return remaining(docs, prints, grouped(prints, F.col("o"), most), key)
