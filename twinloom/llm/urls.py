"""URL filters: a sort-merge range join of pages with nested host and path rules.

A host is turned round (``news.example.org`` becomes ``org.example.news.``), so a rule for a host and its subdomains is
an interval of keys. Rules and pages are dealt by ranges of that key and sorted; one pass over the sorted rows keeps a
stack of the rules whose interval is open. Hosts nest, so the stack is as deep as a host has labels. Of the open rules
whose path starts the page's path the longest wins (host and path together; equal lengths: the longer host, then block).

Ranges come from a bounded sample of keys and only decide how even the tasks are. A key that holds many rows gets
several ranges; its pages are spread over them by a hash. A rule is copied to each range its interval meets, which are
many only for rules that contain many range borders.

NULL url or one without ``://``: empty host and path, which only a rule with an empty host fits. NULL ids, repeated
pages and other columns pass through. No rules: the default verdict everywhere. Rules with a NULL host or path are rejected.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled for the ranges, per range.
SAMPLE_PER_RANGE = 60


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def turned(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def ranges(keys: DataFrame, parts: int) -> list[str]:
    """At most ``parts - 1`` borders from a sample of at most about ``SAMPLE_PER_RANGE * parts`` keys."""
    n = keys.count()
    want = SAMPLE_PER_RANGE * parts
    some = keys if n <= want else keys.sample(want / n, 42)
    got = sorted(r[0] for r in some.limit(2 * want).collect())
    return [got[len(got) * i // parts] for i in range(1, parts)] if got else []


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url", parts: int | None = None) -> DataFrame:
    """(key, host, path, rule, verdict): ``rule`` is the host and path of the rule that decides, else NULL.

    ``rules`` has host, path and verdict (``allow`` or ``block``).
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url))
    held = pages.select(F.col(key).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_key", turned(F.col("host")))
    borders = ranges(held.select("_key"), parts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The range of each page; rows of a key that is itself a border are spread over the ranges it touches."""
        for b in batches:
            at = []
            for k, salt in zip(b.column("_key").to_pylist(), b.column("_salt").to_pylist()):
                lo, hi = bisect.bisect_left(borders, k), bisect.bisect_right(borders, k)
                at.append(lo + salt % (hi - lo + 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at, pa.int32())], names=[*b.schema.names[:-1], "_part"])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule for each range that its interval of keys meets."""
        for b in batches:
            rows = []
            for r in b.to_pylist():
                lo = bisect.bisect_left(borders, r["_key"])
                hi = bisect.bisect_left(borders, r["_key"][:-1] + "/")  # the character after the dot
                rows += [r | {"_part": p} for p in range(lo, hi + 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema.append(pa.field("_part", pa.int32())))

    bad = F.raise_error(F.lit("a rule needs a host and a path"))
    kept = rules.select(
        F.coalesce("host", bad).alias("host"), F.coalesce("path", bad).alias("path"), F.coalesce("verdict", bad).alias("_verdict")
    ).distinct().withColumn("_key", turned(F.col("host")))
    ids = pages.schema[key].dataType.simpleString()
    # the salt spreads a frequent key, so it must differ between its pages
    salted = held.withColumn("_salt", F.pmod(F.xxhash64("_id", "path"), F.lit(1 << 30)))
    left = salted.mapInArrow(dealt, f"_id {ids}, host string, path string, _key string, _part int").withColumn("_verdict", F.lit(None).cast("string"))
    right = kept.mapInArrow(copied, "host string, path string, _verdict string, _key string, _part int").withColumn("_id", F.lit(None).cast(ids))
    order = ["_part", "_key", F.col("_verdict").isNull()]
    both = left.unionByName(right).repartition(parts, "_part").sortWithinPartitions(*order)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # of (key, host, {path: verdict}, path lengths)
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("host", "path", "_key", "_part", "_verdict")]
            at, out = [], []
            for i, (h, p, k, q, v) in enumerate(zip(*cols)):
                if q != part:
                    part, stack = q, []
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if v is None:
                    at.append(i)
                    out.append(longest(stack, p))
                    continue
                if not stack or stack[-1][0] != k:
                    stack.append((k, h, {}, set()))
                stack[-1][2][p] = "block" if "block" in (v, stack[-1][2].get(p)) else v
                stack[-1][3].add(len(p))
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("host"), rows.column("path"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] or default for x in out], pa.string())],
                names=["_id", "host", "path", "rule", "verdict"],
            )

    return both.mapInArrow(swept, f"_id {ids}, host string, path string, rule string, verdict string").withColumnRenamed("_id", key)


def longest(stack: list[tuple], path: str) -> tuple[str | None, str | None]:
    """The longest rule among the open hosts whose path starts ``path``."""
    found = None
    for _, host, paths, sizes in stack:
        n = max((n for n in sizes if n <= len(path) and path[:n] in paths), default=None)
        if n is not None and (found is None or (len(host) + n, len(host)) > found[0]):
            found = ((len(host) + n, len(host)), host + path[:n], paths[path[:n]])
    return (found[1], found[2]) if found else (None, None)
