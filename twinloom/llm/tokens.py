"""Token ids of a corpus as checksummed segments, coded by ``rangecoder``.

Documents are dealt by ranges of their id (or of another order that is asked for) and sorted; each task encodes its texts, appends the end id to each, and
codes runs of whole documents as segments of about ``SEGMENT_IDS`` ids. Spark writes the segments (one binary cell
each, with the index of their documents) to a folder that all executors share, so tasks can be run again. Reading decodes
each segment alone; where a segment begins in the whole stream is a running sum over (range, segment), of which there
are few, and never over documents.

NULL and empty texts are the end id alone. A NULL id comes first. Rows with equal ids stand in the order of a hash of
their text. An empty table writes no segment. The id column is a long; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinloom.llm import rangecoder
from twinloom.llm.encode import PIECE, WORDS
from twinloom.session import checkpoint_dir

END = 1
SEGMENT_IDS = 1 << 22
#: Rows encoded at a time, at most; also at most about ``PIECE`` bytes, or one row.
ROWS = 4096
WRITTEN = "part int, segment int, n_ids long, keys binary, sizes binary, data binary"
READ = "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, folder: str, vocabulary: str = WORDS, end: int = END, key: str = "doc_id", text: str = "text", order: list[Column] | None = None) -> None:
    """``order`` replaces the order by id: columns of ``docs``."""
    held = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *[c.alias(f"o{i}") for i, c in enumerate(order or [])])
    order = [f"o{i}" for i in range(len(order))] if order else [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    placed = held.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from twinloom.llm.encode import word_bpe

        encoder, part, segment = word_bpe(vocabulary), TaskContext.get().partitionId(), 0
        keys, runs, counts, n = [], [], [], 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate(runs)
            known = np.array([k is not None for k in keys], np.uint8)
            packed = zlib.compress(known.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes())
            sizes = zlib.compress(np.concatenate(counts).astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()), *[pa.array([x], pa.binary()) for x in (packed, sizes, rangecoder.encode(ids))]],
                names=["part", "segment", "n_ids", "keys", "sizes", "data"],
            )

        for b in filter(len, batches):
            texts = b.column("t").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64, b.num_rows + 1, 8 * texts.offset)
            data, lo = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)  # rows of about a piece of text
                hi = min(hi, lo + ROWS, b.num_rows)
                ids, size = encoder.packed(data[ends[lo] : ends[hi]], ends[lo + 1 : hi + 1] - ends[lo])
                keys += b.column("k").slice(lo, hi - lo).to_pylist()
                runs.append(np.insert(ids, np.cumsum(size), np.array(end, ids.dtype)))
                counts.append(size + 1)
                n, lo = n + len(runs[-1]), hi
                if n >= SEGMENT_IDS:
                    yield made()
                    keys, runs, counts, n, segment = [], [], [], 0, segment + 1
        if keys:
            yield made()

    placed.mapInArrow(coded, WRITTEN).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, _, keys, sizes, data in zip(*(c.to_pylist() for c in b.columns)):
                n_tokens = np.frombuffer(zlib.decompress(sizes), "<i8")
                raw, n = zlib.decompress(keys), len(n_tokens)
                known, ids = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n)
                body = memoryview(rangecoder.decode(data).astype("<u4").tobytes())
                ends = np.cumsum(n_tokens)
                begins = ends - n_tokens
                sums = [zlib.crc32(body[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(ids, mask=known == 0), pa.array(begins), pa.array(n_tokens), pa.array(sums, pa.int64())],
                    names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(folder)
    sizes = files.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_a"))  # a row per task that wrote
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("segment"))), F.lit(0))
    starts = sizes.select("part", "segment", inside.alias("_b")).join(parts, "part")
    docs = files.select("part", "segment", "n_ids", "keys", "sizes", "data").mapInArrow(opened, READ)
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("_a") + F.col("_b") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def row_order(docs: DataFrame) -> list[Column]:
    """Columns by which the rows of ``docs`` stand as they were written: number of the part file (names sort as
    text up to five digits only), file and row of a plain scan; the place of the row in any other table."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return [F.monotonically_increasing_id()]
    path = F.col("_metadata.file_path")
    return [F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).try_cast("long"), path, F.col("_metadata.row_index")]


def written(docs: DataFrame, folder: str | None = None, vocabulary: str = WORDS, end: int = END, order: list[Column] | None = None) -> DataFrame:
    """Write the corpus and read it back."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, vocabulary, end, order=order)
    return read(spark, folder)
