"""Token counts from an exact length histogram.

Texts are encoded where they lie and leave their task as one count per encoded length. Everything else is suffix sums
over that small table: documents and tokens at or above a length, what a context limit keeps, and quantiles. The sums
run inside ranges of lengths and carry one total per range, so no task sees the whole table.

NULL and empty texts have length 0. Repeated rows count each time. An empty table gives no rows. Only the text is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from twinloom.session import cut

#: Lengths in one range of the suffix sums, at the least.
RANGE = 1024


def lengths(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from twinloom.llm.encode import byte_bpe

        encode, found = byte_bpe(vocabulary), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found[len(encode(t)) if t else 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["n_tokens", "n"])

    return docs.select(text).mapInArrow(counted, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def histogram(counts: DataFrame) -> DataFrame:
    """For each length that occurs: ``n_docs``, documents and tokens at or above it (``docs_from``, ``tokens_from``), the
    tokens that a context limit of this length keeps (``kept``), all tokens (``n_all``), and the rank interval of its
    documents from below (``rank_from`` to ``rank_to``, 0-based, end exclusive)."""
    part = F.floor(F.col("n_tokens") / RANGE)
    held = cut(counts).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_r", part)  # read twice; texts are encoded once
    sums = held.groupBy("_r").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    after = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    carry = sums.select(
        "_r", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_t0"),
        F.sum("_d").over(all_).alias("_docs"), F.sum("_t").over(all_).alias("n_all"),
    )
    inside = Window.partitionBy("_r").orderBy(F.col("n_tokens").desc())
    out = held.select("_r", "n_tokens", "n_docs", F.sum("n_docs").over(inside).alias("_d"), F.sum("_tokens").over(inside).alias("_t")).join(carry, "_r")
    docs_from, tokens_from = F.col("_d") + F.col("_d0"), F.col("_t") + F.col("_t0")
    return out.select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("n_all") - tokens_from + F.col("n_tokens") * docs_from).alias("kept"), "n_all",
        (F.col("_docs") - docs_from).alias("rank_from"), (F.col("_docs") - docs_from + F.col("n_docs")).alias("rank_to"),
    )


def kept_by_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, n_docs_cut, kept): the tokens that each context limit keeps. Any limit has an answer, not only lengths
    that occur: what is kept is linear between them."""
    asked = F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))])
    longer = F.col("n_tokens") > F.col("limit")
    one = table.select("n_tokens", "n_docs", F.explode(asked).alias("limit"))
    return one.groupBy("limit").agg(
        F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("n_docs_cut"), F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("kept")
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the length of the document at rank floor(share * (documents - 1)) from below."""
    top = table.agg(F.max("rank_to").alias("n")).first()["n"] or 0
    ranks = [(float(s), int(s * (top - 1))) for s in shares] if top else []
    pick = F.lit(None).cast("double")
    found = F.array_compact(F.array(*[F.when((F.col("rank_from") <= r) & (F.col("rank_to") > r), F.lit(s)) for s, r in ranks])) if ranks else F.array(pick)
    return table.select(F.explode(found).alias("share"), "n_tokens").where("share is not null")
