"""Words and word pairs of many texts at a time: a batch of texts becomes whole numbers once, and numbers are counted.

Texts are given as their words, parted by single spaces. A task turns the words of an Arrow batch into codes of the batch, counts
(text, code) cells with numpy and passes on one row per different term of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from twinloom.session import cut

COUNTS = "term string, total long, df long"
#: Texts whose vectors are made at a time.
ROWS = 1024
#: Words that pairs may be looked up among; with more, all pairs are counted.
MOST_WORDS = 50_000


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code) of every word in order, and the words by code."""
    lists = pc.split_pattern(texts, " ")
    row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    held = lists.flatten().dictionary_encode()
    code = held.indices.to_numpy().astype(np.int64)
    empty = pc.index(held.dictionary, "").as_py()  # all that an empty text holds
    kept = code != empty
    return row[kept], code[kept], held.dictionary


def paired(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, second) of neighbours; a word of code -1 has none."""
    on = (row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
    return row[1:][on], code[:-1][on], code[1:][on]


def tallied(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, how often it occurs, in how many texts)."""
    keys, at = np.unique(key, return_inverse=True)
    cells = np.unique(row * max(len(keys), 1) + at)
    return keys, np.bincount(at, minlength=len(keys)), np.bincount(cells % max(len(keys), 1), minlength=len(keys))


def _added(texts: DataFrame, part) -> DataFrame:
    return texts.mapInArrow(part, COUNTS).groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def _made(term: pa.Array, total: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(total, pa.int64()), pa.array(df, pa.int64())], names=["term", "total", "df"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(term, total, df) of the words of a one-column table of texts: how often, and in how many texts."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, words = coded(b.column(0))
            n = len(words)
            once = np.unique(row * n + code) % n if n else code
            total, df = np.bincount(code, minlength=n), np.bincount(once, minlength=n)
            yield _made(words, total, df)

    return _added(texts, part)


def pair_counts(texts: DataFrame, among: list[str] | None = None) -> DataFrame:
    """The same for pairs of neighbouring words ("first second"); ``among`` leaves out pairs with any other word."""
    held = None if among is None else pa.array(among, pa.string())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, words = coded(b.column(0))
            if held is not None and len(words):
                code = np.where(pc.is_in(words, value_set=held).to_numpy(zero_copy_only=False)[code], code, -1)
            row, first, second = paired(row, code)
            n = max(len(words), 1)
            keys, total, df = tallied(row, first * n + second)
            yield _made(pc.binary_join_element_wise(*[words.take(pa.array(k, pa.int64())) for k in (keys // n, keys % n)], " "), total, df)

    return _added(texts, part)


def frequent(texts: DataFrame, size: int, min_df: int, most: int = MOST_WORDS) -> list[tuple[str, int]]:
    """(term, df) of the ``size`` most frequent words and pairs found in at least ``min_df`` texts, ties by the term.

    A pair is not more frequent than its words, nor found in more texts. So once ``size`` words are known, only pairs of words that
    are as frequent as the last of these can be among the terms, and no others are counted. At most ``size`` words, as many
    pairs and ``most`` words for the pairs reach the driver.
    """
    words = cut(word_counts(texts).where(F.col("df") >= min_df))
    by = [F.desc("total"), F.col("term")]
    top = words.orderBy(*by).limit(size).collect()
    among = None
    if size and len(top) == size:
        able = words.where(F.col("total") >= top[-1]["total"]).select("term").limit(most + 1).collect()
        among = [r["term"] for r in able] if len(able) <= most else None
    pairs = pair_counts(texts, among).where(F.col("df") >= min_df).orderBy(*by).limit(size).collect()
    best = sorted([*top, *pairs], key=lambda r: (-r["total"], r["term"]))[:size]
    return [(r["term"], r["df"]) for r in best]


class Counter:
    """How often each term of a vocabulary of words and pairs occurs in a text."""

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary)
        split = [t.split(" ") for t in vocabulary]
        self.words = sorted({w for t in split for w in t})
        number = {w: i for i, w in enumerate(self.words)}
        self.single = np.full(len(self.words) + 1, -1)  # the last one stands for all other words
        for i, t in enumerate(split):
            if len(t) == 1:
                self.single[number[t[0]]] = i
        keys = np.array([number[t[0]] * len(number) + number[t[1]] for t in split if len(t) == 2], np.int64)
        order = np.argsort(keys)
        self.pairs, self.at = keys[order], np.array([i for i, t in enumerate(split) if len(t) == 2], np.int64)[order]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """(texts, terms)."""
        row, code, words = coded(texts)
        known = pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, pa.string())), -1).to_numpy().astype(np.int64)
        code = known[code] if len(code) else code
        term = self.single[code]
        cells = [(row * self.size + term)[term >= 0]]
        if len(self.pairs):
            row, first, second = paired(row, code)
            key = first * len(self.words) + second
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            cells.append((row * self.size + self.at[at])[self.pairs[at] == key])
        return np.bincount(np.concatenate(cells), minlength=len(texts) * self.size).reshape(-1, self.size)


def weighted(texts: DataFrame, keep: list[str], said: str, vocabulary: list[str], idf: list[float]) -> DataFrame:
    """(keep..., features): (1 + ln count) * idf of every term, each text scaled to unit length."""
    factors, size = np.array(idf), len(vocabulary)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                n = counter.counts(b.column(len(keep)))
                w = np.where(n > 0, 1.0 + np.log(np.maximum(n, 1)), 0.0) * factors
                length = np.sqrt((w * w).sum(axis=1, keepdims=True))
                w /= np.where(length > 0, length, 1.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * size, pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], names=[*keep, "features"])

    held = texts.select(*keep, said)
    return held.mapInArrow(part, held.select(*keep, F.array(F.lit(0.0)).alias("features")).schema)
