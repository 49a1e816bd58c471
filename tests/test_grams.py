"""Words and pairs counted in batches, against a plain count."""

import math
from collections import Counter

import numpy as np
import pytest

from twinloom.functions import grams
from twinloom.operators import utility
from twinloom.operators.text import tokens
from pyspark.sql import functions as F

WORDS = ["the", "of", "an", "été", "zz", "b2", "café", "no", "on", "it"]


def said(n=120, seed=5):
    r = np.random.default_rng(seed)
    texts = [" ".join(r.choice(WORDS, r.integers(0, 30), p=np.arange(10, 0, -1) / 55)) for _ in range(n)]
    return [*texts, "", "the", "once only", "x" * 300 + " the of"]


def plain(texts):
    total, df = Counter(), Counter()
    for t in texts:
        w = t.split()
        terms = [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]
        total.update(terms)
        df.update(set(terms))
    return total, df


@pytest.mark.parametrize("size,most", [(3, 50), (8, 50), (8, 2), (40, 50), (10_000, 50), (0, 50)])
def test_frequent_terms(spark, size, most):
    texts = said()
    total, df = plain(texts)
    want = sorted((t for t in total if df[t] >= 2), key=lambda t: (-total[t], t))[:size]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    assert grams.frequent(frame, size, 2, most) == [(t, df[t]) for t in want]


def test_pairs_of_rare_words_are_not_counted(spark, monkeypatch):
    """Only pairs of words as frequent as the last term can be terms."""
    asked = []
    count = grams.pair_counts
    monkeypatch.setattr(grams, "pair_counts", lambda texts, among=None: asked.append(among) or count(texts, among))
    texts = [f"the of rare{i} rare{i} the of" for i in range(300)] * 2
    got = grams.frequent(spark.createDataFrame([(t,) for t in texts], "t string"), 2, 2)
    assert got == [("of", 600), ("the", 600)] and sorted(asked[0]) == ["of", "the"]
    assert count(spark.createDataFrame([(t,) for t in texts], "t string"), asked[0]).collect() == [("the of", 1200, 600)]


def test_text_vectors(spark):
    texts = [*said(), None, "The, OF! the—it."]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    words = {r["id"]: r["w"] or [] for r in frame.select("id", tokens(F.col("t")).alias("w")).collect()}
    total, df = plain([" ".join(w) for w in words.values()])
    vocab = sorted((t for t in total if df[t] >= 2), key=lambda t: (-total[t], t))[:12]
    assert any(" " in t for t in vocab)
    idf = [math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab]
    got = utility.text_vectors(frame, "t", ["id"], 12)
    assert got.dtypes == [("id", "bigint"), ("features", "array<double>")]
    rows = got.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        n, _ = plain([" ".join(words[r["id"]])])
        w = np.array([(1 + math.log(n[t])) * i if n[t] else 0.0 for t, i in zip(vocab, idf)])
        assert np.allclose(r["features"], w / (np.linalg.norm(w) or 1.0), atol=1e-12)


def test_texts_without_terms(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    assert [r["features"] for r in utility.text_vectors(frame, "t", ["id"]).collect()] == [[0.0], [0.0]]
    assert grams.frequent(frame.limit(0).select("t"), 5, 2) == []
