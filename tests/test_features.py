"""Text features against plain versions; no exchange of the feature matrix carries a text."""
import re
from collections import Counter

import numpy as np
import pytest

from veracell.operators import features as X

TEXTS = ["alpha beta alpha", "beta gamma", None, "", "alpha beta alpha", "Gamma gamma delta 7_x",
         "ünï alpha, beta!", "alpha" * 30]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        [(i, float(i), "pq"[i % 2], t, t and t[:4]) for i, t in enumerate(TEXTS)],
        "k long, v double, kind string, t string, u string")


PROFILE = [
    {"column_name": "v", "dtype": "numeric", "unique_count": 8, "median": 3.5},
    {"column_name": "kind", "dtype": "categorical", "unique_count": 2, "median": None},
    {"column_name": "t", "dtype": "free_text", "unique_count": 6, "median": None},
    {"column_name": "u", "dtype": "free_text", "unique_count": 5, "median": None}]


def plain_tfidf(vocab):
    out = np.zeros((len(TEXTS), len(vocab.terms)))
    for i, t in enumerate(TEXTS):
        words = Counter(re.findall(r"\w+", (t or "").lower()))
        x = np.array([words[w] for w in vocab.terms]) * np.array(vocab.idf)
        out[i] = x / (np.sqrt((x * x).sum()) or 1)
    return out


def test_tfidf_equals_counts_of_words(texts):
    vocab = X.vocabulary(texts, "t")
    assert vocab.terms == ["alpha", "beta", "gamma"]
    rows = X.with_tfidf(texts, "t", vocab, "w").orderBy("k").select("w").collect()
    assert np.allclose([r["w"] for r in rows], plain_tfidf(vocab))


def test_tfidf_without_terms_is_empty(texts):
    rows = X.with_tfidf(texts, "t", X.Vocabulary([], []), "w").select("w").collect()
    assert [r["w"] for r in rows] == [[]] * len(TEXTS)


def test_matrix_has_every_feature_in_its_place(texts):
    lay = X.plan_features(texts, PROFILE)
    at = {n: i for i, n in enumerate(lay.names)}
    got = {r["row_id"]: r["x"] for r in X.raw_features(texts, "k", lay).collect()}
    x = np.array([got[i] for i in range(len(TEXTS))])
    assert x.shape == (len(TEXTS), len(lay.names))
    filled = [t or "" for t in TEXTS]
    assert x[:, at["v"]].tolist() == [float(i) for i in range(len(TEXTS))]
    assert x[:, at["kind_q"]].tolist() == [i % 2 for i in range(len(TEXTS))]
    assert x[:, at["t__len"]].tolist() == [len(t) for t in filled]
    for c, cells in (("t", filled), ("u", [t[:4] for t in filled])):
        freq = [cells.count(t) for t in cells]
        assert x[:, at[f"{c}__value_freq"]].tolist() == freq
        assert x[:, at[f"{c}__is_rare"]].tolist() == [n == 1 for n in freq]
    vocab, basis = lay.texts["t"]
    assert np.allclose(x[:, at["t__tfidf_svd_0"]], (plain_tfidf(vocab) @ basis)[:, 0])


def test_no_exchange_carries_text(texts):
    lay = X.plan_features(texts, PROFILE)
    plan = X.raw_features(texts, "k", lay)._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(i).schema().apply(j).dataType().simpleString()
             for i in range(leaves.size()) for j in range(leaves.apply(i).schema().size())}
    assert "string" not in kinds and "array<double>" in kinds


def test_hot_values_and_no_rows(spark, texts):
    many = spark.range(150_000).selectExpr("id AS k", "0.5D AS v", "'p' AS kind",
                                           "if(id % 3 = 0, 'alpha beta', concat('t', id % 50000)) AS t")
    lay = X.plan_features(texts.drop("u"), PROFILE[:3])
    at = {n: i for i, n in enumerate(lay.names)}
    got = X.raw_features(many, "k", lay).selectExpr(
        "row_id % 3 = 0 AS hot", f"x[{at['t__value_freq']}] AS n")
    rows = {(r["hot"], r["n"]): r["count"] for r in got.groupBy("hot", "n").count().collect()}
    assert rows[True, 50000.0] == 50000 and sum(rows.values()) == 150_000
    assert set(n for hot, n in rows if not hot) == {2.0}
    assert X.raw_features(many.limit(0), "k", lay).count() == 0


def test_texts_of_a_batch_are_taken_in_slabs(monkeypatch):
    """What a task holds beside its batch is bounded by bytes, not by the rows of a batch."""
    import pyarrow as pa
    from veracell.functions import arrow
    texts = pa.array(["ab c"] * 50 + [None, "", "é" * 300, "x1 Y"] + ["long " * 90] * 9)
    monkeypatch.setattr(arrow, "SLAB", 100)
    parts = list(arrow.text_slabs(texts))
    assert pa.concat_arrays(parts).equals(texts) and list(arrow.text_slabs(texts[:0])) == []
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 100 for p in parts)
    held = []
    count = X._shape_of
    monkeypatch.setattr(X, "_shape_of", lambda part: held.append(len(part)) or count(part))
    got = X._shape.func(texts)
    assert len(held) > 10 and max(held) <= 30
    assert np.array_equal([list(r.values()) for r in got.to_pylist()], count(texts).T)
