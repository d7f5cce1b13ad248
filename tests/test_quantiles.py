import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veracell.operators.numbering import number_rows
from veracell.operators import quantiles as Q
from veracell.operators.quantiles import quantiles, value_ranks, with_average_rank


def skewed(n=3000):
    rng = np.random.default_rng(1)
    v = np.where(np.arange(n) % 3 == 0, 7.0, rng.lognormal(1, 1, n))  # a third share one value
    w = rng.normal(size=n)
    w[::17] = np.nan
    return pd.DataFrame({"v": v, "w": w})


def test_bracketed_quantiles_are_exact(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = quantiles(df, {"v": F.col("v"), "w": F.col("w")}, probs, small=50)
    np.testing.assert_allclose(got["v"], pdf["v"].quantile(probs), rtol=1e-12)
    np.testing.assert_allclose(got["w"], pdf["w"].quantile(probs), rtol=1e-9)


def test_bracketed_quantiles_end_on_stepped_columns(spark):
    """Flags, three values, a constant, heavy steps, infinities: each round must shrink the rest."""
    n = 2000
    i = np.arange(n)
    pdf = pd.DataFrame({
        "flag": (i % 2).astype(float), "three": (i % 3).astype(float), "same": 4.0,
        "step": np.where(i < 1000, 1.0, np.where(i < 1990, 2.0, i)),
        "wide": np.where(i == 0, -np.inf, np.where(i == 1, np.inf, i % 7))})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.3333, 0.4999, 0.5, 0.75, 1.0]
    for small in (1, 10, 100):
        got = quantiles(df, {c: F.col(c) for c in pdf}, probs, small=small)
        for c in pdf:
            v = np.sort(pdf[c].to_numpy())
            for p, x in zip(probs, got[c]):
                lo, hi = int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1)))
                w = p * (n - 1) - lo
                want = v[lo] if v[lo] == v[hi] or w == 0 else (1 - w) * v[lo] + w * v[hi]
                assert x == want or abs(x - want) < 1e-12 * abs(want)


def test_quantiles_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    for small in (0, 10):
        got = quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5], small=small)
        assert got == {"a": [None], "b": [1.5]}


def test_average_ranks(spark):
    pdf = skewed()
    got = with_average_rank(spark.createDataFrame(pdf[["v"]]), "v").toPandas().sort_values("v")
    want = pdf["v"].rank().sort_values().to_numpy()
    np.testing.assert_allclose(np.sort(got["avg_rank"]), np.sort(want))


def test_ranks_do_not_depend_on_ranges(spark):
    df = spark.createDataFrame(skewed()[["v"]])
    a = value_ranks(df, "v", buckets=3).orderBy("v").toPandas()
    b = value_ranks(df.repartition(5), "v", buckets=40).orderBy("v").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_numbering(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 37 % 1000)
    got = number_rows(df, ["k"]).select("k", "n").toPandas()
    assert (got["n"] == got["k"] + 1).all()


def test_ranks_between_the_same_bounds_share_a_sketch(spark, monkeypatch):
    asked = []
    sketch = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: asked.append(1) or sketch(*a))
    v = np.random.default_rng(3).normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": -v}))
    probs = [0.1, 0.25, 0.5, 0.9]
    got = quantiles(df, {"v": F.col("v"), "w": F.col("w")}, probs, small=500)
    np.testing.assert_allclose(got["v"], np.quantile(v, probs), rtol=1e-12)
    np.testing.assert_allclose(got["w"], np.quantile(-v, probs), rtol=1e-12)
    assert len(asked) == 2


def test_group_quantiles_settle_digit_by_digit(spark, monkeypatch):
    """Order statistics of weighted groups with ties, both signs and zeros, whatever is held."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=900), np.zeros(300), -np.zeros(200), [1e300, -1e-300],
                        np.repeat(1.5, 400), 1.5 + np.arange(50) * 2.0 ** -50])
    g, n = rng.integers(0, 3, len(v)), rng.integers(0, 4, len(v))
    long = spark.createDataFrame(pd.DataFrame({"g": g.astype(np.int32), "v": v, "n": n})
                                 ).repartition(5).unionByName(spark.sql(
                                     "SELECT 1 AS g, CAST(NULL AS DOUBLE) AS v, 9L AS n"))
    probs = [0.0, 1 / 6, 0.5, 0.77, 0.95, 1.0]
    for held in (Q.LAST_ROWS, 0):
        monkeypatch.setattr(Q, "LAST_ROWS", held)
        got = Q.group_quantiles(long, 4, probs)
        for k in range(3):
            np.testing.assert_allclose(got[k], np.quantile(np.repeat(v[g == k], n[g == k]), probs),
                                       rtol=1e-12, atol=0)
        assert got[3] == [None] * len(probs)
