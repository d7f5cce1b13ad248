"""Graph search beside an exhaustive one."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from veracell.llm import nn_descent as nd


def asked():
    return F.pmod("id", F.lit(50)) == 0


def exhaustive(rows, k=5):
    """(query, rank, id, score) over (id, vector) rows that take part."""
    x = np.array([v for _, v in rows], float)
    out = []
    for q, (i, v) in enumerate(rows):
        if i % 50:
            continue
        s = nd.cosines(np.repeat(np.array([v], float), len(x), 0), x)
        best = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if j != q)[:k]
        out += [(i, r + 1, o, -c) for r, (c, o) in enumerate(best)]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * .7).astype("float32")
    x[500:900] = x[7]  # one vector that many rows hold
    x[1000:1400] = x[11] + rng.normal(size=(400, 24)) * 1e-3  # very near copies
    return x


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_recall(spark, cloud):
    rows = [(i, v.tolist()) for i, v in enumerate(cloud)]
    got = [tuple(r) for r in nd.nearest_rows(frame(spark, rows), asked()).collect()]
    want = exhaustive(rows)
    assert len(got) == len(want) == 5 * 60
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    score = {(q, i): s for q, _, i, s in want}
    assert all(score[q, i] == s for q, _, i, s in got if (q, i) in score)
    assert all(i != q for q, _, i, _ in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]),
            (100, [-1.0, 0.5]), (7, [-0.0, 3.0]), (8, [0.0, 4.0])]
    odd = [(150, None), (200, [0.0, 0.0]), (250, [nan, 1.0]), (300, [None, 1.0]), (350, [inf, 1.0]),
           (400, [1.0, 2.0, 3.0]), (450, []), (None, [1.0, 0.0])]
    df = frame(spark, good + odd).withColumns({c: F.lit(1) for c in ("id", "key", "v", "pid", "n")})
    got = sorted(tuple(r) for r in nd.nearest_rows(df, asked()).collect())
    assert got == sorted(exhaustive(good))


def test_few_and_no_rows(spark):
    one = frame(spark, [(0, [1.0, 2.0])])
    assert nd.nearest_rows(one, asked()).collect() == []
    two = frame(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])
    assert [tuple(r)[:3] for r in nd.nearest_rows(two, asked()).collect()] == [(0, 1, 1)]
    assert nd.nearest_rows(frame(spark, []), asked()).collect() == []
