import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veracell.operators import duplicates as D


def greedy(pdf, cols, block, threshold):
    """Leaders in key order, by brute force."""
    out = {}
    for _, g in pdf.groupby(block, dropna=False) if block else [(0, pdf)]:
        leaders = []
        for _, r in g.sort_values("k").iterrows():
            for lead in leaders:
                same = sum((pd.isna(r[c]) and pd.isna(lead[c])) or r[c] == lead[c] for c in cols)
                if same / len(cols) >= threshold:
                    out[r["k"]] = lead["k"]
                    break
            else:
                leaders.append(r)
    return out


@pytest.mark.parametrize("threshold,block", [(0.6, []), (0.8, []), (0.6, ["b"]), (1.0, [])])
def test_near_duplicates_match_brute_force(spark, threshold, block):
    rng = np.random.default_rng(3)
    n = 240
    pdf = pd.DataFrame({"k": np.arange(n), "b": (np.arange(n) % 3 == 0).astype(int)})
    cols = [f"c{i}" for i in range(5)]
    for c in cols:
        pdf[c] = [f"v{x}" for x in rng.integers(0, 6, n)]
        pdf.loc[::3, c] = "hot"  # a third of the rows are alike
        pdf.loc[rng.random(n) < 0.1, c] = None
    got = D.near_duplicates(spark.createDataFrame(pdf), "k", cols, block, threshold).toPandas()
    assert dict(zip(got["row_id"], got["leader_id"])) == greedy(pdf, cols, block, threshold)
    assert (got["similarity"] >= threshold).all()


@pytest.mark.parametrize("largest", [1, 30, 1000])
def test_small_blocks_take_one_exchange(spark, largest, monkeypatch):
    """Blocks of 1 to 60 rows and a null block, over several batches, by both ways."""
    monkeypatch.setattr(D, "BLOCK_ROWS", largest)
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 7, 30, 60, 5, 40]
    pdf = pd.DataFrame({"b": np.repeat([f"g{i}" for i in range(len(sizes))], sizes)})
    pdf.loc[pdf["b"] == "g7", "b"] = None
    pdf.insert(0, "k", rng.permutation(len(pdf)))
    cols = [f"c{i}" for i in range(5)]
    for c in cols:
        pdf[c] = [("long " * 30 if x == 1 else " ") + f"v{x} " for x in rng.integers(0, 4, len(pdf))]
        pdf.loc[rng.random(len(pdf)) < 0.1, c] = None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = D.near_duplicates(spark.createDataFrame(pdf), "k", cols, ["b"], 0.6)
        plan = out._jdf.queryExecution().toString()
        got = out.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = greedy(pdf, cols, ["b"], 0.6)
    assert dict(zip(got["row_id"], got["leader_id"])) == want and len(want) > 60
    assert largest < 60 or "Join" not in plan


@pytest.mark.parametrize("width,keys", [(8, 5), (40, 512), (27, 64)])
def test_near_duplicates_of_wide_tables(spark, width, keys, monkeypatch):
    """More choices of fields than keys a row may have: leaders are compared, not enumerated."""
    monkeypatch.setattr(D, "KEYS", keys)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 50, (12, width)).astype(object)
    rows = []
    for i in range(150):
        r = base[i % 12].copy()
        hit = rng.choice(width, rng.integers(0, width // 3 + 1), replace=False)
        r[hit] = [f"x{v}" for v in rng.integers(0, 3, len(hit))]
        r[rng.random(width) < 0.03] = None
        rows.append(r)
    cols = [f"c{i}" for i in range(width)]
    pdf = pd.DataFrame(rows, columns=cols).map(lambda v: None if v is None else str(v))
    pdf.insert(0, "k", np.arange(150))
    got = D.near_duplicates(spark.createDataFrame(pdf), "k", cols, [], 0.8).toPandas()
    want = greedy(pdf, cols, [], 0.8)
    assert dict(zip(got["row_id"], got["leader_id"])) == want and want
    assert (got["similarity"] >= 0.8).all()


def test_report_of_a_wide_table(spark):
    df = spark.range(60).select("id", *[
        F.when(F.col("id") % 20 == 0, F.lit("a")).otherwise(
            F.concat(F.lit(f"v{i}"), F.col("id"))).alias(f"f{i}") for i in range(27)],
        (F.col("id") % 7).alias("g"))
    cols = [c for c in df.columns if c != "id"]
    rep = D.duplicate_report(df, "id", cols).first()
    assert rep["exact_duplicates"] == 0 and rep["near_duplicates"] == 2


def test_exact_count_grows_by_copies(spark):
    pdf = pd.DataFrame({"k": range(30), "a": [f"x{i % 25}" for i in range(30)], "b": 1.0})
    df = spark.createDataFrame(pdf)
    base = D.exact_duplicate_count(df, "k", ["a", "b"]).first()["exact_duplicates"]
    more = spark.createDataFrame(pd.concat([pdf, pdf.iloc[[0] * 7].assign(k=range(100, 107))]))
    assert base == 5
    assert D.exact_duplicate_count(more, "k", ["a", "b"]).first()["exact_duplicates"] == base + 7


def test_null_is_not_a_string(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, "", "a")],
                               "k long, a string, b string")
    assert D.exact_duplicates(df, "k", ["a", "b"]).count() == 0


def test_report_and_blocking(spark):
    df = spark.createDataFrame([(1, "p1", "x", 1), (2, "p1", "x", 1), (3, "p2", "y", 2)],
                               "k long, patient_id string, a string, b int")
    cols = ["patient_id", "a", "b"]
    assert D.blocking_columns(df, cols) == ["patient_id"]
    rep = D.duplicate_report(df, "k", cols).first()
    assert rep["exact_duplicates"] == 1 and rep["near_duplicates"] == 0


def test_hot_key_join_is_whole(spark):
    from veracell.functions.joins import join_group_facts, join_lines
    rows = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert join_group_facts(rows, groups, "g", 3000, small=100).count() == 3000
    lines = groups.where("g < 1500")
    got = join_lines(rows, lines, "g", 3000, "left", small=100)
    assert got.count() == 3000
    assert got.where("n is not null").count() == rows.where("g < 1500").count()
