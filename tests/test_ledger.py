"""The audit trail as a history, and null patterns of many columns."""
import numpy as np
from pyspark.sql import functions as F

from veracell.operators import clean as C, profile as P


def test_the_last_change_of_a_cell_counts(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, "c")],
                               "k long, x double, s string")
    t1, t2 = (F.lit(f"2024-01-0{i} 00:00:00").cast("timestamp") for i in (1, 2))
    lines = [(9999, "x", 1, "5.0", 1), (10000, "x", 1, "6.0", 1), (3, "x", 1, None, 2),
             (4, "s", 2, "z", 1), (5, "__all__", 3, None, 2)]
    book = spark.createDataFrame(lines[::-1], "n long, column_name string, row_id long, "
                                              "new_value string, day int").select(
        F.concat(F.lit("TXN-20240101-"), F.format_string("%04d", "n")).alias(
            "transaction_id"), F.when(F.col("day") == 1, t1).otherwise(t2).alias("timestamp"),
        "row_id", "column_name", "new_value", F.when(F.col("column_name") == "__all__",
                                                     "remove_row").otherwise("winsorize").alias("action"))
    first = sorted(map(tuple, C.rebuild(df, "k", book, t1).collect()))
    assert first == [(1, 6.0, "a"), (2, 2.0, "z"), (3, 3.0, "c")]
    last = {r[0]: tuple(r)[1:] for r in C.rebuild(df, "k", book).collect()}
    assert last == {1: (None, "a"), 2: (2.0, "z"), 3: (None, None)}
    turns = [r[0][13:] for r in C.replay(book).select("transaction_id").collect()]
    assert turns == ["0004", "9999", "10000", "0003", "0005"]


def test_gaps_of_all_pairs_of_columns(spark):
    rng = np.random.default_rng(1)
    gone = rng.random((300, 30)) < .3
    gone[:, 29] = gone[:, 0]  # far apart in the table
    df = spark.createDataFrame([[None if g else 1.0 for g in row] for row in gone.tolist()],
                               ", ".join(f"c{i} double" for i in range(30)))
    got = {(r[0], r[1]): r[2] for r in P.missing_correlations(df).collect()}
    r = np.corrcoef(gone.T.astype(float))
    want = {(f"c{i}", f"c{j}"): round(r[i, j], 3) for i in range(30) for j in range(i + 1, 30)
            if abs(r[i, j]) > .3}
    assert got == want and got["c0", "c29"] == 1.0
