"""Joins that keep a hot key from landing in one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_HOT_KEYS = 1000
SMALL = 100_000


def _hot_from(total: int, small: int) -> int:
    return max(total // MAX_HOT_KEYS, small) + 1


def join_group_facts(rows: DataFrame, groups: DataFrame, key: str, total: int,
                     size_col: str = "n", small: int = SMALL) -> DataFrame:
    """Inner join of rows with a table that has one line per key and a count of its rows.

    Keys that hold over 1/1000 of all rows number at most 1000, so that part of the group
    table is broadcast and its rows never move; all other keys take the shuffled join.
    """
    hot_from = _hot_from(total, small)
    if total < hot_from:
        return rows.join(groups, key)
    hot = groups.where(F.col(size_col) >= hot_from)
    cold = groups.where(F.col(size_col) < hot_from)
    hot_keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(hot_keys, key, "left_anti").join(cold, key))


def join_lines(rows: DataFrame, lines: DataFrame, key: str, total: int, how: str = "inner",
               small: int = SMALL) -> DataFrame:
    """Join of rows with one line per key when the rows per key are not known yet.

    They are counted (before the shuffle) only where a hot key can exist at all.
    """
    hot_from = _hot_from(total, small)
    if total < hot_from:
        return rows.join(lines, key, how)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(
        F.col("__n") >= hot_from).select(key)
    hot_lines = F.broadcast(lines.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_semi").join(hot_lines, key, how).unionByName(
        rows.join(F.broadcast(hot), key, "left_anti").join(lines, key, how))
