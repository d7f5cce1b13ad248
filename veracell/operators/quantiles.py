"""Exact quantiles and exact average ranks at any row count.

Small inputs use Spark's ``percentile``. Its buffer holds every distinct value, so beyond
``SMALL`` rows each quantile is taken from its two order statistics. An order statistic is kept
between two open bounds; a round picks two values near it with ``percentile_approx`` and counts
the rows below and at them. It then is one of the two, or lies between two closer bounds that
leave both values out, so every round ends or shrinks the rest. Every round is a scan with
map-side aggregation; no value is shuffled.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from veracell.functions.joins import join_group_facts
from veracell.functions.session import cut_lineage

SMALL = 1_000_000
#: Values that ``percentile`` may hold at once, over all columns of one aggregation.
HELD_VALUES = 6_000_000
SKETCH = 10_000
MAX_ROUNDS = 100
#: Columns whose values one aggregation holds or sketches at once.
TOGETHER = 24


@dataclass
class _Rank:
    """The order statistic ``rank`` (from 0) of column ``name``, between two open bounds."""
    name: str
    rank: int
    below: int  # rows at or under the lower bound
    inside: int  # rows between the bounds
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def open_rows(self) -> Column:
        v = F.col(self.name)
        ok = v.isNotNull()
        if self.low is not None:
            ok &= v > F.lit(self.low)
        if self.high is not None:
            ok &= v < F.lit(self.high)
        return F.when(ok, v)


def quantiles(df: DataFrame, exprs: dict[str, Column], probs: list[float],
              small: int = SMALL, rows: int | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of named double expressions (nulls left out).

    The answer is ``len(exprs) x len(probs)`` numbers, so it may live on the driver.
    """
    names = list(exprs)
    rows = df.count() if rows is None else rows
    out: dict[str, list[float | None]] = {}
    step = TOGETHER if rows > small else max(1, min(TOGETHER, HELD_VALUES // max(rows, 1)))
    for i in range(0, len(names), step):
        part = {c: exprs[c] for c in names[i:i + step]}
        out |= (_direct if rows <= small else _bracketed)(df, part, probs, small)
    return out


def _named(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[e.cast("double").alias(f"q{i}") for i, e in enumerate(exprs.values())])


def _direct(df, exprs, probs, small):
    data = _named(df, exprs)
    row = data.agg(*[F.percentile(f"q{i}", F.array(*map(F.lit, probs))).alias(f"q{i}")
                     for i in range(len(exprs))]).first()
    return {c: list(row[i]) if row[i] is not None else [None] * len(probs)
            for i, c in enumerate(exprs)}


def _bracketed(df, exprs, probs, small):
    data = _named(df, exprs)
    counts = data.agg(*[F.count(c).alias(c) for c in data.columns]).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    for c in data.columns:
        for p in probs if counts[c] else []:
            at = p * (counts[c] - 1)
            for k in (math.floor(at), math.ceil(at)):
                ranks.setdefault((c, k), _Rank(c, k, 0, counts[c]))
    for _ in range(MAX_ROUNDS):
        todo = [r for r in ranks.values() if r.value is None and r.inside > small]
        if not todo:
            break
        for i in range(0, len(todo), TOGETHER):
            _narrow(data, todo[i:i + TOGETHER])
    else:
        raise RuntimeError(f"quantiles are not settled after {MAX_ROUNDS} rounds")
    left = [r for r in ranks.values() if r.value is None]
    for i in range(0, len(left), TOGETHER):
        part = left[i:i + TOGETHER]
        # The middle of the rank's share picks exactly one value, without interpolation.
        got = data.select(*[r.open_rows().alias(f"o{j}") for j, r in enumerate(part)]).agg(*[
            F.expr(f"percentile_disc({(r.rank - r.below + 0.5) / r.inside!r}D) "
                   f"within group (order by o{j})").alias(f"v{j}")
            for j, r in enumerate(part)]).first()
        for j, r in enumerate(part):
            r.value = got[j]
    out = {}
    for c, name in zip(data.columns, exprs):
        out[name] = [None] * len(probs)
        for j, p in enumerate(probs if counts[c] else []):
            at = p * (counts[c] - 1)
            lo, hi = math.floor(at), math.ceil(at)
            a, b = ranks[c, lo].value, ranks[c, hi].value
            out[name][j] = a if a == b or lo == hi else (hi - at) * a + (at - lo) * b
    return out


#: Bits of a value that one round settles, and rows at which the rest comes to the driver.
DIGIT, LAST_ROWS = 12, 1_000_000


def _keys(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = (v + 0.0).view(np.uint64)  # one zero
    return bits ^ np.where(bits >> np.uint64(63), np.uint64(2 ** 64 - 1), np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return (keys ^ np.where(keys >> np.uint64(63), np.uint64(1 << 63),
                            np.uint64(2 ** 64 - 1))).view(np.float64)


def group_quantiles(long: DataFrame, groups: int, probs: list[float]) -> list[list[float | None]]:
    """Linear-interpolated quantiles in each of a few groups of a (g int, v double) table, from 0.

    A third column ``n`` counts rows other than once. Order statistics are found digit by digit of
    their binary form: a round counts the next twelve bits of the values that share the bits known
    so far. No value is shuffled, and no task holds the values of a group.
    """
    if "n" not in long.columns:
        long = long.withColumn("n", F.lit(1).cast("long"))
    rows = long.where("v IS NOT NULL AND n > 0").select("g", "v", F.col("n").cast("long"))
    size = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    ranks = sorted({(g, k) for g, n in size.items() for p in probs
                    for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    known = {r: (0, r[1], size[r[0]]) for r in ranks}  # bits, rank among those that share them
    bits = 0

    def shared(of: list[tuple[int, int]]):
        """Where the rows whose first bits are asked for stand in ``of``, and their keys."""
        asked = np.array([(g << 48) | (p << (48 - bits)) for g, p in of], np.uint64)
        by = np.argsort(asked)
        asked = asked[by]

        def find(b: pa.RecordBatch):
            key = _keys(b.column(1).to_numpy())
            head = np.zeros(len(key), np.uint64) if not bits else \
                (key >> np.uint64(64 - bits)) << np.uint64(48 - bits)
            head |= b.column(0).to_numpy().astype(np.uint64) << np.uint64(48)
            at = np.minimum(np.searchsorted(asked, head), len(asked) - 1)
            hit = np.flatnonzero(asked[at] == head)
            return by[at[hit]], key[hit], b.column(2).to_numpy()[hit]
        return find

    while ranks and bits < 48:
        of = sorted({(g, known[g, k][0]) for g, k in ranks})
        if sum({(g, known[g, k][0]): known[g, k][2] for g, k in ranks}.values()) <= LAST_ROWS:
            break
        find, shift, cells = shared(of), np.uint64(64 - bits - DIGIT), 1 << DIGIT

        def count(batches):
            total = np.zeros(len(of) * cells, np.int64)
            for b in batches:
                at, key, n = find(b)
                digit = ((key >> shift) & np.uint64(cells - 1)).astype(np.int64)
                np.add.at(total, at * cells + digit, n)
            live = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])],
                                             names=["slot", "n"])

        got = rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(
            F.sum("n").alias("n")).toArrow()
        total = np.zeros(len(of) * cells, np.int64)
        total[got.column("slot").to_numpy()] = got.column("n").to_numpy()
        sums = total.reshape(len(of), cells)
        upto = np.cumsum(sums, axis=1)
        for g, k in ranks:
            head, rank, _ = known[g, k]
            i = of.index((g, head))
            digit = int(np.searchsorted(upto[i], rank, "right"))
            known[g, k] = ((head << DIGIT) | digit, rank - int(upto[i][digit] - sums[i][digit]),
                           int(sums[i][digit]))
        bits += DIGIT
    values = {}
    if ranks:
        of = sorted({(g, known[g, k][0]) for g, k in ranks})
        find = shared(of)

        def send(batches):
            for b in batches:
                at, key, n = find(b)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_values(key)),
                                                      pa.array(n)], names=["i", "v", "n"])

        # Values that agree in 48 bits or so many rows: few, once equal ones are counted.
        got = rows.mapInArrow(send, "i long, v double, n long").groupBy("i", "v").agg(
            F.sum("n").alias("n")).toArrow()
        i, v, n = (got.column(c).to_numpy() for c in ("i", "v", "n"))
        for g, k in ranks:
            head, rank, _ = known[g, k]
            own = i == of.index((g, head))
            by = np.argsort(v[own], kind="stable")
            values[g, k] = float(v[own][by][np.searchsorted(np.cumsum(n[own][by]), rank,
                                                            "right")])
    out = []
    for g in range(groups):
        line: list[float | None] = []
        for p in probs:
            at = p * (size.get(g, 0) - 1)
            lo, hi = math.floor(at), math.ceil(at)
            a, b = values.get((g, lo)), values.get((g, hi))
            line.append(a if a == b or lo == hi else (hi - at) * a + (at - lo) * b)
        out.append(line)
    return out


def _narrow(data: DataFrame, todo: list[_Rank]) -> None:
    slack = 2.0 / SKETCH
    # Ranks of a column between the same bounds ask one sketch.
    spans: dict[tuple, list[_Rank]] = {}
    for r in todo:
        spans.setdefault((r.name, r.low, r.high), []).append(r)
    sketches = data.agg(*[F.percentile_approx(own[0].open_rows(), F.array(*[
        F.lit(min(max((r.rank - r.below) / max(r.inside - 1, 1) + d, 0.0), 1.0))
        for r in own for d in (-slack, slack)]), SKETCH).alias(f"p{i}")
        for i, own in enumerate(spans.values())]).first()
    near = {id(r): got[2 * j:2 * j + 2] for own, got in zip(spans.values(), sketches)
            for j, r in enumerate(own)}
    picked = [near[id(r)] for r in todo]
    # Ranks next to each other mostly pick the same values, which are counted once.
    values = list(dict.fromkeys((r.name, v) for r, pair in zip(todo, picked) for v in pair))
    got = data.agg(*[F.count_if(cond).alias(f"{k}{i}") for i, (c, v) in enumerate(values)
                     for k, cond in zip("ab", (F.col(c) < v, F.col(c) <= v))]).first()
    n = {key: got[2 * i:2 * i + 2] for i, key in enumerate(values)}
    for i, r in enumerate(todo):
        lo, hi = picked[i]
        (a, b), (c, d) = n[r.name, lo], n[r.name, hi]
        if a <= r.rank < b:
            r.value = lo
        elif c <= r.rank < d:
            r.value = hi
        elif r.rank < a:
            r.high, r.inside = lo, a - r.below
        elif r.rank >= d:
            r.low, r.inside, r.below = hi, r.below + r.inside - d, d
        else:
            r.low, r.high, r.inside, r.below = lo, hi, c - b, b


#: Distinct values that one ordered range holds, about.
RANGE_VALUES = 500_000


def _ranges(counts: DataFrame, buckets: int | None) -> int:
    """How many ranges to order apart: more where there are more distinct values."""
    return buckets or max(64, -(-counts.count() // RANGE_VALUES))


def value_ranks(df: DataFrame, value: str, buckets: int | None = None, weight: Column | None = None,
                extra: Column | None = None) -> DataFrame:
    """(value, n, below, avg_rank) for every distinct value of a double column.

    ``weight`` counts rows other than once; ``extra`` is a second count carried along.

    Equal values are counted before the shuffle, distinct values are cut into ranges at literal
    bounds (so a retried task sees the same ranges), and each range is numbered on its own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("n"),
        F.sum(F.lit(0) if extra is None else extra).alias("extra"))
    buckets = _ranges(counts, buckets)
    steps = [i / buckets for i in range(1, buckets)]
    cuts = counts.agg(F.percentile_approx(value, F.array(*map(F.lit, steps)), 1000)).first()[0]
    splits = [-math.inf, *sorted(set(cuts or [])), math.inf]
    ranged = Bucketizer(splits=splits, inputCol=value, outputCol="__range").transform(counts) \
        if len(splits) > 2 else counts.withColumn("__range", F.lit(0.0))
    offsets = ranged.groupBy("__range").agg(F.sum("n").alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # at most `buckets` lines, so the un-partitioned window is bounded
    offsets = offsets.select("__range", F.coalesce(F.sum("__rows").over(before),
                                                   F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(offsets), "__range")
        .withColumn("below", F.col("__offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .select(value, "n", "extra", "below",
                (F.col("below") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
    )


def with_average_rank(df: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """Average rank (ties share their mean rank), 1-based; null values get no rank.

    Rows of a hot value meet the one line of the value without moving.
    """
    ranks = value_ranks(df, value).select(value, "n", F.col("avg_rank").alias(out))
    ranked = join_group_facts(df, ranks, value, df.count()).drop("n")
    gaps = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(gaps)


def group_ranks(long: DataFrame, buckets: int | None = None) -> DataFrame:
    """(g, v, n, avg_rank) within each group of a (g int, v double) table.

    All groups go through one counting shuffle; ranges are cut at literal bounds per group.
    """
    counts = cut_lineage(long.where(F.col("v").isNotNull()).groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("n")))
    buckets = _ranges(counts, buckets)
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = {r["g"]: sorted(set(r["q"])) for r in counts.groupBy("g").agg(
        F.percentile_approx("v", steps, 1000).alias("q")).collect()}
    if not cuts:
        return counts.withColumn("avg_rank", F.lit(0.0))
    bounds = F.create_map(*[x for g, q in cuts.items() for x in (
        F.lit(g), F.array(*[F.lit(float(c)) for c in q]))])
    ranged = counts.withColumn("__range", F.size(F.filter(
        bounds[F.col("g")], lambda c: c <= F.col("v"))))
    before = Window.partitionBy("g").orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("g", "__range").agg(F.sum("n").alias("__rows")).select(
        "g", "__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("g", "__range").orderBy("v").rowsBetween(
        Window.unboundedPreceding, -1)
    below = F.col("__offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return ranged.join(F.broadcast(offsets), ["g", "__range"]).select(
        "g", "v", "n", (below + (F.col("n") + 1) / 2.0).alias("avg_rank"))
