"""Profile aggregates: numeric and categorical columns, missingness, noise, dataset vector."""
from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veracell.functions import values as V
from veracell.functions.arrow import arrays, matrix
from veracell.functions.hashing import unit_hash
from veracell.functions.joins import join_group_facts
from veracell.operators.quantiles import group_ranks, quantiles
from veracell.operators.typing import distinct_counts, long_summary, simple_columns

TOP_VALUES = 50


# ---- numeric columns ---------------------------------------------------------------------------

def adjusted_skewness(g1: Column, n: Column) -> Column:
    """Bias-adjusted skewness from the population one; needs more than two values."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


def jarque_bera_p(g1: Column, g2: Column, n: Column) -> Column:
    """Normality p-value in closed form (chi-square with two degrees of freedom)."""
    return F.when(n > 3, F.exp(-(n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)) / 2.0))


def value_counts(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """(column_name, value, n) of same-typed expressions; counted before the shuffle."""
    lines = F.array(*[F.struct(F.lit(c).alias("column_name"), e.alias("value"))
                      for c, e in exprs.items()])
    return (df.select(F.inline(lines)).where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def modes(counts: DataFrame) -> DataFrame:
    """Distinct count and mode (ties go to the smallest value) from value counts."""
    return counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("mode"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments in one wide pass, exact quartiles, mode and distinct count from value counts."""
    exprs = {c: V.number(df, c) for c in columns}
    stats = long_summary(df, {c: {
        "count": F.count(F.lit(1)), "valid": F.count(e),
        "null_count": F.count_if(V.present(df, c).isNull()),
        "mean": F.avg(e), "std": F.coalesce(F.stddev_samp(e), F.lit(0.0)),
        "min_val": F.min(e), "max_val": F.max(e),
        "g1": F.skewness(e), "g2": F.kurtosis(e),
    } for c, e in exprs.items()})
    quart = quantiles(df, exprs, [0.25, 0.5, 0.75])
    q = F.create_map(*[x for c in columns for x in
                       (F.lit(c), F.array(*[F.lit(v).cast("double") for v in quart[c]]))])
    n = F.col("valid").cast("double")
    return (
        stats.join(F.broadcast(modes(value_counts(df, exprs))), "column_name", "left")
        .withColumn("q", q[F.col("column_name")])
        .withColumn("normality_pvalue", jarque_bera_p(F.col("g1"), F.col("g2"), n))
        .select(
            "position", "column_name", F.lit("numeric").alias("dtype"), "count", "null_count",
            (F.col("null_count") / F.col("count")).alias("null_rate"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            (F.coalesce("unique_count", F.lit(0)) / F.col("count")).alias("cardinality_ratio"),
            "mean", F.col("q")[1].alias("median"), "std",
            (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
            adjusted_skewness(F.col("g1"), n).alias("skewness"),
            adjusted_kurtosis(F.col("g2"), n).alias("kurtosis"),
            "min_val", "max_val", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"),
            F.col("mode").cast("string").alias("mode"), "normality_pvalue",
            F.when(F.col("normality_pvalue") > 0.05, "normal").otherwise("non-normal")
            .alias("distribution_fit"))
    )


# ---- categorical columns -----------------------------------------------------------------------

def top_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` commonest values of each column with at most ``2 k`` distinct ones.

    Columns are picked by their distinct count first, so at most ``2 k`` lines a column are ranked.
    """
    uniques = {r["column_name"]: r["unique_count"]
               for r in distinct_counts(df, columns).collect()}
    few = [c for c in columns if uniques.get(c, 0) <= 2 * k]
    if not few:
        few = []
    counts = value_counts(df, {c: V.as_text(df, c) for c in few or columns[:1]})
    if not few:
        counts = counts.limit(0)
    line = F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))
    per_col = counts.groupBy("column_name").agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(line)).alias("lines"))
    ranked = per_col.select("column_name", "total",
                            F.posexplode(F.slice("lines", 1, k)).alias("i", "v"))
    return ranked.select(
        "column_name", (F.col("i") + 1).alias("rank"), F.col("v.value").alias("value"),
        (-F.col("v.neg")).alias("count"),
        F.round(-F.col("v.neg") / F.col("total") * 100, 2).alias("pct"))


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = long_summary(df, {c: {
        "count": F.count(F.lit(1)), "null_count": F.count_if(V.present(df, c).isNull()),
        "mean_length": F.avg(F.length(V.as_text(df, c)))} for c in columns})
    counts = modes(value_counts(df, {c: V.as_text(df, c) for c in columns}))
    ratio = F.coalesce("unique_count", F.lit(0)) / F.col("count")
    return (
        stats.join(F.broadcast(counts), "column_name", "left")
        .select(
            "position", "column_name",
            F.when((ratio > 0.9) & (F.col("mean_length") > 30), "free_text")
            .when(ratio > 0.9, "identifier").otherwise("categorical").alias("dtype"),
            "count", "null_count", (F.col("null_count") / F.col("count")).alias("null_rate"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            ratio.alias("cardinality_ratio"), "mode")
    )


def split_columns(df: DataFrame, columns: list[str] | None = None) -> tuple[list, list]:
    """Numeric columns (over 80 % of non-null cells parse) and all others."""
    columns = columns or simple_columns(df)
    unsure = [c for c in columns if not V.is_numeric(df, c)]
    share = {}
    if unsure:
        row = df.agg(*[F.avg(F.when(V.present(df, c).isNotNull(),
                                    V.number(df, c).isNotNull().cast("double"))).alias(f"c{i}")
                       for i, c in enumerate(unsure)]).first()
        share = {c: row[i] or 0.0 for i, c in enumerate(unsure)}
    numeric = [c for c in columns if share.get(c, 1.0) > 0.8]
    return numeric, [c for c in columns if c not in numeric]


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One line per column; numeric statistics are null for other columns."""
    columns = columns or simple_columns(df)
    numeric, other = split_columns(df, columns)
    parts = []
    if numeric:
        parts.append(numeric_profile(df, numeric))
    if other:
        parts.append(categorical_profile(df, other))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1],
                                                                allowMissingColumns=True)
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return out.withColumn("position", order[F.col("column_name")])


def table_profile(profile: DataFrame) -> DataFrame:
    """Overall missingness and the share of each column type, from a column profile."""
    one = profile.agg(
        F.max("count").alias("row_count"), F.count(F.lit(1)).alias("col_count"),
        (F.sum("null_count") / F.sum("count")).alias("overall_missingness"))
    kinds = profile.groupBy("dtype").agg(F.count(F.lit(1)).alias("type_columns"))
    return kinds.crossJoin(F.broadcast(one)).withColumn(
        "type_share", F.col("type_columns") / F.col("col_count"))


# ---- correlation and missingness ---------------------------------------------------------------

def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman correlation of each column pair over rows where both are present.

    Columns without gaps are ranked once each; pairs with gaps are ranked on their own rows. All
    ranks come from one grouped pass.
    """
    data = df.select(*[V.number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    counts = data.agg(F.count(F.lit(1)), *[F.count(c) for c in data.columns]).first()
    total, full = counts[0], [i for i in range(len(columns)) if counts[i + 1] == counts[0]]
    pairs = list(itertools.combinations(range(len(columns)), 2))
    whole = [p for p in pairs if set(p) <= set(full)]
    gaps = [p for p in pairs if not set(p) <= set(full)]
    parts = []
    if whole:
        long = data.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("g"), F.col(f"v{i}").alias("v")) for i in full])))
        ranks, ranked = group_ranks(long), data
        for i in full:
            lines = ranks.where(F.col("g") == i).select(
                F.col("v").alias(f"v{i}"), "n", F.col("avg_rank").alias(f"r{i}"))
            ranked = join_group_facts(ranked, lines, f"v{i}", total).drop("n")
        wide = ranked.agg(*[F.corr(f"r{a}", f"r{b}").alias(f"p{k}")
                            for k, (a, b) in enumerate(whole)])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(columns[a]).alias("column_a"), F.lit(columns[b]).alias("column_b"),
                     F.col(f"p{k}").alias("correlation")) for k, (a, b) in enumerate(whole)]))))
    if gaps:
        rows = data.select(F.inline(F.array(*[
            F.struct(F.lit(2 * k).alias("p"), F.col(f"v{a}").alias("a"), F.col(f"v{b}").alias("b"))
            for k, (a, b) in enumerate(gaps)]))).where("a IS NOT NULL AND b IS NOT NULL")
        ranks = group_ranks(rows.select(F.inline(F.array(
            F.struct(F.col("p").alias("g"), F.col("a").alias("v")),
            F.struct((F.col("p") + 1).alias("g"), F.col("b").alias("v"))))))
        for side, shift in (("a", 0), ("b", 1)):
            lines = ranks.where(F.col("g") % 2 == shift).select(
                F.struct((F.col("g") - shift).alias("p"), F.col("v").alias("v")).alias("k"), "n",
                F.col("avg_rank").alias(f"r_{side}"))
            keyed = rows.withColumn("k", F.struct("p", F.col(side).alias("v")))
            rows = join_group_facts(keyed, lines, "k", total * len(gaps)).drop("k", "n")
        name = lambda at: F.element_at(F.array(*[F.lit(columns[p[at]]) for p in gaps]),
                                       (F.col("p") / 2).cast("int") + 1)
        parts.append(rows.groupBy("p").agg(F.corr("r_a", "r_b").alias("correlation")).select(
            name(0).alias("column_a"), name(1).alias("column_b"), "correlation"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(gaps, n): which columns are empty together, one line per pattern of the rows."""
    gaps = F.array(*[V.present(df, c).isNull().cast("double") for c in columns])
    return df.groupBy(gaps.alias("gaps")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def missing_correlations(df: DataFrame, columns: list[str] | None = None,
                         least: float = 0.3) -> DataFrame:
    """Pairs of columns whose null flags correlate, of all pairs.

    Rows become one line per null pattern; the patterns give, in one pass, how often each two
    columns are empty together.
    """
    columns = columns or simple_columns(df)
    d = len(columns)

    def together(batches):
        held = np.zeros((d + 1, d + 1))
        for b in batches:
            if b.num_rows:
                g, n = matrix(b.column(0)), b.column(1).to_numpy()
                g = np.concatenate([g, np.ones((len(g), 1))], 1)
                held += (g * n[:, None]).T @ g
        yield pa.RecordBatch.from_arrays([arrays(held.reshape(1, -1))], ["v"])

    both = np.zeros((d + 1) ** 2)
    for r in missing_patterns(df, columns).mapInArrow(together, "v array<double>").select(
            F.posexplode("v").alias("i", "v")).where("v <> 0").groupBy("i").agg(
            F.sum("v").alias("v")).collect():
        both[r["i"]] = r["v"]
    both = both.reshape(d + 1, d + 1)
    one, n = both[:d, d], both[d, d]
    spread = np.sqrt(np.maximum(n * one - one ** 2, 0))
    found = []
    for i, j in zip(*np.triu_indices(d, 1)):
        if spread[i] > 0 and spread[j] > 0:
            r = float((n * both[i, j] - one[i] * one[j]) / (spread[i] * spread[j]))
            if abs(r) > least:
                found.append((columns[i], columns[j], r))
    return df.sparkSession.createDataFrame(
        found, "column_a string, column_b string, correlation double").withColumn(
        "correlation", F.round("correlation", 3))


def missing_class(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """MCAR, MNAR or MAR with the monotone flag, as one line."""
    columns = columns or simple_columns(df)
    pairs = missing_correlations(df, columns).agg(F.count(F.lit(1)).alias("pair_count"))
    rates = df.agg(F.array(*[F.avg(V.present(df, c).isNull().cast("double")) for c in columns])
                   .alias("rates")).select(
        F.array_sort(F.filter("rates", lambda r: r > 0)).alias("rates"))
    steps = F.zip_with(F.slice("rates", 2, F.greatest(F.size("rates") - 1, F.lit(0))),
                       F.slice("rates", 1, F.greatest(F.size("rates") - 1, F.lit(0))),
                       lambda hi, lo: hi - lo)
    monotone = (F.size("rates") >= 3) & F.exists(steps, lambda d: d > 0.1)
    return rates.select(F.size("rates").alias("null_columns"), monotone.alias("monotone")) \
        .crossJoin(pairs).withColumn(
        "pattern_type", F.when(F.col("pair_count") == 0, "MCAR")
        .when(F.col("monotone"), "MNAR").otherwise("MAR"))


# ---- noise and the dataset vector --------------------------------------------------------------

def fences(df: DataFrame, columns: list[str], width: float = 3.0,
           quartiles: dict | None = None) -> dict[str, tuple]:
    """(low, high) beyond which a cell counts as tail noise; columns with spread only."""
    q = quartiles or quantiles(df, {c: V.number(df, c) for c in columns}, [0.25, 0.75])
    return {c: (lo - width * (hi - lo), hi + width * (hi - lo))
            for c, (lo, hi) in q.items() if lo is not None and hi != lo}


def tail_noise(df: DataFrame, columns: list[str], quartiles: dict | None = None) -> DataFrame:
    """Cells outside the fences over all cells of columns with ten values and some spread."""
    bounds = fences(df, columns, quartiles=quartiles)
    lines = [F.struct(F.count(V.number(df, c)).alias("cells"),
                      F.count_if(~V.number(df, c).between(lo, hi)).alias("outside"))
             for c, (lo, hi) in bounds.items()]
    if not lines:
        return df.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("outside"),
            F.lit(0.0).alias("tail_noise"))
    used = df.agg(F.array(*lines).alias("l")).select(
        F.inline(F.filter("l", lambda s: s.cells >= 10)))
    return used.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"),
                    F.coalesce(F.sum("outside"), F.lit(0)).alias("outside")).withColumn(
        "tail_noise", F.coalesce(F.try_divide(F.col("outside"), F.col("cells")), F.lit(0.0)))


def noise_estimate(impossible_cells: Column, rows: Column, tail: Column) -> Column:
    return F.least(impossible_cells / rows + tail, F.lit(1.0))


def hopkins(df: DataFrame, columns: list[str], key: str, seed: int = 42) -> float:
    """Hopkins statistic: probe points against the data, one scan with a few hundred probes.

    Probes are drawn by key hash; each partition keeps its nearest distance per probe and the
    minimum over partitions is taken, so the work is linear in the rows.
    """
    data = df.select(F.col(key).alias("row_id"), F.array(*[V.number(df, c) for c in columns])
                     .alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    box = data.agg(F.count(F.lit(1)).alias("n"), *[
        f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(columns))
        for k, f in (("lo", F.min), ("hi", F.max))]).first()
    n, d = box["n"], len(columns)
    m = min(n // 10, 200)
    if d < 2 or n < 30 or m < 5:
        return 0.5
    keep = min(1.0, 4.0 * m / n)
    draw = unit_hash(F.col("row_id").cast("string"), seed=seed)
    probes = (data.where(draw < keep).orderBy(draw, "row_id").limit(m).collect())
    real = np.array([r["x"] for r in probes], dtype=float)
    lo = np.array([box[f"lo{i}"] for i in range(d)])
    hi = np.array([box[f"hi{i}"] for i in range(d)])
    fake = np.random.default_rng(seed).uniform(lo, hi, size=(m, d))
    points = np.vstack([fake, real])

    def nearest(batches):
        best = np.full((len(points), 2), np.inf)
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float)
            for i, p in enumerate(points):
                dist = np.sqrt(((x - p) ** 2).sum(axis=1))
                both = np.concatenate([best[i], np.partition(dist, 1)[:2] if len(dist) > 1
                                       else dist])
                best[i] = np.sort(both)[:2]
        yield pd.DataFrame({"probe": np.arange(len(points)), "near": best.tolist()})

    merged = (data.select("x").mapInPandas(nearest, "probe long, near array<double>")
              .select("probe", F.explode("near").alias("d"))
              .groupBy("probe").agg(F.min_by(F.col("d"), "d").alias("first"),
                                    F.slice(F.array_sort(F.collect_list("d")), 1, 2)
                                    .alias("two")).collect())
    u = sum(r["first"] ** d for r in merged if r["probe"] < m)
    w = sum(r["two"][1] ** d for r in merged if r["probe"] >= m)
    return float(min(max(u / (u + w), 0.0), 1.0)) if u + w > 0 else 0.5


def dataset_vector(df: DataFrame, profile: list, mapping: list, noise: float,
                   correlations: list | None, cluster_tendency: float) -> dict:
    """Twelve numbers that describe a table, from collected one-line-per-column summaries."""
    n = profile[0]["count"] if profile else 0
    d = len(profile)
    numeric = [p for p in profile if p["dtype"] == "numeric"]
    cats = [p["cardinality_ratio"] for p in profile if p["dtype"] == "categorical"]
    skews = [abs(p["skewness"]) for p in numeric if p["skewness"] is not None]
    types = {m["clinical_type"]: m["column_name"] for m in reversed(mapping)
             if m["clinical_type"]}
    sites = 0
    if "site_id" in types:
        sites = df.select(F.count_distinct(V.col(types["site_id"]))).first()[0]
    pairs = [abs(r["correlation"] or 0.0) for r in correlations or []]
    return {
        "n": n, "d": d, "d_over_n": d / n if n else 0.0,
        "missingness_burden": sum(p["null_count"] for p in profile) / (n * d) if n and d else 0.0,
        "numeric_proportion": len(numeric) / d if d else 0.0,
        "categorical_cardinality": sum(cats) / len(cats) if cats else 0.0,
        "temporal_flag": int({"visit_date", "patient_id"} <= set(types)),
        "site_count": sites, "estimated_noise_rate": noise,
        "cluster_tendency": cluster_tendency,
        "skewness_spread": sum(skews) / len(skews) if skews else 0.0,
        # the zero diagonal stays in the denominator
        "correlation_density": 2.0 * sum(pairs) / len(numeric) ** 2 if numeric else 0.0,
    }
