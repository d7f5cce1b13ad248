"""Score algebra: flags, method quality, method choice, ensembles.

Scores of all methods stay side by side as columns of one row table, so thresholds are a few
exact quantiles, and flags, agreement and ensemble are projections.
"""
from __future__ import annotations

import itertools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from veracell.functions.hashing import poisson_one
from veracell.functions.session import cut_lineage
from veracell.operators.quantiles import quantiles, value_ranks


def thresholds(scores: DataFrame, columns: list[str], contamination: float) -> dict[str, float]:
    if contamination <= 0:
        return {c: 0.5 for c in columns}
    q = quantiles(scores, {c: F.col(c) for c in columns}, [1.0 - contamination])
    return {c: v[0] for c, v in q.items()}


def flag(scores: DataFrame, columns: list[str], contamination: float) -> DataFrame:
    """Add ``flag_<column>``: strictly above the column's upper quantile."""
    cut = thresholds(scores, columns, contamination)
    return scores.withColumns({f"flag_{c}": F.col(c) > F.lit(cut[c]) for c in columns})


def discrimination(scores: DataFrame, score: str, flagged: str) -> DataFrame:
    """Share of (flagged, other) pairs in which the other scores less, from ranks."""
    other, hit = (~F.col(flagged)).cast("long"), F.col(flagged).cast("long")
    ranks = value_ranks(scores.select(F.col(score).cast("double").alias("v"), flagged), "v",
                        weight=other, extra=hit)
    sums = ranks.agg(F.sum(F.col("below") * F.col("extra")).alias("u"),
                     F.sum("n").alias("others"), F.sum("extra").alias("hits"))
    return sums.select(F.coalesce(F.try_divide(
        F.col("u").cast("double"), F.col("others").cast("double") * F.col("hits")), F.lit(0.0))
        .alias("ad"))


def mean_jaccard(flags: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over column pairs of |both| / |either|; one aggregate over the flag table."""
    pairs = list(itertools.combinations(columns, 2))
    parts = [F.coalesce(F.try_divide(F.count_if(F.col(a) & F.col(b)).cast("double"),
                                     F.count_if(F.col(a) | F.col(b)).cast("double")), F.lit(0.0))
             for a, b in pairs]
    return flags.agg((sum(parts[1:], parts[0]) / len(pairs)).alias("stability")) if pairs else \
        flags.agg(F.lit(0.5).alias("stability"))


def bootstrap(feats: DataFrame, number: int, seed: int = 42) -> DataFrame:
    """One resample with replacement: (row_id, origin, x); copies are drawn from the key."""
    key = F.col("row_id").cast("string")
    copies = feats.withColumn("__n", poisson_one(key, F.lit(number), seed=seed))
    return copies.where("__n > 0").select(
        F.col("row_id").alias("origin"), "x", F.explode(F.sequence(F.lit(1), "__n")).alias("c")) \
        .select(F.xxhash64("origin", "c", F.lit(number)).alias("row_id"), "origin", "x")


def stability(feats: DataFrame, detector: Callable, contamination: float, runs: int = 8,
              seed: int = 42, **options) -> float:
    """Mean pairwise Jaccard overlap of the rows flagged by refits on resamples."""
    if feats.count() < 20 or runs < 2:
        return 0.5

    def refit(b: int) -> DataFrame:
        sample = cut_lineage(bootstrap(feats, b, seed))
        found = detector(sample.select("row_id", "x"), contamination=contamination, **options)
        hits = flag(found.scores, ["score"], contamination).where("flag_score")
        return cut_lineage(sample.select("row_id", "origin").join(hits, "row_id").select(
            "origin", F.lit(b).alias("b")).distinct())

    # refits are independent jobs, so they may share the cluster
    with ThreadPoolExecutor(max_workers=4) as pool:
        parts = list(pool.map(refit, range(runs)))
    flagged = parts[0]
    for part in parts[1:]:
        flagged = flagged.unionByName(part)
    wide = flagged.groupBy("origin").agg(*[
        F.max(F.col("b") == b).alias(f"r{b}") for b in range(runs)])
    return mean_jaccard(wide, [f"r{b}" for b in range(runs)]).first()[0]


def stability_words(ss: Column) -> Column:
    return (F.when(ss > 0.7, "Highly stable: same anomalies across resamples")
            .when(ss > 0.3, "Moderately stable")
            .otherwise("Low stability: results vary across resamples"))


def plausibility_share(flags: DataFrame, flagged: str, violates: str) -> DataFrame:
    """Share of flagged rows that break a range; 0.5 without flagged rows."""
    return flags.agg(F.coalesce(F.avg(F.when(F.col(flagged), F.col(violates).cast("double"))),
                                F.lit(0.5)).alias("cp"))


def composite(methods: DataFrame) -> DataFrame:
    """Fill cc, ndc and composite of a method table (method, ad, ss, cp, ex, duration_ms,
    penalty); the table has one line per method."""
    longest = methods.agg(F.max("duration_ms").alias("__max"))
    m = methods.crossJoin(F.broadcast(longest))
    cc = F.when(F.col("__max") > 0, F.greatest(
        F.lit(0.0), 1.0 - F.col("duration_ms") / (F.col("__max") + 1e-10))).otherwise(0.5)
    ndc = 0.6 * F.col("ad") + 0.4 * F.col("ss")
    total = (0.35 * ndc + 0.25 * F.col("cp") + 0.20 * F.col("ex") + 0.10 * cc
             + 0.10 * (1.0 - F.col("penalty")))
    rounded = {c: F.round(c, 4) for c in ("ad", "ss", "cp", "ex")}
    return m.withColumns({"cc": F.round(cc, 4), "ndc": F.round(ndc, 4),
                          "composite": F.round(total, 4)}).withColumns(rounded).drop("__max")


def select_methods(methods: DataFrame, single: float = 0.70, spread: float = 0.05,
                   least: float = 0.50) -> DataFrame:
    """(mode, method, weight) of the chosen methods.

    One method if the best is clearly good; the best three if they are close and passable; the
    forest and the neighbour method when none is passable; else the best.
    """
    line = F.struct((-F.col("composite")).alias("neg"), F.col("method").alias("method"))
    ranked = methods.agg(F.array_sort(F.collect_list(line)).alias("r"))
    top = -F.col("r")[0]["neg"]
    three = F.slice("r", 1, 3)
    gap = top + F.element_at(three, -1)["neg"]
    mode = (F.when(top > single, "single")
            .when((F.size(three) >= 2) & (gap < spread) & (top > least), "ensemble")
            .when(top < least, "fallback").otherwise("single"))
    ran = F.transform("r", lambda s: s.method)
    safe = F.filter(F.array(F.lit("isolation_forest"), F.lit("lof")),
                    lambda m: F.array_contains(ran, m))
    safe = F.when(F.size(safe) > 0, safe).otherwise(F.transform(F.slice("r", 1, 1),
                                                                lambda s: s.method))
    total = F.aggregate(three, F.lit(0.0), lambda a, s: a - s["neg"])
    picked = (F.when(F.col("mode") == "ensemble", F.transform(three, lambda s: F.struct(
        s.method.alias("method"), (-s.neg / total).alias("weight"))))
        .when(F.col("mode") == "fallback", F.transform(safe, lambda m: F.struct(
            m.alias("method"), (F.lit(1.0) / F.size(safe)).alias("weight"))))
        .otherwise(F.transform(F.slice("r", 1, 1), lambda s: F.struct(
            s.method.alias("method"), F.lit(1.0).alias("weight")))))
    return ranked.withColumn("mode", mode).select("mode", F.inline(picked))


def ensemble_score(weights: dict[str, float], columns: list[str]) -> Column:
    """Weighted mean over the methods that have both a weight and a score column."""
    used = {c: w for c, w in weights.items() if c in columns}
    total = sum(used.values())
    if not total:
        return F.lit(0.0)
    parts = [F.col(c) * F.lit(float(w)) for c, w in used.items()]
    return sum(parts[1:], parts[0]) / F.lit(float(total))


def ensemble(scores: DataFrame, columns: list[str], weights: dict[str, float],
             contamination: float) -> tuple[DataFrame, float]:
    """Add final score, flag, method agreement and ambiguity; also return the threshold."""
    full = scores.withColumn("final_score", ensemble_score(weights, columns))
    cut = thresholds(full, [*columns, "final_score"], contamination)
    hits = [(F.col(c) > F.lit(cut[c])).cast("double") for c in columns]
    out = full.withColumn("flagged", F.col("final_score") > F.lit(cut["final_score"])) \
        .withColumn("agreement", sum(hits[1:], hits[0]) / len(hits)) \
        .withColumn("ambiguous", ambiguous(F.col("flagged"), F.col("agreement")))
    return out, cut["final_score"]


def ambiguous(flagged: Column, agreement: Column, level: float = 0.4) -> Column:
    return (flagged & (agreement < 1.0 - level)) | (~flagged & (agreement > level))


def borderline(scores: DataFrame, key: str, score: str, threshold: float, k: int = 15) \
        -> DataFrame:
    """Unflagged rows that come close to the threshold; a top-k, not a sort of the table."""
    pct = F.col(score) / F.lit(threshold) * 100
    near = scores.where((F.col(score) >= 0.6 * threshold) & (F.col(score) < threshold))
    return near.orderBy(F.desc(score), key).limit(k).select(
        key, F.round(score, 4).alias("score"), F.round(F.lit(threshold), 4).alias("threshold"),
        F.round(pct, 1).alias("pct_of_threshold"),
        F.concat(F.lit("Score "), F.format_string("%.4f", F.col(score)), F.lit(" is "),
                 F.format_string("%.0f", pct),
                 F.lit(f"% of threshold {threshold:.4f}")).alias("reason"))
