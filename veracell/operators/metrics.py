"""Quality metrics and queries over result tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def percentages(noise: Column, missing: Column, duplicate: Column, implausible: Column) -> dict:
    """Percentages, two places, from shares."""
    return {"noise_pct": F.round(noise * 100, 2), "missingness_pct": F.round(missing * 100, 2),
            "duplicate_pct": F.round(duplicate * 100, 2),
            "plausibility_rate": F.round((1 - implausible) * 100, 2)}


def trust(noise_pct: Column, missing_pct: Column, duplicate_pct: Column, plausible: Column) \
        -> Column:
    """Weighted trust score out of 100, one place."""
    floor = lambda c: F.greatest(F.lit(0.0), 100 - c)
    return F.round(0.25 * floor(missing_pct) + 0.30 * floor(noise_pct) + 0.25 * plausible
                   + 0.20 * floor(duplicate_pct), 1)


def quality(shares: DataFrame) -> DataFrame:
    """Metrics of a one-line table (noise, missing, duplicate, implausible shares, total_rows)."""
    p = percentages(*[F.col(c) for c in ("noise", "missing", "duplicate", "implausible")])
    out = shares.withColumns(p)
    return out.withColumn("trust_score", trust(*[F.col(c) for c in (
        "noise_pct", "missingness_pct", "duplicate_pct", "plausibility_rate")])).select(
        *p, "trust_score", "total_rows")


def column_errors(anomalies: DataFrame) -> DataFrame:
    return (anomalies.select(F.explode("flagged_columns").alias("column_name"))
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("errors")))


def error_burden(errors: DataFrame, rows: int, columns: int) -> DataFrame:
    cells = max(rows * columns, 1)
    return errors.agg(F.round(F.coalesce(F.sum("errors"), F.lit(0)) / cells * 100, 4)
                      .alias("column_error_burden"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric by metric (metric, value): the change and whether it is for the better."""
    up = F.col("metric").isin("trust_score", "plausibility_rate")
    gain = F.when(up, F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    both = before.select("metric", F.col("value").alias("before")).join(
        after.select("metric", F.col("value").alias("after")), "metric")
    return both.withColumn("gain", F.round(gain, 4)).withColumn(
        "verdict", F.when(F.col("gain") > 0, "improved").when(F.col("gain") < 0, "worse")
        .otherwise("unchanged"))


def long_metrics(quality_line: DataFrame) -> DataFrame:
    names = [c for c in quality_line.columns if c != "total_rows"]
    return quality_line.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in names])))


def list_anomalies(anomalies: DataFrame, anomaly_type: str | None = None,
                   severity: str | None = None, min_confidence: float | None = None,
                   column: str | None = None, site: tuple[str, str] | None = None,
                   status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Filtered page of anomalies, most confident first."""
    out = anomalies
    if anomaly_type:
        out = out.where(F.col("anomaly_type") == anomaly_type)
    if severity:
        out = out.where(F.col("severity") == severity)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if column:
        out = out.where(F.array_contains("flagged_columns", column))
    if site:
        out = out.where(F.col(site[0]) == site[1])
    if status:
        out = out.where(F.col("status") == status)
    return page(out, [F.desc("confidence"), F.col("row_id")], offset, limit)


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def adjudicate(anomalies: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merge decisions (row_id, decision, new_value, comment) into the anomalies."""
    d = decisions.select("row_id", "decision", "new_value")
    verdict = (F.when(F.col("decision") == "accept", "accepted")
               .when(F.col("decision") == "dismiss", "dismissed")
               .when(F.col("decision") == "modify", "modified"))
    return anomalies.join(d, "row_id", "left").withColumn(
        "status", F.coalesce(verdict, F.col("status"))).withColumn(
        "final_value", F.when(F.col("decision") == "modify", F.col("new_value")).when(
            F.col("decision") == "accept", F.col("proposed_value"))).drop("decision", "new_value")


def cleaning_plan(recs: DataFrame) -> DataFrame:
    """Recommendations by risk and action, with the cells and rows they touch."""
    return recs.groupBy("auto_clean_risk", "recommended_action").agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("row_id").alias("rows"))
