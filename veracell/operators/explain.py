"""Explanations: contributions, flagged columns, clean twins, types, cards, summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veracell.dims import Range
from veracell.functions import values as V
from veracell.operators import knn

# Severity of each anomaly type.
SEVERITY = {
    "extreme_numeric_outlier": "high", "contextual_outlier": "medium",
    "site_specific_anomaly": "high", "temporal_inconsistency": "high",
    "duplicate_near_duplicate": "medium", "impossible_biological_value": "critical",
    "suspicious_missingness": "medium", "unit_mismatch": "high", "data_entry_typo": "medium",
    "category_encoding_inconsistency": "low", "drift_related_anomaly": "medium",
    "cross_field_contradiction": "high", "visit_sequence_inconsistency": "high",
    "latent_cluster_isolated": "low", "graph_isolated_record": "medium",
    "high_reconstruction_error": "medium", "distributional_contamination": "medium",
    "rare_but_plausible": "low", "rare_and_implausible": "high",
}
# Wording of each anomaly type on a card; others use their own name.
TYPE_WORDS = {
    "site_specific_anomaly": "site-specific data anomaly",
    "duplicate_near_duplicate": "duplicate or near-duplicate record",
    "impossible_biological_value": "clinically impossible value",
    "suspicious_missingness": "suspicious missingness pattern",
    "unit_mismatch": "possible unit mismatch",
    "data_entry_typo": "likely data entry error",
    "drift_related_anomaly": "drift-related anomaly",
    "cross_field_contradiction": "cross-field contradiction",
    "latent_cluster_isolated": "cluster-isolated observation",
    "graph_isolated_record": "graph-isolated patient record",
    "high_reconstruction_error": "high reconstruction error pattern",
    "rare_but_plausible": "rare but clinically plausible case",
    "rare_and_implausible": "rare and clinically implausible case",
}
# Likely cause by type; other types name their columns.
CAUSE_WORDS = {
    "impossible_biological_value":
        "Likely a data entry error (e.g., extra digit, decimal point error, or wrong unit).",
    "unit_mismatch":
        "Values suggest a possible unit conversion error between measurement systems.",
    "data_entry_typo": "Pattern suggests a typographical error during data entry.",
    "duplicate_near_duplicate":
        "Record appears to be a duplicate or near-duplicate of another entry.",
    "temporal_inconsistency": "Date or visit sequence does not align with expected timeline.",
    "rare_but_plausible":
        "Value is statistically extreme but within the realm of clinical possibility.",
}
# Risk of leaving an anomaly of each severity.
RISK_WORDS = {
    "critical": "Could bias safety analyses and lead to incorrect clinical conclusions.",
    "high": "May affect statistical summaries and downstream modeling.",
    "medium": "Could introduce minor noise in analyses.",
    "low": "Low risk to downstream analyses, but worth documenting.",
}
# Wording of recommended actions; others use their own name.
ACTION_WORDS = {
    "review": "Review with source data and clinical context",
    "correct_or_impute": "Verify against source document; correct if confirmed as error",
    "remove_row": "Consider removing if confirmed as invalid",
    "winsorize": "Winsorize to a clinically plausible boundary",
    "escalate_clinician": "Escalate to clinician for adjudication",
    "preserve_annotate": "Preserve the value and annotate as a rare clinical case",
    "merge_duplicate": "Merge with the most complete version of the record",
    "normalize_coding": "Standardize to canonical category encoding",
    "convert_unit": "Apply unit conversion based on detected mismatch",
}
# Columns that name the patient on a card.
PATIENT_COLUMNS = ["patient_id", "subject_id", "ptid", "subjid", "record_id", "usubjid", "mrn"]


def words(mapping: dict[str, str], key: Column, otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), otherwise)


def severity(anomaly_type: Column) -> Column:
    return words(SEVERITY, anomaly_type, F.lit("medium"))


# ---- contributions -----------------------------------------------------------------------------

def feature_stats(feats: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population deviation per feature position."""
    d = len(feats.select("x").first()["x"])
    row = feats.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d)
                      for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [row[f"m{i}"] for i in range(d)], [row[f"s{i}"] for i in range(d)]


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def z_contribution(x: Column, means, stds) -> Column:
    spread = F.zip_with(x, _literal(means), lambda v, m: F.abs(v - m))
    return F.zip_with(spread, _literal(stds), lambda v, s: v / (s + 1e-10))


def scaled_deviation(x: Column, means, scale, square: bool) -> Column:
    diff = F.zip_with(x, _literal(means), lambda v, m: v - m)
    return F.zip_with(diff, _literal(scale),
                      lambda v, e: (v * v if square else F.abs(v)) * e)


def neighbour_contribution(feats: DataFrame, rows: DataFrame, k: int = 20,
                           block: int = knn.BLOCK) -> DataFrame:
    """(row_id, raw): squared distance per feature to the mean of the k nearest rows."""
    from veracell.operators.detectors import _weighted_edges
    from veracell.functions.session import cut_lineage
    k = min(k, feats.count() - 1)
    near = cut_lineage(knn.neighbours(feats, k, block, only=rows))
    links = _weighted_edges(near, k)
    points = knn.distinct_points(feats).select(F.col("pid").alias("npid"), F.col("x").alias("nx"))
    line = F.struct(F.col("rows").alias("r"), F.col("nx").alias("nx"))
    grouped = links.join(points, "npid").groupBy("pid").agg(F.collect_list(line).alias("l"))
    zero = F.transform(F.col("x"), lambda v: F.lit(0.0))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda a, s: a + s["r"])
    summed = F.aggregate("l", zero, lambda a, s: F.zip_with(
        a, s["nx"], lambda u, v: u + v * s["r"]))
    means = near.select("pid", "x", "w").join(grouped, "pid").select("x", "w", V.let(
        F.struct(summed.alias("s"), total.alias("t")),
        lambda z: F.transform(z["s"], lambda v: v / z["t"])).alias("m"))
    mine = feats.join(rows.select("row_id"), "row_id", "left_semi")
    return knn.to_rows(mine, means).select("row_id", F.zip_with(
        "x", "m", lambda a, b: (a - b) * (a - b)).alias("raw"))


def normalised(raw: Column) -> Column:
    """Round to four places, scale to sum one, round again."""
    def scale(r):
        total = F.aggregate(r, F.lit(0.0), lambda a, v: a + F.abs(v))
        return V.let(F.struct(r.alias("r"), total.alias("t")), lambda s: F.transform(
            s["r"], lambda v: F.when(s["t"] > 0, F.round(v / s["t"], 4)).otherwise(v)))
    return V.let(F.transform(raw, lambda v: F.round(v, 4)), scale)


def contributions(method: str, feats: DataFrame, rows: DataFrame, meta: dict,
                  stats: tuple | None = None, block: int = knn.BLOCK) -> DataFrame:
    """(row_id, contrib) for the given rows, by the method's own rule."""
    means, stds = stats or feature_stats(feats)
    if method in ("lof", "hdbscan"):
        raw = neighbour_contribution(feats, rows, block=block)
        return raw.select("row_id", normalised(F.col("raw")).alias("contrib"))
    x, mine = F.col("x"), feats.join(rows.select("row_id"), "row_id", "left_semi")
    if method == "isolation_forest" and meta.get("importances"):
        raw = F.zip_with(z_contribution(x, means, stds), _literal(meta["importances"]),
                         lambda z, i: z * i)
    elif method == "autoencoder" and meta.get("feature_error"):
        raw = scaled_deviation(x, means, meta["feature_error"], True)
    elif method == "robust_pca" and meta.get("sparse_magnitude"):
        raw = scaled_deviation(x, means, meta["sparse_magnitude"], False)
    else:
        raw = z_contribution(x, means, stds)
    return mine.select("row_id", normalised(raw).alias("contrib"))


def ranked_features(contrib: Column, names: list[str]) -> Column:
    """(name, value) by falling magnitude, ties in feature order."""
    labelled = F.zip_with(contrib, F.array(*map(F.lit, names)),
                          lambda v, n: F.struct(n.alias("name"), v.alias("value")))
    keyed = F.transform(labelled, lambda s, i: F.struct(
        (-F.abs(s["value"])).alias("neg"), i.alias("i"), s["name"].alias("name"),
        s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["name"].alias("name"), s["value"].alias("value")))


def flagged_features(ranked: Column, most: int = 5, least: float = 0.01) -> Column:
    return F.transform(F.filter(F.slice(ranked, 1, most), lambda s: F.abs(s["value"]) > least),
                       lambda s: s["name"])


# ---- clean twins -------------------------------------------------------------------------------

def clean_twins(feats: DataFrame, flags: DataFrame, block: int = knn.BLOCK) -> DataFrame:
    """(row_id, twin_id, distance): the nearest unflagged row of every flagged one, ties to the
    smallest id. ``flags`` is (row_id, flagged)."""
    joined = feats.join(flags.select("row_id", "flagged"), "row_id")
    bad, good = joined.where("flagged"), joined.where(~F.col("flagged"))
    if good.isEmpty() or bad.isEmpty():
        return joined.limit(0).select("row_id", F.col("row_id").alias("twin_id"),
                                      F.lit(0.0).alias("distance"))
    queries = bad.groupBy("x").agg(F.min("row_id").alias("qid"), F.count(F.lit(1)).alias("w"))
    found = knn.nearest(queries.select("qid", "x"), knn.distinct_points(good.select("row_id", "x")),
                        1, block)
    best = found.select("qid", F.col("c")[0]["pid"].alias("twin_id"),
                        F.col("c")[0]["d"].alias("distance"))
    return knn.to_rows(bad.select("row_id", "x"), queries.join(best, "qid")).select(
        "row_id", "twin_id", "distance")


def twin_differences(twins: DataFrame, feats: DataFrame, df: DataFrame, key: str,
                     names: list[str], most: int = 10) -> DataFrame:
    """Up to ten features per flagged row that differ most, with both raw values."""
    cols = [c for c in names if c in df.columns]
    raw = df.select(F.col(key).alias("row_id"), F.create_map(*[
        x for c in cols for x in (F.lit(c), V.as_text(df, c))]).alias("raw"))
    a = feats.join(raw, "row_id").select("row_id", F.col("x").alias("xa"),
                                         F.col("raw").alias("ra"))
    b = feats.join(raw, "row_id").select(F.col("row_id").alias("twin_id"),
                                         F.col("x").alias("xb"), F.col("raw").alias("rb"))
    size = F.zip_with("xa", "xb", lambda u, v: F.abs(u - v))
    labelled = F.transform(size, lambda m, i: F.struct(
        (-F.round(m, 4)).alias("neg"), i.alias("i"),
        F.array(*map(F.lit, names))[i].alias("name"), m.alias("m")))
    kept = F.slice(F.array_sort(F.filter(labelled, lambda s: (s["m"] > 0.01) & F.array_contains(
        F.array(*map(F.lit, cols)), s["name"]))), 1, most)
    return (twins.join(a, "row_id").join(b, "twin_id")
            .select("row_id", "twin_id", "distance", "ra", "rb",
                    F.posexplode(kept).alias("rank", "s"))
            .select("row_id", "twin_id", F.round("distance", 4).alias("distance"),
                    (F.col("rank") + 1).alias("rank"), F.col("s.name").alias("column_name"),
                    F.try_element_at("ra", F.col("s.name")).alias("original"),
                    F.try_element_at("rb", F.col("s.name")).alias("clean"),
                    F.round("s.m", 4).alias("magnitude")))


def raw_points(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(row_id, x) of numeric columns as they are, gaps filled with the column mean."""
    row = df.agg(*[F.avg(V.number(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return df.select(F.col(key).alias("row_id"), F.array(*[
        F.coalesce(V.number(df, c), F.lit(float(row[i] or 0.0)))
        for i, c in enumerate(columns)]).alias("x"))


def raw_twins(df: DataFrame, key: str, numeric: list[str], flags: DataFrame,
              most: int = 10, block: int = knn.BLOCK) -> DataFrame:
    """Twins in raw space with the names of the differing columns, in column order."""
    twins = clean_twins(raw_points(df, key, numeric), flags, block)
    cols = [c for c in df.columns if c != key]
    a = df.select(F.col(key).alias("row_id"), F.struct(*[
        V.present(df, c).alias(c) for c in cols]).alias("a"))
    b = a.select(F.col("row_id").alias("twin_id"), F.col("a").alias("b"))
    differs = []
    for c in cols:
        u, v = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        unequal = F.abs(u - v) > 1e-6 if V.is_numeric(df, c) else \
            u.cast("string") != v.cast("string")
        differs.append(F.when(u.isNull() & v.isNull(), False)
                       .when(u.isNull() | v.isNull(), True).otherwise(unequal))
    listed = F.filter(F.array(*[F.when(d, F.lit(c)) for c, d in zip(cols, differs)]),
                      lambda n: n.isNotNull())
    return twins.join(a, "row_id").join(b, "twin_id").select(
        "row_id", "twin_id", "distance", F.slice(listed, 1, most).alias("differing_columns"))


# ---- anomaly types -----------------------------------------------------------------------------

def range_break(value: Column, r: Range, low_scale: float = 0.5, high_scale: float = 1.5) -> Column:
    """Far outside a range: bounds widened by the scales, a negative minimum widened downwards."""
    low = r.low * low_scale if r.low >= 0 else r.low * high_scale
    return (value < low) | (value > r.high * high_scale)


def classify(rows: DataFrame, method: str, ranges: dict[str, Range]) -> DataFrame:
    """Anomaly type, confidence and rationale of flagged rows.

    ``rows`` has score, agreement (may be null), noise (true when density clustering left the row
    out), flagged_columns, top_share, and ``values``, a map of raw text by column.
    """
    checks = {c: F.when(range_break(V.to_number(F.try_element_at("values", F.lit(c))), r),
                        F.concat(F.lit(f"{c}="), F.try_element_at("values", F.lit(c)),
                                 F.lit(f" outside plausible range [{r.low}-{r.high}] {r.unit}")))
              for c, r in ranges.items()}
    why = F.create_map(*[x for c, e in checks.items() for x in (F.lit(c), e)]) if checks else \
        F.create_map(F.lit(""), F.lit(None).cast("string"))
    cols, score = F.col("flagged_columns"), F.col("score")
    broken = V.let(why, lambda m: F.filter(cols, lambda c: F.try_element_at(m, c).isNotNull()))
    lead = F.try_element_at(cols, F.lit(1))
    steps = [
        (F.size(broken) > 0, "impossible_biological_value", F.lit(0.95),
         F.try_element_at(why, F.try_element_at(broken, F.lit(1)))),
        ((F.size(cols) > 0) & (F.col("top_share") > 0.6), "extreme_numeric_outlier",
         F.least(score + 0.1, F.lit(0.99)),
         F.concat(lead, F.lit("="), F.coalesce(F.try_element_at("values", lead), F.lit("None")),
                  F.lit(f" is an extreme outlier based on {method} scoring"))),
        (F.lit(method == "autoencoder") & (F.size(cols) >= 3), "high_reconstruction_error", score,
         F.concat(F.lit("Multiple features ("), F.concat_ws(", ", F.slice(cols, 1, 3)),
                  F.lit(") contribute to high reconstruction error"))),
        (F.col("noise") & (score > 0.8), "rare_and_implausible", score,
         F.lit("Record is noise-labeled by density clustering with high anomaly score")),
        (F.col("noise"), "latent_cluster_isolated", score,
         F.lit("Record is isolated from all clusters (noise point)")),
        (F.col("agreement") < 0.5, "contextual_outlier", score * 0.8,
         F.lit("Flagged by some methods but not others; likely context-dependent anomaly")),
        (score > 0.7, "extreme_numeric_outlier", score,
         F.concat(F.lit("High anomaly score ("), F.format_string("%.3f", score),
                  F.lit(") driven by "), F.concat_ws(", ", F.slice(cols, 1, 2)))),
    ]
    last = F.struct(F.lit("distributional_contamination").alias("anomaly_type"),
                    score.alias("confidence"),
                    F.lit("Moderate anomaly score; may represent distributional tail")
                    .alias("rationale"))
    out = None
    for cond, kind, conf, text in steps:
        s = F.struct(F.lit(kind).alias("anomaly_type"), conf.alias("confidence"),
                     text.alias("rationale"))
        out = F.when(cond, s) if out is None else out.when(cond, s)
    return rows.withColumn("__c", out.otherwise(last)).select(
        *rows.columns, F.col("__c.anomaly_type").alias("anomaly_type"),
        severity(F.col("__c.anomaly_type")).alias("severity"),
        F.round("__c.confidence", 3).alias("confidence"),
        F.col("__c.rationale").alias("rationale"))


# ---- cards -------------------------------------------------------------------------------------

def confidence_label(confidence: Column) -> Column:
    return (F.when(confidence >= 0.9, "Very High").when(confidence >= 0.7, "High")
            .when(confidence >= 0.5, "Moderate").otherwise("Low"))


def percent(c: Column) -> Column:
    return F.format_string("%.0f", c * 100)


def type_words(t: Column) -> Column:
    return words(TYPE_WORDS, t, F.replace(t, F.lit("_"), F.lit(" ")))


def finding(drivers: Column, values: Column) -> Column:
    """Text of the top three drivers (name, value)."""
    parts = F.transform(F.slice(drivers, 1, 3), lambda s: F.concat(
        s["name"], F.lit("="), F.coalesce(F.try_element_at(values, s["name"]), F.lit("N/A")),
        F.lit(" (contribution: "), percent(F.abs(s["value"])), F.lit("%)")))
    return F.when(F.size(drivers) == 0,
                  "No specific feature dominated the anomaly score.").otherwise(
        F.concat(F.lit("Key drivers: "), F.concat_ws("; ", parts), F.lit(".")))


def record_name(row_id: Column, values: Column) -> Column:
    patient = F.coalesce(*[F.try_element_at(values, F.lit(c)) for c in PATIENT_COLUMNS])
    number = F.concat(F.lit("#"), row_id.cast("string"))
    return F.when(patient.isNotNull(), F.concat(number, F.lit(" (Patient "), patient,
                                                F.lit(")"))).otherwise(number)


def cards(rows: DataFrame, ranges: dict[str, Range]) -> DataFrame:
    """Add the explanation card; rows carry type, severity, confidence, flagged_columns, drivers,
    values and action."""
    label, t = confidence_label(F.col("confidence")), F.col("anomaly_type")
    found = finding(F.col("drivers"), F.col("values"))
    cause = words(CAUSE_WORDS, t, F.concat(
        F.lit("Anomalous pattern detected across "),
        F.concat_ws(", ", F.slice("flagged_columns", 1, 3)), F.lit(".")))
    action = words(ACTION_WORDS, F.col("action"), F.replace(F.col("action"), F.lit("_"),
                                                            F.lit(" ")))
    texts = {c: f"Normal range: {r.low}-{r.high} {r.unit}" for c, r in ranges.items()}
    known = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]) if texts else None
    context = F.lit("No specific clinical reference available")
    if known is not None:
        hits = F.filter("flagged_columns", lambda c: F.try_element_at(known, c).isNotNull())
        context = F.coalesce(F.try_element_at(known, F.try_element_at(hits, F.lit(1))), context)
    summary = F.concat(
        F.lit("Record "), record_name(F.col("row_id"), F.col("values")),
        F.lit(" was flagged as a "), type_words(t), F.lit(" ("), F.col("severity"),
        F.lit(" severity, "), label, F.lit(" confidence). "), found, F.lit(" "), cause,
        F.lit(" Recommended action: "), action, F.lit("."))
    return rows.withColumn("card", F.struct(
        summary.alias("summary"), found.alias("finding"), context.alias("clinical_context"),
        cause.alias("likely_cause"),
        F.concat(label, F.lit(" ("), percent(F.col("confidence")), F.lit("%)"))
        .alias("confidence_label"),
        action.alias("recommended_action"),
        words(RISK_WORDS, F.col("severity"), F.lit(RISK_WORDS["low"]))
        .alias("risk_if_uncorrected")))


def simple_card(row_id: Column, patient: Column | None, visit: Column | None,
                anomaly_type: Column, confidence: Column, drivers: Column) -> Column:
    """One-sentence card with patient and visit."""
    who = F.concat(F.lit("Record at row "), row_id.cast("string"))
    if patient is not None:
        named = F.concat(F.lit("Record for patient "), patient.cast("string"))
        if visit is not None:
            named = F.concat(named, F.when(visit.isNotNull(), F.concat(
                F.lit(" (visit: "), visit.cast("string"), F.lit(")"))).otherwise(""))
        who = F.when(patient.isNotNull(), named).otherwise(who)
    top = F.transform(F.slice(drivers, 1, 3), lambda s: F.concat(
        F.lit("'"), s["name"], F.lit("' ("), percent(s["value"]), F.lit("%)")))
    return F.concat(who, F.lit(" was flagged as '"), anomaly_type, F.lit("' with "),
                    percent(confidence), F.lit("% confidence."),
                    F.when(F.size(drivers) > 0, F.concat(
                        F.lit(" Top contributing features: "), F.concat_ws(", ", top),
                        F.lit("."))).otherwise(""))


# ---- summaries ---------------------------------------------------------------------------------

def global_drivers(contrib: DataFrame, names: list[str], most: int = 10) -> DataFrame:
    """Features by their share of all contribution mass."""
    long = contrib.select(F.posexplode("contrib").alias("i", "v"))
    label = F.array(*map(F.lit, names))
    sums = long.groupBy("i").agg(F.sum(F.abs("v")).alias("mass")).select(
        "i", label[F.col("i")].alias("column_name"), "mass")
    total = sums.agg(F.sum("mass").alias("total"))
    return (sums.crossJoin(F.broadcast(total)).orderBy(F.desc("mass"), "i").limit(most)
            .select("column_name", F.round(F.coalesce(F.try_divide(
                F.col("mass"), F.col("total")), F.lit(0.0)) * 100, 1).alias("contribution_pct")))


def distribution(anomalies: DataFrame, column: str) -> DataFrame:
    counts = anomalies.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = anomalies.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        column, "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("pct"))


def narrative(anomalies: DataFrame, drivers: DataFrame, total_rows: int,
              labels: dict[str, str] | None = None) -> DataFrame:
    """One paragraph on the whole run, from one-line aggregates."""
    one = anomalies.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"))
    top = anomalies.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("c")).agg(
        F.min_by("anomaly_type", F.struct(-F.col("c"), "anomaly_type")).alias("kind"),
        F.max("c").alias("kind_n"))
    name = words(labels, F.col("column_name"), F.col("column_name")) if labels else \
        F.col("column_name")
    lines = drivers.orderBy(F.desc("contribution_pct"), "column_name").limit(5).agg(F.collect_list(
        F.struct("contribution_pct", name.alias("name"))).alias("d"))
    numbered = F.transform(F.array_sort("d", lambda a, b: F.when(
        a["contribution_pct"] > b["contribution_pct"], -1).when(
        a["contribution_pct"] < b["contribution_pct"], 1).otherwise(0)), lambda s, i: F.concat(
        F.lit("  ("), (i + 1).cast("string"), F.lit(") "), s["name"], F.lit(" contributing "),
        s["contribution_pct"].cast("string"), F.lit("% of total anomaly score mass")))
    rows = max(total_rows, 1)
    return one.crossJoin(top).crossJoin(lines).select(F.concat_ws(
        " ",
        F.concat(F.lit("Detected "), F.col("n").cast("string"), F.lit(
            f" anomalies across {total_rows} records ("),
            F.round(F.col("n") / rows * 100, 2).cast("string"), F.lit("% noise rate).")),
        F.when(F.size("d") > 0, "The top drivers of anomaly detection were:"),
        F.when(F.size("d") > 0, F.concat_ws(" ", numbered)),
        F.concat(F.lit("The most common anomaly type was '"), F.replace(
            F.coalesce("kind", F.lit("unknown")), F.lit("_"), F.lit(" ")), F.lit("' with "),
            F.coalesce("kind_n", F.lit(0)).cast("string"), F.lit(" occurrences.")),
        F.when(F.col("critical") > 0, F.concat(
            F.col("critical").cast("string"),
            F.lit(" anomalies are classified as CRITICAL severity requiring immediate review."))),
        F.when(F.col("high") > 0, F.concat(
            F.col("high").cast("string"), F.lit(" additional anomalies are HIGH severity."))),
    ).alias("narrative"))


def column_contrast(df: DataFrame, columns: list[str], flagged: Column) -> DataFrame:
    """Flagged against normal values of each numeric column; one wide aggregate."""
    from veracell.operators.typing import long_summary
    metrics = {}
    for c in columns:
        v = V.number(df, c)
        bad, good = F.when(flagged, v), F.when(~flagged, v)
        metrics[c] = {"flagged_mean": F.avg(bad), "flagged_std": F.stddev_samp(bad),
                      "normal_mean": F.avg(good), "flagged_values": F.count(bad)}
    return long_summary(df, metrics).drop("position")


def top_records(anomalies: DataFrame, k: int = 40) -> DataFrame:
    return anomalies.orderBy(F.desc("confidence"), "row_id").limit(k)
