"""Cleaning: recommendations, cell repairs as conditional projections, and their audit trail."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veracell.dims import Range
from veracell.functions import values as V
from veracell.operators.numbering import number_rows
from veracell.operators.quantiles import quantiles
from veracell.operators.semantics import valid_value

# Per anomaly type the default action, the alternatives and the risk of automating.
ACTION_MAP = {
    "extreme_numeric_outlier": ("winsorize", ["review", "remove_row", "impute_median"], "caution"),
    "contextual_outlier": ("review", ["impute_conditional"], "manual_only"),
    "site_specific_anomaly": ("escalate_data_manager", ["normalize_site_effect", "review"],
                              "manual_only"),
    "temporal_inconsistency": ("flag_for_review", ["reorder_visits", "correct_date", "remove_row"],
                               "manual_only"),
    "duplicate_near_duplicate": ("merge_keep_complete", ["review", "remove_duplicate"], "caution"),
    "impossible_biological_value": ("correct_or_impute", ["convert_unit", "escalate_clinician",
                                                          "remove_row"], "manual_only"),
    "suspicious_missingness": ("annotate_pattern", ["impute_mice", "impute_knn",
                                                    "escalate_data_manager"], "caution"),
    "unit_mismatch": ("convert_unit", ["flag_for_review"], "safe"),
    "data_entry_typo": ("correct_pattern", ["review", "remove_field"], "caution"),
    "category_encoding_inconsistency": ("normalize_coding", ["flag_for_review"], "safe"),
    "drift_related_anomaly": ("annotate_drift_window", ["split_by_period",
                                                        "escalate_data_manager"], "manual_only"),
    "cross_field_contradiction": ("escalate_clinician", ["remove_contradicting_field"],
                                  "manual_only"),
    "visit_sequence_inconsistency": ("reorder_or_flag", ["remove_row", "impute_visit"],
                                     "manual_only"),
    "latent_cluster_isolated": ("review", ["remove_if_implausible"], "manual_only"),
    "graph_isolated_record": ("review_linkage", ["escalate_data_manager"], "manual_only"),
    "high_reconstruction_error": ("review", ["remove_row", "impute"], "manual_only"),
    "distributional_contamination": ("exclude_from_modeling", ["split_subpopulations"],
                                     "caution"),
    "rare_but_plausible": ("preserve_annotate", ["sensitivity_analysis_variant"], "manual_only"),
    "rare_and_implausible": ("escalate_clinician", ["remove_after_review"], "manual_only"),
}
# Spellings of sex and their code.
SEX_CODES = {"male": "M", "female": "F", "m": "M", "f": "F", "man": "M", "woman": "F"}
MEDIAN_ACTIONS = ["correct_or_impute", "impute_median", "impute_mice"]
REPAIRS = ["winsorize", *MEDIAN_ACTIONS, "impute_knn", "remove_row", "remove_field",
           "convert_unit", "normalize_coding", "correct_pattern"]


# ---- recommendations ---------------------------------------------------------------------------

def _action(t: Column) -> Column:
    table = F.create_map(*[x for k, (a, alt, risk) in ACTION_MAP.items() for x in (
        F.lit(k), F.struct(F.lit(a).alias("action"), F.array(*map(F.lit, alt)).alias("alt"),
                           F.lit(risk).alias("risk")))])
    unknown = F.struct(F.lit("review").alias("action"), F.array().cast("array<string>")
                       .alias("alt"), F.lit("manual_only").alias("risk"))
    return F.coalesce(F.try_element_at(table, t), unknown)


def default_action(anomaly_type: Column) -> Column:
    return _action(anomaly_type)["action"]


def recommend(anomalies: DataFrame, values: str = "values") -> DataFrame:
    """One line per anomaly and flagged column; ``values`` maps a column to its raw text.

    An anomaly of the whole row, such as a copy, has no flagged column and gives one line for
    column ``*``.
    """
    columns = F.when(F.size("flagged_columns") > 0, F.col("flagged_columns")).otherwise(
        F.array(F.lit("*")))
    each = anomalies.withColumn("column_name", F.explode(columns)).withColumn(
        "__a", _action(F.col("anomaly_type")))
    return each.select(
        "row_id", "column_name", "anomaly_type", "severity", "confidence",
        F.col("__a.action").alias("recommended_action"),
        F.col("__a.alt").alias("alternative_actions"), F.col("__a.risk").alias("auto_clean_risk"),
        "rationale", F.try_element_at(values, "column_name").alias("original_value"))


def safe_actions(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("auto_clean_risk") == "safe")


def manual_actions(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("auto_clean_risk") == "manual_only")


# ---- single repairs as expressions -------------------------------------------------------------

def winsorized(v: Column, p1: float, p99: float) -> Column:
    """The bound a value beyond the 1st or 99th percentile moves to; null if it stays."""
    return F.when(v < p1, F.round(F.lit(float(p1)), 4)).when(v > p99, F.round(F.lit(float(p99)), 4))


def normal_code(text: Column) -> Column:
    """Stripped lower case, sex spellings as M or F."""
    low = F.lower(V.strip(text))
    codes = F.create_map(*[F.lit(x) for kv in SEX_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, low), low)


def digit_slip(v: Column, variants: list[Range] | None) -> Column:
    """The value over 10, else over 100, whichever first is plausible; only with a range."""
    if not variants:
        return F.lit(None).cast("double")
    return F.coalesce(*[F.when(valid_value(v / d, variants), F.round(v / d, 4))
                        for d in (10, 100)])


def middle_mean(df: DataFrame, column: str, key: str, median: float, k: int = 5) -> float | None:
    """Mean of the k values nearest the median, ties by key: a top-k, not a sort."""
    v = V.number(df, column)
    near = (df.where(v.isNotNull()).select(v.alias("v"), key)
            .orderBy(F.abs(F.col("v") - F.lit(median)), key).limit(k))
    n, mean = near.agg(F.count("v"), F.avg("v")).first()
    return median if n < k else mean


# ---- applying recommendations ------------------------------------------------------------------

@dataclass
class RepairValues:
    """Column constants taken once from the input table."""
    p1: dict = field(default_factory=dict)
    p99: dict = field(default_factory=dict)
    median: dict = field(default_factory=dict)
    middle: dict = field(default_factory=dict)


def repair_values(df: DataFrame, key: str, actions: dict[str, set]) -> RepairValues:
    out = RepairValues()
    wins = [c for c, a in actions.items() if "winsorize" in a]
    meds = [c for c, a in actions.items() if a & {*MEDIAN_ACTIONS, "impute_knn"}]
    for cols, probs, targets in ((wins, [0.01, 0.99], (out.p1, out.p99)),
                                 (meds, [0.5], (out.median,))):
        if cols:
            q = quantiles(df, {c: V.number(df, c) for c in cols}, probs)
            for c in cols:
                for t, v in zip(targets, q[c]):
                    if v is not None:
                        t[c] = v
    for c in out.median:
        if "impute_knn" in actions[c]:
            out.middle[c] = middle_mean(df, c, key, out.median[c])
    return out


def _repair(df: DataFrame, c: str, actions: set, consts: RepairValues, variants,
            factor: float | None) -> Column:
    """Struct (new, applied, risk, why) for the cell's action, null for no change."""
    text, v = V.as_text(df, c), V.number(df, c)
    act = F.try_element_at("__acts", F.lit(c))

    def outcome(new, name, risk, why):
        return F.struct(new.cast("string").alias("new"), F.lit(name).alias("applied"),
                        F.lit(risk).alias("risk"), why.alias("why"))

    def checked(new, name, failed, why):
        ok = valid_value(new, variants)
        return F.when(ok, outcome(new, name, "caution", why)).otherwise(
            outcome(F.lit(None), failed, "manual_only", F.concat(
                F.lit("Value "), new.cast("string"), F.lit(" failed plausibility"))))

    said = F.coalesce(text, F.lit("None"))
    out = F.when(F.lit(False), outcome(F.lit(None), "", "", F.lit("")))
    if c in consts.p1 and c in consts.p99:
        new = winsorized(v, consts.p1[c], consts.p99[c])
        out = out.when((act == "winsorize") & new.isNotNull(), checked(
            new, "winsorize", "winsorize_rejected",
            F.concat(F.lit("Winsorized from "), said, F.lit(" to "), new.cast("string"),
                     F.lit(" (1st/99th percentile)"))))
    if c in consts.median and actions & set(MEDIAN_ACTIONS):
        new = F.round(F.lit(float(consts.median[c])), 4)
        out = out.when(act.isin(MEDIAN_ACTIONS), checked(
            new, "impute_median", "impute_rejected",
            F.concat(F.lit("Imputed with median "), new.cast("string"), F.lit(" (original: "),
                     said, F.lit(")"))))
    if c in consts.middle:
        new = F.round(F.lit(float(consts.middle[c])), 4)
        out = out.when((act == "impute_knn") & valid_value(new, variants), outcome(
            new, "impute_knn", "caution", F.concat(F.lit("KNN imputed to "),
                                                   new.cast("string"))))
    if "remove_field" in actions:
        out = out.when(act == "remove_field", outcome(
            F.lit(None), "remove_field", "caution",
            F.concat(F.lit("Field cleared (was: "), said, F.lit(")"))))
    if "normalize_coding" in actions:
        new = normal_code(text)
        out = out.when((act == "normalize_coding") & (new != text), outcome(
            new, "normalize_coding", "safe",
            F.concat(F.lit("Normalized encoding: '"), said, F.lit("' to '"), new, F.lit("'"))))
    if "correct_pattern" in actions:
        new = digit_slip(v, variants)
        out = out.when((act == "correct_pattern") & new.isNotNull(), outcome(
            new, "correct_pattern", "caution",
            F.concat(F.lit("Likely extra digit: "), said, F.lit(" to "), new.cast("string"))))
        out = out.when((act == "correct_pattern") & v.isNotNull(), outcome(
            F.lit(None), "correct_pattern_failed", "manual_only",
            F.lit("No pattern correction found")))
    if "convert_unit" in actions:
        if factor is None:
            out = out.when(act == "convert_unit", outcome(
                F.lit(None), "convert_unit_pending", "safe",
                F.lit("Unit conversion requires source and target units")))
        else:
            new = F.round(v * factor, 4)
            out = out.when((act == "convert_unit") & valid_value(new, variants), outcome(
                new, "convert_unit", "safe",
                F.concat(F.lit("Converted from "), said, F.lit(" to "), new.cast("string"))))
    handled = act.isin([a for a in REPAIRS])
    return out.when(act.isNotNull() & ~handled, outcome(
        F.lit(None), "flag_for_review", "manual_only", F.lit("Flagged, not changed")))


def _typed(text: Column, kind: T.DataType) -> Column:
    """Replacement text as the column's type; whole-number columns take the nearest number."""
    if isinstance(kind, T.IntegralType):
        return F.round(text.try_cast("double")).try_cast(kind)
    return text.try_cast(kind)


CHANGES = ["winsorize", "impute_median", "impute_knn", "remove_field", "normalize_coding",
           "correct_pattern", "convert_unit"]


def apply_actions(df: DataFrame, key: str, recs: DataFrame,
                  ranges: dict[str, list[Range]] | None = None,
                  factors: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, log) for recommendations (row_id, column_name, recommended_action).

    Recommendations meet the table in one join; every column is then one conditional projection.
    Column constants come from the input once, so the order of repairs does not matter. If a cell
    has several actions, the first by name is taken.
    """
    ranges, factors = ranges or {}, factors or {}
    known = set(df.columns)
    kinds = recs.where(F.col("column_name").isin(list(known))) \
        .select("column_name", "recommended_action").distinct().collect()
    actions: dict[str, set] = {}
    for r in kinds:
        actions.setdefault(r["column_name"], set()).add(r["recommended_action"])
    consts = repair_values(df, key, actions)
    per_cell = recs.groupBy("row_id", "column_name").agg(
        F.min("recommended_action").alias("a"))
    per_row = per_cell.groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "a"))).alias("__acts"),
        F.bool_or(F.col("a") == "remove_row").alias("__gone"))
    joined = df.join(per_row, df[key] == per_row["row_id"], "left").drop("row_id") \
        if key != "row_id" else df.join(per_row, "row_id", "left")
    cols = {c: _repair(df, c, a, consts, ranges.get(c), factors.get(c))
            for c, a in actions.items() if c != key}
    staged = joined.withColumns({f"__r_{i}": e for i, e in enumerate(cols.values())})
    gone = F.coalesce(F.col("__gone"), F.lit(False))
    cleaned = []
    for c in df.columns:
        old = V.col(c)
        if c == key:
            cleaned.append(old)
            continue
        new = old
        if c in cols:
            r = F.col(f"__r_{list(cols).index(c)}")
            kind = df.schema[c].dataType
            new = F.when(r["applied"].isin(CHANGES), _typed(r["new"], kind)).otherwise(old)
        cleaned.append(F.when(gone, F.lit(None)).otherwise(new).alias(c))
    entries = [F.when(F.col(f"__r_{i}").isNotNull(), F.struct(
        F.lit(c).alias("column_name"), V.as_text(df, c).alias("original_value"),
        F.col(f"__r_{i}")["new"].alias("new_value"), F.col(f"__r_{i}")["applied"].alias("action"),
        F.col(f"__r_{i}")["risk"].alias("risk_level"),
        F.col(f"__r_{i}")["why"].alias("rationale"))) for i, c in enumerate(cols)]
    whole = F.when(gone, F.struct(
        F.lit("__all__").alias("column_name"),
        F.to_json(F.struct(*[V.col(c) for c in df.columns])).alias("original_value"),
        F.lit(None).cast("string").alias("new_value"), F.lit("remove_row").alias("action"),
        F.lit("manual_only").alias("risk_level"), F.concat(
            F.lit("Row "), V.col(key).cast("string"), F.lit(" marked for removal"))
        .alias("rationale")))
    log = staged.where(F.col("__acts").isNotNull()).select(
        V.col(key).alias("row_id"), F.inline(F.filter(
            F.array(whole, *entries), lambda s: s.isNotNull())))
    return staged.select(*cleaned), log


def propose(recs: DataFrame, log: DataFrame) -> DataFrame:
    """Recommendations with the value each would write."""
    new = log.select("row_id", "column_name", F.col("new_value").alias("proposed_value"))
    return recs.join(new, ["row_id", "column_name"], "left")


def remove_rows(df: DataFrame, key: str, ids: DataFrame, drop: bool = False) -> DataFrame:
    """Blank every cell of the listed rows, or drop the rows."""
    marks = ids.select(F.col("row_id").alias(key)).distinct()
    if drop:
        return df.join(marks, key, "left_anti")
    marked = df.join(marks.withColumn("__gone", F.lit(True)), key, "left")
    return marked.select(key, *[F.when(F.col("__gone"), F.lit(None)).otherwise(V.col(c)).alias(c)
                                for c in df.columns if c != key])


# ---- audit trail -------------------------------------------------------------------------------

def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells that differ between two versions of a table: one join, one bounded array per row."""
    a = before.select(key, F.struct(*[V.as_text(before, c).alias(c) for c in columns]).alias("a"))
    b = after.select(key, F.struct(*[V.as_text(after, c).alias(c) for c in columns]).alias("b"))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.col(f"a.`{c}`").alias("original_value"),
                               F.col(f"b.`{c}`").alias("new_value")) for c in columns])
    diff = F.filter(cells, lambda s: ~s["original_value"].eqNullSafe(s["new_value"]))
    return a.join(b, key).select(F.col(key).alias("row_id"), F.inline(diff))


def audit(log: DataFrame, run_id: str, method: str, seed: int = 42, version: str = "1.0",
          params: dict[str, str] | None = None, at: Column | None = None) -> DataFrame:
    """Ledger lines with ``TXN-yyyymmdd-NNNN`` ids in (column, row) order."""
    now = at if at is not None else F.current_timestamp()
    stamped = number_rows(log.withColumn("timestamp", now), ["column_name", "row_id"], "__n")
    params_col = F.create_map(*[F.lit(x) for kv in (params or {}).items() for x in kv]) \
        if params else F.create_map().cast("map<string,string>")
    return stamped.select(
        F.concat(F.lit("TXN-"), F.date_format("timestamp", "yyyyMMdd"), F.lit("-"),
                 F.when(F.col("__n") < 10000, F.lpad(F.col("__n").cast("string"), 4, "0"))
                 .otherwise(F.col("__n").cast("string"))).alias("transaction_id"),
        "timestamp", F.lit(run_id).alias("run_id"), F.lit(None).cast("string").alias("anomaly_id"),
        "row_id", "column_name", "original_value", "new_value", "action",
        F.lit(method).alias("method_trigger"), "risk_level",
        F.lit(None).cast("string").alias("approved_by"), "rationale",
        F.struct(F.lit(version).alias("engine_version"), F.lit(seed).alias("random_seed"),
                 params_col.alias("method_params")).alias("reproducibility"))


def _turn() -> Column:
    """The place of a ledger line in time: its moment, then the number in its id."""
    return F.struct(F.col("timestamp"), F.regexp_extract("transaction_id", r"(\d+)$", 1).cast(
        "long").alias("number"))


def replay(ledger: DataFrame) -> DataFrame:
    """The lines in the order in which they were written."""
    return ledger.orderBy(_turn())


def rebuild(df: DataFrame, key: str, ledger: DataFrame, at: Column | None = None) -> DataFrame:
    """The table as the ledger's changes up to a moment (all without one) leave it.

    Of a cell's changes the last one counts: a maximum by time, which partitions combine before
    the exchange, so no cell's history is sorted. Removed rows are blank but for the key.
    """
    lines = ledger if at is None else ledger.where(F.col("timestamp") <= at)
    lines = lines.where(F.col("action").isin([*CHANGES, "remove_row"]))
    cells = lines.groupBy("row_id", "column_name").agg(F.max_by(
        F.struct("new_value"), _turn()).alias("v"))
    rows = cells.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "column_name", F.col("v.new_value")))).alias("__v"))
    joined = df.join(rows.withColumnRenamed("row_id", "__row"), F.col(key) == F.col("__row"),
                     "left")
    gone = F.coalesce(F.map_contains_key("__v", F.lit("__all__")), F.lit(False))
    out = [V.col(c) if c == key else F.when(gone, F.lit(None)).when(
        F.map_contains_key("__v", F.lit(c)), _typed(F.col("__v")[c], df.schema[c].dataType))
        .otherwise(V.col(c)).alias(c) for c in df.columns]
    return joined.select(*out)


def before_after(recs: DataFrame) -> DataFrame:
    return recs.select("row_id", "column_name", "original_value", "proposed_value",
                       F.col("recommended_action").alias("action"), "severity")
