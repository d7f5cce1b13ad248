"""Queries over cleaning, its audit trail and exports."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell import sources
from veracell.dims import Range
from veracell.functions import values as V
from veracell.operators import clean as C, metrics as M
from veracell.operators.quantiles import quantiles
from veracell.plans.catalog_explain import ANOM, anomalies
from veracell.plans.registry import query, table

ACT = """CASE anomaly_type WHEN 'impossible_biological_value' THEN 'correct_or_impute' WHEN
 'extreme_numeric_outlier' THEN 'winsorize' WHEN 'rare_and_implausible' THEN 'escalate_clinician' WHEN
 'distributional_contamination' THEN 'exclude_from_modeling' ELSE 'review' END"""
RISK = """CASE WHEN anomaly_type IN ('extreme_numeric_outlier', 'distributional_contamination') THEN 'caution'
 ELSE 'manual_only' END"""
RECS = f"""{ANOM}, rc AS (SELECT row_id, 'p_retailprice' AS column_name, {ACT} AS action, {RISK} AS risk,
 p_retailprice::VARCHAR AS original_value FROM t UNION ALL SELECT row_id, 'p_size', {ACT}, {RISK},
 p_size::VARCHAR FROM t WHERE two)"""


@query("recommendations_part", f"WITH {RECS} SELECT * FROM rc")
def _(spark, d):
    return C.recommend(anomalies(spark, d)).select(
        "row_id", "column_name", F.col("recommended_action").alias("action"),
        F.col("auto_clean_risk").alias("risk"), "original_value")


@query("manual_actions_part", f"WITH {RECS} SELECT row_id, column_name FROM rc WHERE risk = 'manual_only'")
def _(spark, d):
    return C.manual_actions(C.recommend(anomalies(spark, d))).select("row_id", "column_name")


@query("action_distribution_part", f"""WITH {RECS} SELECT risk AS auto_clean_risk, action AS
 recommended_action, count(*)::BIGINT AS cells, count(DISTINCT row_id)::BIGINT AS rows FROM rc GROUP BY 1, 2""")
def _(spark, d):
    return M.cleaning_plan(C.recommend(anomalies(spark, d)))


@query("winsorized_lineitem", f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo,
 quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey,
 l_extendedprice AS before, CASE WHEN l_extendedprice < lo THEN round(lo, 4) WHEN l_extendedprice > hi THEN
 round(hi, 4) ELSE l_extendedprice END AS after FROM lineitem, q""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    lo, hi = quantiles(df, {"p": F.col("l_extendedprice")}, [0.01, 0.99])["p"]
    v = F.col("l_extendedprice")
    return df.select("l_orderkey", "l_partkey", "l_suppkey", v.alias("before"),
                     F.coalesce(C.winsorized(v, lo, hi), v).alias("after"))


def part_recs(spark, d, column, action, modulus):
    k = F.col("p_partkey")
    return table(spark, d, "part").where(k % modulus == 0).select(
        k.alias("row_id"), F.lit(column).alias("column_name"),
        F.lit(action).alias("recommended_action"))


@query("median_imputed_part", """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN round((SELECT
 median(p_retailprice) FROM part), 4) ELSE p_retailprice END AS price FROM part""")
def _(spark, d):
    out, _ = C.apply_actions(table(spark, d, "part"), "p_partkey",
                             part_recs(spark, d, "p_retailprice", "impute_median", 9))
    return out.select("p_partkey", F.col("p_retailprice").alias("price"))


@query("middle_imputed_part", """WITH m AS (SELECT median(p_retailprice) AS m FROM part), f AS (SELECT
 p_retailprice FROM part, m ORDER BY abs(p_retailprice - m), p_partkey LIMIT 5) SELECT p_partkey, CASE WHEN
 p_partkey % 9 = 0 THEN round((SELECT avg(p_retailprice) FROM f), 4) ELSE p_retailprice END AS price
 FROM part""")
def _(spark, d):
    out, _ = C.apply_actions(table(spark, d, "part"), "p_partkey",
                             part_recs(spark, d, "p_retailprice", "impute_knn", 9))
    return out.select("p_partkey", F.col("p_retailprice").alias("price"))


@query("removed_rows_orders", """SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN o_orderstatus END AS status,
 CASE WHEN o_custkey % 10 > 0 THEN o_totalprice END AS price FROM orders""")
def _(spark, d):
    df = table(spark, d, "orders")
    ids = df.where(F.col("o_custkey") % 10 == 0).select(F.col("o_orderkey").alias("row_id"))
    return C.remove_rows(df, "o_orderkey", ids).select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@query("dropped_rows_orders", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 > 0")
def _(spark, d):
    df = table(spark, d, "orders")
    ids = df.where(F.col("o_custkey") % 10 == 0).select(F.col("o_orderkey").alias("row_id"))
    return C.remove_rows(df, "o_orderkey", ids, drop=True).select("o_orderkey")


@query("removed_fields_part", """SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS p_brand, p_type
 FROM part""")
def _(spark, d):
    out, _ = C.apply_actions(table(spark, d, "part"), "p_partkey",
                             part_recs(spark, d, "p_brand", "remove_field", 4))
    return out.select("p_partkey", "p_brand", "p_type")


@query("normalised_coding_customer", """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'M' WHEN c_nationkey
 % 3 = 1 THEN 'F' ELSE lower(c_mktsegment) END AS sex FROM customer""")
def _(spark, d):
    k = F.col("c_nationkey") % 3
    df = table(spark, d, "customer").select("c_custkey", F.when(k == 0, " MALE ").when(
        k == 1, "woman").otherwise(F.col("c_mktsegment")).alias("sex"))
    recs = df.select(F.col("c_custkey").alias("row_id"), F.lit("sex").alias("column_name"),
                     F.lit("normalize_coding").alias("recommended_action"))
    return C.apply_actions(df, "c_custkey", recs)[0]


SLIP = [Range("p_size", 1, 50)]


@query("digit_slips_part", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10.0 / 10 WHEN p_partkey
 % 3 = 1 THEN p_size * 100.0 / CASE WHEN p_size * 10.0 BETWEEN 1 AND 50 THEN 10 ELSE 100 END ELSE p_size
 END::DOUBLE AS size FROM part""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    df = table(spark, d, "part").select("p_partkey", F.when(k == 0, F.col("p_size") * 10.0).when(
        k == 1, F.col("p_size") * 100.0).otherwise(F.col("p_size").cast("double")).alias("size"))
    fixed = C.digit_slip(F.col("size"), SLIP)
    return df.select("p_partkey", F.when(k < 2, F.coalesce(fixed, F.col("size"))).otherwise(
        F.col("size")).alias("size"))


def cleaned_part(spark, d):
    df = table(spark, d, "part")
    recs = part_recs(spark, d, "p_retailprice", "winsorize", 2).unionByName(
        part_recs(spark, d, "p_brand", "normalize_coding", 5)).unionByName(
        part_recs(spark, d, "p_type", "review", 7)).unionByName(
        part_recs(spark, d, "p_size", "correct_or_impute", 11)).unionByName(
        part_recs(spark, d, "p_name", "remove_row", 499))
    return df, *C.apply_actions(df, "p_partkey", recs, {"p_size": SLIP})


LOG = """q AS (SELECT quantile_cont(p_retailprice, 0.01) AS lo, quantile_cont(p_retailprice, 0.99) AS hi,
 median(p_size) AS mid FROM part), lg AS (SELECT p_partkey AS row_id, 'p_retailprice' AS column_name,
 'winsorize' AS action, 'caution' AS risk_level FROM part, q WHERE p_partkey % 2 = 0 AND (p_retailprice < lo OR
 p_retailprice > hi) UNION ALL SELECT p_partkey, 'p_brand', 'normalize_coding', 'safe' FROM part WHERE
 p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'p_type', 'flag_for_review', 'manual_only' FROM part WHERE
 p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'p_size', 'impute_median', 'caution' FROM part WHERE p_partkey
 % 11 = 0 UNION ALL SELECT p_partkey, '__all__', 'remove_row', 'manual_only' FROM part WHERE p_partkey % 499 = 0)"""


@query("applied_actions_part", f"WITH {LOG} SELECT * FROM lg")
def _(spark, d):
    _, _, log = cleaned_part(spark, d)
    return log.select("row_id", "column_name", "action", "risk_level")


@query("cell_changes_part", """WITH q AS (SELECT quantile_cont(p_retailprice, 0.01) AS lo,
 quantile_cont(p_retailprice, 0.99) AS hi, round(median(p_size), 4) AS mid FROM part) SELECT column_name,
 count(*)::BIGINT AS changed FROM (SELECT 'p_retailprice' AS column_name FROM part, q WHERE p_partkey % 499 = 0
 OR (p_partkey % 2 = 0 AND ((p_retailprice < lo AND p_retailprice <> round(lo, 4)) OR (p_retailprice > hi AND
 p_retailprice <> round(hi, 4)))) UNION ALL SELECT 'p_brand' FROM part WHERE p_partkey % 5 = 0 OR p_partkey %
 499 = 0 UNION ALL SELECT 'p_size' FROM part, q WHERE p_partkey % 499 = 0 OR (p_partkey % 11 = 0 AND p_size <>
 round(mid)) UNION ALL SELECT unnest(['p_name', 'p_type']) FROM part WHERE p_partkey % 499 =
 0) GROUP BY 1""")
def _(spark, d):
    df, after, _ = cleaned_part(spark, d)
    cols = [c for c in df.columns if c != "p_partkey"]
    return C.changes(df, after, "p_partkey", cols).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("changed"))




def ledger(spark, d):
    _, _, log = cleaned_part(spark, d)
    return C.audit(log, "run-001", "lof", at=F.lit("2026-01-02 03:04:05").cast("timestamp"))


@query("audit_ledger_part", f"""WITH {LOG} SELECT 'TXN-20260102-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4,
 '0') ELSE n::VARCHAR END AS transaction_id, row_id, column_name, action FROM (SELECT *, row_number() OVER (ORDER
 BY column_name, row_id) AS n FROM lg)""")
def _(spark, d):
    return ledger(spark, d).select("transaction_id", "row_id", "column_name", "action")


@query("audit_replay_part", f"WITH {LOG} SELECT count(*)::BIGINT AS entries, count(DISTINCT row_id)::BIGINT AS rows FROM lg")
def _(spark, d):
    return C.replay(ledger(spark, d)).agg(F.count(F.lit(1)).alias("entries"),
                                          F.count_distinct("row_id").alias("rows"))


@query("rebuilt_table_part", """WITH m AS (SELECT round(median(p_retailprice), 4) AS m FROM part)
 SELECT p_partkey, p_size, p_retailprice AS before, CASE WHEN p_partkey % 9 = 0 THEN m ELSE
 p_retailprice END AS first, CASE WHEN p_partkey % 18 = 9 THEN m ELSE p_retailprice END AS last
 FROM part, m""")
def _(spark, d):
    """Repairs of one day, half of them taken back on the next: the table after each day."""
    df = table(spark, d, "part")
    _, log = C.apply_actions(df, "p_partkey", part_recs(spark, d, "p_retailprice",
                                                        "impute_median", 9))
    undone = log.where("row_id % 18 = 0").withColumns({
        "original_value": F.col("new_value"), "new_value": F.col("original_value")})
    days = [F.lit(t).cast("timestamp") for t in (
        "2024-01-01 10:00:00", "2024-01-02 10:00:00")]
    book = C.audit(undone, "r2", "lof", at=days[1]).unionByName(C.audit(
        log, "r1", "lof", at=days[0]))
    first, last = (C.rebuild(df, "p_partkey", book, t).select(
        "p_partkey", F.col("p_retailprice").alias(name)) for t, name in zip(days, ("first", "last")))
    return df.select("p_partkey", "p_size", F.col("p_retailprice").alias("before")).join(
        first, "p_partkey").join(last, "p_partkey")


@query("audit_export_part", f"""WITH {LOG} SELECT row_id::VARCHAR AS row_index, column_name, action, 'lof' AS
 method_trigger, risk_level FROM lg""")
def _(spark, d):
    return sources.audit_log(ledger(spark, d)).select(
        "row_index", "column_name", "action", "method_trigger", "risk_level")


@query("audit_page_part", f"""WITH {LOG} SELECT row_id, column_name FROM lg ORDER BY column_name, row_id LIMIT 25
 OFFSET 50""")
def _(spark, d):
    return M.page(ledger(spark, d), [F.col("transaction_id")], 50, 25).select(
        "row_id", "column_name")


@query("before_after_cells_part", f"""WITH {LOG} SELECT p_partkey AS row_id, p_retailprice::VARCHAR AS
 original_value, (CASE WHEN p_retailprice < lo THEN round(lo, 4) ELSE round(hi, 4) END) AS proposed FROM part, q
 WHERE p_partkey % 2 = 0 AND (p_retailprice < lo OR p_retailprice > hi)""")
def _(spark, d):
    df = table(spark, d, "part")
    recs = part_recs(spark, d, "p_retailprice", "winsorize", 2)
    _, log = C.apply_actions(df, "p_partkey", recs)
    full = recs.withColumn("severity", F.lit("high")).join(
        df.select(F.col("p_partkey").alias("row_id"), V.as_text(df, "p_retailprice")
                  .alias("original_value")), "row_id")
    return C.before_after(C.propose(full, log)).where("proposed_value IS NOT NULL").select(
        "row_id", "original_value", F.col("proposed_value").cast("double").alias("proposed"))


@query("safe_auto_clean_customer", """SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer""")
def _(spark, d):
    df = table(spark, d, "customer")
    found = df.select(
        F.col("c_custkey").alias("row_id"), F.array(F.lit("c_mktsegment")).alias("flagged_columns"),
        F.lit("category_encoding_inconsistency").alias("anomaly_type"), F.lit("low").alias("severity"),
        F.lit(0.8).alias("confidence"), F.lit("").alias("rationale"),
        F.create_map(F.lit("c_mktsegment"), F.col("c_mktsegment")).alias("values"))
    out, _ = C.apply_actions(df, "c_custkey", C.safe_actions(C.recommend(found)))
    return out.select("c_custkey", "c_mktsegment")


@query("method_export_events", """SELECT event_type AS method, printf('%.4f', least(1.0, avg(value) / 100)) AS ad,
 count(*)::BIGINT AS anomaly_count FROM events GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(
        F.least(F.lit(1.0), F.avg("value") / 100).alias("ad"), F.count(F.lit(1)).alias("anomaly_count"))
    m = e.select("*", *[F.lit(0.0).alias(c) for c in ("composite", "ndc", "ss", "cp", "ex", "cc")],
                 F.lit(1).alias("duration_ms"), F.lit(False).alias("selected"))
    return sources.method_log(m).select("method", "ad", "anomaly_count")


@query("result_tables_round_trip", f"""WITH {ANOM} SELECT 'r1' AS run_id, severity, count(*)::BIGINT AS n FROM t
 GROUP BY 2""")
def _(spark, d):
    from veracell.functions.session import scratch_path
    path = scratch_path(spark, "results")
    sources.write_results({"anomaly_records": anomalies(spark, d)}, path, "r1")
    back = spark.read.parquet(f"{path}/anomaly_records")
    return back.groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("full_analysis_part")
def _(spark, d):
    from veracell.plans.analysis import analyze
    run = analyze(table(spark, d, "part"), ["p_partkey"])
    return run.anomalies.select("row_id", "anomaly_type", "severity", "confidence",
                                "flagged_columns", "card.summary")


@query("auto_clean_metrics_customer")
def _(spark, d):
    from veracell.plans.analysis import Config, analyze
    df = table(spark, d, "customer").withColumn("sex", F.when(
        F.col("c_custkey") % 9 == 0, " male ").when(F.col("c_custkey") % 2 == 0, "M").otherwise("F"))
    run = analyze(df, ["c_custkey"], Config(mode="auto"))
    return M.compare(M.long_metrics(run.before), M.long_metrics(run.after))


@query("simulated_plan_part")
def _(spark, d):
    df, after, log = cleaned_part(spark, d)
    n = log.groupBy("action").agg(F.count(F.lit(1)).alias("cells"))
    bad = after.agg(F.avg((F.col("p_size") > 48).cast("double")).alias("implausible_after"))
    return n.crossJoin(bad)
