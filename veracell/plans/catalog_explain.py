"""Queries over explanations and summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell.dims import Range
from veracell.operators import explain as EX, metrics as M, quantiles as Q
from veracell.plans.catalog_detect import KNN, vectors
from veracell.plans.registry import long, query, r, table, union_all

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
Z = f"""z AS (SELECT {KEY}, {", ".join(f"abs({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-10) AS "
                                      f"z{i}" for i, c in enumerate(COLS))} FROM lineitem),
 rr AS (SELECT *, {", ".join(f"round(z{i}, 4) AS r{i}" for i in range(4))} FROM z),
 n AS (SELECT *, {", ".join(f"round((r{i} / (r0 + r1 + r2 + r3))::DECIMAL(20, 12), 4)::DOUBLE AS n{i}" for i in range(4))} FROM rr)"""
KEYS = """l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice AS
 price"""


def raw_lines(spark, d):
    """(row_id, x) with the raw numbers of each line item."""
    return table(spark, d, "lineitem").select(
        F.struct("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_partkey",
                 "l_suppkey", F.col("l_extendedprice").alias("price")).alias("row_id"),
        F.array(*COLS).alias("x"))


@query("z_contributions_lineitem", f"WITH {Z} SELECT {KEYS}, "
       + ", ".join(f"round(z{i}, 4) AS z{i}" for i in range(4)) + " FROM z")
def _(spark, d):
    feats = raw_lines(spark, d)
    means, stds = EX.feature_stats(feats)
    z = feats.select("row_id", EX.z_contribution(F.col("x"), means, stds).alias("z"))
    return z.select("row_id.*", *[r(F.col("z")[i], 4).alias(f"z{i}") for i in range(4)])


@query("normal_contributions_lineitem", f"WITH {Z} SELECT {KEYS}, "
       + ", ".join(f"n{i}" for i in range(4)) + " FROM n")
def _(spark, d):
    feats = raw_lines(spark, d)
    out = EX.contributions("z", feats, feats, {})
    return out.select("row_id.*", *[F.col("contrib")[i].alias(f"n{i}") for i in range(4)])


@query("flagged_columns_lineitem", f"WITH {Z} SELECT {KEYS}, array_to_string(list_transform(list_sort("
       "list_filter([" + ", ".join(f"struct_pack(v := -n{i}, i := {i}, c := '{c}')"
                                   for i, c in enumerate(COLS))
       + "], lambda s: s.v < -0.01)), lambda s: s.c), ';') AS flagged FROM n")
def _(spark, d):
    feats = raw_lines(spark, d)
    ranked = EX.ranked_features(F.col("contrib"), COLS)
    return EX.contributions("z", feats, feats, {}).select(
        "row_id.*", F.concat_ws(";", EX.flagged_features(ranked)).alias("flagged"))


@query("neighbour_contributions_embeddings", f"""WITH {KNN}, e AS (SELECT vec_id,
 embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT n.a, {", ".join(
     f"avg(o.v[{i}]) AS m{i}" for i in range(1, 5))} FROM n JOIN e o ON n.b = o.vec_id GROUP BY n.a)
 SELECT a AS row_id, {", ".join(f"round((v[{i}] - m{i}) * (v[{i}] - m{i}), 8) AS d{i}"
                               for i in range(1, 5))} FROM m JOIN e ON a = vec_id""")
def _(spark, d):
    feats = vectors(spark, d)
    return EX.neighbour_contribution(feats, feats).select(
        "row_id", *[r(F.col("raw")[i - 1], 8).alias(f"d{i}") for i in range(1, 5)])


@query("method_contributions_lineitem")
def _(spark, d):
    feats = raw_lines(spark, d)
    stats = EX.feature_stats(feats)
    parts = [EX.contributions(m, feats, feats, meta, stats).select(
        F.lit(m).alias("method"), F.col("contrib")[0].alias("first"),
        F.aggregate("contrib", F.lit(0.0), lambda a, v: a + v).alias("mass"))
        for m, meta in (("isolation_forest", {"importances": [.4, .3, .2, .1]}),
                        ("autoencoder", {"feature_error": [1., 2., 3., 4.]}),
                        ("robust_pca", {"sparse_magnitude": [.1, .2, .3, .4]}))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("method").agg(r(F.avg("first"), 4).alias("mean_first"),
                                     r(F.avg("mass"), 3).alias("mean_mass"))


@query("clean_twins_embeddings", """SELECT a AS row_id, b AS twin_id, round(d, 4) AS distance FROM (SELECT
 x.vec_id AS a, y.vec_id AS b, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d FROM
 embeddings x JOIN embeddings y ON x.label = 0 AND y.label <> 0) QUALIFY row_number() OVER (PARTITION BY a
 ORDER BY d, b) = 1""")
def _(spark, d):
    flags = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                 (F.col("label") == 0).alias("flagged"))
    return EX.clean_twins(vectors(spark, d), flags).select(
        "row_id", "twin_id", r("distance", 4).alias("distance"))


@query("twin_differences_customer")
def _(spark, d):
    from veracell.operators.features import numeric_matrix
    df = table(spark, d, "customer")
    cols = ["c_nationkey", "c_acctbal"]
    feats = numeric_matrix(df, "c_custkey", cols)
    flags = df.select(F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") < 0).alias("flagged"))
    return EX.twin_differences(EX.clean_twins(feats, flags), feats, df, "c_custkey", cols)


@query("raw_twins_supplier", """SELECT x.s_suppkey AS row_id, y.s_suppkey AS twin_id, array_to_string(
 list_filter(['s_name', CASE WHEN x.s_nationkey <> y.s_nationkey THEN 's_nationkey' END,
 CASE WHEN abs(x.s_acctbal - y.s_acctbal) > 1e-6 THEN 's_acctbal' END], lambda c: c IS NOT NULL), ';') AS
 differing FROM supplier x JOIN supplier y ON x.s_acctbal < 1000 AND y.s_acctbal >= 1000 QUALIFY
 row_number() OVER (PARTITION BY x.s_suppkey ORDER BY sqrt((x.s_nationkey - y.s_nationkey) *
 (x.s_nationkey - y.s_nationkey) + (x.s_acctbal - y.s_acctbal) * (x.s_acctbal - y.s_acctbal)),
 y.s_suppkey) = 1""")
def _(spark, d):
    df = table(spark, d, "supplier")
    flags = df.select(F.col("s_suppkey").alias("row_id"), (F.col("s_acctbal") < 1000).alias("flagged"))
    out = EX.raw_twins(df, "s_suppkey", ["s_nationkey", "s_acctbal"], flags)
    return out.select("row_id", "twin_id", F.concat_ws(";", "differing_columns").alias("differing"))


# ---- anomalies derived from part ---------------------------------------------------------------

RANGES = {"p_size": Range("p_size", 4, 30, "cm")}


def anomalies(spark, d):
    """All parts with the inputs of the type cascade."""
    df = table(spark, d, "part")
    k = F.col("p_partkey")
    rows = df.select(
        k.alias("row_id"), (k % 100 / 100.0).alias("score"), (k % 3 / 3.0).alias("agreement"),
        (k % 5 == 0).alias("noise"),
        F.when(k % 4 == 0, F.array(F.lit("p_size"), F.lit("p_retailprice"))).otherwise(
            F.array(F.lit("p_retailprice"))).alias("flagged_columns"),
        F.when(k % 7 == 0, 0.7).otherwise(0.4).alias("top_share"),
        F.create_map(F.lit("p_size"), F.col("p_size").cast("string"), F.lit("p_retailprice"),
                     F.col("p_retailprice").cast("string"), F.lit("p_brand"), F.col("p_brand"))
        .alias("values"))
    return EX.classify(rows, "isolation_forest", RANGES)


ANOM = """a AS (SELECT p_partkey AS row_id, p_brand, p_size, p_retailprice, k % 100 / 100.0::DOUBLE AS score,
 k % 3 / 3.0::DOUBLE AS agreement, k % 5 = 0 AS noise, k % 4 = 0 AS two, k % 7 = 0 AS top FROM (SELECT *,
 p_partkey AS k FROM part)), b AS (SELECT *, CASE WHEN two AND (p_size < 2 OR p_size > 45)
 THEN 'impossible_biological_value' WHEN top THEN 'extreme_numeric_outlier' WHEN noise AND score > 0.8 THEN
 'rare_and_implausible' WHEN noise THEN 'latent_cluster_isolated' WHEN agreement < 0.5 THEN
 'contextual_outlier' WHEN score > 0.7 THEN 'extreme_numeric_outlier' ELSE 'distributional_contamination' END
 AS anomaly_type, CASE WHEN two AND (p_size < 2 OR p_size > 45) THEN 0.95 WHEN top THEN least(score + 0.1,
 0.99) WHEN noise THEN score WHEN agreement < 0.5 THEN score * 0.8 ELSE score END AS conf FROM a),
 t AS (SELECT *, round(conf, 3)::DOUBLE AS confidence, CASE anomaly_type WHEN 'impossible_biological_value'
 THEN 'critical' WHEN 'extreme_numeric_outlier' THEN 'high' WHEN 'rare_and_implausible' THEN 'high' WHEN
 'latent_cluster_isolated' THEN 'low' ELSE 'medium' END AS severity FROM b)"""


@query("anomaly_types_part", f"WITH {ANOM} SELECT row_id, anomaly_type, confidence FROM t")
def _(spark, d):
    return anomalies(spark, d).select("row_id", "anomaly_type", "confidence")


@query("anomaly_severity_part", f"""WITH {ANOM} SELECT severity, count(*)::BIGINT AS n FROM t GROUP BY 1""")
def _(spark, d):
    return anomalies(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def carded(spark, d):
    a = anomalies(spark, d).withColumn("drivers", F.array(
        F.struct(F.lit("p_size").alias("name"), F.lit(0.6).alias("value")),
        F.struct(F.lit("p_brand").alias("name"), F.lit(0.3).alias("value"))))
    from veracell.operators.clean import default_action
    return EX.cards(a.withColumn("action", default_action(F.col("anomaly_type"))), RANGES)


@query("explanation_cards_part", f"""WITH {ANOM} SELECT row_id, 'Key drivers: p_size=' || p_size ||
 ' (contribution: 60%); p_brand=' || p_brand || ' (contribution: 30%).' AS finding, CASE WHEN two THEN
 'Normal range: 4-30 cm' ELSE 'No specific clinical reference available' END AS context, (CASE WHEN
 confidence >= 0.9 THEN 'Very High' WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.5 THEN 'Moderate'
 ELSE 'Low' END) AS label, CASE severity WHEN 'critical' THEN
 'Could bias safety analyses and lead to incorrect clinical conclusions.' WHEN 'high' THEN
 'May affect statistical summaries and downstream modeling.' WHEN 'medium' THEN
 'Could introduce minor noise in analyses.' ELSE
 'Low risk to downstream analyses, but worth documenting.' END AS risk FROM t""")
def _(spark, d):
    return carded(spark, d).select(
        "row_id", "card.finding", F.col("card.clinical_context").alias("context"),
        F.regexp_extract("card.confidence_label", r"^(.*) \(", 1).alias("label"),
        F.col("card.risk_if_uncorrected").alias("risk"))


@query("simple_cards_customer", """SELECT c_custkey, 'Record for patient ' || c_name || ' (visit: ' || c_nationkey
 || ') was flagged as ''contextual_outlier'' with 60% confidence.' AS card FROM customer""")
def _(spark, d):
    none = F.array().cast("array<struct<name:string,value:double>>")
    return table(spark, d, "customer").select("c_custkey", EX.simple_card(
        F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.lit("contextual_outlier"),
        F.lit(0.6), none).alias("card"))


@query("global_drivers_lineitem", f"""WITH {Z}, m AS (SELECT {", ".join(
    f"sum(abs(n{i})) AS m{i}" for i in range(4))} FROM n) {union_all([
        f"SELECT '{c}' AS column_name, round(m{i} / (m0 + m1 + m2 + m3) * 100, 1) AS contribution_pct FROM m"
        for i, c in enumerate(COLS)])}""")
def _(spark, d):
    feats = raw_lines(spark, d)
    return EX.global_drivers(EX.contributions("z", feats, feats, {}), COLS)


@query("type_distribution_part", f"""WITH {ANOM} SELECT anomaly_type, count(*)::BIGINT AS n, round(count(*) /
 sum(count(*)) OVER () * 100, 1)::DOUBLE AS pct FROM t GROUP BY 1""")
def _(spark, d):
    return EX.distribution(anomalies(spark, d), "anomaly_type")


@query("narrative_part", f"""WITH {ANOM} SELECT 'Detected ' || count(*) || ' anomalies across ' || (SELECT
 count(*) FROM part) || ' records (' || (round(count(*) / (SELECT count(*) FROM part)::DOUBLE * 100, 2)) ||
 '% noise rate).' AS opening FROM t""")
def _(spark, d):
    a = anomalies(spark, d)
    drivers = a.select(F.explode("flagged_columns").alias("column_name")).groupBy("column_name") \
        .agg(F.count(F.lit(1)).cast("double").alias("contribution_pct"))
    text = EX.narrative(a, drivers, table(spark, d, "part").count())
    return text.select(F.regexp_extract("narrative", r"^(.*?noise rate\)\.)", 1).alias("opening"))


@query("column_contrast_lineitem", """WITH c AS (SELECT quantile_cont(l_extendedprice, 0.95) AS q FROM
 lineitem) SELECT 'l_quantity' AS column_name, round(avg(l_quantity) FILTER (WHERE l_extendedprice > q), 4)
 AS flagged_mean, round(stddev_samp(l_quantity) FILTER (WHERE l_extendedprice > q), 4) AS flagged_std,
 round(avg(l_quantity) FILTER (WHERE l_extendedprice <= q), 4) AS normal_mean, count(*) FILTER (WHERE
 l_extendedprice > q)::BIGINT AS flagged_values FROM lineitem, c UNION ALL SELECT 'l_tax',
 round(avg(l_tax) FILTER (WHERE l_extendedprice > q), 4), round(stddev_samp(l_tax) FILTER (WHERE
 l_extendedprice > q), 4), round(avg(l_tax) FILTER (WHERE l_extendedprice <= q), 4), count(*) FILTER (WHERE
 l_extendedprice > q)::BIGINT FROM lineitem, c""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    cut = Q.quantiles(df, {"p": F.col("l_extendedprice")}, [0.95])["p"][0]
    out = EX.column_contrast(df, ["l_quantity", "l_tax"], F.col("l_extendedprice") > cut)
    return out.select("column_name", *[r(c, 4).alias(c) for c in (
        "flagged_mean", "flagged_std", "normal_mean")], "flagged_values")


@query("top_flagged_part", f"""WITH {ANOM} SELECT row_id, anomaly_type, confidence FROM t ORDER BY confidence
 DESC, row_id LIMIT 40""")
def _(spark, d):
    return EX.top_records(anomalies(spark, d)).select("row_id", "anomaly_type", "confidence")


# ---- result queries ----------------------------------------------------------------------------

@query("column_errors_part", f"""WITH {ANOM} SELECT 'p_retailprice' AS column_name, count(*)::BIGINT AS errors
 FROM t UNION ALL SELECT 'p_size', count(*)::BIGINT FROM t WHERE two""")
def _(spark, d):
    return M.column_errors(anomalies(spark, d))


@query("error_burden_part", f"""WITH {ANOM} SELECT round((count(*) + count(*) FILTER (WHERE two)) / ((SELECT
 count(*) FROM part) * 6)::DOUBLE * 100, 4) AS column_error_burden FROM t""")
def _(spark, d):
    df = table(spark, d, "part")
    return M.error_burden(M.column_errors(anomalies(spark, d)), df.count(), len(df.columns))


@query("list_anomalies_part", f"""WITH {ANOM} SELECT row_id, severity, confidence FROM t WHERE severity = 'high'
 AND confidence >= 0.5 AND two ORDER BY confidence DESC, row_id LIMIT 20 OFFSET 5""")
def _(spark, d):
    return M.list_anomalies(anomalies(spark, d), severity="high", min_confidence=0.5,
                            column="p_size", offset=5, limit=20).select(
        "row_id", "severity", "confidence")


@query("adjudication_part", f"""WITH {ANOM} SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'accepted' WHEN 2 THEN
 'modified' ELSE 'open' END AS status, CASE row_id % 6 WHEN 0 THEN 'p' || row_id WHEN 2 THEN 'n' || row_id END
 AS final_value FROM t""")
def _(spark, d):
    a = anomalies(spark, d).select(
        "row_id", F.lit("open").alias("status"),
        F.concat(F.lit("p"), F.col("row_id").cast("string")).alias("proposed_value"))
    k = F.col("p_partkey") % 6
    decisions = table(spark, d, "part").where(k.isin(0, 2)).select(
        F.col("p_partkey").alias("row_id"),
        F.when(k == 0, "accept").otherwise("modify").alias("decision"),
        F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("new_value"))
    return M.adjudicate(a, decisions).select("row_id", "status", "final_value")


@query("before_after_comparison_lineitem", """WITH b AS (SELECT 100 * avg((l_quantity > 45)::INT) AS n, 100 -
 100 * avg((l_tax > 0.07)::INT) AS p FROM lineitem), a AS (SELECT 100 * avg((l_quantity > 48)::INT) AS n, 100 -
 100 * avg((l_tax > 0.075)::INT) AS p FROM lineitem) SELECT 'noise_pct' AS metric, round(b.n - a.n, 4) AS gain,
 CASE WHEN round(b.n - a.n, 4) > 0 THEN 'improved' WHEN round(b.n - a.n, 4) < 0 THEN 'worse' ELSE 'unchanged'
 END AS verdict FROM a, b UNION ALL SELECT 'plausibility_rate', round(a.p - b.p, 4), CASE WHEN round(a.p - b.p,
 4) > 0 THEN 'improved' WHEN round(a.p - b.p, 4) < 0 THEN 'worse' ELSE 'unchanged' END FROM a, b""")
def _(spark, d):
    df = table(spark, d, "lineitem")

    def line(q, t):
        return M.long_metrics(df.agg(
            (100 * F.avg((F.col("l_quantity") > q).cast("double"))).alias("noise_pct"),
            (100 - 100 * F.avg((F.col("l_tax") > t).cast("double"))).alias("plausibility_rate")))
    return M.compare(line(45, 0.07), line(48, 0.075)).select(
        "metric", r("gain", 4).alias("gain"), "verdict")
