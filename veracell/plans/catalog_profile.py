"""Queries over sources, column typing and profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell import sources
from veracell.functions import values as V
from veracell.operators import profile as P, typing as TY
from veracell.operators.quantiles import value_ranks
from veracell.plans.registry import long, query, r, table, union_all

# ---- sources and sinks -------------------------------------------------------------------------

CUSTOMER_SQL = """SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey,
 round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer"""


def _customer(df):
    return df.select(long("c_custkey").alias("c_custkey"), "c_name",
                     long("c_nationkey").alias("c_nationkey"), r("c_acctbal", 2).alias("c_acctbal"),
                     "c_mktsegment")


@query("csv_scan_round_trip", CUSTOMER_SQL)
def _(spark, d):
    return _customer(sources.round_trip(table(spark, d, "customer"), "csv"))


@query("tsv_scan_round_trip", CUSTOMER_SQL)
def _(spark, d):
    return _customer(sources.round_trip(table(spark, d, "customer"), "tsv"))


@query("csv_line_breaks_documents", """SELECT doc_id::VARCHAR AS doc_id, text, lang, source
 FROM documents""")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return sources.round_trip(df, "csv")


@query("json_scan_round_trip", CUSTOMER_SQL)
def _(spark, d):
    return _customer(sources.round_trip(table(spark, d, "customer"), "json"))


@query("parquet_scan_orders", """SELECT o_orderstatus, count(*)::BIGINT AS n,
 round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus""")
def _(spark, d):
    df = sources.read_table(spark, f"{d}/orders.parquet")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                           r(F.sum("o_totalprice"), 2).alias("total"))


@query("anomaly_log_export", """SELECT o_orderkey::VARCHAR AS row_index,
 'extreme_numeric_outlier' AS anomaly_type, 'high' AS severity,
 printf('%.3f', CASE WHEN o_orderstatus = 'F' THEN 0.9 ELSE 0.5 END) AS confidence,
 'o_totalprice; ' || o_orderpriority AS flagged_columns, o_orderstatus AS rationale
 FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    return sources.anomaly_log(o.select(
        F.col("o_orderkey").alias("row_id"),
        F.lit("extreme_numeric_outlier").alias("anomaly_type"), F.lit("high").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", 0.9).otherwise(0.5).alias("confidence"),
        F.array(F.lit("o_totalprice"), F.col("o_orderpriority")).alias("flagged_columns"),
        F.col("o_orderstatus").alias("rationale")))


@query("json_result_projection", """SELECT '{"r":' || c_custkey || ',"seg":"' || c_mktsegment
 || '"}' AS json FROM customer""")
def _(spark, d):
    return sources.as_json(table(spark, d, "customer"), r="c_custkey", seg="c_mktsegment")


# ---- typing ------------------------------------------------------------------------------------

SENT = ", ".join("'" + s + "'" for s in V.SENTINEL_NULLS)


@query("hidden_nulls_orders", union_all([
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim(x) IN ({SENT}))::BIGINT AS hidden, "
    f"coalesce(array_to_string(list_sort(list(DISTINCT x) FILTER (WHERE x IN ({SENT}))), ','), '')"
    f" AS patterns FROM (SELECT {e} AS x FROM orders)"
    for c, e in (("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"),
                 ("coded", "CASE WHEN o_custkey % 7 = 0 THEN 'N/A' WHEN o_custkey % 11 = 0 "
                           "THEN '-999' ELSE o_orderstatus END"))]))
def _(spark, d):
    o = table(spark, d, "orders").withColumn(
        "coded", F.when(F.col("o_custkey") % 7 == 0, "N/A")
        .when(F.col("o_custkey") % 11 == 0, "-999").otherwise(F.col("o_orderstatus")))
    return TY.hidden_nulls(o).select(
        "column_name", F.col("hidden_null_count").alias("hidden"),
        F.concat_ws(",", "hidden_null_patterns").alias("patterns"))


CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("cardinality_customer", union_all([
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_count, "
    f"count(DISTINCT {c})::BIGINT AS unique_count, "
    f"round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS cardinality_ratio FROM customer"
    for c in CUST]))
def _(spark, d):
    return TY.infer_schema(table(spark, d, "customer")).select(
        "column_name", "null_count", "unique_count",
        r("cardinality_ratio").alias("cardinality_ratio"))


@query("head_sample_nation", """SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS sample_value
 FROM nation WHERE n_name IS NOT NULL ORDER BY n_nationkey LIMIT 5""")
def _(spark, d):
    s = TY.head_sample(table(spark, d, "nation"), "n_name", "n_nationkey")
    return s.select(long("n_nationkey").alias("n_nationkey"), "sample_value")


FLAGS = "'0','1','true','false','yes','no','y','n','t','f'"
DATE_AVG = "least(1.0, " + " + ".join(
    f"avg(regexp_matches(x, '{p}')::INT)" for p in V.DATE_SHAPES) + ")"


def _type_sql(tab: str, col: str, text: bool, ident: bool) -> str:
    x = f"{col}::VARCHAR"
    return f"""SELECT '{col}' AS column_name, CASE
 WHEN count(x) = 0 THEN 'unknown'
 WHEN bool_and(lower(trim(x)) IN ({FLAGS})) AND count(DISTINCT lower(trim(x))) <= 4 THEN 'boolean'
 WHEN avg(regexp_full_match(trim(x), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')::INT) > 0.9
 THEN 'numeric'
 WHEN {DATE_AVG} > 0.7 THEN 'datetime'
 WHEN {str(ident).lower()} AND count(DISTINCT x) / count(x)::DOUBLE > 0.8 THEN 'identifier'
 WHEN {str(text).lower()} AND avg(length(x)) > 50 AND count(DISTINCT x) / count(x)::DOUBLE > 0.8
 THEN 'free_text' ELSE 'categorical' END AS inferred_type FROM (SELECT {x} AS x FROM {tab})"""


def _types(name, tab, cols):
    ids = [c for c in cols if any(w in c for w in TY.ID_WORDS)]
    texts = {"text", "lang", "source", "c_name", "c_mktsegment", "event_type", "props", "url"}

    @query(name, union_all([_type_sql(tab, c, c in texts, c in ids) for c in cols]))
    def _(spark, d):
        df = table(spark, d, tab)
        if tab == "events":
            df = df.withColumn("ts", F.col("ts").cast("string"))
        return TY.infer_schema(df, cols).select("column_name", "inferred_type")


_types("boolean_columns_labels", "labels", ["doc_id", "quality", "toxic"])
_types("text_columns_documents", "documents", ["doc_id", "text", "lang", "source", "n_chars"])
_types("datetime_columns_events", "events",
       ["event_id", "ts", "user_id", "event_type", "value", "props"])
_types("identifier_columns_customer", "customer", CUST)


@query("mixed_numeric_documents", """SELECT round(avg(ok), 6) AS numeric_ratio,
 avg(ok) > 0.9 AND avg(ok) < 1 AS mixed, round(1 - avg(ok), 6) AS mixed_proportion FROM (
 SELECT CASE WHEN doc_id % 25 = 3 THEN 0 ELSE 1 END AS ok FROM documents)""")
def _(spark, d):
    df = table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 25 == 3, F.concat(F.col("lang"), F.lit("?")))
        .otherwise(F.col("n_chars").cast("string")).alias("amount"),
        F.col("source"))
    return TY.infer_schema(df, ["amount"]).select(
        r("type_confidence").alias("numeric_ratio"), F.col("mixed_type").alias("mixed"),
        r("mixed_type_proportion").alias("mixed_proportion"))


@query("impossible_values_part", """SELECT 'p_size' AS column_name, count(*)::BIGINT AS
 impossible_count FROM part WHERE p_size < 3 OR p_size > 48 UNION ALL SELECT 'p_retailprice',
 count(*)::BIGINT FROM part WHERE p_retailprice > 950""")
def _(spark, d):
    rules = TY.impossible_rules(["p_size", "p_retailprice"],
                                [(["size"], 3, 48), (["price"], None, 950)])
    return TY.impossible_counts(table(spark, d, "part"), rules)


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUM = [c for c in LINE if c not in ("l_returnflag", "l_linestatus", "l_shipdate")]


@query("dataset_summary_lineitem", f"""WITH t AS ({union_all([
    _type_sql('lineitem', c, False, any(w in c for w in TY.ID_WORDS)) for c in LINE])}),
 h AS (SELECT {' + '.join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in LINE)}
 + count(*) FILTER (WHERE trim(l_returnflag) IN ({SENT}))
 + count(*) FILTER (WHERE trim(l_linestatus) IN ({SENT})) AS nulls, count(*) AS n FROM lineitem)
 SELECT inferred_type, count(*)::BIGINT AS type_columns, max(n)::BIGINT AS row_count,
 11::BIGINT AS col_count, round(max(nulls) / (max(n) * 11.0)::DOUBLE, 6) AS overall_nullity,
 round(count(*) / 11.0::DOUBLE, 6) AS type_share FROM t, h GROUP BY inferred_type""")
def _(spark, d):
    s = TY.dataset_summary(TY.infer_schema(table(spark, d, "lineitem")))
    return s.select("inferred_type", "type_columns", "row_count", "col_count",
                    r("overall_nullity").alias("overall_nullity"),
                    r("type_share").alias("type_share"))


# ---- coercion ----------------------------------------------------------------------------------

@query("coerce_numbers_documents", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL
 ELSE n_chars::DOUBLE END AS number FROM documents""")
def _(spark, d):
    messy = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("n_chars"))) \
        .otherwise(F.concat(F.lit(" "), F.col("n_chars"), F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", V.to_number(messy).alias("number"))


@query("coerce_dates_orders", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL
 ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(spark, d):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(
        k == 1, F.date_format(day, "MM/dd/yyyy")).when(
        k == 2, F.date_format(day, "yyyy/MM/dd")).otherwise(F.lit("2030-15-45"))
    return table(spark, d, "orders").select(
        "o_orderkey", V.to_datetime(text).cast("date").cast("string").alias("day"))


@query("iso_dates_orders", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_date
 FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", V.iso_date(F.date_format("o_orderdate", "ddMMMyyyy")).alias("iso_date"))


@query("coerce_booleans_labels", """SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic
 FROM labels""")
def _(spark, d):
    df = table(spark, d, "labels")
    word = F.when(F.col("quality") == 1, " Yes").otherwise("no ")
    return df.select("doc_id", V.to_boolean(word).alias("quality"),
                     V.to_boolean(F.col("toxic")).alias("toxic"))


@query("normal_categories_customer", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL
 ELSE lower(c_mktsegment) END AS segment FROM customer""")
def _(spark, d):
    raw = F.when(F.col("c_custkey") % 5 == 0, F.lit(" None ")).otherwise(
        F.concat(F.lit("  "), "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", V.normal_category(raw).alias("segment"))


# ---- profiles ----------------------------------------------------------------------------------

def _numeric_sql(tab, c):
    x = f"{c}::DOUBLE"
    return f"""SELECT '{c}' AS column_name, count(*)::BIGINT AS n,
 count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_count, count(DISTINCT {c})::BIGINT AS
 unique_count, round(avg({x}), 4) AS mean, round(median({x}), 4) AS median,
 round(stddev_samp({x}), 4) AS std, round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 4)
 AS iqr, min({x}) AS min_val, max({x}) AS max_val, round(quantile_cont({x}, 0.25), 4) AS q1,
 round(quantile_cont({x}, 0.75), 4) AS q3 FROM {tab}"""


@query("numeric_profile_lineitem", union_all([_numeric_sql("lineitem", c) for c in LINE_NUM]))
def _(spark, d):
    p = P.numeric_profile(table(spark, d, "lineitem"), LINE_NUM)
    return p.select("column_name", F.col("count").alias("n"), "null_count", "unique_count",
                    *[r(c, 4).alias(c) for c in ("mean", "median", "std", "iqr")],
                    "min_val", "max_val", r("q1", 4).alias("q1"), r("q3", 4).alias("q3"))


SHAPE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("shape_moments_lineitem", union_all([
    f"""SELECT '{c}' AS column_name, round(skewness({c}), 6) + 0.0 AS skewness,
 round(kurtosis({c}), 6) + 0.0 AS kurtosis FROM lineitem""" for c in SHAPE]))
def _(spark, d):
    p = P.numeric_profile(table(spark, d, "lineitem"), SHAPE)
    return p.select("column_name", r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


@query("normality_lineitem", union_all([
    f"""SELECT '{c}' AS column_name, round(p, 9) AS normality_pvalue,
 CASE WHEN p > 0.05 THEN 'normal' ELSE 'non-normal' END AS distribution_fit FROM (
 SELECT exp(-(n / 6.0 * (m3 / pow(m2, 1.5) * (m3 / pow(m2, 1.5))
 + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 4)) / 2) AS p FROM (
 SELECT count(*) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
 FROM (SELECT {e} AS x, avg({e}) OVER () AS m FROM lineitem)))"""
    for c, e in (("l_quantity", "l_quantity"), ("l_tax", "l_tax"),
                 ("noise", "(l_orderkey * 7919 % 1009 + l_partkey * 104729 % 1013"
                           " + l_suppkey * 31 % 97)::DOUBLE"))]))
def _(spark, d):
    df = table(spark, d, "lineitem").withColumn(
        "noise", (F.col("l_orderkey") * 7919 % 1009 + F.col("l_partkey") * 104729 % 1013
                  + F.col("l_suppkey") * 31 % 97).cast("double"))
    return P.numeric_profile(df, ["l_quantity", "l_tax", "noise"]).select(
        "column_name", r("normality_pvalue", 9).alias("normality_pvalue"), "distribution_fit")


def _mode_sql(c):
    return f"""SELECT '{c}' AS column_name, arg_min(x, struct_pack(n := -n, x := x))::DOUBLE AS mode
 FROM (SELECT {c}::DOUBLE AS x, count(*) AS n FROM part GROUP BY 1)"""


@query("mode_part", union_all([_mode_sql("p_size"), _mode_sql("p_retailprice")]))
def _(spark, d):
    p = P.numeric_profile(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return p.select("column_name", F.col("mode").cast("double").alias("mode"))


def _top_sql(tab, c):
    return f"""SELECT '{c}' AS column_name, row_number() OVER (ORDER BY n DESC, v)::BIGINT AS rank,
 v AS value, n::BIGINT AS count, round(n / sum(n) OVER () * 100, 2) AS pct FROM (
 SELECT {c} AS v, count(*) AS n FROM {tab} GROUP BY {c})"""


@query("top_values_orders", union_all([_top_sql("orders", "o_orderstatus"),
                                       _top_sql("orders", "o_orderpriority")]))
def _(spark, d):
    t = P.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return t.select("column_name", long("rank").alias("rank"), "value",
                    long("count").alias("count"), "pct")


def _cat_sql(tab, c):
    return f"""SELECT '{c}' AS column_name, CASE WHEN u / n::DOUBLE > 0.9 AND len > 30 THEN 'free_text'
 WHEN u / n::DOUBLE > 0.9 THEN 'identifier' ELSE 'categorical' END AS dtype, u::BIGINT AS
 unique_count, md5(mode) AS mode FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS u,
 avg(length({c})) AS len FROM {tab}), (SELECT arg_min(v, struct_pack(k := -k, v := v)) AS mode
 FROM (SELECT {c} AS v, count(*) AS k FROM {tab} WHERE {c} IS NOT NULL GROUP BY {c}))"""


@query("categorical_profile_documents", union_all([
    _cat_sql("documents", c) for c in ("text", "lang", "source")]))
def _(spark, d):
    p = P.categorical_profile(table(spark, d, "documents"), ["text", "lang", "source"])
    return p.select("column_name", "dtype", "unique_count", F.md5("mode").alias("mode"))


@query("table_profile_lineitem", """SELECT dtype, k::BIGINT AS type_columns, n::BIGINT AS row_count,
 11::BIGINT AS col_count, 0.0::DOUBLE AS overall_missingness, round(k / 11.0::DOUBLE, 6) AS
 type_share FROM (SELECT 'numeric' AS dtype, 8 AS k UNION ALL SELECT 'categorical', 3),
 (SELECT count(*) AS n FROM lineitem)""")
def _(spark, d):
    t = P.table_profile(P.column_profile(table(spark, d, "lineitem")))
    return t.select("dtype", "type_columns", "row_count", "col_count",
                    r("overall_missingness").alias("overall_missingness"),
                    r("type_share").alias("type_share"))


def _rank_sql(c, src):
    return (f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0")


SPEAR = ["l_quantity", "l_extendedprice", "l_discount"]


@query("spearman_lineitem", union_all([
    f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM (
 SELECT {', '.join(_rank_sql(c, '') + ' AS ' + c for c in SPEAR)} FROM lineitem)"""
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
                 ("l_extendedprice", "l_discount"))]))
def _(spark, d):
    return P.spearman(table(spark, d, "lineitem"), SPEAR).select(
        "column_a", "column_b", r("correlation").alias("correlation"))


@query("spearman_with_gaps_lineitem", f"""WITH t AS (SELECT l_quantity, CASE WHEN l_partkey % 9 = 0
 THEN NULL ELSE l_extendedprice END AS price FROM lineitem), f AS (SELECT
 {_rank_sql('l_quantity', '')} AS a, {_rank_sql('price', '')} AS b FROM t WHERE price IS NOT NULL)
 SELECT 'l_quantity' AS column_a, 'price' AS column_b, round(corr(a, b), 6) AS correlation FROM f""")
def _(spark, d):
    df = table(spark, d, "lineitem").withColumn("price", F.when(
        F.col("l_partkey") % 9 != 0, F.col("l_extendedprice")))
    return P.spearman(df, ["l_quantity", "price"]).select(
        "column_a", "column_b", r("correlation").alias("correlation"))


NULLED = """SELECT CASE WHEN l_orderkey % 10 < 2 THEN NULL ELSE l_quantity END AS q,
 CASE WHEN l_orderkey % 10 < 3 THEN NULL ELSE l_tax END AS t,
 CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_discount END AS d, l_extendedprice AS p FROM lineitem"""


def _nulled(spark, d):
    k = F.col("l_orderkey") % 10
    return table(spark, d, "lineitem").select(
        F.when(k >= 2, F.col("l_quantity")).alias("q"), F.when(k >= 3, F.col("l_tax")).alias("t"),
        F.when(F.col("l_partkey") % 2 != 0, F.col("l_discount")).alias("d"),
        F.col("l_extendedprice").alias("p"))


@query("missing_correlation_lineitem", f"""WITH t AS ({NULLED}), n AS (SELECT (q IS NULL)::INT AS q,
 (t IS NULL)::INT AS t, (d IS NULL)::INT AS d FROM t) SELECT * FROM ({union_all([
     f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 3) AS correlation FROM n"
     for a, b in (('q', 't'), ('q', 'd'), ('t', 'd'))])}) WHERE abs(correlation) > 0.3""")
def _(spark, d):
    return P.missing_correlations(_nulled(spark, d))


@query("missing_class_lineitem", f"""WITH t AS ({NULLED}), n AS (SELECT avg((q IS NULL)::INT) AS q,
 avg((t IS NULL)::INT) AS t, avg((d IS NULL)::INT) AS d, abs(corr((q IS NULL)::INT, (t IS NULL)::INT))
 > 0.3 AS c1, abs(corr((q IS NULL)::INT, (d IS NULL)::INT)) > 0.3 AS c2,
 abs(corr((t IS NULL)::INT, (d IS NULL)::INT)) > 0.3 AS c3 FROM t),
 s AS (SELECT *, list_sort([q, t, d]) AS l FROM n), m AS (SELECT *, l[2] - l[1] > 0.1 OR
 l[3] - l[2] > 0.1 AS mono, c1::INT + c2::INT + c3::INT AS pairs FROM s)
 SELECT 3::BIGINT AS null_columns, mono AS monotone, pairs::BIGINT AS pair_count,
 CASE WHEN pairs = 0 THEN 'MCAR' WHEN mono THEN 'MNAR' ELSE 'MAR' END AS pattern_type FROM m""")
def _(spark, d):
    return P.missing_class(_nulled(spark, d)).select(
        long("null_columns").alias("null_columns"), "monotone", long("pair_count")
        .alias("pair_count"), "pattern_type")


def _tail_union(cols, tab="lineitem", x="{c}"):
    return union_all([f"""SELECT count(*) AS cells, count(*) FILTER (WHERE {x.format(c=c)} <
 lo - 3 * (hi - lo) OR {x.format(c=c)} > hi + 3 * (hi - lo)) AS outside FROM {tab}, (SELECT
 quantile_cont({x.format(c=c)}, 0.25) AS lo, quantile_cont({x.format(c=c)}, 0.75) AS hi FROM {tab})
 WHERE hi <> lo""" for c in cols])


SKEWED = "pow({c}, 6)"


@query("tail_noise_lineitem", f"""SELECT sum(cells)::BIGINT AS cells, sum(outside)::BIGINT AS outside,
 round(sum(outside) / sum(cells)::DOUBLE, 9) AS tail_noise FROM (
 {_tail_union(["l_quantity", "l_extendedprice", "l_tax"], x=SKEWED)})""")
def _(spark, d):
    df = table(spark, d, "lineitem").select(*[F.pow(c, F.lit(6.0)).alias(c) for c in (
        "l_quantity", "l_extendedprice", "l_tax")])
    t = P.tail_noise(df, df.columns)
    return t.select(long("cells").alias("cells"), long("outside").alias("outside"),
                    r("tail_noise", 9).alias("tail_noise"))


@query("noise_estimate_lineitem", f"""SELECT round(least(bad / n::DOUBLE + outside / cells::DOUBLE,
 1.0), 9) AS noise FROM (SELECT sum(cells) AS cells, sum(outside) AS outside FROM (
 {_tail_union(["l_quantity", "l_extendedprice"], x=SKEWED)})), (SELECT count(*) AS n,
 count(*) FILTER (WHERE l_quantity > 49) AS bad FROM lineitem)""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    skewed = df.select(*[F.pow(c, F.lit(6.0)).alias(c) for c in ("l_quantity", "l_extendedprice")])
    tail = P.tail_noise(skewed, skewed.columns)
    bad = TY.impossible_values(df, [("l_quantity", 0, 49)]).agg(F.count(F.lit(1)).alias("bad"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return tail.crossJoin(bad).crossJoin(n).select(r(P.noise_estimate(
        F.col("bad"), F.col("n"), F.col("tail_noise")), 9).alias("noise"))


@query("average_ranks_lineitem", """SELECT l_extendedprice AS value, count(*)::BIGINT AS n,
 (rank() OVER (ORDER BY l_extendedprice))::DOUBLE AS first_rank FROM lineitem
 GROUP BY l_extendedprice QUALIFY true""".replace(
    "(rank() OVER (ORDER BY l_extendedprice))::DOUBLE AS first_rank",
    "coalesce(sum(count(*)) OVER (ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
    "PRECEDING), 0)::DOUBLE + (count(*) + 1) / 2.0::DOUBLE AS avg_rank").replace(" QUALIFY true", ""))
def _(spark, d):
    ranks = value_ranks(table(spark, d, "lineitem"), "l_extendedprice")
    return ranks.select(F.col("l_extendedprice").alias("value"), "n", "avg_rank")


@query("dataset_vector_lineitem", f"""SELECT n::BIGINT AS n, 11::BIGINT AS d, round(11.0 / n, 6) AS
 d_over_n, 0.0::DOUBLE AS missingness_burden, round(8 / 11.0::DOUBLE, 4) AS numeric_proportion,
 round(cat, 6) AS categorical_cardinality, 0::BIGINT AS temporal_flag, 0::BIGINT AS site_count,
 round(skew, 4) AS skewness_spread FROM (SELECT count(*)::DOUBLE AS n,
 (count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) + count(DISTINCT l_shipdate))
 / 3.0 / count(*) AS cat, ({' + '.join(f'abs(skewness({c}))' for c in LINE_NUM)}) / 8 AS skew
 FROM lineitem)""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    prof = P.column_profile(df)
    vec = P.dataset_vector(df, prof.collect(), [], 0.0, None, 0.5)
    keep = ["d_over_n", "missingness_burden", "numeric_proportion", "categorical_cardinality",
            "skewness_spread"]
    digits = {"d_over_n": 6, "categorical_cardinality": 6}
    return df.sparkSession.createDataFrame(
        [(vec["n"], vec["d"], vec["temporal_flag"], vec["site_count"],
          *[round(float(vec[c]), digits.get(c, 4)) for c in keep])],
        "n long, d long, temporal_flag long, site_count long, "
        + ", ".join(f"{c} double" for c in keep))


@query("hopkins_lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem").withColumn(
        "k", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    h = P.hopkins(df, ["l_quantity", "l_extendedprice", "l_discount"], "k")
    return spark.createDataFrame([(round(h, 6),)], "hopkins double")
