"""Queries over column semantics, ranges, vocabularies and units."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell import dims
from veracell.dims import Range
from veracell.operators import semantics as S
from veracell.operators.typing import simple_columns
from veracell.plans.registry import long, query, r, table, union_all

# A small user dictionary over the test tables.
PART_RANGES = {
    "p_size": [Range("p_size", 1, 50, "cm", "dimension", critical_low=3, critical_high=48,
                     normal_low=10, normal_high=40)],
    "p_retailprice": [Range("p_retailprice", 0, 5000, "usd", "price", critical_low=905,
                            critical_high=1080, normal_low=920, normal_high=1050)],
}
BAD = """(p_size < 3 OR p_size > 48 OR p_retailprice < 905 OR p_retailprice > 1080)"""


def _cells_sql(kinds):
    parts = []
    for c, u, hl, hh, nl, nh in (("p_size", "cm", "3.0", "48.0", "10.0", "40.0"),
                                 ("p_retailprice", "usd", "905.0", "1080.0", "920.0", "1050.0")):
        v = f"{c}::DOUBLE"
        if kinds == "impossible":
            parts.append(f"""SELECT p_partkey, '{c}' AS column_name, {v} AS value, CASE WHEN {v} < {hl}
 THEN '{c}=' || {v}::VARCHAR || ' below critical minimum ({hl} {u})' ELSE '{c}=' || {v}::VARCHAR ||
 ' above critical maximum ({hh} {u})' END AS reason FROM part WHERE {v} < {hl} OR {v} > {hh}""")
        else:
            parts.append(f"""SELECT p_partkey, '{c}' AS column_name, {v} AS value, CASE WHEN {v} < {nl}
 THEN '{c}=' || {v}::VARCHAR || ' below normal range ({nl}-{nh} {u})' ELSE '{c}=' || {v}::VARCHAR ||
 ' above normal range ({nl}-{nh} {u})' END AS reason FROM part WHERE {v} < {nl} OR {v} > {nh}""")
    return union_all(parts)


@query("field_map_customer", """SELECT 'glucose' AS column_name, 'lab_value' AS clinical_type,
 (CASE WHEN share > 0.7 THEN 0.85 ELSE 0.8 END)::DOUBLE AS confidence, round(share, 6) AS share
 FROM (SELECT avg((abs(c_acctbal) / 40 BETWEEN 5 AND 1050)::INT) AS share FROM customer)""")
def _(spark, d):
    df = table(spark, d, "customer").select((F.abs("c_acctbal") / 40).alias("glucose"))
    share = df.agg(r(F.avg(F.col("glucose").between(5, 1050).cast("double"))).alias("share"))
    return S.field_map(df).select("column_name", "clinical_type", "confidence").crossJoin(share)


@query("confirmed_map_customer", """SELECT 'c_custkey' AS column_name, 'patient_id' AS clinical_type,
 true AS user_confirmed, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'c_mktsegment',
 'site_id', true, count(*)::BIGINT FROM customer UNION ALL SELECT 'c_acctbal', NULL, false,
 count(*)::BIGINT FROM customer""")
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    found = S.field_map(df, dictionary=[])
    user = spark.createDataFrame([("c_custkey", "patient_id"), ("c_mktsegment", "site_id")],
                                 "column_name string, clinical_type string")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return S.confirm_map(found, user).select(
        "column_name", "clinical_type", "user_confirmed").crossJoin(n)


@query("dictionary_coverage_part", """SELECT 2::BIGINT AS matched_count, 4::BIGINT AS skipped_count,
 33.3::DOUBLE AS coverage_pct, count(*)::BIGINT AS n FROM part""")
def _(spark, d):
    df = table(spark, d, "part")
    rep = S.plausibility_report(df, simple_columns(df), PART_RANGES)
    mapping = rep.select("column_name", F.when(F.col("matched"), F.col("category"))
                         .alias("clinical_type"))
    return S.coverage(mapping).crossJoin(df.agg(F.count(F.lit(1)).alias("n")))


@query("impossible_cells_part", _cells_sql("impossible"))
def _(spark, d):
    return S.impossible_cells(table(spark, d, "part"), "p_partkey", PART_RANGES).select(
        "p_partkey", "column_name", "value", "reason")


@query("abnormal_cells_part", _cells_sql("abnormal"))
def _(spark, d):
    return S.abnormal_cells(table(spark, d, "part"), "p_partkey", PART_RANGES).select(
        "p_partkey", "column_name", "value", "reason")


@query("sex_aware_cells_customer", """SELECT c_custkey, value, CASE WHEN value < lo THEN 'low'
 ELSE 'high' END AS side FROM (SELECT c_custkey, abs(c_acctbal) / 500 AS value,
 CASE WHEN c_nationkey % 2 = 0 THEN 12.0 ELSE 11.5 END AS lo,
 CASE WHEN c_nationkey % 2 = 0 THEN 17.5 ELSE 15.5 END AS hi FROM customer)
 WHERE value < lo OR value > hi""")
def _(spark, d):
    df = table(spark, d, "customer").select(
        "c_custkey", (F.abs("c_acctbal") / 500).alias("hemoglobin"),
        F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("sex"))
    found = S.abnormal_cells(df, "c_custkey", S.ranges_for(["hemoglobin"]), F.col("sex"))
    return found.select("c_custkey", "value", F.when(
        F.col("reason").contains("below"), "low").otherwise("high").alias("side"))


@query("plausibility_report_part", f"""SELECT 'p_size' AS column_name, true AS matched,
 'dimension' AS category, count(*)::BIGINT AS checked, count(*) FILTER (WHERE p_size < 3 OR p_size >
 48)::BIGINT AS impossible_count FROM part UNION ALL SELECT 'p_retailprice', true, 'price',
 count(*)::BIGINT, count(*) FILTER (WHERE p_retailprice < 905 OR p_retailprice > 1080)::BIGINT
 FROM part UNION ALL SELECT 'p_partkey', false, NULL, count(*)::BIGINT, 0::BIGINT FROM part""")
def _(spark, d):
    return S.plausibility_report(table(spark, d, "part"),
                                 ["p_size", "p_retailprice", "p_partkey"], PART_RANGES)


@query("column_plausibility_part", """SELECT 'p_size' AS column_name, count(*)::BIGINT AS
 impossible_count, min(p_partkey)::BIGINT AS first_row FROM part WHERE p_size < 3 OR p_size > 48
 UNION ALL SELECT 'p_retailprice', count(*)::BIGINT, min(p_partkey)::BIGINT FROM part
 WHERE p_retailprice < 905 OR p_retailprice > 1080""")
def _(spark, d):
    cells = S.impossible_cells(table(spark, d, "part"), "p_partkey", PART_RANGES)
    return cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("impossible_count"),
                                            F.min("p_partkey").alias("first_row"))


@query("row_plausibility_part", f"SELECT p_partkey, {BAD} AS implausible FROM part")
def _(spark, d):
    df = table(spark, d, "part")
    return df.select("p_partkey", S.implausible(df, PART_RANGES).alias("implausible"))


@query("valid_corrections_part", """SELECT p_partkey, p_size / 2.0 BETWEEN 3 AND 48 AS valid,
 true AS valid_without_range FROM part""")
def _(spark, d):
    half = F.col("p_size") / 2.0
    return table(spark, d, "part").select(
        "p_partkey", S.valid_value(half, PART_RANGES["p_size"]).alias("valid"),
        S.valid_value(half, None).alias("valid_without_range"))


@query("user_range_dictionary_part", f"SELECT count(*)::BIGINT AS n FROM part WHERE {BAD}")
def _(spark, d):
    df = table(spark, d, "part")
    lim = df.agg(F.lit(3.0).alias("size_lo"), F.lit(48.0).alias("size_hi"))
    dim = lim.select(F.inline(F.array(
        F.struct(F.lit("p_size").alias("column_name"), F.col("size_lo").alias("low"),
                 F.col("size_hi").alias("high"), F.lit("cm").alias("unit")),
        F.struct(F.lit("p_retailprice").alias("column_name"), F.lit(905.0).alias("low"),
                 F.lit(1080.0).alias("high"), F.lit("usd").alias("unit")))))
    bad = S.implausible(df, S.ranges_from(dim, df.columns))
    return df.agg(F.count_if(bad).alias("n"))


# ---- codes and terms ---------------------------------------------------------------------------

CODES = ["2160-0", "2345-7", "718-7", "8480-6", "0000-0"]
CODE_SQL = "CASE l_linenumber % 5 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"


@query("loinc_ranges_lineitem", f"""SELECT code, range_name, low, high, count(*)::BIGINT AS n FROM
 (SELECT {CODE_SQL} AS code FROM lineitem) LEFT JOIN (VALUES ('2160-0', 'creatinine', 0.05, 30.0),
 ('2345-7', 'glucose', 5.0, 2000.0), ('718-7', 'hemoglobin', 1.0, 25.0),
 ('8480-6', 'systolic_bp', 30.0, 300.0)) v(c, range_name, low, high) ON code = c
 GROUP BY ALL""".replace("low, high, count", "low::DOUBLE AS low, high::DOUBLE AS high, count"))
def _(spark, d):
    k = F.col("l_linenumber") % 5
    code = F.element_at(F.array(*map(F.lit, CODES)), k + 1)
    rows = table(spark, d, "lineitem").select(code.alias("code")).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"))
    return S.lookup_loinc(rows, "code", S.loinc_ranges(spark)).select(
        "code", "range_name", "low", "high", "n")


@query("term_match_nations", """WITH names AS (SELECT n_nationkey AS ord, n_name AS name FROM nation),
 terms AS (SELECT DISTINCT lower(substr(c_name, 1, 1)) || '' AS t FROM customer UNION
 SELECT DISTINCT 'nation_' || (c_nationkey // 2) FROM customer UNION
 SELECT DISTINCT 'no_' || c_nationkey FROM customer)
 SELECT t AS term, (SELECT arg_min(name, ord) FROM names WHERE contains(lower(name), t)) AS concept
 FROM terms""")
def _(spark, d):
    c = table(spark, d, "customer")
    words = c.select(F.explode(F.array(
        F.substring("c_name", 1, 1),
        F.concat(F.lit(" Nation_"), F.floor(F.col("c_nationkey") / 2).cast("string")),
        F.concat(F.lit("NO_"), F.col("c_nationkey").cast("string")))).alias("word"))
    concepts = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("concept_id"),
        F.col("n_name").alias("term"))
    return S.match_terms(words, "word", concepts).select("term", "concept")


@query("diagnosis_coverage_nations", """WITH v AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'nation_' ||
 c_nationkey WHEN c_custkey % 4 = 1 THEN '' ELSE lower(c_mktsegment) END AS t FROM customer), m AS (
 SELECT t, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE t <> '' AND contains(lower(n_name),
 t)) AS concept FROM v) SELECT count(*)::BIGINT AS total, count(concept)::BIGINT AS matched,
 count(*) FILTER (WHERE t <> '' AND concept IS NULL)::BIGINT AS unmatched,
 count(DISTINCT concept)::BIGINT AS matched_concepts,
 count(DISTINCT t) FILTER (WHERE t <> '' AND concept IS NULL)::BIGINT AS unmatched_values FROM m""")
def _(spark, d):
    k = F.col("c_custkey") % 4
    v = table(spark, d, "customer").select(
        F.when(k == 0, F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string")))
        .when(k == 1, "").otherwise(F.col("c_mktsegment")).alias("dx"))
    concepts = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("concept_id"),
        F.col("n_name").alias("term"))
    return S.diagnosis_coverage(v, "dx", concepts)


@query("snomed_lookup_segments", """SELECT term, concept, count(*)::BIGINT AS n FROM (SELECT
 CASE c_nationkey % 4 WHEN 0 THEN 'asthma' WHEN 1 THEN 'heart' WHEN 2 THEN 'type 2 diabetes'
 ELSE lower(c_mktsegment) END AS term FROM customer) LEFT JOIN (VALUES ('asthma', 'Asthma'),
 ('heart', 'Heart failure'), ('type 2 diabetes', 'Type 2 diabetes mellitus')) v(t, concept)
 ON term = t GROUP BY ALL""")
def _(spark, d):
    k = F.col("c_nationkey") % 4
    v = table(spark, d, "customer").select(F.lower(
        F.when(k == 0, "Asthma").when(k == 1, " heart ").when(k == 2, "Type 2 Diabetes")
        .otherwise(F.col("c_mktsegment"))).alias("dx"))
    n = v.groupBy(F.trim("dx").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return S.match_terms(v, "dx", dims.snomed_dim(spark)).join(n, "term").select(
        "term", "concept", "n")


WORDS_SQL = "(SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents)"


@query("text_classes_documents", f"""SELECT coalesce(k, 'none') AS text_class, count(*)::BIGINT AS n
 FROM (SELECT CASE WHEN regexp_full_match(w, '[A-Z]\\d{{2}}(\\.\\d{{1,4}})?') THEN 'icd10_code'
 WHEN regexp_full_match(w, '\\d{{3,7}}-\\d') THEN 'loinc_code'
 WHEN regexp_matches(lower(w), '{"|".join(S.EVENT_TERMS)}') THEN 'adverse_event_term'
 WHEN {" OR ".join(f"ends_with(lower(w), '{e}')" for e in S.DRUG_ENDINGS)} THEN 'drug_name'
 {" ".join(f"WHEN starts_with(lower(w), '{p.lower()}') THEN 'cdisc_{n.lower().replace(' ', '_')}'"
           for p, n in S.CDISC_DOMAINS.items())} END AS k FROM {WORDS_SQL} WHERE w <> '') GROUP BY 1""")
def _(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")).where(
        "w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy(F.coalesce(S.classify_text(F.col("w")), F.lit("none")).alias("text_class")) \
        .agg(F.sum("n").alias("n"))


@query("invalid_values_orders", """SELECT o_orderstatus AS value, count(*)::BIGINT AS n FROM orders
 WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1""")
def _(spark, d):
    return S.invalid_values(table(spark, d, "orders"), "o_orderstatus", ["F", "O"])


@query("canonical_segments_customer", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN
 'Vehicles' WHEN 'MACHINERY' THEN 'Industry' WHEN 'BUILDING' THEN 'Industry' END AS canonical
 FROM customer""")
def _(spark, d):
    vocab = spark.createDataFrame(
        [("AUTOMOBILE", "Vehicles"), ("MACHINERY", "Industry"), ("BUILDING", "Industry")],
        "value string, canonical string")
    return S.canonical(table(spark, d, "customer"), "c_mktsegment", vocab).select(
        "c_custkey", "canonical")


@query("smoking_vocabulary_customer", """SELECT raw, canonical, count(*)::BIGINT AS n FROM (SELECT
 CASE c_nationkey % 5 WHEN 0 THEN 'Ex-smoker' WHEN 1 THEN 'quit' WHEN 2 THEN 'No' WHEN 3 THEN 'active'
 ELSE c_mktsegment END AS raw FROM customer) LEFT JOIN (VALUES ('Ex-smoker', 'Former'),
 ('quit', 'Former'), ('No', 'Never'), ('active', 'Current')) v(x, canonical) ON raw = x GROUP BY ALL""")
def _(spark, d):
    k = F.col("c_nationkey") % 5
    df = table(spark, d, "customer").select(
        F.when(k == 0, "Ex-smoker").when(k == 1, "quit").when(k == 2, "No").when(k == 3, "active")
        .otherwise(F.col("c_mktsegment")).alias("raw"))
    vocab = dims.vocabulary_dim(spark).where("vocabulary = 'smoking_status'")
    return S.canonical(df, "raw", vocab).groupBy("raw", "canonical").agg(
        F.count(F.lit(1)).alias("n"))


# ---- units -------------------------------------------------------------------------------------

@query("unit_conversion_part", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN
 round(p_size * 0.3937, 4) WHEN 1 THEN round(p_size * 9 / 5.0 + 32, 1) WHEN 2 THEN
 round(p_size * 18.018, 4) END::DOUBLE AS converted FROM part""")
def _(spark, d):
    k = F.col("p_partkey") % 4
    pick = lambda a, b, c, z: F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(z)
    return table(spark, d, "part").select("p_partkey", S.convert_unit(
        F.col("p_size").cast("double"), pick("cm", "°C", "mmol/L", "kg"),
        pick("in", "°F", "mg/dL", "furlong"),
        pick("Height", "temperature", "glucose", "weight")).alias("converted"))


SCALED = """(SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_retailprice / 18
 ELSE p_retailprice END AS price FROM part)"""
GUESSES = [10, 18, 0.1, 1 / 18, 2.54, 0.3937]


def _scaled(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(
        F.col("p_partkey") % 10 == 0, F.col("p_retailprice") / 18)
        .otherwise(F.col("p_retailprice")).alias("price"))


@query("unit_mismatch_part", f"""WITH a AS (SELECT count(*)::BIGINT AS "values", count(*) FILTER
 (WHERE NOT price BETWEEN 899 AND 2000)::BIGINT AS out_of_range, {", ".join(
     f"avg((price * {g!r} BETWEEN 899 AND 2000)::INT) FILTER (WHERE NOT price BETWEEN 899 AND 2000)"
     f" AS s{i}" for i, g in enumerate(GUESSES))} FROM {SCALED})
 SELECT "values", out_of_range, greatest({", ".join(f"s{i}" for i in range(6))}) > 0.7 AS mismatch,
 CASE {" ".join(f"WHEN s{i} > 0.7 THEN {g!r}" for i, g in enumerate(GUESSES))} END::DOUBLE
 AS likely_factor FROM a""")
def _(spark, d):
    return S.unit_mismatch(_scaled(spark, d), "price", 899, 2000).select(
        "values", long("out_of_range").alias("out_of_range"), "mismatch", "likely_factor")


@query("unit_harmonize_part", f"""SELECT p_partkey, round(CASE WHEN price BETWEEN 899 AND 2000 THEN
 price ELSE price * 18 END, 6) AS price FROM {SCALED}""")
def _(spark, d):
    return _scaled(spark, d).select("p_partkey", r(S.harmonize(
        F.col("price"), 18.0, 899, 2000)).alias("price"))
