"""Queries over exact and near duplicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell.functions import values as V
from veracell.operators import duplicates as D
from veracell.operators.quantiles import quantiles
from veracell.operators import metrics as M, profile as P
from veracell.plans.registry import query, r, table

DOC = ["text", "lang", "source"]


@query("exact_duplicates_documents", """SELECT min(doc_id) OVER w AS cluster_id, doc_id AS row_id,
 doc_id <> min(doc_id) OVER w AS is_extra, count(*) OVER w::BIGINT AS n FROM documents
 WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1""".replace(
    "count(*) OVER w::BIGINT", "(count(*) OVER w)::BIGINT"))
def _(spark, d):
    return D.exact_duplicates(table(spark, d, "documents"), "doc_id", ["text"]).select(
        "cluster_id", "row_id", "is_extra", "n")


@query("most_complete_copy_documents", """WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN
 NULL ELSE lang END AS lang FROM documents) SELECT min(doc_id) AS cluster_id,
 arg_min(doc_id, struct_pack(n := (lang IS NULL)::INT, d := doc_id)) AS most_complete_id
 FROM t GROUP BY text HAVING count(*) > 1""")
def _(spark, d):
    df = table(spark, d, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"))
    fp = D.fingerprint(V.as_text(df, "text"))
    return (df.groupBy(fp.alias("fp")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("cluster_id"),
        F.min_by("doc_id", F.struct(D.null_count(df, ["text", "lang"]).alias("n"), "doc_id"))
        .alias("most_complete_id")).where("n > 1").select("cluster_id", "most_complete_id"))


@query("merge_keep_complete_documents", """WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0
 THEN NULL ELSE lang END AS lang, source FROM documents), k AS (SELECT *, struct_pack(n :=
 (lang IS NULL)::INT, d := doc_id) AS o FROM t) SELECT arg_min(doc_id, o) AS doc_id, md5(text) AS text,
 arg_min(lang, o) FILTER (WHERE lang IS NOT NULL) AS lang, arg_min(source, o) AS source
 FROM k GROUP BY text""")
def _(spark, d):
    df = table(spark, d, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), "source")
    return D.merge_keep_complete(df, "doc_id", ["text"]).select(
        "doc_id", F.md5("text").alias("text"), "lang", "source")


SIM = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
SAME = " + ".join("(coalesce({a}.%s = {b}.%s, {a}.%s IS NULL AND {b}.%s IS NULL))::INT" % (c, c, c, c)
                  for c in SIM)


@query("row_similarity_lineitem", f"""SELECT l_orderkey, rn::BIGINT AS line, round(({SAME.format(
    a='x', b='y')}) / 5.0, 6)::DOUBLE AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY
 l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) x JOIN
 (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
 l_extendedprice) AS rn2 FROM lineitem) y USING (l_orderkey) WHERE rn2 = rn + 1""")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_extendedprice")
    df = table(spark, d, "lineitem")
    nxt = df.select("l_orderkey", F.row_number().over(w).cast("long").alias("line"), *SIM,
                    *[F.lead(c).over(w).alias(f"next_{c}") for c in SIM],
                    F.lead(F.lit(True)).over(w).alias("more"))
    a = {c: F.col(c).cast("string") for c in SIM}
    b = {c: F.col(f"next_{c}").cast("string") for c in SIM}
    return nxt.where("more").select("l_orderkey", "line", r(D.similarity(a, b)).alias("similarity"))


NEAR = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
KEYED = """(SELECT *, l_orderkey * 1000000 + l_linenumber * 100000 + row_number() OVER (PARTITION BY
 l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem)"""


def _near_sql():
    same = " + ".join(f"(l.{c} = t2.{c})::INT" for c in NEAR)
    pack = ", ".join(f"{c} := t2.{c}" for c in NEAR)
    pack1 = ", ".join(f"{c} := {c}" for c in NEAR)
    return f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY id)
 AS rn FROM {KEYED}), s AS (SELECT l_orderkey AS b, rn, id AS k, NULL::BIGINT AS leader,
 NULL::DOUBLE AS sim, [struct_pack(k := id, {pack1})] AS leaders FROM t WHERE rn = 1 UNION ALL
 SELECT b, rn, k, hit[1].k, CASE WHEN len(hit) > 0 THEN list_sum([{", ".join(
     f"(hit[1].{c} = me.{c})::INT" for c in NEAR)}]) / 5.0 END,
 CASE WHEN len(hit) = 0 THEN list_append(leaders, me) ELSE leaders END FROM (SELECT s.b, t2.rn,
 t2.id AS k, s.leaders, struct_pack(k := t2.id, {pack}) AS me,
 list_filter(s.leaders, lambda l: {same} >= 4) AS hit FROM s JOIN t t2
 ON t2.l_orderkey = s.b AND t2.rn = s.rn + 1))
 SELECT leader AS leader_id, k AS row_id, round(sim, 6)::DOUBLE AS similarity FROM s
 WHERE leader IS NOT NULL"""


@query("near_duplicates_lineitem", _near_sql())
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_extendedprice")
    df = table(spark, d, "lineitem").withColumn(
        "id", F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000
        + F.row_number().over(w))
    out = D.near_duplicates(df, "id", NEAR, ["l_orderkey"], threshold=0.8)
    return out.select("leader_id", "row_id", r("similarity").alias("similarity"))


@query("near_duplicates_unblocked_customer", """ SELECT min(c_custkey) OVER w AS leader_id, c_custkey AS row_id FROM customer WINDOW w AS (PARTITION BY
 c_nationkey, c_mktsegment, round(c_acctbal / 500)) QUALIFY c_custkey <> min(c_custkey) OVER w""")
def _(spark, d):
    df = table(spark, d, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 500).alias("bal"))
    out = D.near_duplicates(df, "c_custkey", ["c_nationkey", "c_mktsegment", "bal"], [])
    return out.select("leader_id", "row_id")


@query("duplicate_report_documents", """SELECT count(*)::BIGINT AS total_rows,
 (count(*) - count(DISTINCT text))::BIGINT AS exact_duplicates, 0::BIGINT AS near_duplicates,
 round((count(*) - count(DISTINCT text)) / count(*)::DOUBLE, 6) AS exact_rate,
 round((count(*) - count(DISTINCT text)) / count(*)::DOUBLE, 6) AS total_rate FROM documents""")
def _(spark, d):
    rep = D.duplicate_report(table(spark, d, "documents"), "doc_id", ["text"], block=[])
    return rep.select("total_rows", "exact_duplicates", "near_duplicates",
                      r("exact_rate").alias("exact_rate"), r("total_rate").alias("total_rate"))


@query("blocking_columns_orders")
def _(spark, d):
    df = table(spark, d, "orders")
    found = D.blocking_columns(df.withColumnRenamed("o_custkey", "patient_id"), [
        "patient_id", "o_orderstatus", "o_orderdate"])
    return df.agg(F.count_distinct("o_custkey").alias("blocks"),
                  F.max(F.lit(",".join(found))).alias("columns"))


# ---- the trust score card ----------------------------------------------------------------------

CARD_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
       "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SHARES = f"""WITH q AS (SELECT {", ".join(
    f"quantile_cont({c}, [0.25, 0.75]) AS {c}" for c in CARD_NUM)} FROM lineitem),
 s AS (SELECT count(*)::BIGINT AS n, avg(({" OR ".join(
     f"t.{c} < q.{c}[1] - 3 * (q.{c}[2] - q.{c}[1]) OR t.{c} > q.{c}[2] + 3 * (q.{c}[2] - q.{c}[1])"
     for c in CARD_NUM)})::INT) AS noise, ({" + ".join(
         f"count(*) FILTER (WHERE t.{c} IS NULL)" for c in ALL)}) / (count(*) * 11.0)::DOUBLE AS missing,
 (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))) / count(*)::DOUBLE AS dup,
 avg((t.l_quantity > 49 OR t.l_discount > 0.09)::INT) AS bad FROM lineitem t, q)"""
PCT = """, p AS (SELECT n, round(noise * 100, 2) AS noise_pct, round(missing * 100, 2) AS
 missingness_pct, round(dup * 100, 2) AS duplicate_pct, round((1 - bad) * 100, 2) AS plausibility_rate
 FROM s)"""


def _card(df):
    from veracell.dims import Range
    from veracell.operators.semantics import implausible
    quart = quantiles(df, {c: F.col(c) for c in CARD_NUM}, [0.25, 0.75])
    fences = P.fences(df, CARD_NUM, quartiles=quart)
    out = F.lit(False)
    for c, (lo, hi) in fences.items():
        out = out | ~F.col(c).between(lo, hi)
    bad = implausible(df, {"l_quantity": [Range("l_quantity", 0, 49)],
                           "l_discount": [Range("l_discount", 0, 0.09)]})
    one = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.avg(out.cast("double")).alias("noise"),
        (F.sum(D.null_count(df, ALL)) / (F.count(F.lit(1)) * len(ALL))).alias("missing"),
        F.avg(bad.cast("double")).alias("implausible"))
    rows = df.select(D.fingerprint(*[V.as_text(df, c) for c in ALL]).alias("fp"))
    distinct = rows.agg(F.count_distinct("fp").alias("kinds"))
    shares = one.crossJoin(distinct).withColumn(
        "duplicate", 1.0 - F.col("kinds") / F.col("total_rows"))
    return M.quality(shares)


@query("trust_score_card_lineitem", SHARES + PCT + """ SELECT noise_pct, missingness_pct, duplicate_pct,
 plausibility_rate, round(0.25 * greatest(0, 100 - missingness_pct) + 0.30 * greatest(0, 100 -
 noise_pct) + 0.25 * plausibility_rate + 0.20 * greatest(0, 100 - duplicate_pct), 1) AS trust_score,
 n AS total_rows FROM p""")
def _(spark, d):
    return _card(table(spark, d, "lineitem"))


@query("quality_percentages_lineitem", SHARES + PCT + """ SELECT noise_pct, missingness_pct,
 duplicate_pct, plausibility_rate FROM p""")
def _(spark, d):
    return _card(table(spark, d, "lineitem")).select(
        "noise_pct", "missingness_pct", "duplicate_pct", "plausibility_rate")

