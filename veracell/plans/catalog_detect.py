"""Queries over neighbours and detectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell.functions.session import materialise
from veracell.operators import detectors as DT, features as X, knn
from veracell.plans.registry import long, query, r, table

PAIRS = """SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[],
 b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""
KNN = f"""n AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank
 FROM ({PAIRS}) QUALIFY rank <= 20)"""


def vectors(spark, d):
    return materialise(table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x")),
        "row_id")


def line_features(spark, d, columns=("l_quantity", "l_extendedprice", "l_discount", "l_tax")):
    df = table(spark, d, "lineitem").withColumn("k", F.xxhash64(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return X.numeric_matrix(df, "k", list(columns))


@query("min_max_scores_embeddings", """SELECT vec_id, round((n - min(n) OVER ()) / (max(n) OVER () -
 min(n) OVER ()), 6) AS score FROM (SELECT vec_id, sqrt(list_sum([v * v FOR v IN embedding::DOUBLE[]]))
 AS n FROM embeddings)""".replace("[v * v FOR v IN embedding::DOUBLE[]]",
                                  "list_transform(embedding::DOUBLE[], lambda v: v * v)"))
def _(spark, d):
    norm = vectors(spark, d).select(F.col("row_id").alias("vec_id"), F.sqrt(F.aggregate(
        "x", F.lit(0.0), lambda a, v: a + v * v)).alias("n"))
    return DT.min_max(norm, "n").select("vec_id", r("score").alias("score"))


@query("nearest_neighbours_embeddings", f"""WITH {KNN} SELECT a AS row_id, rank::BIGINT AS rank,
 b AS neighbour_id, round(d, 6) AS distance FROM n""")
def _(spark, d):
    return knn.edges(vectors(spark, d), 20).select(
        "row_id", long("rank").alias("rank"), "neighbour_id", r("distance").alias("distance"))


@query("local_outlier_factor_embeddings", f"""WITH {KNN}, kd AS (SELECT a AS b, max(d) AS kd FROM n GROUP
 BY a), l AS (SELECT n.a, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN kd USING (b) GROUP BY
 n.a), f AS (SELECT n.a, avg(o.lrd) / max(m.lrd) AS lof FROM n JOIN l o ON n.b = o.a JOIN l m ON
 n.a = m.a GROUP BY n.a) SELECT a AS row_id, round(lof, 5) AS lof, round((lof - min(lof) OVER ()) /
 (max(lof) OVER () - min(lof) OVER ()), 5) AS score FROM f""")
def _(spark, d):
    found = DT.local_outlier_factor(vectors(spark, d))
    return found.scores.select("row_id", r("lof", 5).alias("lof"), r("score", 5).alias("score"))


@query("isolation_forest_lineitem")
def _(spark, d):
    return DT.isolation_forest(line_features(spark, d)).scores


@query("split_shares_lineitem")
def _(spark, d):
    feats = line_features(spark, d)
    nodes, _ = DT.forest(feats)
    shares = DT.split_shares(nodes, 4)
    names = F.array(*map(F.lit, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    return spark.createDataFrame(list(enumerate(shares)), "i int, share double").select(
        names[F.col("i")].alias("feature"), "share")


@query("density_clusters_embeddings")
def _(spark, d):
    found = DT.density_clusters(vectors(spark, d))
    return found.scores.join(found.clusters, "row_id")


@query("reconstruction_error_lineitem", """WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey,
 l_suppkey, l_extendedprice AS price, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity)
 OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER ()
 AS b FROM lineitem), e AS (SELECT *, CASE WHEN (SELECT corr(l_quantity,
 l_extendedprice) FROM lineitem) >= 0 THEN (a - b) * (a - b) ELSE (a + b) * (a + b) END / 4 AS raw FROM z) SELECT l_orderkey,
 l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, price, round(raw, 6) AS raw,
 round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS score FROM e""")
def _(spark, d):
    df = table(spark, d, "lineitem").withColumn("k", F.struct(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
        "l_suppkey", F.col("l_extendedprice").alias("price")))
    feats = X.numeric_matrix(df, "k", ["l_quantity", "l_extendedprice"])
    found = DT.reconstruction_error(feats)
    return found.scores.select("row_id.*", r("raw").alias("raw"), r("score").alias("score"))


@query("robust_pca_lineitem")
def _(spark, d):
    return DT.robust_pca(line_features(spark, d)).scores.select("row_id", "score")
