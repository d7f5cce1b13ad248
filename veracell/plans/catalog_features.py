"""Queries over the feature matrix."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell.functions.stop_words import STOP_WORDS
from veracell.operators import features as X, profile as P
from veracell.plans.registry import query, r, table


@query("imputed_features_lineitem", """WITH t AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 7 =
 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem) SELECT l_orderkey, l_partkey,
 round(coalesce(price, (SELECT median(price) FROM t)), 4) AS price FROM t""")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(
        F.col("l_partkey") % 7 != 0, F.col("l_extendedprice")).alias("price"))
    keyed = df.withColumn("k", F.struct("l_orderkey", "l_partkey"))
    prof = P.numeric_profile(df, ["price"]).collect()
    lay = X.plan_features(df, [x.asDict() for x in prof])
    return X.raw_features(keyed, "k", lay).select(
        "row_id.l_orderkey", "row_id.l_partkey", r(F.col("x")[0], 4).alias("price"))


@query("one_hot_orders", """SELECT o_orderkey, (o_orderstatus = 'O')::INT::DOUBLE AS status_o,
 (o_orderstatus = 'P')::INT::DOUBLE AS status_p, (o_orderpriority = '2-HIGH')::INT::DOUBLE AS high,
 4::BIGINT AS priority_dummies FROM orders""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    prof = [p.asDict() for p in P.categorical_profile(
        df, ["o_orderstatus", "o_orderpriority"]).collect()]
    lay = X.plan_features(df, prof)
    at = {n: i for i, n in enumerate(lay.names)}
    return X.raw_features(df, "o_orderkey", lay).select(
        F.col("row_id").alias("o_orderkey"), F.col("x")[at["o_orderstatus_O"]].alias("status_o"),
        F.col("x")[at["o_orderstatus_P"]].alias("status_p"),
        F.col("x")[at["o_orderpriority_2-HIGH"]].alias("high"),
        F.lit(len(lay.levels["o_orderpriority"])).cast("long").alias("priority_dummies"))


@query("standardised_lineitem", """SELECT l_orderkey, l_partkey, l_suppkey, round((l_quantity - (SELECT
 avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) + 0.0 AS z_quantity,
 round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT
 stddev_pop(l_extendedprice) FROM lineitem), 6) + 0.0 AS z_price, 0.0::DOUBLE AS z_flat FROM lineitem""")
def _(spark, d):
    df = table(spark, d, "lineitem").withColumn("flat", F.lit(3.0)).withColumn(
        "k", F.struct("l_orderkey", "l_partkey", "l_suppkey"))
    z = X.numeric_matrix(df, "k", ["l_quantity", "l_extendedprice", "flat"])
    return z.select("row_id.*", r(F.col("x")[0]).alias("z_quantity"),
                    r(F.col("x")[1]).alias("z_price"), r(F.col("x")[2]).alias("z_flat"))


def _ratio(pattern):
    return (f"round(length(regexp_replace(text, '{pattern}', '', 'g')) / "
            "greatest(length(text), 1)::DOUBLE, 6)")


@query("text_shape_documents", f"""SELECT doc_id, length(text)::DOUBLE AS len,
 len(string_split_regex(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'),
 '[\\s\\p{{Z}}]+'))::DOUBLE AS words, {_ratio('[^\\p{Nd}]')} AS digit_ratio,
 {_ratio('[^\\p{L}]')} AS alpha_ratio, {_ratio('[^\\p{Lu}]')} AS upper_ratio,
 {_ratio('[^\\s\\p{Z}]')} AS space_ratio, {_ratio('[\\p{L}\\p{N}\\s\\p{Z}]')} AS special_ratio
 FROM documents""")
def _(spark, d):
    shape = X.text_shape(F.col("text"))
    names = ["len", "words", "digit_ratio", "alpha_ratio", "upper_ratio", "space_ratio",
             "special_ratio"]
    return table(spark, d, "documents").select("doc_id", *[r(shape[n]).alias(n) for n in names])


@query("char_entropy_documents", """SELECT doc_id, round(entropy(ch), 6) AS entropy FROM (SELECT doc_id,
 unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", r(X.char_entropy(F.col("text"))).alias("entropy"))


@query("text_flags_documents", """SELECT doc_id, (length(text) = 0)::INT::DOUBLE AS is_empty,
 regexp_full_match(trim(text), '[\\d.\\-+eE,]+')::INT::DOUBLE AS looks_numeric,
 regexp_matches(text, '\\d{2,4}[-/]\\d{1,2}[-/]\\d{1,2}')::INT::DOUBLE AS has_date_pattern
 FROM documents""")
def _(spark, d):
    shape = X.text_shape(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[
        shape[n].alias(n) for n in ("is_empty", "looks_numeric", "has_date_pattern")])


@query("value_frequency_documents", """SELECT doc_id, (count(*) OVER (PARTITION BY text))::DOUBLE AS
 value_freq, (count(*) OVER (PARTITION BY text) = 1)::INT::DOUBLE AS is_rare FROM documents""")
def _(spark, d):
    return X.value_frequency(table(spark, d, "documents"), "text").select(
        "doc_id", "value_freq", "is_rare")


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tfidf_sql():
    return f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'))
 AS term FROM documents), k AS (SELECT * FROM t WHERE term <> '' AND term NOT IN ({STOP})),
 v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM k GROUP BY term
 HAVING count(DISTINCT doc_id) >= 2 ORDER BY tf DESC, term LIMIT 20),
 w AS (SELECT doc_id, term, count(*) * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)::DOUBLE)
 + 1) AS w FROM k JOIN v USING (term) GROUP BY doc_id, term, df)
 SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("tfidf_documents", _tfidf_sql())
def _(spark, d):
    df = table(spark, d, "documents")
    vocab = X.vocabulary(df, "text")
    terms = F.array(*map(F.lit, vocab.terms))
    return (X.with_tfidf(df, "text", vocab, "v").select("doc_id", F.posexplode("v").alias("i", "w"))
            .where("w > 0").select("doc_id", terms[F.col("i")].alias("term"), r("w").alias("weight")))


@query("tfidf_components_documents")
def _(spark, d):
    df = table(spark, d, "documents")
    vocab = X.vocabulary(df, "text")
    basis = X.svd_basis(df, "text", vocab)
    return X.with_components(df, "text", vocab, basis, "v").select(
        "doc_id", F.posexplode("v").alias("component", "value"))


@query("text_columns_documents_selected", """SELECT 'text' AS text_columns, count(*)::BIGINT AS n
 FROM documents""")
def _(spark, d):
    df = table(spark, d, "documents").select("text", "lang", "source", "n_chars")
    prof = [p.asDict() for p in P.column_profile(df).orderBy("position").collect()]
    return df.agg(F.lit(",".join(X.text_columns(prof))).alias("text_columns"),
                  F.count(F.lit(1)).alias("n"))


@query("feature_matrix_orders")
def _(spark, d):
    df = table(spark, d, "orders")
    prof = [p.asDict() for p in P.column_profile(
        df, ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
        .orderBy("position").collect()]
    feats, _ = X.feature_matrix(df, "o_orderkey", prof)
    return feats.select(F.col("row_id").alias("o_orderkey"), F.posexplode("x").alias("i", "value"))
