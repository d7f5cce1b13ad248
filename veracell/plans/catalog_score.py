"""Queries over score algebra and method choice."""
from __future__ import annotations

from pyspark.sql import functions as F

from veracell.operators import detectors as DT, replicates as RE, scoring as SC
from veracell.plans.registry import query, r, table

SCORES = """e AS (SELECT event_id, value, user_id, abs(value - avg(value) OVER ()) AS dev FROM events),
 s AS (SELECT event_id, user_id, value, (value - min(value) OVER ()) / (max(value) OVER () - min(value)
 OVER ()) AS by_value, (dev - min(dev) OVER ()) / (max(dev) OVER () - min(dev) OVER ()) AS by_dev,
 (user_id - min(user_id) OVER ()) / (max(user_id) OVER () - min(user_id) OVER ())::DOUBLE AS by_user
 FROM e)"""
CUT = """c AS (SELECT quantile_cont(by_value, 0.95) AS cv, quantile_cont(by_dev, 0.95) AS cd,
 quantile_cont(by_user, 0.95) AS cu FROM s)"""
NAMES = ["by_value", "by_dev", "by_user"]


def scores(spark, d):
    e = table(spark, d, "events")
    mean = e.agg(F.avg("value")).first()[0]
    e = e.select("event_id", "user_id", "value", F.abs(F.col("value") - mean).alias("dev"))
    out = e
    for src, name in (("value", "by_value"), ("dev", "by_dev"), ("user_id", "by_user")):
        out = DT.min_max(out, src, name)
    return out


@query("quantile_flags_events", f"""WITH {SCORES}, {CUT} SELECT event_id, by_value > cv AS flag_by_value,
 by_dev > cd AS flag_by_dev, by_user > cu AS flag_by_user FROM s, c""")
def _(spark, d):
    return SC.flag(scores(spark, d), NAMES, 0.05).select(
        "event_id", *[f"flag_{c}" for c in NAMES])


@query("discrimination_events", f"""WITH {SCORES}, {CUT}, f AS (SELECT by_dev, by_value > cv AS hit FROM s,
 c), g AS (SELECT by_dev AS v, count(*) FILTER (WHERE hit) AS h, count(*) FILTER (WHERE NOT hit) AS o
 FROM f GROUP BY 1), w AS (SELECT h, o, coalesce(sum(o) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(h * below) / (sum(h) * sum(o))::DOUBLE, 6) AS ad
 FROM w""")
def _(spark, d):
    f = SC.flag(scores(spark, d), ["by_value"], 0.05)
    return SC.discrimination(f, "by_dev", "flag_by_value").select(r("ad").alias("ad"))


@query("flag_overlap_events", f"""WITH {SCORES}, {CUT}, f AS (SELECT by_value > cv AS a, by_dev > cd AS b,
 by_user > cu AS c3 FROM s, c) SELECT round((count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR
 b)::DOUBLE + count(*) FILTER (WHERE a AND c3) / count(*) FILTER (WHERE a OR c3)::DOUBLE + count(*) FILTER
 (WHERE b AND c3) / count(*) FILTER (WHERE b OR c3)::DOUBLE) / 3, 6) AS stability FROM f""")
def _(spark, d):
    f = SC.flag(scores(spark, d), NAMES, 0.05)
    return SC.mean_jaccard(f, [f"flag_{c}" for c in NAMES]).select(
        r("stability").alias("stability"))


@query("bootstrap_stability_lineitem")
def _(spark, d):
    from veracell.plans.catalog_detect import line_features
    feats = line_features(spark, d)
    ss = RE.stability(RE.weighted(feats, 8), "autoencoder", 8, 0.05)
    return spark.createDataFrame([("autoencoder", ss)], "method string, stability double").select(
        "method", "stability", SC.stability_words(F.col("stability")).alias("interpretation"))


@query("clinical_plausibility_part", """WITH s AS (SELECT p_retailprice, (p_size < 3 OR p_size > 48) AS bad
 FROM part), c AS (SELECT quantile_cont(p_retailprice, 0.9) AS q FROM part) SELECT
 round(coalesce(avg(bad::INT), 0.5), 6) AS cp FROM s, c WHERE p_retailprice > q""")
def _(spark, d):
    df = table(spark, d, "part").withColumn("bad", (F.col("p_size") < 3) | (F.col("p_size") > 48))
    return SC.plausibility_share(SC.flag(df, ["p_retailprice"], 0.1), "flag_p_retailprice", "bad") \
        .select(r("cp").alias("cp"))


METHODS = """m AS (SELECT event_type AS method, least(1.0, avg(value) / 100) AS ad, (count(*) % 97) / 97.0
 AS ss, 0.5 + (count(*) % 7) / 20.0 AS cp, 0.6 + (count(*) % 5) / 20.0 AS ex, (count(*) % 13)::DOUBLE AS
 ms, (count(*) % 3) / 10.0 AS penalty FROM events GROUP BY 1), k AS (SELECT *, CASE WHEN max(ms) OVER () > 0
 THEN greatest(0, 1 - ms / (max(ms) OVER () + 1e-10)) ELSE 0.5 END AS cc, 0.6 * ad + 0.4 * ss AS ndc FROM
 m), t AS (SELECT *, round(0.35 * ndc + 0.25 * cp + 0.20 * ex + 0.10 * cc + 0.10 * (1 - penalty), 4) AS
 composite FROM k)"""


def methods(spark, d):
    n = F.count(F.lit(1))
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(
        F.least(F.lit(1.0), F.avg("value") / 100).alias("ad"), (n % 97 / 97.0).alias("ss"),
        (0.5 + n % 7 / 20.0).alias("cp"), (0.6 + n % 5 / 20.0).alias("ex"),
        (n % 13).cast("double").alias("duration_ms"), (n % 3 / 10.0).alias("penalty"))
    return SC.composite(m)


@query("composite_scores_events", f"""WITH {METHODS} SELECT method, round(cc, 4)::DOUBLE AS cc, round(ndc,
 4)::DOUBLE AS ndc, composite::DOUBLE AS composite FROM t""")
def _(spark, d):
    return methods(spark, d).select("method", *[r(c, 4).alias(c)
                                                for c in ("cc", "ndc", "composite")])


def _choice(name, shift):
    @query(name, f"""WITH {METHODS}, u AS (SELECT method, composite + {shift} AS composite FROM t),
 r AS (SELECT *, row_number() OVER (ORDER BY composite DESC, method) AS rn FROM u),
 g AS (SELECT max(composite) AS top, max(composite) - min(composite) AS gap, sum(composite) AS total,
 count(*) AS n FROM r WHERE rn <= 3), md AS (SELECT *, CASE WHEN top > 0.7 THEN 'single' WHEN n >= 2 AND
 gap < 0.05 AND top > 0.5 THEN 'ensemble' WHEN top < 0.5 THEN 'fallback' ELSE 'single' END AS mode FROM g)
 SELECT mode, method, round(CASE WHEN mode = 'ensemble' THEN composite / total ELSE 1 END, 6)::DOUBLE AS
 weight FROM r, md WHERE rn <= CASE WHEN mode = 'ensemble' THEN 3 ELSE 1 END""")
    def _(spark, d):
        m = methods(spark, d).withColumn("composite", F.col("composite") + shift)
        return SC.select_methods(m).select("mode", "method", r("weight").alias("weight"))


_choice("method_choice_events", 0.0)
_choice("method_choice_good_events", 0.5)
_choice("method_choice_poor_events", -0.5)

WEIGHTS = {"by_value": 0.5, "by_dev": 0.3, "absent": 0.9}
ENS = f"""WITH {SCORES}, {CUT}, f AS (SELECT *, (0.5 * by_value + 0.3 * by_dev) / 0.8 AS fin FROM s),
 q AS (SELECT quantile_cont(fin, 0.95) AS cf FROM f), a AS (SELECT event_id, fin, fin > cf AS flagged, cf,
 ((by_value > cv)::INT + (by_dev > cd)::INT + (by_user > cu)::INT) / 3.0 AS agreement FROM f, q, c)"""


@query("ensemble_scores_events", ENS + """ SELECT event_id, round(fin, 6) AS final_score FROM a""")
def _(spark, d):
    s = scores(spark, d)
    return s.select("event_id", r(SC.ensemble_score(WEIGHTS, NAMES)).alias("final_score"))


@query("method_agreement_events", ENS + """ SELECT event_id, flagged, round(agreement, 6)::DOUBLE AS
 agreement FROM a""")
def _(spark, d):
    out, _ = SC.ensemble(scores(spark, d), NAMES, WEIGHTS, 0.05)
    return out.select("event_id", "flagged", r("agreement").alias("agreement"))


@query("ambiguous_rows_events", ENS + """ SELECT event_id FROM a WHERE (flagged AND agreement < 0.7) OR (NOT
 flagged AND agreement > 0.3)""")
def _(spark, d):
    out, _ = SC.ensemble(scores(spark, d), NAMES, WEIGHTS, 0.05)
    return out.where(SC.ambiguous(F.col("flagged"), F.col("agreement"), 0.3)).select("event_id")


@query("borderline_rows_events", ENS + """ SELECT event_id, round(fin, 4) AS score, round(cf, 4) AS threshold,
 round(fin / cf * 100, 1) AS pct_of_threshold FROM a WHERE fin >= 0.6 * cf AND fin < cf ORDER BY fin DESC,
 event_id LIMIT 15""")
def _(spark, d):
    out, cut = SC.ensemble(scores(spark, d), NAMES, WEIGHTS, 0.05)
    return SC.borderline(out, "event_id", "final_score", cut).drop("reason")


