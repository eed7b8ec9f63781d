"""Queries: statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import stats as S
from panelspark.plans.registry import query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("a08_distribution_summary", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS feature, COUNT({c}) AS n, MEDIAN({c}) AS median, QUANTILE_CONT({c}, 0.25) AS p25,
      QUANTILE_CONT({c}, 0.75) AS p75, AVG({c}) AS mean, STDDEV_POP({c}) AS std FROM lineitem GROUP BY 1""" for c in FEATURES
) + ") u", "median, p25, p75, mean, std", digits=5)
def a08(t):
    return S.summarize(t.lineitem, FEATURES, ["l_returnflag"])


@query("a09_ks_two_sample", """
    WITH v AS (SELECT l_extendedprice AS x, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS na, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS nb
        FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
      c AS (SELECT SUM(na) OVER (ORDER BY x) AS ca, SUM(nb) OVER (ORDER BY x) AS cb, SUM(na) OVER () AS n_a, SUM(nb) OVER () AS n_b FROM v),
      d AS (SELECT MAX(ABS(ca * 1e0 / n_a - cb * 1e0 / n_b)) AS d, CAST(MAX(n_a) AS BIGINT) AS n_a, CAST(MAX(n_b) AS BIGINT) AS n_b FROM c),
      l AS (SELECT *, (SQRT(n_a * n_b * 1e0 / (n_a + n_b)) + 12e-2 + 11e-2 / SQRT(n_a * n_b * 1e0 / (n_a + n_b))) * d AS lam FROM d)
    SELECT d, n_a, n_b, (SELECT GREATEST(0e0, LEAST(1e0, 2 * SUM(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * EXP(-2 * lam * lam * j * j))))
        FROM (SELECT UNNEST(RANGE(1, 101)) AS j) q) AS p FROM l""", "d, p")
def a09(t):
    return S.ks_test(t.lineitem, "l_extendedprice", "l_returnflag", "A", "R")


@query("a10_histogram_linear", """
    WITH s AS (SELECT MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem)
    SELECT l_returnflag, CAST(LEAST(FLOOR((l_quantity - lo) / (hi - lo) * 49), 48) AS BIGINT) AS bin, COUNT(*) AS n
    FROM lineitem CROSS JOIN s GROUP BY 1, 2""")
def a10(t):
    return S.histograms(t.lineitem, "l_quantity", "l_returnflag")


@query("a10_histogram_log", """
    WITH x AS (SELECT l_returnflag, LN(l_extendedprice) AS v FROM lineitem WHERE l_extendedprice > 0),
      s AS (SELECT GREATEST(MIN(v), LN(1e-3)) AS lo, MAX(v) AS hi FROM x)
    SELECT l_returnflag, CAST(LEAST(FLOOR((v - lo) / (hi - lo) * 49), 48) AS BIGINT) AS bin, COUNT(*) AS n
    FROM x CROSS JOIN s WHERE v >= lo GROUP BY 1, 2""")
def a10_log(t):
    return S.histograms(t.lineitem, "l_extendedprice", "l_returnflag", log=True)


@query("a15_feature_coverage", """
    WITH d AS (SELECT EXTRACT(YEAR FROM dt) AS year, precipitation_sum, pm2_5, wind_speed_10m_max FROM f_daily),
      u AS (SELECT CAST(year AS INT) AS year, 'pm2_5' AS feature, AVG(CASE WHEN pm2_5 IS NULL THEN 0e0 ELSE 1e0 END) AS coverage FROM d GROUP BY ROLLUP (year)
        UNION ALL SELECT CAST(year AS INT), 'wind_speed_10m_max', AVG(CASE WHEN wind_speed_10m_max IS NULL THEN 0e0 ELSE 1e0 END) FROM d GROUP BY ROLLUP (year))
    SELECT *, coverage < 0.5 AS sparse FROM u""", "coverage")
def a15(t):
    return S.coverage(t.f_daily.withColumn("year", F.year("dt")), ["pm2_5", "wind_speed_10m_max"], "year")


@query("a17_feature_medians", """
    SELECT 'precipitation_sum' AS feature, COALESCE(MEDIAN(precipitation_sum), 0) AS median FROM f_daily
    UNION ALL SELECT 'pm2_5', COALESCE(MEDIAN(pm2_5), 0) FROM f_daily
    UNION ALL SELECT 'wind_speed_10m_max', COALESCE(MEDIAN(wind_speed_10m_max), 0) FROM f_daily
    UNION ALL SELECT 'absent', 0""", "median")
def a17(t):
    df = t.f_daily.withColumn("absent", F.lit(None).cast("double"))
    return S.medians(df, ["precipitation_sum", "pm2_5", "wind_speed_10m_max", "absent"])


AUC_SQL = """WITH s AS ({source}), r AS (SELECT grp, y, RANK() OVER (PARTITION BY grp ORDER BY score)
      + (COUNT(*) OVER (PARTITION BY grp, score) - 1) / 2e0 AS rk FROM s),
    c AS (SELECT grp, COUNT(*) FILTER (WHERE y = 1) AS n_pos, COUNT(*) FILTER (WHERE y <> 1) AS n_neg, SUM(CASE WHEN y = 1 THEN rk END) AS sr FROM r GROUP BY 1)
    SELECT grp, n_pos, n_neg, CASE WHEN n_pos * n_neg > 0 THEN (sr - n_pos * (n_pos + 1) / 2e0) / (n_pos * n_neg * 1e0) END AS auc FROM c"""
BIG_SCORE = """SELECT l_returnflag AS grp, l_quantity * 100 + l_linenumber AS score, CASE WHEN l_discount * 100 + l_quantity > 40 THEN 1 ELSE 0 END AS y FROM lineitem"""


@query("a18_roc_auc", AUC_SQL.format(source="SELECT grp, score, y FROM f_score"), "auc")
def a18(t):
    return S.roc_auc(t.f_score, "score", "y", ["grp"])


@query("a18_roc_auc_lineitem", AUC_SQL.format(source=BIG_SCORE), "auc")
def a18_big(t):
    return S.roc_auc(t.sql(BIG_SCORE), "score", "y", ["grp"])


@query("a19_average_precision", """
    WITH v AS (SELECT grp, score, COUNT(*) FILTER (WHERE y = 1) AS p, COUNT(*) AS n FROM f_score GROUP BY 1, 2),
      c AS (SELECT grp, p, SUM(p) OVER w * 1e0 / SUM(n) OVER w AS prec, SUM(p) OVER (PARTITION BY grp) AS np FROM v
        WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
    SELECT grp, CASE WHEN MAX(np) > 0 THEN SUM(p * prec) / MAX(np) END AS average_precision FROM c GROUP BY 1""", "average_precision")
def a19(t):
    return S.average_precision(t.f_score, "score", "y", ["grp"])


@query("a20_spearman", """
    WITH r AS (SELECT l_returnflag, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2e0 AS rx,
        RANK() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2e0 AS ry FROM lineitem)
    SELECT l_returnflag, COUNT(*) AS n, CORR(rx, ry) AS spearman FROM r GROUP BY 1""", "spearman")
def a20(t):
    return S.spearman(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
