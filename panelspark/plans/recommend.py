"""Queries: area risk, cleaning windows, per-array recommendations; the flagship chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.numeric import round_binary_sql
from panelspark.operators import daily as D
from panelspark.operators import physics as P
from panelspark.operators import recommend as R
from panelspark.plans.fixtures import Tables
from panelspark.plans.registry import query

TODAY = "2024-03-01"


def areas(t):
    return t.nation.select(
        F.col("n_nationkey").alias("aoi_id"),
        F.date_sub(F.to_date(F.lit(TODAY)), (F.col("n_nationkey") * 3) % 60).alias("last_cleaned"))


def decisions(t):
    return R.recommend_areas(t.f_risk, t.f_forecast, areas(t), F.to_date(F.lit(TODAY)))


AREA = """s AS (SELECT aoi_id, risk_score, ROW_NUMBER() OVER (PARTITION BY aoi_id ORDER BY risk_score) - 1 AS i,
      COUNT(*) OVER (PARTITION BY aoi_id) AS n FROM f_risk WHERE risk_score IS NOT NULL),
    k AS (SELECT aoi_id, risk_score FROM s WHERE i = LEAST(n - 1, CAST(FLOOR(n * 0.9) AS BIGINT))),
    ar AS (SELECT c.aoi_id, c.n_arrays, COALESCE(k.risk_score, 0) AS aoi_risk
      FROM (SELECT aoi_id, COUNT(*) AS n_arrays FROM f_risk GROUP BY 1) c LEFT JOIN k USING (aoi_id))"""
DRY = """dr AS (SELECT aoi_id, day_no, day_no - ROW_NUMBER() OVER (PARTITION BY aoi_id ORDER BY day_no) AS g
      FROM f_forecast WHERE rain_mm < 5e0 / 7),
    rn AS (SELECT aoi_id, g, MAX(day_no) AS e, COUNT(*) AS n FROM dr GROUP BY 1, 2),
    de AS (SELECT a.aoi_id, (SELECT e FROM rn WHERE rn.aoi_id = a.aoi_id ORDER BY n DESC, e LIMIT 1) AS dry_end_day
      FROM (SELECT DISTINCT aoi_id FROM f_forecast) a)"""
DECIDE = f"""WITH {AREA}, {DRY},
    tr AS (SELECT aoi_id, SUM(rain_mm) AS total_rain_mm FROM f_forecast GROUP BY 1),
    ba AS (SELECT n.n_nationkey AS aoi_id, DATE '{TODAY}' AS today, DATE '{TODAY}' - (n.n_nationkey * 3) % 60 AS last_cleaned,
        (n.n_nationkey * 3) % 60 AS days_since_clean, ar.aoi_risk, ar.n_arrays, tr.total_rain_mm, de.dry_end_day
      FROM nation n JOIN ar ON ar.aoi_id = n.n_nationkey LEFT JOIN tr ON tr.aoi_id = n.n_nationkey LEFT JOIN de ON de.aoi_id = n.n_nationkey),
    ru AS (SELECT *, CASE WHEN aoi_risk < 0.6 THEN 'below_risk_threshold' WHEN days_since_clean < 30 THEN 'below_age_threshold'
        WHEN total_rain_mm >= 5 THEN 'deferred_due_to_rain' ELSE 'weather_window_open' END AS rule_fired FROM ba),
    dec AS (SELECT aoi_id, rule_fired, CASE WHEN rule_fired = 'weather_window_open' THEN today + 1 END AS window_start,
        CASE WHEN rule_fired = 'weather_window_open' THEN today + CASE WHEN dry_end_day > 1 THEN CAST(dry_end_day AS INT) ELSE 7 END END AS window_end,
        CASE WHEN aoi_risk < 0.5 THEN 'low' WHEN aoi_risk < 0.75 THEN 'medium' ELSE 'high' END AS confidence,
        aoi_risk, n_arrays, days_since_clean, total_rain_mm, last_cleaned, today FROM ru)"""
ARRAYS = DECIDE + """, sc AS (SELECT array_id, aoi_id, COALESCE(risk_score, 0) AS s FROM f_risk),
    ac AS (SELECT sc.*, d.window_start, d.window_end, COALESCE(d.rule_fired = 'weather_window_open' AND s >= 0.6, FALSE) AS act
      FROM sc LEFT JOIN dec d USING (aoi_id)),
    rec AS (SELECT aoi_id, array_id, """ + round_binary_sql("s", 3) + """ AS risk_score,
        CASE WHEN act THEN CONCAT(CAST(window_start AS VARCHAR), ' → ', CAST(window_end AS VARCHAR)) END AS cleaning_window,
        CASE WHEN act THEN CASE WHEN s >= 0.75 THEN 'high' ELSE 'medium' END WHEN s < 0.5 THEN 'low' ELSE 'medium' END AS priority,
        CASE WHEN act THEN 'clean' ELSE 'monitor' END AS action,
        CASE WHEN act THEN CASE WHEN s < 0.5 THEN '2-5' WHEN s < 0.75 THEN '5-12' ELSE '10-20' END END AS recovery FROM ac)"""


def _range_text(df):
    """Array column as text, so both engines print the same thing."""
    pair = F.col("expected_recovery_pct")
    text = F.concat_ws("-", pair[0].cast("int").cast("string"), pair[1].cast("int").cast("string"))
    return df.withColumn("recovery", F.when(pair.isNotNull(), text)).drop("expected_recovery_pct")


@query("a07_area_risk", f"WITH {AREA} SELECT * FROM ar", "aoi_risk")
def a07(t):
    return R.area_risk(t.f_risk)


@query("a23_score_stats", """SELECT AVG(risk_score) AS mean, QUANTILE_CONT(risk_score, 0.9) AS p90, MAX(risk_score) AS max
    FROM f_risk WHERE risk_score IS NOT NULL""", "mean, p90, max")
def a23(t):
    from panelspark.operators.stats import score_stats
    return score_stats(t.f_risk, "risk_score")


@query("w11_longest_dry_run", f"WITH {DRY} SELECT * FROM de")
def w11(t):
    return D.longest_dry_run(t.f_forecast, ["aoi_id"], "day_no", "rain_mm", F.lit(5.0 / 7))


@query("p08_risk_buckets", """SELECT array_id, CASE WHEN risk_score < 0.5 THEN 'low' WHEN risk_score < 0.75 THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN risk_score < 0.5 THEN '2-5' WHEN risk_score < 0.75 THEN '5-12' ELSE '10-20' END AS recovery
    FROM f_risk WHERE risk_score IS NOT NULL""")
def p08(t):
    rows = t.f_risk.where(F.col("risk_score").isNotNull())
    return _range_text(rows.select("array_id", R.risk_bucket(F.col("risk_score")).alias("confidence"),
                                   R.recovery_range(F.col("risk_score")).alias("expected_recovery_pct")))


@query("d01_recommend_areas", DECIDE + """ SELECT *, CASE confidence WHEN 'low' THEN '2-5' WHEN 'medium' THEN '5-12' ELSE '10-20' END AS recovery FROM dec""",
       "aoi_risk, total_rain_mm")
def d01(t):
    return _range_text(decisions(t))


@query("d02_recommend_arrays", ARRAYS + " SELECT * FROM rec", "risk_score")
def d02(t):
    return _range_text(R.recommend_arrays(t.f_risk, decisions(t)))


@query("o01_ordered_recommendations", ARRAYS + " SELECT array_id, action, risk_score FROM rec ORDER BY action <> 'clean', risk_score DESC, array_id",
       "risk_score")
def o01(t):
    return R.ordered(R.recommend_arrays(t.f_risk, decisions(t))).select("array_id", "action", "risk_score")


@query("a32_actionable_count", ARRAYS + " SELECT aoi_id, COUNT(*) FILTER (WHERE action = 'clean') AS n_clean, COUNT(*) AS n_total FROM rec GROUP BY 1")
def a32(t):
    return R.actionable(R.recommend_arrays(t.f_risk, decisions(t)), "aoi_id")


@query("j02_arrays_with_scores", "SELECT r.array_id, r.minx, r.miny, k.risk_score FROM f_rect r LEFT JOIN (SELECT * FROM f_risk WHERE array_id % 7 <> 0) k USING (array_id)",
       "risk_score")
def j02(t):
    scores = t.f_risk.where(F.col("array_id") % 7 != 0).select("array_id", "risk_score")
    return t.f_rect.select("array_id", "minx", "miny").join(scores, "array_id", "left")


@query("j19_arrays_with_recommendations", ARRAYS + """ SELECT r.array_id, COALESCE(k.priority, '—') AS priority, COALESCE(k.action, '—') AS action,
      COALESCE(k.cleaning_window, '—') AS cleaning_window FROM f_rect r LEFT JOIN (SELECT * FROM rec WHERE array_id % 5 <> 0) k USING (array_id)""")
def j19(t):
    recs = R.recommend_arrays(t.f_risk, decisions(t)).where(F.col("array_id") % 5 != 0)
    return R.with_recommendations(t.f_rect.select("array_id"), recs)


def flagship(spark, sf_dir):
    """Daily series -> recurrence -> risk per station -> area risk -> decision per area."""
    t = Tables(spark, sf_dir)
    at = t.f_station.select("station_id", F.to_date(F.lit("2000-06-30")).alias("as_of"))
    scored = P.score_series(D.days_in_lookback(at, t.f_daily, 365, inclusive=False), ["station_id", "as_of"])
    home = t.supplier.select(F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("aoi_id"))
    scores = scored.join(home, "station_id").select("aoi_id", "station_id", "risk_score")
    return R.recommend_areas(scores, t.f_forecast, areas(t), F.to_date(F.lit(TODAY))).orderBy("aoi_id")


@query("flagship_soiling_decision")
def flagship_query(t):
    return _range_text(flagship(t.spark, t.sf_dir))
