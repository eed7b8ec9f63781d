"""Queries: label tables, weights, folds, splits, calibration, model."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import SCORING, Boosting, Features, SampleWeights, SpatialCv
from panelspark.functions import geo as G
from panelspark.operators import daily as D
from panelspark.operators import features as X
from panelspark.operators import labels as L
from panelspark.operators import model as M
from panelspark.operators import physics as P
from panelspark.operators import spatial as SP
from panelspark.operators import stats as S
from panelspark.plans.daily import LABELS_SQL, W02_NAMES, W02_SPECS, _window_cols, eqd_sql, label_days, look
from panelspark.plans.registry import query

PANEL = "SELECT p.*, s.latitude, s.longitude FROM f_panel p JOIN f_station s ON s.station_id = p.station_id WHERE p.station_id % 4 <> 0"
SUMMARY = """SELECT s.station_id, s.latitude, s.longitude, CAST(90 + s.station_id % 10 AS DOUBLE) / 100 AS iwsr, s.station_id % 3 = 0 AS iwsr_censored, s.station_id % 40 AS tilt FROM f_station s"""
MERGED = f"""pa AS ({PANEL}), pk AS (SELECT * FROM pa WHERE NOT iwsr_censored),
    mg AS (SELECT station_id, latitude, longitude, iwsr, iwsr_lower, iwsr_upper, iwsr_censored, CAST(NULL AS BIGINT) AS tilt, year, MAKE_DATE(year, 12, 31) AS as_of, FALSE AS is_summary FROM pk
      UNION ALL SELECT station_id, latitude, longitude, iwsr, NULL, NULL, iwsr_censored, tilt, 2024, DATE '2024-03-01', TRUE FROM ({SUMMARY}) s WHERE station_id NOT IN (SELECT station_id FROM pk))"""


def merged(t):
    return L.merged_labels(t.sql(PANEL), t.sql(SUMMARY), F.to_date(F.lit("2024-03-01")), 0.95)


@query("p03_drop_censored", "SELECT station_id, year, iwsr FROM f_panel WHERE NOT iwsr_censored", "iwsr", digits=9)
def p03(t):
    return L.drop_censored(t.f_panel).select("station_id", "year", "iwsr")


@query("j07_summary_only_stations", f"""WITH {MERGED} SELECT station_id, as_of FROM mg WHERE is_summary""")
def j07(t):
    return merged(t).where("is_summary").select("station_id", "as_of")


@query("u01_merged_labels", f"WITH {MERGED} SELECT *, CAST(iwsr < 95e-2 AS INT) AS label FROM mg", "latitude, longitude, iwsr, iwsr_lower, iwsr_upper", digits=9)
def u01(t):
    return merged(t)


FB = "SELECT CAST(c_custkey AS BIGINT) AS station_id, CAST(c_custkey % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 170 AS DOUBLE) AS longitude, CAST(80 + c_custkey % 20 AS DOUBLE) / 100 AS iwsr, CAST(2020 + c_custkey % 4 AS INT) AS year FROM customer"


@query("u02_labels_with_feedback", f"""WITH {MERGED} SELECT station_id, iwsr, year, is_summary, FALSE AS is_feedback FROM mg
    UNION ALL SELECT station_id, iwsr, year, NULL, TRUE FROM ({FB}) f""", "iwsr", digits=9)
def u02(t):
    fb = t.sql(FB).withColumn("is_feedback", F.lit(True))
    return L.with_feedback(merged(t), fb).select("station_id", "iwsr", "year", "is_summary", "is_feedback")


@query("a16_label_distribution", f"WITH {MERGED} SELECT CAST(iwsr < 95e-2 AS INT) AS label, COUNT(*) AS n, COUNT(DISTINCT station_id) AS stations FROM mg GROUP BY 1")
def a16(t):
    return L.label_distribution(merged(t))


@query("a33_ingest_profile", """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE iwsr_censored) AS n_censored, COUNT(DISTINCT station_id) AS n_stations, MIN(year) AS min_year, MAX(year) AS max_year,
    (SELECT STRING_AGG(n, ',' ORDER BY n) FROM (SELECT DISTINCT n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN f_panel ON station_id = s_suppkey) z) AS states FROM f_panel""")
def a33(t):
    home = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("station_id"), F.col("n_name").alias("state"))
    return L.ingest_profile(t.f_panel.join(home, "station_id")).withColumn("states", F.array_join("states", ","))


@query("a25_first_station", "SELECT l_suppkey AS station_id, ARG_MIN(l_partkey, ROW(l_orderkey, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def a25(t):
    df = t.lineitem.select(F.col("l_suppkey").alias("station_id"), "l_partkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"))
    return L.first_per_key(df, ["station_id"], "o").select("station_id", "l_partkey")


@query("m08_sample_weights", f"""WITH {MERGED}, a AS (SELECT station_id, year, is_summary, iwsr_lower, iwsr_upper, FALSE AS is_feedback FROM mg UNION ALL SELECT station_id, year, NULL, NULL, NULL, TRUE FROM ({FB}) f),
    w AS (SELECT *, CASE WHEN iwsr_upper - iwsr_lower > 0 THEN iwsr_upper - iwsr_lower END AS wd FROM a), m AS (SELECT MEDIAN(wd) AS md FROM w),
    r AS (SELECT *, 1e0 / GREATEST(COALESCE(wd, md, 1e-2), 1e-3) AS raw FROM w CROSS JOIN m), q AS (SELECT QUANTILE_CONT(raw, 0.05) AS lo, QUANTILE_CONT(raw, 0.95) AS hi FROM r)
    SELECT station_id, year, is_feedback, GREATEST(lo, LEAST(hi, raw)) * CASE WHEN is_summary THEN 5e-1 ELSE 1e0 END * CASE WHEN is_feedback THEN 3e0 ELSE 1e0 END AS weight FROM r CROSS JOIN q""", "weight")
def m08(t):
    fb = t.sql(FB).withColumn("is_feedback", F.lit(True))
    df = L.with_feedback(merged(t), fb).select("station_id", "year", "is_summary", "iwsr_lower", "iwsr_upper", "is_feedback")
    return L.sample_weights(df, SampleWeights(mode="iwsr_ci_width")).select("station_id", "year", "is_feedback", "weight")


M11_BASE = f"""SELECT l.station_id, l.as_of, {_window_cols(W02_SPECS)} FROM ({LABELS_SQL}) l
    JOIN f_daily d ON d.station_id = l.station_id AND d.dt BETWEEN l.as_of - 364 AND l.as_of GROUP BY 1, 2"""


@query("m11_training_matrix", f"""WITH f AS ({M11_BASE})
    SELECT p.station_id, p.year, f.as_of, p.iwsr, CAST(EXTRACT(MONTH FROM f.as_of) AS INT) AS month_of_year, st.elevation_m, {W02_NAMES},
      CASE WHEN m = 'fixed' THEN 1e0 ELSE 0e0 END AS mounting_fixed, CASE WHEN m IS NULL THEN 1e0 ELSE 0e0 END AS mounting_unknown
    FROM (SELECT *, CASE WHEN station_id % 3 = 0 THEN 'fixed' WHEN station_id % 3 = 1 THEN 'tracker' END AS m FROM f_panel) p JOIN f ON f.station_id = p.station_id AND f.as_of = MAKE_DATE(p.year, 12, 31)
    LEFT JOIN (SELECT s_suppkey AS station_id, s_acctbal AS elevation_m FROM supplier WHERE s_suppkey % 5 <> 0) st ON st.station_id = p.station_id""",
       f"iwsr, elevation_m, {W02_NAMES}, mounting_fixed, mounting_unknown")
def m11(t):
    sid = F.col("station_id")
    lab = t.f_panel.select("station_id", "year", "iwsr", D.year_end(F.col("year")).alias("as_of"),
                           F.when(sid % 3 == 0, "fixed").when(sid % 3 == 1, "tracker").alias("mounting"))
    static = t.supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("station_id"), F.col("s_acctbal").alias("elevation_m"))
    out = X.training_matrix(lab, t.f_daily, static, cfg=Features(), categorical={"mounting": ["fixed", "tracker", "unknown"]})
    return out.select("station_id", "year", "as_of", "iwsr", "month_of_year", "elevation_m", *W02_NAMES.split(", "), "mounting_fixed", "mounting_unknown")


#: Every array with one of all stations.
NEAREST = "SELECT array_id, array_id % (SELECT COUNT(*) FROM f_station) + 1 AS station_id FROM f_rect"
M12_COLS = [(c, w, a, o) for c, w, a, o in W02_SPECS if w == 30]


@query("m12_inference_matrix", f"""WITH f AS (SELECT l.station_id, {_window_cols(M12_COLS)} FROM (SELECT station_id, DATE '2000-06-30' AS as_of FROM f_station) l
      JOIN f_daily d ON d.station_id = l.station_id AND d.dt BETWEEN l.as_of - 179 AND l.as_of GROUP BY 1)
    SELECT r.array_id, r.station_id, {', '.join(o for _, _, _, o in M12_COLS)} FROM ({NEAREST}) r LEFT JOIN f ON f.station_id = r.station_id""", ", ".join(o for _, _, _, o in M12_COLS))
def m12(t):
    arrays = t.sql(NEAREST)
    return X.inference_matrix(arrays, t.f_daily, None, "2000-06-30").select("array_id", "station_id", *[o for _, _, _, o in M12_COLS])


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("p13_one_hot", f"""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 1e0 ELSE 0e0 END AS c_mktsegment_unknown,
    {', '.join(f"CASE WHEN c_custkey % 6 <> 0 AND c_mktsegment = '{s}' THEN 1e0 ELSE 0e0 END AS c_mktsegment_{s}" for s in SEGMENTS)} FROM customer""",
       ", ".join(f"c_mktsegment_{s}" for s in ("unknown", *SEGMENTS)))
def p13(t):
    df = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return X.one_hot(df, "c_mktsegment", X.categories(df, "c_mktsegment"))


CALIB = eqd_sql(look("pm10", 364), "station_id, as_of") + """, e AS (SELECT station_id, as_of, ARG_MAX(eqd, dt) AS eqd FROM r GROUP BY 1, 2),
    y AS (SELECT e.*, p.iwsr, CASE WHEN s.longitude < -120 THEN 'coastal' WHEN s.longitude > -116 OR (s.latitude < 34.5 AND s.longitude > -117.5) THEN 'desert' ELSE 'valley' END AS zone
      FROM e JOIN f_panel p ON p.station_id = e.station_id AND MAKE_DATE(p.year, 12, 31) = e.as_of JOIN f_station s ON s.station_id = e.station_id),
    g AS (SELECT CAST(k AS DOUBLE) AS k, CAST(s AS DOUBLE) AS sl_sat, ik * 7 + js AS ord FROM (SELECT UNNEST([5, 10, 20, 30, 45, 60, 90]) AS k, UNNEST(RANGE(0, 7)) AS ik) a
      CROSS JOIN (SELECT UNNEST([0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40]) AS s, UNNEST(RANGE(0, 7)) AS js) b),
    gm AS (SELECT zone, k, sl_sat, ord, COUNT(*) AS n, AVG(ABS(1e0 - sl_sat * (1e0 - EXP(-eqd / k)) - iwsr)) AS mae FROM y CROSS JOIN g GROUP BY GROUPING SETS ((k, sl_sat, ord), (zone, k, sl_sat, ord))
      HAVING zone IS NULL OR COUNT(*) >= 10)"""


def _calibration(t):
    measured = t.f_panel.join(t.f_station, "station_id").select(
        "station_id", D.year_end(F.col("year")).alias("as_of"), "iwsr", G.climate_zone(F.col("latitude"), F.col("longitude")).alias("zone"))
    return L.calibration_grid(label_days(t).select("station_id", "as_of", "dt", "precipitation_sum", "pm10"), measured, ["station_id", "as_of"])


@query("j18_a22_calibration_grid", CALIB + " SELECT zone, k, sl_sat, n, mae FROM gm", "k, sl_sat, mae")
def a22(t):
    return _calibration(t).select("zone", "k", "sl_sat", "n", "mae")


@query("m13_best_parameters", CALIB + " SELECT zone, n, k, sl_sat, mae FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone ORDER BY mae, ord) AS rn FROM gm) q WHERE rn = 1", "k, sl_sat, mae")
def m13(t):
    return L.best_parameters(_calibration(t))


CLUSTERED = """WITH RECURSIVE ml AS (SELECT AVG(s.latitude) AS ml FROM f_panel p JOIN f_station s ON s.station_id = p.station_id), b AS (SELECT p.station_id, p.year, p.iwsr, s.latitude, s.longitude,
      CAST(FLOOR(latitude * (1e0 / (1e0 / 111e0 * 1e2))) AS BIGINT) * 10000 + CAST(FLOOR(longitude * (1e0 / (1e0 / (111e0 * GREATEST(1e-1, COS(RADIANS(ml)))) * 1e2))) AS BIGINT) AS bin
      FROM f_panel p JOIN f_station s ON s.station_id = p.station_id CROSS JOIN ml),
    cl AS (SELECT *, DENSE_RANK() OVER (ORDER BY bin) - 1 AS cluster FROM b),
    sz AS MATERIALIZED (SELECT cluster, n, ROW_NUMBER() OVER (ORDER BY n DESC, cluster DESC) AS rn FROM (SELECT cluster, COUNT(*) AS n FROM cl GROUP BY 1) x),
    fo AS (SELECT CAST(0 AS BIGINT) AS rn, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS load, CAST(NULL AS BIGINT) AS fold, CAST(NULL AS BIGINT) AS cluster
      UNION ALL SELECT s.rn, LIST_TRANSFORM(fo.load, lambda v, i: CASE WHEN i = LIST_POSITION(fo.load, LIST_MIN(fo.load)) THEN v + s.n ELSE v END), LIST_POSITION(fo.load, LIST_MIN(fo.load)) - 1, s.cluster
      FROM fo JOIN sz s ON s.rn = fo.rn + 1),
    fd AS (SELECT cl.*, CAST(fo.fold AS INT) AS fold FROM cl JOIN fo ON fo.cluster = cl.cluster)"""


def folds(t):
    rows = t.f_panel.join(t.f_station, "station_id").select("station_id", "year", "iwsr", "latitude", "longitude")
    return L.assign_folds(SP.spatial_clusters(rows, 100.0))


@query("m02_grouped_folds", CLUSTERED + " SELECT station_id, year, cluster, fold FROM fd")
def m02(t):
    return folds(t).select("station_id", "year", "cluster", "fold")


@query("a21_fold_composition", CLUSTERED + """, l AS (SELECT *, CAST(iwsr < 95e-2 AS INT) AS label FROM fd),
    st AS (SELECT fold, station_id, COUNT(*) AS n FROM l GROUP BY 1, 2), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY n DESC, station_id) AS r FROM st),
    tp AS (SELECT fold, STRING_AGG(CONCAT(CAST(station_id AS VARCHAR), ':', CAST(n AS VARCHAR)), ',' ORDER BY r) AS top_stations FROM rk WHERE r <= 8 GROUP BY 1)
    SELECT l.fold, COUNT(*) AS n_rows, COUNT(DISTINCT station_id) AS n_stations, COUNT(DISTINCT cluster) AS n_clusters, AVG(label) AS pos_rate, MIN(latitude) AS lat_min, MAX(latitude) AS lat_max,
      MIN(longitude) AS lon_min, MAX(longitude) AS lon_max, ANY_VALUE(top_stations) AS top_stations FROM l JOIN tp ON tp.fold = l.fold GROUP BY 1""", "pos_rate, lat_min, lat_max, lon_min, lon_max")
def a21(t):
    return L.fold_composition(folds(t).withColumn("label", L.risk_label(F.col("iwsr"), 0.95)))


@query("m14_seeded_split_sizes", "SELECT 'train' AS split, CAST(FLOOR(COUNT(*) * 7e-1) AS BIGINT) AS n FROM orders UNION ALL SELECT 'val', CAST(FLOOR(COUNT(*) * 15e-2) AS BIGINT) FROM orders UNION ALL SELECT 'test', COUNT(*) - CAST(FLOOR(COUNT(*) * 7e-1) AS BIGINT) - CAST(FLOOR(COUNT(*) * 15e-2) AS BIGINT) FROM orders")
def m14(t):
    return L.seeded_split(t.orders.select("o_orderkey"), "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("m15_group_split_sizes", """WITH g AS (SELECT COUNT(DISTINCT o_custkey) AS k FROM orders) SELECT 'train' AS split, CAST(FLOOR(k * 7e-1) AS BIGINT) AS n_groups, CAST(1 AS BIGINT) AS splits_per_group FROM g
    UNION ALL SELECT 'val', CAST(FLOOR(k * 15e-2) AS BIGINT), 1 FROM g UNION ALL SELECT 'test', k - CAST(FLOOR(k * 7e-1) AS BIGINT) - CAST(FLOOR(k * 15e-2) AS BIGINT), 1 FROM g""")
def m15(t):
    rows = L.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")
    per = rows.groupBy("o_custkey").agg(F.count_distinct("split").alias("k"), F.min("split").alias("split"))
    return per.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.max("k").alias("splits_per_group"))


@query("m16_background_limit", """WITH c AS (SELECT COUNT(*) FILTER (WHERE o_orderkey % 5 = 0) AS p, COUNT(*) FILTER (WHERE o_orderkey % 5 <> 0) AS e FROM orders)
    SELECT TRUE AS has_labels, p AS n FROM c UNION ALL SELECT FALSE, LEAST(e, CAST(FLOOR(p * 4e-1 / 6e-1) AS BIGINT)) FROM c""")
def m16(t):
    tiles = t.orders.select("o_orderkey", (F.col("o_orderkey") % 5 == 0).alias("has_labels"))
    return L.limit_background(tiles, "o_orderkey", 0.4).groupBy("has_labels").agg(F.count(F.lit(1)).alias("n"))


@query("u05_nested_subsets", "SELECT LEAST(500, COUNT(*)) AS n_small, LEAST(1200, COUNT(*)) AS n_large, LEAST(500, COUNT(*)) AS n_shared FROM part")
def u05(t):
    small = L.nested_subset(t.part.select("p_partkey"), "p_partkey", 500).withColumn("s", F.lit(1))
    large = L.nested_subset(t.part.select("p_partkey"), "p_partkey", 1200).withColumn("l", F.lit(1))
    return small.join(large, "p_partkey", "full_outer").agg(F.count("s").alias("n_small"), F.count("l").alias("n_large"),
                                                            F.count(F.when(F.col("s") == F.col("l"), 1)).alias("n_shared"))


@query("p24_sparse_features", "SELECT station_id, dt, pm2_5 FROM f_daily", "pm2_5")
def p24(t):
    df = t.f_daily.select("station_id", "dt", "pm2_5", F.when(F.col("station_id") % 10 == 0, F.col("pm10")).alias("rare"))
    return L.drop_sparse(df, ["station_id", "dt"])


@query("m03_p21_impute", """WITH m AS (SELECT MEDIAN(precipitation_sum) AS a, MEDIAN(wind_speed_10m_max) AS b FROM f_daily WHERE EXTRACT(YEAR FROM dt) < 2000)
    SELECT station_id, dt, COALESCE(precipitation_sum, a) AS precipitation_sum, COALESCE(wind_speed_10m_max, b) AS wind_speed_10m_max, 3e0 AS never_seen FROM f_daily CROSS JOIN m WHERE EXTRACT(YEAR FROM dt) >= 2000""",
       "precipitation_sum, wind_speed_10m_max, never_seen")
def m03(t):
    names = ["precipitation_sum", "wind_speed_10m_max"]
    medians = {**S.median_map(t.f_daily.where(F.year("dt") < 2000), names), "never_seen": 3.0}
    test = t.f_daily.where(F.year("dt") >= 2000).select("station_id", "dt", *names)
    return M.impute(test, [*names, "never_seen"], medians)


@query("m17_acceptance_gates", """WITH m AS (SELECT n_nationkey, (600 + n_nationkey * 9) / 1e3 AS mean_auc, (n_nationkey * 3 - 60) / 1e2 AS spearman FROM nation)
    SELECT *, mean_auc >= 7e-1 AS auc_pass, CASE WHEN ABS(spearman) >= 4e-1 THEN 'PASS' ELSE 'BELOW_GATE' END AS validation_gate, NOT mean_auc >= 7e-1 AS beta FROM m""", "mean_auc, spearman")
def m17(t):
    k = F.col("n_nationkey")
    return L.acceptance_gates(t.nation.select("n_nationkey", ((600 + k * 9) / 1000.0).alias("mean_auc"), ((k * 3 - 60) / 100.0).alias("spearman")))


@query("w14_d03_ramp_steps", """WITH s AS (SELECT n_nationkey AS step, (570 - n_nationkey * 4) / 1e3 AS map50, (40 - n_nationkey) / 1e2 AS precision FROM nation)
    SELECT *, 563e-3 - map50 AS regression_delta, map50 - LAG(map50) OVER (ORDER BY step) AS step_delta, 563e-3 - map50 > 7e-2 AS halt,
      CASE WHEN 563e-3 - map50 > 7e-2 THEN 'halt' WHEN precision < 25e-2 THEN 'soft_halt' ELSE 'ok' END AS status FROM s""", "map50, precision, regression_delta, step_delta")
def w14(t):
    k = F.col("n_nationkey")
    return L.ramp_steps(t.nation.select(k.alias("step"), ((570 - k * 4) / 1000.0).alias("map50"), ((40 - k) / 100.0).alias("precision")))


# Model queries use a small forest so that a check run stays short; defaults are the full settings.
QUICK = Boosting(n_trees=5, max_depth=3)
MODEL_FEATURES = ["precip_30d_mm", "pm2_5_30d_mean", "wind_speed_10m_max_30d_mean", "dry_day_streak", "latitude"]


def matrix(t):
    lab = t.f_panel.join(t.f_station, "station_id").select(
        "station_id", "year", "iwsr", "latitude", "longitude", D.year_end(F.col("year")).alias("as_of"), L.risk_label(F.col("iwsr"), 0.95).alias("label"))
    return X.training_matrix(lab, t.f_daily, None, cfg=Features(use_kimber=False, use_equivalent_day=False))


@query("m04_m05_m06_m07_risk_scores")
def m04(t):
    rows = matrix(t).persist()
    model = M.train_risk_model(rows, MODEL_FEATURES, cv=SpatialCv(3, 100.0), cfg=QUICK)
    return M.predict_risk(model, rows).select("station_id", "year", "risk_score")


@query("m04_regression_scores")
def m04_regression(t):
    rows = matrix(t).persist()
    model = M.train_risk_model(rows, MODEL_FEATURES, "regression", cv=None, cfg=QUICK)
    return M.predict_risk(model, rows).select("station_id", "year", "risk_score")


@query("m09_temporal_holdout")
def m09(t):
    return M.temporal_holdout(matrix(t).persist(), MODEL_FEATURES, 1998, cfg=QUICK)


@query("o06_feature_importance")
def o06(t):
    model = M.train_risk_model(matrix(t).persist(), MODEL_FEATURES, cv=None, cfg=QUICK)
    return M.feature_importance(model, t.spark)


@query("m18_validate")
def m18(t):
    rows = matrix(t).persist()
    model = M.train_risk_model(rows.where("year < 1998"), MODEL_FEATURES, cv=None, cfg=QUICK)
    measured = rows.where("year >= 1998").withColumn("measured_iwsr", F.col("iwsr"))
    return M.validate(model, measured)[1]


@query("p02_p06_columns", "SELECT station_id, year, iwsr FROM f_panel", "iwsr", digits=9)
def p06(t):
    from panelspark.sources.scans import optional_columns, require_columns
    require_columns(t.f_panel.columns, ["station_id", "iwsr"])
    return optional_columns(t.f_panel, ["station_id", "tilt", "year", "iwsr"])


@query("s01_s02_panel_scan", "SELECT station_id, year, latitude FROM (SELECT p.station_id, p.year, s.latitude, s.longitude FROM f_panel p JOIN f_station s ON s.station_id = p.station_id) q WHERE longitude BETWEEN -122 AND -117 AND latitude BETWEEN 34 AND 40", "latitude")
def s01(t):
    rows = t.f_panel.join(t.f_station, "station_id")
    return SP.in_box(rows, (-122.0, 34.0, -117.0, 40.0)).select("station_id", "year", "latitude")


@query("w10_score_arrays_m12_chain")
def score_chain(t):
    """Arrays to sites to physics score, one score per distinct site."""
    sites = t.sql(NEAREST)
    at = sites.select("station_id").distinct().withColumn("as_of", F.to_date(F.lit("2000-06-30")))
    scored = P.score_series(D.days_in_lookback(at, t.f_daily, 365, inclusive=False), ["station_id", "as_of"], SCORING)
    return sites.join(scored.drop("as_of"), "station_id", "left")


