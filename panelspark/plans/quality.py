"""Queries: dataset audits, pairing, strata, disagreement, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import geo as G
from panelspark.functions import names as N
from panelspark.operators import joins as J
from panelspark.operators import lineage as LN
from panelspark.operators import quality as Q
from panelspark.plans.registry import query

SPLIT = "CASE WHEN {k} % 10 < 7 THEN 'train' WHEN {k} % 10 < 9 THEN 'val' ELSE 'test' END"
IMAGES = f"""SELECT {SPLIT.format(k='o_orderkey')} AS split, CONCAT('tile_', CAST(o_orderkey AS STRING)) AS stem, CAST(o_orderkey * 7 % 256 AS DOUBLE) AS brightness
    FROM orders WHERE o_orderkey % 11 <> 0
    UNION ALL SELECT 'val' AS split, CONCAT('tile_', CAST(o_orderkey AS STRING)) AS stem, CAST(100 AS DOUBLE) AS brightness FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 10 < 7"""
FILES = f"SELECT {SPLIT.format(k='o_orderkey')} AS split, CONCAT('tile_', CAST(o_orderkey AS STRING)) AS stem FROM orders WHERE o_orderkey % 13 <> 0"
# Tokens of a label line: one of five kinds by line number, so each verdict occurs.
LINES = f"""SELECT {SPLIT.format(k='tile_id')} AS split, CONCAT('tile_', CAST(tile_id AS STRING)) AS stem, line_no,
    CASE WHEN line_no = 5 THEN REPLACE(line, ' 0.', ' 1.') WHEN tile_id % 29 = 0 THEN '0 0.500 0.500 0.510 0.500 0.510 0.510' ELSE line END AS line FROM f_line WHERE tile_id % 13 <> 0"""
# Literal reading of a line in DuckDB: tokens, numbers, axes.
PARSED = f"""l0 AS ({LINES}), l1 AS (SELECT *, STRING_SPLIT(line, ' ') AS tok FROM l0), l2 AS (SELECT *, LIST_TRANSFORM(tok[2:], lambda v: TRY_CAST(v AS DOUBLE)) AS num FROM l1),
    l3 AS (SELECT *, LEN(tok) AS n, LEN(LIST_FILTER(num, lambda v: v IS NULL)) > 0 AS bad, LEN(LIST_FILTER(num, lambda v: v < 0 OR v > 1)) AS n_out,
      LIST_MAX(LIST_FILTER(num, lambda v, i: i % 2 = 1)) - LIST_MIN(LIST_FILTER(num, lambda v, i: i % 2 = 1)) AS w,
      LIST_MAX(LIST_FILTER(num, lambda v, i: i % 2 = 0)) - LIST_MIN(LIST_FILTER(num, lambda v, i: i % 2 = 0)) AS h FROM l2)"""


@query("f24_line_size", f"WITH {PARSED} SELECT split, stem, line_no, CASE WHEN bad OR n < 5 THEN 0 ELSE GREATEST(w, h) * 640 END AS size_px FROM l3", "size_px")
def f24(t):
    return Q.line_size_px(t.sql(LINES)).select("split", "stem", "line_no", "size_px")


@query("p23_range_violations", f"WITH {PARSED} SELECT split, stem, line_no, w, h, CAST(n_out AS INT) AS n_violations, w > 85e-2 OR h > 85e-2 AS oversize FROM l3 WHERE n >= 7 AND NOT bad", "w, h")
def p23(t):
    return Q.range_violations(t.sql(LINES)).drop("line")


CLEAN = f"""WITH {PARSED}, i AS ({IMAGES}), s AS (SELECT split, stem, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE CASE WHEN bad OR n < 5 THEN 0 ELSE GREATEST(w, h) * 640 END >= 16) AS n_large FROM l3 GROUP BY 1, 2),
    st AS (SELECT i.split, i.stem, CASE WHEN brightness < 15 THEN 'removed_dark' WHEN n_lines IS NULL THEN 'removed_no_label' WHEN n_large = 0 THEN 'removed_all_tiny'
      WHEN n_large < n_lines THEN 'pruned' ELSE 'kept' END AS status FROM i LEFT JOIN s ON s.split = i.split AND s.stem = i.stem)"""


@query("p16_clean_dataset", CLEAN + " SELECT * FROM st")
def p16(t):
    return Q.clean_dataset(t.sql(IMAGES), t.sql(LINES))


@query("p16_cleaning_counts", CLEAN + """ SELECT split, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'removed_dark') AS removed_dark,
    COUNT(*) FILTER (WHERE status = 'removed_no_label') AS removed_no_label, COUNT(*) FILTER (WHERE status = 'removed_all_tiny') AS removed_all_tiny,
    COUNT(*) FILTER (WHERE status = 'pruned') AS pruned_labels, COUNT(*) FILTER (WHERE status IN ('kept', 'pruned')) AS kept FROM st GROUP BY 1""")
def p16_counts(t):
    return Q.cleaning_counts(Q.clean_dataset(t.sql(IMAGES), t.sql(LINES)))


PAIRS = f"""i AS (SELECT DISTINCT split, stem FROM ({IMAGES}) a), f AS ({FILES}),
    pr AS (SELECT COALESCE(i.split, f.split) AS split, COALESCE(i.stem, f.stem) AS stem, CASE WHEN i.stem IS NULL THEN 'orphan_label' WHEN f.stem IS NULL THEN 'missing_label' ELSE 'paired' END AS status
      FROM i FULL OUTER JOIN f ON f.split = i.split AND f.stem = i.stem)"""


@query("j08_pair_files", f"WITH {PAIRS} SELECT * FROM pr")
def j08(t):
    return Q.pair_files(t.sql(IMAGES), t.sql(FILES))


LEAK = f"""SELECT a.split AS a, b.split AS b, COUNT(*) AS overlap FROM (SELECT DISTINCT split, stem FROM ({IMAGES}) x) a
    JOIN (SELECT DISTINCT split, stem FROM ({IMAGES}) y) b ON a.stem = b.stem AND a.split < b.split GROUP BY 1, 2"""


@query("j09_split_leakage", LEAK)
def j09(t):
    return Q.split_leakage(t.sql(IMAGES))


AUDIT = f"""WITH {PARSED}, {PAIRS},
    v AS (SELECT split, stem, TRY_CAST(tok[1] AS DOUBLE) AS c, n < 7 OR bad OR (n - 1) % 2 <> 0 AS fatal, n_out FROM l3),
    pf AS (SELECT split, stem, COUNT(*) FILTER (WHERE NOT fatal) AS obj, COUNT(*) FILTER (WHERE fatal OR n_out > 0) AS iss FROM v GROUP BY 1, 2),
    fl AS (SELECT f.split, COUNT(*) AS labels, CAST(SUM(COALESCE(obj, 0)) AS BIGINT) AS objects, COUNT(*) FILTER (WHERE COALESCE(obj, 0) = 0) AS empty_labels, CAST(SUM(COALESCE(iss, 0)) AS BIGINT) AS format_issues
      FROM f LEFT JOIN pf ON pf.split = f.split AND pf.stem = f.stem GROUP BY 1),
    pc AS (SELECT split, COUNT(*) FILTER (WHERE status <> 'orphan_label') AS images, COUNT(*) FILTER (WHERE status = 'missing_label') AS missing_labels, COUNT(*) FILTER (WHERE status = 'orphan_label') AS orphan_labels FROM pr GROUP BY 1),
    au AS (SELECT pc.split, images, labels, objects, empty_labels, empty_labels * 1e0 / labels AS empty_label_ratio, missing_labels, orphan_labels, format_issues FROM pc JOIN fl USING (split))"""


def report(t):
    return Q.audit(t.sql(IMAGES), t.sql(FILES), t.sql(LINES))


@query("a11_dataset_audit", AUDIT + " SELECT * FROM au", "empty_label_ratio")
def a11(t):
    return report(t)


@query("a11_class_counts", AUDIT + " SELECT split, CAST(c AS INT) AS class_id, COUNT(*) AS objects FROM v WHERE NOT fatal GROUP BY 1, 2")
def a11_classes(t):
    return Q.class_counts(t.sql(LINES))


@query("a12_audit_warnings", AUDIT + f""", m AS (SELECT *, CASE split WHEN 'train' THEN 40 WHEN 'val' THEN 5 WHEN 'test' THEN 5 ELSE 0 END AS need FROM au)
    SELECT split AS scope, 'too_few_images' AS warning FROM m WHERE images < need UNION ALL SELECT split, 'too_many_empty_labels' FROM m WHERE empty_label_ratio > 0.8
    UNION ALL SELECT split, 'missing_labels' FROM m WHERE missing_labels > 0 UNION ALL SELECT split, 'orphan_labels' FROM m WHERE orphan_labels > 0
    UNION ALL SELECT split, 'format_issues' FROM m WHERE format_issues > 0 UNION ALL SELECT CONCAT(a, '/', b), 'split_leakage' FROM ({LEAK}) k
    UNION ALL SELECT 'all', 'class_balance' WHERE (SELECT COUNT(*) FROM m WHERE objects > 0) < 2""")
def a12(t):
    return Q.audit_warnings(report(t), Q.split_leakage(t.sql(IMAGES)))


@query("a13_size_stats", f"""WITH {PARSED}, g AS (SELECT * FROM l3 WHERE n >= 7 AND NOT bad), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY w) - 1 AS iw,
      ROW_NUMBER() OVER (PARTITION BY split ORDER BY h) - 1 AS ih, COUNT(*) OVER (PARTITION BY split) AS k FROM g)
    SELECT split, COUNT(*) AS total_objects, CAST(SUM(n_out) AS BIGINT) AS violations, COUNT(*) FILTER (WHERE w > 85e-2 OR h > 85e-2) AS large_objects, MEDIAN(w) AS median_w, MEDIAN(h) AS median_h,
      MAX(CASE WHEN iw = CAST(FLOOR(k * 95e-2) AS BIGINT) THEN w END) AS p95_w, MAX(CASE WHEN ih = CAST(FLOOR(k * 95e-2) AS BIGINT) THEN h END) AS p95_h FROM r GROUP BY 1""",
       "median_w, median_h, p95_w, p95_h", digits=9)
def a13(t):
    return Q.size_stats(t.sql(LINES))


TILES = f"""SELECT {SPLIT.format(k='o_orderkey')} AS split, CONCAT('tile_', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '.png' ELSE '_png.rf.a1B2.jpg' END) AS name,
    o_custkey % 9 AS objects FROM orders"""
INDEX = """SELECT CONCAT('tile_', CAST(o_orderkey AS STRING), '.png') AS tile_name, CASE WHEN o_orderkey % 6 = 1 THEN 'other.tif'
    ELSE CONCAT('naip_', CASE WHEN o_orderkey % 2 = 0 THEN 'sc' ELSE 'kern' END, '_', CAST(2016 + o_orderkey % 4 AS STRING), '_512_1.tif') END AS source FROM orders WHERE o_orderkey % 10 <> 4"""


@query("j05_canonical_join", f"""SELECT t.name, i.source FROM ({TILES}) t LEFT JOIN ({INDEX}) i
    ON i.tile_name = CONCAT(REPLACE(REPLACE(t.name, '_png.rf.a1B2.jpg', ''), '.png', ''), '.png')""")
def j05(t):
    return Q.canonical_join(t.sql(TILES), t.sql(INDEX)).select("name", "source")


@query("a14_strata", f"""WITH j AS (SELECT t.*, i.source, i.tile_name IS NOT NULL AS hit FROM ({TILES}) t LEFT JOIN ({INDEX}) i
      ON i.tile_name = CONCAT(REPLACE(REPLACE(t.name, '_png.rf.a1B2.jpg', ''), '.png', ''), '.png')),
    k AS (SELECT *, CASE WHEN source LIKE 'naip%' THEN SPLIT_PART(source, '_', 2) ELSE 'unknown' END AS region, CASE WHEN source LIKE 'naip%' THEN CAST(SPLIT_PART(source, '_', 3) AS INT) END AS vintage FROM j),
    g AS (SELECT split, region, vintage, COUNT(*) AS tiles, CAST(COALESCE(SUM(CASE WHEN hit THEN objects END), 0) AS BIGINT) AS objects, COUNT(*) FILTER (WHERE NOT hit) AS unmatched FROM k GROUP BY 1, 2, 3)
    SELECT *, 1e2 * tiles / SUM(tiles) OVER (PARTITION BY split) AS tile_pct_of_split, objects * 1e0 / tiles AS objs_per_tile FROM g""", "tile_pct_of_split, objs_per_tile")
def a14(t):
    return Q.strata(t.sql(TILES), t.sql(INDEX))


@query("a38_split_manifest", f"SELECT split, COUNT(*) AS tiles FROM ({TILES}) t GROUP BY ROLLUP (split)")
def a38(t):
    return Q.split_manifest(t.sql(TILES))


@query("p22_tile_index_errors", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'missing_key' WHEN 1 THEN 'bad_transform' WHEN 2 THEN 'bad_size' WHEN 3 THEN 'unusual_crs' WHEN 4 THEN 'bad_size,unusual_crs' ELSE '' END AS errors FROM orders""")
def p22(t):
    k = F.col("o_orderkey") % 6
    six, five = F.array(*[F.lit(1.0)] * 6), F.array(*[F.lit(1.0)] * 5)
    idx = t.orders.select("o_orderkey", F.when(k == 0, F.lit(None)).when(k == 1, five).otherwise(six).alias("transform"),
                          F.when(k.isin(3, 4), "local").otherwise("EPSG:32610").alias("crs"),
                          F.when(k.isin(2, 4), 0).otherwise(640).alias("width"), F.lit(640).alias("height"))
    return Q.tile_index_errors(idx).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("u03_merge_tile_indices", """SELECT name, ARG_MAX(v, src) AS v FROM (SELECT CONCAT('t', CAST(s_suppkey AS VARCHAR)) AS name, s_acctbal AS v, 0 AS src FROM supplier
    UNION ALL SELECT CONCAT('t', CAST(p_partkey AS VARCHAR)), p_retailprice, 1 FROM part) u GROUP BY 1""", "v", digits=2)
def u03(t):
    a = t.supplier.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("tile_name"), F.col("s_acctbal").alias("v"))
    b = t.part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("tile_name"), F.col("p_retailprice").alias("v"))
    return Q.merge_tile_indices([a, b], last_wins=True).withColumnRenamed("tile_name", "name")


@query("a26_triage", """SELECT o_orderkey AS tile_id, COUNT(p.conf) AS n_predictions, AVG(p.conf) AS mean_conf, MAX(p.conf) AS max_conf,
    CASE WHEN COUNT(p.conf) = 0 THEN 'skip' WHEN MIN(p.conf) >= 75e-2 THEN 'auto_accept' ELSE 'review' END AS recommended_action
    FROM orders o LEFT JOIN f_pred p ON p.tile_id = o.o_orderkey GROUP BY 1""", "mean_conf, max_conf")
def a26(t):
    return Q.triage(t.orders.select(F.col("o_orderkey").alias("tile_id")), t.f_pred)


def _rings(df, *keep):
    return df.select("tile_id", *keep, G.box_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("ring"))


PX = "CAST(CEIL({s}.x1 - 5e-1) AS BIGINT) AS a1, CAST(CEIL({s}.x2 - 5e-1) AS BIGINT) AS a2, CAST(CEIL({s}.y1 - 5e-1) AS BIGINT) AS b1, CAST(CEIL({s}.y2 - 5e-1) AS BIGINT) AS b2"
UNION_RUNS = """{n}r AS (SELECT DISTINCT tile_id, y, a1, a2 FROM (SELECT tile_id, a1, a2, UNNEST(RANGE(b1, b2)) AS y FROM {t}) q),
    {n}s AS (SELECT *, CASE WHEN MAX(a2) OVER (PARTITION BY tile_id, y ORDER BY a1, a2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a1 THEN 0 ELSE 1 END AS st FROM {n}r),
    {n}g AS (SELECT *, SUM(st) OVER (PARTITION BY tile_id, y ORDER BY a1, a2 ROWS UNBOUNDED PRECEDING) AS g FROM {n}s),
    {n}u AS (SELECT tile_id, y, MIN(a1) AS a1, MAX(a2) AS a2 FROM {n}g GROUP BY tile_id, y, g)"""
DIS = f"""WITH l AS (SELECT tile_id, gt_idx, {PX.format(s='g')} FROM f_gt g), p AS (SELECT tile_id, pred_idx, conf, {PX.format(s='p')} FROM f_pred p),
    sh AS (SELECT l.tile_id, l.gt_idx, p.pred_idx, GREATEST(0, LEAST(l.a2, p.a2) - GREATEST(l.a1, p.a1)) * GREATEST(0, LEAST(l.b2, p.b2) - GREATEST(l.b1, p.b1)) AS s,
      (l.a2 - l.a1) * (l.b2 - l.b1) AS la, (p.a2 - p.a1) * (p.b2 - p.b1) AS pa FROM l JOIN p ON p.tile_id = l.tile_id),
    be AS (SELECT tile_id, gt_idx, MAX(s * 1e0 / (la + pa - s)) AS best FROM sh WHERE s > 0 GROUP BY 1, 2),
    un AS (SELECT l.tile_id, COUNT(*) AS n_label_polys, COUNT(*) FILTER (WHERE COALESCE(best, 0) < 3e-1) AS label_polys_uncovered FROM l LEFT JOIN be ON be.tile_id = l.tile_id AND be.gt_idx = l.gt_idx GROUP BY 1),
    ot AS (SELECT p.tile_id, COUNT(*) AS n_pred, MAX(conf) AS max_pred_conf, COUNT(*) FILTER (WHERE conf >= 5e-1 AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.tile_id = p.tile_id AND sh.pred_idx = p.pred_idx AND s > 0)) AS confident_fps FROM p GROUP BY 1),
    {UNION_RUNS.format(n='l', t='l')}, {UNION_RUNS.format(n='p', t='p')},
    ar AS (SELECT tile_id, SUM(n) AS n, SUM(m) AS m FROM (SELECT tile_id, a2 - a1 AS n, 0 AS m FROM lu UNION ALL SELECT tile_id, 0, a2 - a1 FROM pu) z GROUP BY 1),
    ov AS (SELECT lu.tile_id, SUM(LEAST(lu.a2, pu.a2) - GREATEST(lu.a1, pu.a1)) AS s FROM lu JOIN pu ON pu.tile_id = lu.tile_id AND pu.y = lu.y AND pu.a1 < lu.a2 AND lu.a1 < pu.a2 GROUP BY 1),
    al AS (SELECT tile_id FROM un UNION SELECT tile_id FROM ot),
    di AS (SELECT al.tile_id, COALESCE(ov.s, 0) * 1e0 / (ar.n + ar.m - COALESCE(ov.s, 0)) AS overall_iou, COALESCE(n_label_polys, 0) AS n_label_polys, COALESCE(n_pred, 0) AS n_pred,
      COALESCE(confident_fps, 0) AS confident_fps, COALESCE(label_polys_uncovered, 0) AS label_polys_uncovered, COALESCE(max_pred_conf, 0) AS max_pred_conf, ar.n > 0 AS lab
      FROM al LEFT JOIN un ON un.tile_id = al.tile_id LEFT JOIN ot ON ot.tile_id = al.tile_id LEFT JOIN ar ON ar.tile_id = al.tile_id LEFT JOIN ov ON ov.tile_id = al.tile_id),
    db AS (SELECT * EXCLUDE (lab), CASE WHEN overall_iou >= 5e-1 AND confident_fps = 0 AND label_polys_uncovered = 0 THEN 'agree'
      WHEN confident_fps > 0 AND label_polys_uncovered = 0 AND NOT lab THEN 'confident_FP' WHEN label_polys_uncovered > 0 AND confident_fps = 0 THEN 'confident_FN'
      WHEN confident_fps > 0 AND label_polys_uncovered > 0 THEN 'both_directions' WHEN confident_fps > 0 AND lab THEN 'confident_FP' ELSE 'noisy' END AS bucket,
      confident_fps + label_polys_uncovered AS disagreement_score FROM di)"""


def disagreement(t):
    return Q.label_disagreement(_rings(t.f_gt, "gt_idx"), _rings(t.f_pred, "pred_idx", "conf"))


@query("j21_a27_label_disagreement", DIS + " SELECT * FROM db", "overall_iou, max_pred_conf")
def j21(t):
    return disagreement(t)


@query("a27_bucket_shares", DIS + " SELECT bucket, COUNT(*) AS n, 1e2 * COUNT(*) / SUM(COUNT(*)) OVER () AS pct FROM db GROUP BY 1", "pct")
def a27(t):
    return Q.bucket_shares(disagreement(t))


@query("o04_review_queue", DIS + """ SELECT tile_id, disagreement_score FROM db WHERE disagreement_score >= 1 AND tile_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    ORDER BY disagreement_score DESC, tile_id LIMIT 50""")
def o04(t):
    log = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tile_id"))
    return Q.review_queue(disagreement(t), log).select("tile_id", "disagreement_score")


LOG = """SELECT o_orderkey AS tile_id, CAST(o_orderdate AS DATE) AS ts, CASE o_orderkey % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'remove' WHEN 2 THEN 'remove_all' WHEN 3 THEN 'flag_for_reannotation' WHEN 4 THEN 'skip' ELSE 'remove' END AS action,
      CASE o_orderkey % 6 WHEN 1 THEN '1;3' WHEN 5 THEN '2' END AS removed_indices FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT o_orderkey AS tile_id, CAST('1980-01-01' AS DATE) AS ts, 'remove_all' AS action, CAST(NULL AS STRING) AS removed_indices FROM orders WHERE o_orderkey % 6 IN (0, 4)
    UNION ALL SELECT o_orderkey AS tile_id, CAST('1985-01-01' AS DATE) AS ts, 'remove' AS action, '2' AS removed_indices FROM orders WHERE o_orderkey % 6 IN (1, 3, 5)"""


@query("d05_replay_decisions", f"""WITH RECURSIVE lg AS ({LOG}), e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tile_id ORDER BY ts, action, removed_indices) AS rn FROM lg WHERE action <> 'skip'),
    st AS (SELECT tile_id, CAST(0 AS BIGINT) AS n, LIST(gt_idx ORDER BY gt_idx) AS l FROM f_gt GROUP BY tile_id UNION ALL
      SELECT st.tile_id, e.rn, CASE e.action WHEN 'remove_all' THEN l[1:0]
        WHEN 'remove' THEN LIST_FILTER(l, LAMBDA x, i: NOT LIST_CONTAINS(STRING_SPLIT(COALESCE(e.removed_indices, ''), ';'), CAST(i AS VARCHAR))) ELSE l END
      FROM st JOIN e ON e.tile_id = st.tile_id AND e.rn = st.n + 1),
    done AS (SELECT tile_id, ARG_MAX(l, n) AS l FROM st GROUP BY tile_id), la AS (SELECT tile_id, ARG_MAX(action, rn) AS action FROM e GROUP BY tile_id)
    SELECT d.tile_id, d.poly_no, COALESCE(la.action = 'flag_for_reannotation', FALSE) AS flagged
    FROM (SELECT tile_id, UNNEST(l) AS poly_no FROM done) d LEFT JOIN la ON la.tile_id = d.tile_id""")
def d05(t):
    return Q.replay_decisions(t.f_gt.select("tile_id", F.col("gt_idx").cast("int").alias("poly_no")), t.sql(LOG)).select(
        "tile_id", F.col("poly_no").cast("bigint").alias("poly_no"), "flagged")


META = "SELECT l_orderkey AS image_name, l_orderkey * 10 + l_linenumber AS polygon_id, l_linenumber AS line, l_returnflag AS city, l_quantity AS lat FROM lineitem"
FIRST = f"""SELECT image_name, COUNT(polygon_id) AS polygons, ARG_MIN(city, ROW(line, lat, city)) AS city, ARG_MIN(lat, ROW(line, lat, city)) AS lat FROM ({META}) m GROUP BY 1"""


def _images(t):
    m = t.sql(META).withColumn("o", F.struct("line", "lat", "city"))
    return Q.images_by_polygons(m, ["city", "lat"], "o", 2)


@query("a24_images_by_polygons", f"SELECT * FROM ({FIRST}) f WHERE polygons >= 2", "lat")
def a24(t):
    return _images(t)


@query("o05_top_images", f"SELECT image_name, polygons FROM ({FIRST}) f WHERE polygons >= 2 ORDER BY polygons DESC, image_name LIMIT 25")
def o05(t):
    return Q.top_images(_images(t), 25).select("image_name", "polygons")


@query("o07_first_per_split", f"""SELECT split, name FROM (SELECT split, name, ROW_NUMBER() OVER (PARTITION BY split ORDER BY name) AS rn FROM ({TILES}) t) q WHERE rn <= 12""")
def o07(t):
    return Q.first_per_split(t.sql(TILES), 12).select("split", "name")


@query("a34_cloud_fraction", """SELECT l_suppkey % 3 AS scene, CAST(FLOOR((l_partkey % 2000) / 640e0) AS BIGINT) AS tile_x, CAST(FLOOR((l_orderkey % 1500) / 640e0) AS BIGINT) AS tile_y,
    AVG(CASE WHEN l_linenumber = 1 OR l_discount > 8e-2 THEN 1e0 ELSE 0e0 END) AS cloud_fraction FROM lineitem GROUP BY 1, 2, 3""", "cloud_fraction")
def a34(t):
    px = t.lineitem.select((F.col("l_suppkey") % 3).alias("scene"), (F.col("l_partkey") % 2000).alias("x"), (F.col("l_orderkey") % 1500).alias("y"),
                           (F.col("l_linenumber") == 1).cast("int").alias("cloud"), (F.col("l_discount") > 0.08).cast("int").alias("shadow"))
    return Q.cloud_fraction(px, ["scene"])


@query("p15_pixel_area", """SELECT tile_id, gt_idx, (x2 - x1) * (y2 - y1) * CASE tile_id % 3 WHEN 0 THEN 6e-1 * 6e-1 WHEN 1 THEN 3e-1 * 3e-1 END AS area_m2 FROM f_gt""", "area_m2")
def p15(t):
    domain = F.when(F.col("tile_id") % 3 == 0, "a").when(F.col("tile_id") % 3 == 1, "b").otherwise("c")
    df = t.f_gt.select("tile_id", "gt_idx", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("px"), domain.alias("domain"))
    return Q.pixel_area_m2(df, "px", "domain", {"a": 0.6, "b": 0.3}).select("tile_id", "gt_idx", "area_m2")


@query("p12_land_cover", """SELECT p_partkey, CASE p_size * 10 WHEN 10 THEN 'tree' WHEN 20 THEN 'shrub' WHEN 30 THEN 'grass' WHEN 40 THEN 'cropland' WHEN 50 THEN 'built_up' WHEN 60 THEN 'bare' WHEN 70 THEN 'snow_ice'
      WHEN 80 THEN 'water' WHEN 90 THEN 'wetland' WHEN 100 THEN 'moss' ELSE 'unknown' END AS bucket, CASE p_size WHEN 4 THEN 1e0 ELSE 0e0 END AS worldcover_cropland, CASE p_size WHEN 6 THEN 1e0 ELSE 0e0 END AS worldcover_bare FROM part""",
       "worldcover_cropland, worldcover_bare")
def p12(t):
    df = t.part.select("p_partkey", J.cover_bucket((F.col("p_size") * 10).cast("int")).alias("bucket"))
    return df.select("*", *J.cover_one_hot(F.col("bucket"))).select("p_partkey", "bucket", "worldcover_cropland", "worldcover_bare")


PRED_FILES = "SELECT CONCAT('/p/', CASE WHEN o_orderkey % 4 = 0 THEN 'a/' ELSE 'b/' END, 'tile_', CAST(o_custkey AS STRING), '.txt') AS path FROM orders WHERE o_orderkey % 3 <> 0"
GT_FILES = "SELECT CONCAT('/g/tile_', CAST(c_custkey AS STRING), '.txt') AS path FROM customer WHERE c_custkey % 5 <> 0"


@query("j20_full_pairing", f"""SELECT COALESCE(p.token, g.token) AS token, pred_path, gt_path FROM
    (SELECT REGEXP_EXTRACT(path, 'tile_[0-9]+') AS token, MAX(path) AS pred_path FROM ({PRED_FILES}) a GROUP BY 1) p FULL OUTER JOIN
    (SELECT REGEXP_EXTRACT(path, 'tile_[0-9]+') AS token, MAX(path) AS gt_path FROM ({GT_FILES}) b GROUP BY 1) g ON g.token = p.token""")
def j20(t):
    with_token = lambda df: df.withColumn("token", N.tile_token(F.col("path")))
    return J.full_pairing(with_token(t.sql(PRED_FILES)), with_token(t.sql(GT_FILES)))


@query("a28_image_stats")
def a28(t):
    # Page bytes padded to whole 32-pixel BGR rows stand in for decoded images.
    size = F.ceil(F.length("html") / 96) * 96
    text = F.rpad(F.col("html"), size.cast("int"), F.lit(" "))
    img = F.struct((size / 96).cast("int").alias("height"), F.lit(32).alias("width"), F.lit(3).alias("nChannels"), F.encode(text, "ISO-8859-1").alias("data"))
    return LN.image_stats(t.pages.where(F.length("html") > 0).select(F.col("page_id").cast("string").alias("path"), img.alias("image")))


@query("f17_usable_rings", "SELECT array_id, array_id % 10 <> 0 AS usable FROM f_rect")
def f17(t):
    flat = F.when(F.col("array_id") % 10 == 0, F.col("miny")).otherwise(F.col("maxy"))
    return t.f_rect.select("array_id", G.is_usable(G.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), flat)).alias("usable"))


@query("f22_content_hash", "SELECT doc_id, SHA256(text) AS sha256 FROM documents")
def f22(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


# Input lists are short: at most fifty files each here.
@query("f22_inputs_hash", """SELECT lang, CAST(FLOOR(doc_id / 50) AS BIGINT) AS stage_no, SHA256(STRING_AGG(CONCAT(CAST(doc_id AS VARCHAR), CHR(0), SHA256(text), CHR(10)), '' ORDER BY doc_id)) AS inputs_hash FROM documents GROUP BY 1, 2""")
def f22_inputs(t):
    files = t.documents.select("lang", F.floor(F.col("doc_id") / 50).alias("stage_no"), F.col("doc_id").alias("path"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"))
    return LN.inputs_hash(files, ["lang", "stage_no"])


@query("l02_manifest_rollup", """SELECT CAST(CAST(FLOOR(o_orderkey / 8) AS BIGINT) AS VARCHAR) AS run_id, COUNT(*) AS n_stages, BOOL_OR(o_orderstatus <> 'F') AS beta,
    STRING_AGG(o_orderpriority, '|' ORDER BY o_orderdate, o_orderpriority) AS stages FROM orders GROUP BY 1""")
def l02(t):
    m = t.orders.select(F.floor(F.col("o_orderkey") / 8).cast("string").alias("run_id"), F.col("o_orderdate").alias("generated_at"), F.col("o_orderpriority").alias("stage"),
                        F.lit("v1").alias("model_version"), F.lit(None).cast("string").alias("inputs_hash"), (F.col("o_orderstatus") != "F").alias("beta"))
    return LN.rollup(m).select("run_id", "n_stages", "beta", F.array_join(F.transform("stages", lambda s: s["stage"]), "|").alias("stages"))
