"""Risk model: cross-validation, calibration, scoring, persistence."""

import pytest
from pyspark.sql import functions as F

from panelspark.config import Boosting, SampleWeights, SpatialCv
from panelspark.operators import labels as L
from panelspark.operators import model as M

CFG = Boosting(n_trees=5, max_depth=3)
FEATURES = ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    df = spark.range(240).select(
        k.cast("string").alias("station_id"), (F.lit(33.0) + (k % 10)).alias("latitude"), (F.lit(-120.0) + (k % 8)).alias("longitude"),
        (F.rand(1) + (k % 2) * 0.6).alias("f1"), F.rand(2).alias("f2"), F.when(k % 9 == 0, F.lit(None)).otherwise(F.rand(3)).alias("f3"),
        (k % 2).cast("int").alias("label"), (F.lit(0.99) - (k % 2) * 0.05).alias("iwsr"), (F.lit(2018) + k % 4).cast("int").alias("year"))
    return df.persist()


def test_binary_with_calibrator(spark, rows, tmp_path):
    model = M.train_risk_model(rows, FEATURES, cv=SpatialCv(3, 120.0), cfg=CFG)
    assert model.metrics["n_folds"] == 3 and len(model.metrics["fold_aucs"]) == 3 and model.metrics["mean_auc"] > 0.6
    assert model.calibrator is not None
    scored = M.predict_risk(model, rows)
    lo, hi = scored.agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 0.0 <= lo <= hi <= 1.0
    raw = M.predict_risk(model, rows, calibrated=False, out="raw_score").select("station_id", "raw_score")
    pairs = scored.join(raw, "station_id").orderBy("raw_score").select("risk_score").collect()
    assert all(a["risk_score"] <= b["risk_score"] + 1e-12 for a, b in zip(pairs, pairs[1:]))
    M.save_model(model, str(tmp_path / "m"))
    again = M.predict_risk(M.load_model(str(tmp_path / "m"), spark), rows)
    assert again.join(scored.withColumnRenamed("risk_score", "s"), "station_id").where("abs(risk_score - s) > 1e-12").count() == 0
    # A feature column the scoring table lacks takes its training median.
    assert M.predict_risk(model, rows.drop("f2")).where("risk_score IS NULL").count() == 0


def test_regression(rows):
    model = M.train_risk_model(rows, FEATURES, "regression", SpatialCv(3, 120.0), CFG)
    assert len(model.metrics["fold_spearmans"]) == 3 and model.target_mode == "regression"
    plain = M.predict_risk(model, rows, threshold=0.97, calibrated=False)
    assert plain.where("risk_score < 0 OR risk_score > 1 OR risk_score IS NULL").count() == 0
    with pytest.raises(ValueError):
        M.train_risk_model(rows, FEATURES, "ranking")


def test_single_cluster_skips_cross_validation(rows):
    one = rows.withColumn("latitude", F.lit(36.0)).withColumn("longitude", F.lit(-120.0))
    assert M.cross_validate(one, FEATURES, cv=SpatialCv(3, 120.0), cfg=CFG) is None


def test_folds_are_disjoint(rows):
    oof = M.cross_validate(rows, FEATURES, cv=SpatialCv(3, 120.0), cfg=CFG)
    assert oof.count() == rows.count() and oof.groupBy("cluster").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0


def test_impute_literal(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a DOUBLE, b DOUBLE")
    got = [tuple(r) for r in M.impute(df, ["a", "b"], {"a": 2.5, "b": 7.0}).collect()]
    assert got == [(1.0, 7.0), (2.5, 7.0)]
    assert [tuple(r) for r in M.impute(df, ["a", "b"], {}).collect()] == [(1.0, 0.0), (1.0, 0.0)]


def test_holdout_and_importance(spark, rows):
    held = M.temporal_holdout(rows, FEATURES, 2020, cfg=CFG).first()
    assert held["n_pos"] + held["n_neg"] == rows.where("year = 2020").count()
    model = M.train_risk_model(rows, FEATURES, cv=None, cfg=CFG)
    top = M.feature_importance(model, spark).where("part = 'top'").orderBy("place").collect()
    assert top[0]["feature"] == "f1" and sum(r["importance"] for r in top) == pytest.approx(1.0)


def test_uniform_weights(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, None)], "id INT, is_summary BOOLEAN, is_feedback BOOLEAN")
    assert {r["id"]: r["weight"] for r in L.sample_weights(df).collect()} == {1: 0.5, 2: 3.0, 3: 1.0}
    with pytest.raises(ValueError):
        L.sample_weights(df, SampleWeights(mode="other"))


def test_background_limit_keeps_all_without_labels(spark):
    df = spark.range(50).withColumn("has_labels", F.lit(False))
    assert L.limit_background(df, "id", 0.3).count() == 50
