"""Risk model on Spark ML: imputation, boosted trees, grouped cross-validation, calibration, scoring, persistence."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.config import Boosting, SpatialCv
from panelspark.functions.geo import climate_zone
from panelspark.operators import stats as S
from panelspark.operators.labels import assign_folds
from panelspark.operators.spatial import spatial_clusters
from panelspark.session import cut_lineage


@dataclass
class RiskModel:
    """Fitted trees with everything scoring needs."""

    trees: GBTClassificationModel | GBTRegressionModel
    features: list[str]
    medians: dict[str, float]
    target_mode: str = "binary"
    calibrator: IsotonicRegressionModel | None = None
    metrics: dict = field(default_factory=dict)


def impute(df: DataFrame, features: Sequence[str], medians: dict[str, float]) -> DataFrame:
    """M03 + P21: absent and missing features take the training median.

    A feature without a training median takes the median of this frame, and 0 when it is empty everywhere.
    """
    left = [f for f in features if f not in medians and f in df.columns]
    fill = {**(S.median_map(df, left) if left else {}), **medians}
    return df.select(
        *[c for c in df.columns if c not in features],
        *[F.coalesce(F.col(f).cast("double") if f in df.columns else F.lit(None), F.lit(fill.get(f, 0.0))).alias(f)
          for f in features])


def _fit(df: DataFrame, features: Sequence[str], target: str, mode: str, cfg: Boosting, weight: str | None):
    common = dict(featuresCol="_x", labelCol=target, maxIter=cfg.n_trees, maxDepth=cfg.max_depth, stepSize=cfg.learning_rate,
                  subsamplingRate=cfg.subsample, featureSubsetStrategy=cfg.column_sample, seed=cfg.seed)
    if weight:
        common["weightCol"] = weight
    learner = GBTClassifier(**common) if mode == "binary" else GBTRegressor(**common)
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    return learner.fit(ready)


def raw_scores(trees, df: DataFrame, features: Sequence[str], mode: str, out: str = "raw") -> DataFrame:
    """Higher is riskier: probability of the positive class, or minus the predicted ratio."""
    x = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    scored = trees.transform(x)
    score = vector_to_array("probability")[1] if mode == "binary" else -F.col("prediction")
    return scored.withColumn(out, score).select(*df.columns, out)


def cross_validate(df: DataFrame, features: Sequence[str], mode: str = "binary", target: str = "label",
                   cv: SpatialCv = SpatialCv(), cfg: Boosting = Boosting(), weight: str | None = None) -> DataFrame | None:
    """Out-of-fold scores by spatial cluster folds (M01, M02); None when there is a single cluster.

    Each fold imputes with its own training medians. Folds are fits over all rows of their complement, so nothing is
    collected; the scored parts are checkpointed as the folds finish.
    """
    placed = assign_folds(spatial_clusters(df, cv.cluster_km), "cluster", cv.n_folds)
    placed = cut_lineage(placed)
    n = placed.agg(F.count_distinct("fold")).first()[0]
    if n < 2:
        return None
    parts = None
    for fold in range(n):
        train, test = placed.where(F.col("fold") != fold), placed.where(F.col("fold") == fold)
        medians = S.median_map(train, features)
        trees = _fit(impute(train, features, medians), features, target if mode != "binary" else "label", mode, cfg, weight)
        scored = cut_lineage(raw_scores(trees, impute(test, features, medians), features, mode))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def fold_metrics(oof: DataFrame, mode: str = "binary") -> DataFrame:
    """Per fold AUC, average precision (null for single-class folds) and, for regression, Spearman."""
    auc = S.roc_auc(oof, "raw", "label", ["fold"])
    ap = S.average_precision(oof, "raw", "label", ["fold"])
    out = auc.join(ap, "fold").withColumn("average_precision", F.when(F.col("auc").isNotNull(), F.col("average_precision")))
    if mode == "regression":
        rho = S.spearman(oof.withColumn("_p", -F.col("raw")), "_p", "iwsr", ["fold"]).select("fold", "spearman")
        out = out.join(rho, "fold", "left")
    return out


def fit_calibrator(oof: DataFrame, score: str = "raw", y: str = "label") -> IsotonicRegressionModel:
    """Monotone map from out-of-fold score to observed rate."""
    valid = oof.where(F.col(score).isNotNull()).select(F.col(score).alias("_s"), F.col(y).cast("double").alias("_y"))
    return IsotonicRegression(featuresCol="_s", labelCol="_y", predictionCol="_c").fit(valid)


def train_risk_model(df: DataFrame, features: Sequence[str], mode: str = "binary", cv: SpatialCv | None = SpatialCv(),
                     cfg: Boosting = Boosting(), weight: str | None = None) -> RiskModel:
    """Optional spatial cross-validation and calibrator, then a fit on all rows."""
    if mode not in ("binary", "regression"):
        raise ValueError(f"target mode must be 'binary' or 'regression', got {mode!r}")
    target = "label" if mode == "binary" else "iwsr"
    metrics: dict = {}
    calibrator = None
    oof = cross_validate(df, features, mode, target, cv, cfg, weight) if cv else None
    if oof is not None:
        rows = fold_metrics(oof, mode).orderBy("fold").collect()
        aucs = [r["auc"] for r in rows if r["auc"] is not None]
        aps = [r["average_precision"] for r in rows if r["average_precision"] is not None]
        mean = lambda v: sum(v) / len(v) if v else None
        metrics = {"target_mode": mode, "n_folds": len(rows), "mean_auc": mean(aucs), "mean_ap": mean(aps), "fold_aucs": aucs}
        if mode == "regression":
            rhos = [r["spearman"] for r in rows if r["spearman"] is not None]
            if rhos:
                metrics.update(mean_spearman=mean(rhos), fold_spearmans=rhos)
        if oof.agg(F.count_distinct("label")).first()[0] > 1:
            calibrator = fit_calibrator(oof)
    medians = S.median_map(df, features)
    trees = _fit(impute(df, features, medians), features, target, mode, cfg, weight)
    return RiskModel(trees, list(features), medians, mode, calibrator, metrics)


def predict_risk(model: RiskModel, df: DataFrame, threshold: float = 0.97, out: str = "risk_score",
                 calibrated: bool = True) -> DataFrame:
    """Calibrated score, or the raw probability, or (threshold - predicted) / threshold; clipped to [0, 1]."""
    scored = raw_scores(model.trees, impute(df, model.features, model.medians), model.features, model.target_mode, "_raw")
    if calibrated and model.calibrator is not None:
        moved = model.calibrator.transform(scored.withColumn("_s", F.col("_raw")))
        score = F.col("_c")
    else:
        moved = scored
        score = F.col("_raw") if model.target_mode == "binary" else (F.lit(threshold) + F.col("_raw")) / F.lit(threshold)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    keep = [c for c in scored.columns if c != "_raw"]
    return moved.select(*keep, clipped.alias(out))


def temporal_holdout(df: DataFrame, features: Sequence[str], year: int, mode: str = "binary", cfg: Boosting = Boosting(),
                     weight: str | None = None) -> DataFrame:
    """Fit on the other years, score the held-out year with the training medians."""
    train, test = df.where(F.col("year") != year), df.where(F.col("year") == year)
    model = train_risk_model(train, features, mode, None, cfg, weight)
    scored = raw_scores(model.trees, impute(test, features, model.medians), list(features), mode)
    return S.roc_auc(scored, "raw", "label").crossJoin(F.broadcast(S.average_precision(scored, "raw", "label")))


def feature_importance(model: RiskModel, spark, top: int = 15, bottom: int = 5) -> DataFrame:
    """Strongest and weakest features; one number per feature."""
    pairs = sorted(zip(model.features, model.trees.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    rows = [("top", i + 1, f, v) for i, (f, v) in enumerate(pairs[:top])]
    rows += [("bottom", i + 1, f, v) for i, (f, v) in enumerate(pairs[-bottom:])]
    return spark.createDataFrame(rows, "part string, place int, feature string, importance double")


def save_model(model: RiskModel, path: str) -> None:
    """Trees, calibrator and the metadata document side by side."""
    model.trees.write().overwrite().save(f"{path}/trees")
    if model.calibrator is not None:
        model.calibrator.write().overwrite().save(f"{path}/calibrator")
    meta = {"features": model.features, "medians": model.medians, "target_mode": model.target_mode,
            "metrics": model.metrics, "calibrated": model.calibrator is not None}
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str, spark) -> RiskModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    trees = (GBTClassificationModel if meta["target_mode"] == "binary" else GBTRegressionModel).load(f"{path}/trees")
    calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if meta["calibrated"] else None
    return RiskModel(trees, meta["features"], meta["medians"], meta["target_mode"], calibrator, meta["metrics"])


def validate(model: RiskModel, measured: DataFrame, min_rows: int = 3, gate: float = 0.40) -> tuple[DataFrame, DataFrame]:
    """Scored comparison rows, and rank correlation with the gate, overall (zone null) and per climate zone."""
    scored = predict_risk(model, measured, out="predicted_risk_score").withColumn(
        "climate_zone", climate_zone(F.col("latitude"), F.col("longitude")))
    per_zone = S.spearman(scored, "predicted_risk_score", "measured_iwsr", ["climate_zone"], min_rows).where(F.col("n") >= min_rows)
    overall = S.spearman(scored, "predicted_risk_score", "measured_iwsr", [], min_rows).withColumn(
        "climate_zone", F.lit(None).cast("string"))
    both = overall.unionByName(per_zone).withColumn(
        "gate", F.when(F.abs("spearman") >= gate, "PASS").otherwise("BELOW_GATE"))
    return scored, both
