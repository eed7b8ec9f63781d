"""Writers. Rows stay rows until the file format itself is one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import blank_rounds


def feature_json(ring: Column, properties: Column) -> Column:
    """A GeoJSON feature as text; the ring is closed on the way out."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    coordinates = F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def write_geojson_seq(df: DataFrame, path: str, properties: Sequence[str], ring: str = "ring") -> None:
    """One feature per line, written in parallel (GeoJSONSeq)."""
    df.select(feature_json(F.col(ring), F.struct(*properties)).alias("value")).write.mode("overwrite").text(path)


def label_line(ring: Column, class_id: Column | None = None) -> Column:
    """``class x1 y1 …`` with six decimals."""
    flat = F.flatten(F.transform(ring, lambda p: F.array(F.format_string("%.6f", p["x"]), F.format_string("%.6f", p["y"]))))
    head = F.lit("0") if class_id is None else class_id.cast("string")
    return F.concat_ws(" ", head, F.array_join(flat, " "))


def write_label_text(lines: DataFrame, path: str, tile: str = "tile", order: str = "line_no") -> None:
    """One label file per split and tile, sorted by line on disk and never assembled in memory."""
    keys = [c for c in ("split", tile) if c in lines.columns]
    lines.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, F.col("line").alias("value")).write.mode(
        "overwrite").partitionBy(*keys).text(path)


def per_detection_table(rows: DataFrame, domain: str, split: str, weights_run: str) -> DataFrame:
    """The seventeen-column per-detection layout, rounded for display."""
    digits = {"iou": 4, "conf": 4, "pred_area_px": 2, "gt_area_px": 2, "pred_centroid_x": 2, "pred_centroid_y": 2,
              "gt_centroid_x": 2, "gt_centroid_y": 2, "distance_to_image_edge_px": 2, "pred_aspect": 3, "gt_aspect": 3}
    rounds = {d: blank_rounds(d) for d in set(digits.values())}
    shown = lambda c: rounds[digits[c]](F.col(c).cast("double")).alias(c)
    return rows.select(
        "tile_id", F.lit(domain).alias("domain"), F.lit(split).alias("split"), "class", shown("iou"), shown("conf"),
        *[shown(c) for c in ("pred_area_px", "gt_area_px", "pred_centroid_x", "pred_centroid_y", "gt_centroid_x",
                             "gt_centroid_y", "distance_to_image_edge_px")],
        "num_other_panels_in_tile", shown("pred_aspect"), shown("gt_aspect"), F.lit(weights_run).alias("weights_run"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, blanks for null."""
    df.write.mode(mode).csv(path, header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_matrix(df: DataFrame, path: str, geo_path: str | None = None, partition: Sequence[str] = ()) -> None:
    """Feature matrix, and the copy with rings when asked for."""
    flat = df.drop("ring") if "ring" in df.columns else df
    flat.write.mode("overwrite").partitionBy(*partition).parquet(path)
    if geo_path is not None:
        df.write.mode("overwrite").partitionBy(*partition).parquet(geo_path)


def write_tile_index(index: DataFrame, path: str) -> None:
    """Validated before it is saved."""
    from panelspark.operators.quality import tile_index_errors

    bad = tile_index_errors(index).where(F.size("errors") > 0).limit(5).collect()
    if bad:
        raise ValueError(f"invalid tile index entries: {[(r['tile_name'], r['errors']) for r in bad]}")
    index.write.mode("overwrite").parquet(path)


def training_list(paths_a: DataFrame, paths_b: DataFrame, repeat: int, column: str = "path") -> DataFrame:
    """Every A path ``repeat`` times, every B path once."""
    a = paths_a.select(column).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).select(column)
    return a.unionAll(paths_b.select(column))


def write_lines(df: DataFrame, path: str, column: str = "path", mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def feedback_record(df: DataFrame) -> DataFrame:
    """Add the measured recovery and the submission time."""
    from panelspark.functions.numeric import recovery_pct

    return df.withColumn("actual_recovery_pct", recovery_pct(F.col("pre_clean_kwh_7d"), F.col("post_clean_kwh_7d"))).withColumn(
        "submitted_at", F.current_timestamp())


def recommendation_payload(decisions: DataFrame) -> DataFrame:
    """The nested recommendation document per area."""
    return decisions.select(
        "aoi_id", "window_start", "window_end", "expected_recovery_pct", "confidence", "rule_fired",
        F.lit("recommend-v1-rule").alias("model_version"), F.lit(True).alias("beta"),
        F.array(F.lit("recovery ranges come from a fixed table, not from measurements"),
                F.lit("all arrays of an area share one rain forecast")).alias("known_limitations"),
        F.struct(F.col("aoi_risk").alias("aoi_risk_p90"), "n_arrays", "days_since_clean",
                 F.col("total_rain_mm").alias("total_rain_7d_mm"), "last_cleaned", "today").alias("inputs"))
