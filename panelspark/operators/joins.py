"""Lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import geo as G

# Land-cover codes and their bucket names.
LAND_COVER = {
    10: "tree", 20: "shrub", 30: "grass", 40: "cropland", 50: "built_up", 60: "bare", 70: "snow_ice", 80: "water",
    90: "wetland", 95: "mangrove", 100: "moss",
}
ONE_HOT_COVER = ("cropland", "built_up", "bare", "tree", "grass")


def cover_bucket(code: Column) -> Column:
    """Bucket name of a land-cover code; unknown codes read ``unknown``, null stays null."""
    table = F.create_map(*[F.lit(v) for pair in LAND_COVER.items() for v in pair])
    return F.when(code.isNotNull(), F.coalesce(table[code], F.lit("unknown")))


def cover_one_hot(bucket: Column) -> list[Column]:
    """Five 0/1 columns; other buckets give all zeros."""
    return [F.when(bucket == b, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"worldcover_{b}") for b in ONE_HOT_COVER]


def with_static_features(sites: DataFrame, lookup: DataFrame, fallback: dict[str, Column], bucket: str | None = None,
                         decimals: int = 3) -> DataFrame:
    """Static features by rounded position, the fallback expressions where the lookup has no entry.

    The join side is left to the optimizer: a small lookup is broadcast by its measured size.
    """
    keyed = sites.withColumn("lat_key", G.rounded_key(F.col("latitude"), decimals)).withColumn(
        "lon_key", G.rounded_key(F.col("longitude"), decimals))
    found = lookup.withColumn("_hit", F.lit(True))
    out = keyed.join(found, ["lat_key", "lon_key"], "left").withColumn("from_lookup", F.col("_hit").isNotNull())
    for name, expression in fallback.items():
        out = out.withColumn(name, F.when(F.col("from_lookup"), F.col(name)).otherwise(expression))
    if bucket is not None:
        out = out.select("*", *cover_one_hot(F.col(bucket)))
    return out.drop("lat_key", "lon_key", "_hit")


def vertices_with_image(vertices: DataFrame, meta: DataFrame, key: str = "polygon_id") -> DataFrame:
    """Only the image name is taken from the metadata; vertices without metadata drop out."""
    return vertices.join(meta.select(key, "image_name"), key)


def full_pairing(preds: DataFrame, gts: DataFrame, token: str = "token", order: str = "path") -> DataFrame:
    """Prediction and truth files by token, one-sided tokens kept; of several files the last one counts."""
    last = lambda df, out: df.where(F.col(token).isNotNull()).groupBy(token).agg(F.max(order).alias(out))
    return last(preds, "pred_path").join(last(gts, "gt_path"), token, "full_outer")
