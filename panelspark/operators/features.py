"""Feature rows: all look-back windows, streaks and physics proxies of a label row in one pass over its days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.config import Features
from panelspark.operators import daily as D
from panelspark.operators import physics as P


def window_specs(columns: Sequence[str], cfg: Features) -> list[tuple[str, int, str, str]]:
    """(column, days, aggregate, output) for the columns the daily table really has."""
    specs = []
    if "precipitation_sum" in columns:
        specs += [("precipitation_sum", w, "sum", f"precip_{w}d_mm") for w in cfg.windows]
    for c in cfg.mean_columns:
        if c in columns:
            specs += [(c, w, "mean", f"{c}_{w}d_mean") for w in cfg.windows]
    return specs


def feature_rows(rows: DataFrame, keys: Sequence[str], cfg: Features = Features()) -> DataFrame:
    """W02 + W03 + W04 + W09 for label rows joined with their days (``keys`` includes ``as_of``).

    Every step partitions by the label keys, so the plan shuffles the joined days once.
    """
    keys = list(keys)
    label = W.partitionBy(*keys)
    columns = rows.columns
    specs = window_specs(columns, cfg)
    aggs = []
    work = rows
    if "precipitation_sum" in columns:
        rain = F.col("precipitation_sum")
        work = work.withColumn("_wet", F.max(F.when(rain >= cfg.dry_day_mm, F.col("dt"))).over(label)).withColumn(
            "_heavy", F.max(F.when(rain >= cfg.significant_rain_mm, F.col("dt"))).over(label)
        )
        for mark, out in (("_wet", "dry_day_streak"), ("_heavy", "days_since_rain_5mm")):
            late = F.col(mark).isNull() | (F.col("dt") > F.col(mark))
            aggs.append(F.count_if(rain.isNotNull() & late).alias(out))
    if cfg.use_kimber and {"precipitation_sum", "pm2_5"} <= set(columns):
        work = P.kimber_ratio(work, keys, cfg.kimber)
        aggs.append(F.avg("soiling_ratio").alias("kimber_iwsr_proxy"))
        specs += [("soiling_ratio", w, "mean", f"kimber_iwsr_{w}d_mean") for w in cfg.windows]
    known = {"sum": F.sum, "mean": F.avg, "max": F.max}
    aggs += [known[agg](F.when(D.in_window(days), F.col(c))).alias(out) for c, days, agg, out in specs]
    out = work.groupBy(*keys).agg(*aggs)
    if cfg.use_equivalent_day and "precipitation_sum" in columns:
        path = P.equivalent_days(rows, keys, cfg.equivalent_day)
        loss = path.groupBy(*keys).agg(
            F.max_by("soiling_loss", "dt").alias("eqd_loss_proxy"),
            *[F.avg(F.when(D.in_window(w), F.col("soiling_loss"))).alias(f"eqd_loss_{w}d_mean")
              for w in cfg.loss_windows],
        )
        out = out.join(loss, keys)
    return out


def training_matrix(labels: DataFrame, daily: DataFrame, static: DataFrame | None, days: int = 365,
                    cfg: Features = Features(), categorical: dict[str, list[str]] | None = None) -> DataFrame:
    """Label rows + static columns + look-back features; labels without any day are skipped."""
    keys = ["station_id", "as_of"]
    feats = feature_rows(D.days_in_lookback(labels.select(*keys).distinct(), daily, days), keys, cfg)
    out = labels.join(feats, keys).withColumn("month_of_year", F.month("as_of"))
    if static is not None:
        out = out.join(static, "station_id", "left")
    for c, values in (categorical or {}).items():
        out = one_hot(out, c, values)
    return out


def inference_matrix(arrays: DataFrame, daily: DataFrame, static: DataFrame | None, as_of, days: int = 180,
                     cfg: Features = Features(use_equivalent_day=False)) -> DataFrame:
    """One row per array. The equivalent-day features are off by default, as in scoring practice here:
    the training medians stand in for them.

    Weather is built once per distinct station, then joined to the arrays that share it.
    """
    sites = arrays.select("station_id").distinct().withColumn("as_of", F.lit(as_of).cast("date"))
    keys = ["station_id", "as_of"]
    feats = feature_rows(D.days_in_lookback(sites, daily, days), keys, cfg)
    out = arrays.join(feats, "station_id", "left")
    return out if static is None else out.join(static, "station_id", "left")


def categories(df: DataFrame, column: str) -> list[str]:
    """The categories of a training table in order, and ``unknown``. A category list is short; keep it with the model."""
    return sorted({r[0] for r in df.select(F.coalesce(F.col(column), F.lit("unknown"))).distinct().collect()} | {"unknown"})


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """0/1 columns named ``column_value``; nulls and categories not in ``values`` count as ``unknown``."""
    filled = F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.lit("unknown"))
    return df.select(
        *[c for c in df.columns if c != column],
        *[F.when(filled == v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{column}_{v}") for v in values],
    )
