"""Operator parameters. The defaults are the fixed values the results are compared against."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Kimber:
    deposition_per_pm25: float = 0.0006
    rain_clean_mm: float = 1.0
    empty_series_pm25: float = 10.0


@dataclass(frozen=True)
class EquivalentDay:
    sl_sat: float = 0.25
    k: float = 30.0
    heavy_rain_mm: float = 10.0
    rain_min_mm: float = 1.0
    pm10_dust_threshold: float = 50.0
    pm10_dust_scale: float = 0.02


SCORING = EquivalentDay(sl_sat=0.10)


@dataclass(frozen=True)
class Features:
    windows: tuple[int, ...] = (7, 30, 90)
    dry_day_mm: float = 1.0
    significant_rain_mm: float = 5.0
    mean_columns: tuple[str, ...] = (
        "wind_speed_10m_max", "relative_humidity_2m_mean", "temperature_2m_max", "pm2_5", "pm10",
    )
    loss_windows: tuple[int, ...] = (7, 30)
    use_kimber: bool = True
    use_equivalent_day: bool = True
    kimber: Kimber = Kimber()
    equivalent_day: EquivalentDay = SCORING


@dataclass(frozen=True)
class Recommend:
    risk_threshold: float = 0.6
    rain_mm_threshold: float = 5.0
    min_days_since_clean: int = 30
    forecast_days: int = 7


@dataclass(frozen=True)
class SpatialCv:
    n_folds: int = 5
    cluster_km: float = 10.0


@dataclass(frozen=True)
class Boosting:
    n_trees: int = 200
    max_depth: int = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    column_sample: str = "0.8"
    seed: int = 42


@dataclass(frozen=True)
class SampleWeights:
    mode: str = "uniform"  # or "iwsr_ci_width"
    feedback_multiplier: float = 3.0
    summary_factor: float = 0.5
    clip_percentiles: tuple[float, float] = (5.0, 95.0)
    empty_width: float = 0.01
    min_width: float = 1e-3


@dataclass(frozen=True)
class SweepGrid:
    conf: tuple[float, ...] = (0.10, 0.15, 0.20, 0.25, 0.30, 0.40)
    iou: tuple[float, ...] = (0.50, 0.60, 0.70)


@dataclass(frozen=True)
class AuditRules:
    min_images: dict = field(default_factory=lambda: {"train": 40, "val": 5, "test": 5})
    max_empty_label_ratio: float = 0.80
