"""Imports every query module so the registry is complete."""

from __future__ import annotations

from panelspark.plans import daily, detect, labels, quality, recommend, sources, spatial, stats, streams  # noqa: F401
from panelspark.plans.recommend import flagship  # noqa: F401
from panelspark.plans.registry import ORACLES, QUERIES  # noqa: F401
