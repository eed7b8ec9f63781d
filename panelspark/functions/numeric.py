"""Numeric column helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_binary(x: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, as IEEE-minded languages do.

    Spark rounds the decimal text, which differs when the text ends in 5. The product ``x * 10^digits`` is taken
    with its rounding error (split multiplication), and the error decides the apparent ties.
    """
    scale = float(10 ** digits)
    split = lambda a: a * 134217729.0 - (a * 134217729.0 - a)
    p = x * scale
    hi, s_hi = split(x), float(scale * 134217729.0 - (scale * 134217729.0 - scale))
    lo, s_lo = x - hi, scale - s_hi
    err = ((hi * s_hi - p) + hi * s_lo + lo * s_hi) + lo * s_lo
    base = F.floor(p).cast("double")
    frac = p - base
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (base % 2 != 0))))
    return (base + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def round_binary_sql(x: str, digits: int) -> str:
    """The same rounding as SQL text (used by oracles)."""
    scale = 10 ** digits
    split = f"(({x}) * 134217729e0 - (({x}) * 134217729e0 - ({x})))"
    p, lo = f"(({x}) * {scale}e0)", f"(({x}) - {split})"
    err = f"(({split} * {scale}e0 - {p}) + {lo} * {scale}e0)"
    return (f"((FLOOR({p}) + CASE WHEN {p} - FLOOR({p}) > 5e-1 OR ({p} - FLOOR({p}) = 5e-1 AND ({err} > 0 OR "
            f"({err} = 0 AND FLOOR({p}) % 2 <> 0))) THEN 1e0 ELSE 0e0 END) / {scale}e0)")


def blank_round(x: Column, digits: int = 3) -> Column:
    """rounded, with NaN and infinities as null."""
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, round_binary(x, digits))


def blank_rounds(digits: int):
    """``blank_round`` on whole Arrow columns: for tables with many rounded columns, whose expressions are too long to be
    compiled together."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        x = column.to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            scale = float(10 ** digits)
            split = lambda a: a * 134217729.0 - (a * 134217729.0 - a)
            p, hi, s_hi = x * scale, split(x), split(scale)
            lo, s_lo = x - hi, scale - s_hi
            err = ((hi * s_hi - p) + hi * s_lo + lo * s_hi) + lo * s_lo
            base = np.floor(p)
            frac = p - base
            up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (base % 2 != 0))))
            return pa.array((base + up) / scale, mask=~np.isfinite(x))

    return run


def recovery_pct(pre: Column, post: Column) -> Column:
    """(post - pre) / pre * 100, two digits; null when pre is zero."""
    return round_binary(F.try_divide(post - pre, pre) * 100, 2)


def pseudo_iwsr(recovery: Column) -> Column:
    """soiling ratio implied by a measured recovery."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - recovery / 100.0)


def coerce_number(c: Column) -> Column:
    """Number or null."""
    return c.try_cast("double")


def reanalysis_stream(year: Column) -> Column:
    """F16: stream number of a reanalysis year."""
    return F.when(year >= 2011, "400").when(year >= 2001, "300").when(year >= 1992, "200").otherwise("100")


def censored_ratio(text: Column) -> tuple[Column, Column]:
    """``>x`` means "above x": the middle of (x, 1), flagged; else the number, else null."""
    trimmed = F.trim(text)
    above = F.coalesce(trimmed.startswith(">"), F.lit(False))
    value = F.when(above, (F.substring(trimmed, F.lit(2), F.length(trimmed)).try_cast("double") + 1.0) / 2.0).otherwise(
        trimmed.try_cast("double"))
    return value, above
