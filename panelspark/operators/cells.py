"""Grid cells for spatial joins that follow the density: a crowded cell becomes several keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

BOX = ("minx", "miny", "maxx", "maxy")
#: Shapes of a cell before it is cut in four, and how often a cell can be cut.
BOUND, LEVELS = 1000, 10


def _span(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def side(size: float, level: Column) -> Column:
    """The side of a cell of that level."""
    return F.lit(float(size)) / F.pow(F.lit(2.0), level)


def at_corner(x: Column, y: Column, size: float) -> Column:
    """Whether the row's cell (_level, _cx, _cy) holds a point: cells cover the plane without overlap, so of all cells in
    which two shapes meet, one holds a given corner of what they share."""
    s = side(size, F.col("_level"))
    return (F.floor(x / s) == F.col("_cx")) & (F.floor(y / s) == F.col("_cy"))


def assigned(boxes: DataFrame, size: float, keys: Sequence[str] = (), bound: int = BOUND, levels: int = LEVELS) -> DataFrame:
    """``boxes`` once for every cell they reach: with ``_level``, ``_cx``, ``_cy``.

    Cells of side ``size`` that hold over ``bound`` boxes are cut in four, again and again. A cell whose boxes are about
    as large as itself stays whole: its boxes lie on each other, and smaller cells would hold the same boxes. Cells of
    different ``keys`` (say a tile) are counted apart. Nothing is dropped.
    """
    at = [*keys, "_level", "_cx", "_cy"]
    s = F.lit(float(size))
    here = boxes.withColumn("_level", F.lit(0)).withColumn("_cx", F.explode(_span(F.col("minx"), F.col("maxx"), s))).withColumn(
        "_cy", F.explode(_span(F.col("miny"), F.col("maxy"), s)))
    done = None
    for level in range(levels + 1):
        here = cut_lineage(here)
        extent = F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))
        full = here.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), extent.alias("_extent"))
        full = full.where((F.col("_n") > bound) & (F.col("_extent") * 2 < side(size, F.col("_level")))).select(*at)
        full = cut_lineage(full)
        if level == levels or full.isEmpty():
            return here if done is None else done.unionByName(here)
        kept = here.join(full, at, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        half = side(size, F.lit(level + 1))
        inside = lambda lo, hi, c: F.filter(F.array(c * 2, c * 2 + 1), lambda i: (i >= F.floor(lo / half)) & (i <= F.floor(hi / half)))  # noqa: B023, E731
        cut = here.join(full, at).withColumn("_level", F.lit(level + 1))
        cut = cut.withColumn("_cx", F.explode(inside(F.col("minx"), F.col("maxx"), F.col("_cx"))))
        here = cut.withColumn("_cy", F.explode(inside(F.col("miny"), F.col("maxy"), F.col("_cy"))))
    raise AssertionError


def meeting(left: DataFrame, right: DataFrame, size: float, keys: Sequence[str] = (), bound: int = BOUND) -> DataFrame:
    """Rows of ``left`` (box in l_minx …) with rows of ``right`` (r_minx …) whose boxes share a point, each pair once.

    Both sides are counted together, so a cell crowded on either is cut for both.
    """
    own = {"l": [c for c in left.columns if c not in keys], "r": [c for c in right.columns if c not in keys]}
    rows = lambda df, s: df.select(*keys, F.lit(s).alias("_side"), *[F.col(f"{s}_{b}").alias(b) for b in BOX],
                                   *[F.struct(*own[o]).alias(f"_{o}") if o == s else F.lit(None).alias(f"_{o}") for o in ("l", "r")])
    placed = assigned(rows(left, "l").unionByName(rows(right, "r")), size, keys, bound)
    at = [*keys, "_level", "_cx", "_cy"]
    a = placed.where("_side = 'l'").select(*at, "_l.*")
    b = placed.where("_side = 'r'").select(*at, "_r.*")
    home = at_corner(F.greatest("l_minx", "r_minx"), F.greatest("l_miny", "r_miny"), size)
    touch = (F.col("l_minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("l_maxx")) & (F.col("l_miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("l_maxy"))
    return a.join(b, at).where(touch & home).drop("_level", "_cx", "_cy")
