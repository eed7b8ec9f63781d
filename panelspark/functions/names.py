"""File, tile and source names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: source file names and the suffix an annotation service adds to tile names.
SOURCE = r"naip_([a-z]+)_(\d{4})_(\d+)_(\d+)"
EXPORT_SUFFIX = r"_png\.rf\.[A-Za-z0-9]+(?=\.[a-zA-Z]+$)"
PARTNER_ID = r"^[a-zA-Z0-9][a-zA-Z0-9_\-]{0,62}$"


def region(source: Column) -> Column:
    """Region part of a source name, null when it does not match."""
    return F.nullif(F.regexp_extract(source, SOURCE, 1), F.lit(""))


def vintage(source: Column) -> Column:
    """Year part."""
    return F.nullif(F.regexp_extract(source, SOURCE, 2), F.lit("")).cast("int")


def canonical_tile(name: Column) -> Column:
    """Drop the export suffix and force the .png extension; idempotent."""
    return F.concat(F.regexp_replace(F.regexp_replace(name, EXPORT_SUFFIX, ""), r"\.[^.]*$", ""), F.lit(".png"))


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def tile_token(path: Column) -> Column:
    """The ``tile_<digits>`` part of a path, null when absent."""
    return F.nullif(F.regexp_extract(path, r"tile_\d+", 0), F.lit(""))


def split_of(path: Column) -> Column:
    """Split of an exported file; both folder layouts, ``valid`` read as ``val``."""
    pattern = r"(?:^|/)(?:(?:images|labels)/(train|val|valid|test)|(train|val|valid|test)/(?:images|labels))/"
    found = F.concat(F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2))
    return F.when(found == "valid", "val").otherwise(F.nullif(found, F.lit("")))


def valid_partner(partner: Column) -> Column:
    """P20."""
    return F.coalesce(partner.rlike(PARTNER_ID), F.lit(False))
