"""Query registry shared by ``__spark_entry__`` and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.plans.fixtures import FIXTURES, Tables, needed_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(body: str, digits: int, doubles: str) -> str:
    """Oracle text: fixture CTEs in front, double columns rounded like the Spark side."""
    names = [c.strip() for c in doubles.split(",") if c.strip()]
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in needed_fixtures(body))
    replace = ", ".join(f"ROUND({c}, {digits}) + 0.0 AS {c}" for c in names)
    outer = f"SELECT * REPLACE ({replace}) FROM ({body}) q" if names else body
    if not ctes:
        return outer
    if not names and body.lstrip().upper().startswith("WITH"):
        outer = f"SELECT * FROM ({body}) q"
    return f"WITH {ctes} {outer}"


def query(name: str, oracle: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(t: Tables) -> DataFrame``; ``doubles`` are compared rounded to ``digits``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            for c in (c.strip() for c in doubles.split(",") if c.strip()):
                df = df.withColumn(c, F.round(F.col(c).cast("double"), digits) + F.lit(0.0))
            return df

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle, digits, doubles)
        return fn

    return wrap
