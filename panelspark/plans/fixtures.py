"""Fixture views: the engine's input shapes derived from the driver tables.

Each text is SQL that means the same on Spark and DuckDB, so both sides of a check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES = {
    "f_daily": """SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS dt,
  SUM(CASE WHEN l_discount >= 0.08 THEN l_tax * 100 ELSE 0 END) AS precipitation_sum,
  AVG(l_quantity) AS pm2_5, AVG(l_quantity) * 1.6 AS pm10,
  CASE WHEN MIN(l_linenumber) = 1 THEN NULL ELSE AVG(l_tax) * 100 END AS wind_speed_10m_max
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "f_station": """SELECT s_suppkey AS station_id, CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 100 + 32.5 AS latitude,
  CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 100 - 124 AS longitude FROM supplier""",
    "f_panel": """SELECT l_suppkey AS station_id, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS year,
  1 - AVG(l_discount) AS iwsr, 1 - AVG(l_discount) - AVG(l_tax) / 10 AS iwsr_lower,
  1 - AVG(l_discount) + AVG(l_tax) / 10 AS iwsr_upper, AVG(l_discount) < 0.045 AS iwsr_censored
FROM lineitem GROUP BY l_suppkey, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT)""",
    "f_hourly": """SELECT event_id, user_id AS station_id, ts, value AS pm2_5,
  CASE WHEN event_type = 'error' THEN NULL ELSE value * 1.7 END AS pm10 FROM events""",
    "f_gt": """SELECT l_orderkey AS tile_id,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS gt_idx,
  CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_suppkey * 6 % 600 AS DOUBLE) AS y1,
  CAST(l_partkey % 600 AS DOUBLE) + 10 + l_quantity AS x2, CAST(l_suppkey * 6 % 600 AS DOUBLE) + 10 + l_quantity AS y2
FROM lineitem WHERE l_discount < 0.09""",
    "f_pred": """SELECT l_orderkey AS tile_id,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pred_idx,
  CAST(0.05 AS DOUBLE) + l_discount * 9 AS conf,
  CAST(l_partkey % 600 AS DOUBLE) + l_tax * 200 AS x1, CAST(l_suppkey * 6 % 600 AS DOUBLE) + l_tax * 100 AS y1,
  CAST(l_partkey % 600 AS DOUBLE) + l_tax * 200 + 10 + l_quantity AS x2,
  CAST(l_suppkey * 6 % 600 AS DOUBLE) + l_tax * 100 + 10 + l_quantity AS y2
FROM lineitem WHERE l_discount > 0.01""",
    # Squares of 3 km side by side with 2,000 arrays each: the extent grows with the table, the density does not.
    "f_rect": """SELECT c_custkey AS array_id, CAST((c_custkey * c_custkey * 31 + c_custkey * 17) % 3001 AS DOUBLE) + FLOOR(c_custkey / 2000) * 3000 AS minx,
  CAST((c_custkey * c_custkey * 57 + c_custkey * 11) % 2999 AS DOUBLE) AS miny,
  CAST((c_custkey * c_custkey * 31 + c_custkey * 17) % 3001 AS DOUBLE) + FLOOR(c_custkey / 2000) * 3000 + 5 + c_custkey % 23 AS maxx,
  CAST((c_custkey * c_custkey * 57 + c_custkey * 11) % 2999 AS DOUBLE) + 4 + c_custkey % 17 AS maxy FROM customer""",
    "f_risk": """SELECT c_custkey AS array_id, c_nationkey AS aoi_id,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(c_custkey * (c_nationkey + 3) % 1000 AS DOUBLE) / CASE WHEN c_nationkey % 4 = 0 THEN 2000 ELSE 1000 END END AS risk_score FROM customer""",
    "f_forecast": """SELECT n.n_nationkey AS aoi_id, d.day_no,
  CASE WHEN (n.n_nationkey * 7 + d.day_no * 3) % (4 + n.n_nationkey % 9) = 0 THEN CAST(n.n_nationkey % 6 AS DOUBLE) * 2 ELSE CAST(0 AS DOUBLE) END AS rain_mm
FROM nation n CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS d(day_no)""",
    "f_score": """SELECT d.doc_id, d.lang AS grp, CAST(d.n_chars AS DOUBLE) / (1000 + d.n_chars) AS score, l.quality AS y
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "f_line": """SELECT tile_id, gt_idx AS line_no,
  CASE WHEN gt_idx = 4 THEN '0 abc 0.1' ELSE CONCAT('0 0.', LPAD(CAST(CAST(x1 AS INT) AS STRING), 3, '0'), ' 0.', LPAD(CAST(CAST(y1 AS INT) AS STRING), 3, '0'),
    ' 0.', LPAD(CAST(CAST(x2 AS INT) AS STRING), 3, '0'), ' 0.', LPAD(CAST(CAST(y1 AS INT) AS STRING), 3, '0'),
    ' 0.', LPAD(CAST(CAST(x2 AS INT) AS STRING), 3, '0'), ' 0.', LPAD(CAST(CAST(y2 AS INT) AS STRING), 3, '0'),
    CASE WHEN gt_idx = 3 THEN ' 0.75' ELSE '' END) END AS line
FROM f_gt""",
}


def needed_fixtures(text: str) -> list[str]:
    """Fixtures a SQL text names, dependencies first."""
    found = [name for name in FIXTURES if re.search(rf"\b{name}\b", text)]
    out: list[str] = []
    for name in found:
        for inner in needed_fixtures(FIXTURES[name]):
            if inner not in out:
                out.append(inner)
        if name not in out:
            out.append(name)
    return out


class Tables:
    """Lazy access to driver tables and fixtures of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        raise AttributeError(name)

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """Run a derivation; table and fixture names resolve to this folder, or to the tables given."""
        inputs = [n for n in (*DRIVER_TABLES, *FIXTURES) if re.search(rf"(FROM|JOIN)\s+{n}\b", text)]
        for name in inputs:
            text = re.sub(rf"((?:FROM|JOIN)\s+){name}\b", rf"\1{{{name}}}", text)
        return self.spark.sql(text, **{name: given[name] if name in given else getattr(self, name) for name in inputs})
