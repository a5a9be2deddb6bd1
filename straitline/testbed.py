"""Views over the driver's tables that stand in for the real inputs; portable SQL, one text for Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "positions": """SELECT event_id, user_id AS mmsi, ts,
  CAST(5550 + (event_id*37 + user_id*11) % 200 AS DOUBLE)/CAST(100 AS DOUBLE) AS lon,
  CAST(2550 + (event_id*53 + user_id*7) % 180 AS DOUBLE)/CAST(100 AS DOUBLE) AS lat,
  CASE WHEN event_type IN ('view','click') THEN CAST(event_id % 10 AS DOUBLE)/CAST(10 AS DOUBLE)
       ELSE CAST(50 + event_id % 120 AS DOUBLE)/CAST(10 AS DOUBLE) END AS sog,
  CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 5 ELSE 0 END AS nav_status FROM events""",
    "static_reports": """SELECT event_id, user_id AS mmsi, ts,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 9000000 + user_id - user_id % 2 END AS imo,
  CASE WHEN event_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(8 + event_id % 14 AS DOUBLE) END AS draught,
  CAST(100 + (user_id*13) % 260 AS DOUBLE) AS length_m, CAST(60 + event_id % 35 AS INT) AS ship_type
  FROM events WHERE event_type = 'purchase'""",
    "brent": "SELECT CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice)/CAST(1000 AS DOUBLE) AS value FROM orders GROUP BY 1",
    "wti": "SELECT CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice)/CAST(1000 AS DOUBLE) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "chokepoint_daily": """SELECT CAST(l_shipdate AS DATE) AS date,
  CASE n_regionkey WHEN 0 THEN 'hormuz' WHEN 1 THEN 'suez' WHEN 2 THEN 'cape_of_good_hope' WHEN 3 THEN 'malacca' ELSE 'bab_el_mandeb' END AS zone_key,
  CAST(COUNT(*) AS DOUBLE) AS n_transits, CAST(SUM(l_quantity) AS DOUBLE) AS n_total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "port_daily": """SELECT CAST(o_orderdate AS DATE) AS date, CONCAT('port', CAST(n_nationkey AS VARCHAR(8))) AS port_id,
  n_name AS port_name, CAST(COUNT(*) AS DOUBLE) AS n_tanker
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    # one event a month and priority, from all orders
    "dated_events": """SELECT CAST(MIN(o_orderdate) AS DATE) AS date,
  CONCAT('event ', CAST(YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS VARCHAR(20)), ' ', o_orderpriority) AS event, o_orderpriority AS category
  FROM orders GROUP BY YEAR(o_orderdate) * 100 + MONTH(o_orderdate), o_orderpriority""",
    "port_cfg": "SELECT * FROM (VALUES ('alpha','NATION_1','gulf_export'),('beta','nation_24','red_sea_export'),('gamma','NOWHERE','outside_hormuz')) AS t(port_key, match_name, port_group)",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ZONE_KEYS = ["bab_el_mandeb", "cape_of_good_hope", "hormuz", "malacca", "suez"]


class Bed:
    """``bed.positions`` and so on as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, view: str) -> DataFrame:
        if view not in VIEWS:
            raise AttributeError(view)
        used = {t: self.table(t) for t in TABLES if f" {t}" in VIEWS[view].replace("\n", " ")}
        sql = VIEWS[view]
        for t in used:
            for lead in ("FROM ", "JOIN "):
                sql = sql.replace(f"{lead}{t}", f"{lead}{{{t}}}")
        return self.spark.sql(sql, **{t: df for t, df in used.items() if f"{{{t}}}" in sql})


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the views, for the oracle."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
