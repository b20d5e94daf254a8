"""Where queries register, and the views of the tables that they share.

A view is one SELECT that both engines read; ``{table}`` stands for a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "samples": """
        SELECT CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS week, l_returnflag AS slot,
               s_nationkey AS market, l_linenumber AS color, l_discount > 0 AS colored
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "manifest": """
        SELECT CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS week, l_returnflag AS slot,
               l_linenumber AS revision, CASE WHEN l_linestatus = 'F' THEN 'live' ELSE 'wayback' END AS source,
               CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS capture, l_quantity AS bytes, l_orderkey, l_partkey, l_suppkey, l_extendedprice
        FROM {lineitem}""",
    "projections": """
        SELECT week, team, position, name, round(sum(pts) / 1000, 1) AS points FROM (
          SELECT CAST(month(l_shipdate) AS INT) AS week, CAST(l_suppkey % 32 AS INT) AS team, p_type AS position, p_partkey AS name,
                 CASE WHEN l_quantity = 1 THEN 0 ELSE l_extendedprice END AS pts
          FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) t GROUP BY week, team, position, name""",
    "quotes": """
        SELECT l_partkey AS event, l_suppkey AS book, l_returnflag AS side, CASE WHEN l_tax = 0 THEN NULL ELSE floor(l_extendedprice) END AS price,
               l_quantity AS point, l_shipdate AS updated, l_orderkey FROM {lineitem}""",
    "zips": """
        SELECT CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR(20)), 5, '0') ELSE CAST(c_custkey AS VARCHAR(20)) END AS zip,
               CASE WHEN CAST(floor(c_custkey / 100) AS INT) % 2 = 0 THEN 'ZONE' ELSE c_mktsegment END AS zone
        FROM {customer}""",
    "kickoffs": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 24 AS INT) AS h, CAST(o_orderkey % 60 AS INT) AS mi, CAST(o_custkey % 35 AS INT) AS zone_no,
               CASE WHEN o_custkey % 2 = 0 THEN 'CBS' ELSE 'FOX' END AS network FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def cte(*names: str) -> str:
    """``name AS (...)`` of the views, for a WITH clause."""
    return ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add
