"""Catalogs, histories and records derived from the given tables, as SQL that both Spark and DuckDB run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sums are of whole numbers, so that their order doesn't matter.
TABLES = ("part", "lineitem", "orders", "customer", "supplier", "events", "pages")

#: One row to a part: every rung of the price ladder is used, some scores and uptimes are missing.
CAT = """
SELECT concat('p', p_partkey) AS model_id, concat(p_name, ' ', p_brand) AS name, p_brand AS creator,
  CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE CAST(p_size * 1.2 AS DOUBLE) END AS intelligence_score,
  CASE WHEN p_partkey % 4 = 0 THEN u / 1000 END AS price_blended,
  CASE WHEN p_partkey % 4 IN (1, 2) THEN u / 900 END AS price_input,
  CASE WHEN p_partkey % 4 = 1 THEN u / 300 END AS price_output,
  CASE WHEN p_partkey % 4 = 3 THEN u / 1100 END AS openrouter_price_input,
  CASE WHEN p_partkey % 8 = 3 THEN u / 400 END AS openrouter_price_output,
  spd AS output_speed_tps,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(90 + p_partkey % 11 AS DOUBLE) END AS uptime_30m,
  CASE WHEN p_partkey % 6 = 1 THEN CAST(93 + p_partkey % 7 AS DOUBLE) END AS uptime_1d,
  CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE CAST(10 + p_partkey % 45 AS DOUBLE) END AS coding_index,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(900 + p_size * 9 AS DOUBLE) END AS arena_coding_elo,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1000 + p_size * 10 AS DOUBLE) END AS arena_elo
FROM part LEFT JOIN (
  SELECT l_partkey, round(avg(l_extendedprice / l_quantity), 4) AS u, round(sum(l_quantity) / 5, 2) AS spd FROM lineitem GROUP BY l_partkey
) a ON l_partkey = p_partkey
"""

#: Yearly snapshots of parts; a source is missing in the last year.
SNAP = """
SELECT CAST(concat(year(l_shipdate), '-01-01') AS DATE) AS snapshot_date, concat('p', l_partkey) AS model_id, concat('Part ', l_partkey) AS name,
  round(sum(l_quantity) / count(l_quantity), 4) AS intelligence_score, floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 10 / sum(l_quantity) + 0.5) / 1000000 AS price, round(sum(l_quantity), 2) AS output_speed_tps,
  max(l_suppkey % 5) AS top_source, min(l_suppkey % 5) AS low_source
FROM lineitem WHERE NOT (year(l_shipdate) = 1998 AND l_suppkey % 5 = 4) GROUP BY year(l_shipdate), l_partkey
"""

#: Monthly history of suppliers.
HIST = """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date, concat('s', l_suppkey) AS model_id, concat('Supplier ', l_suppkey) AS name,
  round(sum(l_quantity) / count(l_quantity), 4) AS intelligence_score, floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 10 / sum(l_quantity) + 0.5) / 1000000 AS price
FROM lineitem GROUP BY date_trunc('month', l_shipdate), l_suppkey
"""

#: Records of customers from five sources.
RAWS = """
SELECT o_orderkey AS ingest_seq, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR(20)) ELSE concat('cust-', c_custkey) END AS model_id,
  concat(c_name, CASE WHEN o_orderkey % 7 = 0 THEN ' (Nov 24)' WHEN o_orderkey % 7 = 1 THEN ' v1.2' ELSE '' END) AS name,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'leaderboard' WHEN '2' THEN 'coding' WHEN '3' THEN 'arena-text' WHEN '4' THEN 'openrouter' ELSE 'other' END AS source,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price_input,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS intelligence_score,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('creator ', o_orderkey % 11) END AS creator
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over the tables of a folder."""
    names = [t for t in TABLES if f" {t}" in sql]
    return spark.sql(_placed(sql, names), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def _placed(sql: str, names: list[str]) -> str:
    """The text with tables as parameters."""
    import re

    for t in names:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CAT)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, SNAP)
    page = lambda c: F.concat(F.lit("src"), F.col(c))
    return out.withColumn("source_pages", F.array_distinct(F.array(page("low_source"), page("top_source")))).drop("low_source", "top_source")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HIST)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RAWS).withColumn("source_pages", F.array("source")).drop("source")
