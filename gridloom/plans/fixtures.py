"""Test inputs derived from the driver's tables, as SQL that Spark and DuckDB both run.

``tables`` are the Parquet tables a fixture reads. ``with_fixtures`` puts the fixtures in
front of a query as common table expressions for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.scratch import by_key

TABLES = {"px": ("orders", "part"), "obs": ("lineitem",), "gt": ("part",), "pred": ("customer",), "moved": ("customer",), "segs": ("supplier",), "cand": ("embeddings",), "scenes": ("orders",)}

SQL = {
    "px": """
SELECT r, c, CASE WHEN k % 997 = 0 THEN NULL ELSE dtm + base + noise END AS dsm, dtm
FROM (
  SELECT o.o_orderkey AS k, CAST(floor(o.o_orderkey / 100) AS INT) AS r, CAST(o.o_orderkey % 100 AS INT) AS c,
         CAST(10 + 0.25 * floor(o.o_orderkey / 800) AS DOUBLE) AS dtm,
         CAST(CASE WHEN p.p_size > 25 AND o.o_orderkey % 10 < 8 AND floor(o.o_orderkey / 100) % 10 < 8 THEN 0.25 * (p.p_size - 12) ELSE 0 END AS DOUBLE) AS base,
         CAST(CASE WHEN p.p_size <= 6 AND o.o_custkey % 2 = 0 THEN 4 WHEN o.o_custkey % 40 = 0 THEN 0.25 ELSE 0 END AS DOUBLE) AS noise
  FROM orders o JOIN part p ON p.p_partkey = (CAST(floor(o.o_orderkey / 1000) * 10 + floor((o.o_orderkey % 100) / 10) AS BIGINT)) % 200) t""",
    "obs": """
SELECT CAST(floor(l_orderkey / 100) AS INT) AS r, CAST(l_orderkey % 100 AS INT) AS c, l_linenumber AS scene, CAST(l_partkey % 12 AS INT) AS scl,
       CAST(1000 + 20 * l_quantity AS INT) AS red_dn, CAST(CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 2000 + 30 * (l_suppkey % 100) END AS INT) AS nir_dn
FROM lineitem""",
    "gt": """
SELECT p_partkey AS fid, CAST(25 * (p_partkey % 40) AS DOUBLE) AS minx, CAST(25 * floor(p_partkey / 40) AS DOUBLE) AS miny,
       CAST(25 * (p_partkey % 40) + 6 + p_size % 20 AS DOUBLE) AS maxx, CAST(25 * floor(p_partkey / 40) + 4 + (p_partkey * 7) % 20 AS DOUBLE) AS maxy,
       CASE WHEN p_brand IN ('Brand#1','Brand#2') THEN 'Domestic Outbuilding' WHEN p_brand IN ('Brand#3','Brand#4','Brand#5') THEN 'Unknown Building'
            WHEN p_brand = 'Brand#6' THEN 'Electricity Sub Station' WHEN p_brand < 'Brand#15' THEN 'Detached House' WHEN p_brand < 'Brand#2' THEN 'Semi-Detached House'
            WHEN p_brand = 'Brand#25' THEN 'Church' ELSE 'Commercial Building' END AS description,
       CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(2 + p_partkey % 37 AS DOUBLE) / 4 END AS height_relativemax_m
FROM part""",
    "pred": """
SELECT c_custkey AS pid, lower(c_mktsegment) AS dataset, CAST(25 * (c_custkey % 40) + (c_custkey * 3) % 7 - 3 AS DOUBLE) AS minx,
       CAST(25 * floor((c_custkey % 2000) / 40) + (c_custkey * 5) % 5 - 2 AS DOUBLE) AS miny, CAST(25 * (c_custkey % 40) + (c_custkey * 3) % 7 + 5 + c_nationkey % 20 AS DOUBLE) AS maxx,
       CAST(25 * floor((c_custkey % 2000) / 40) + 4 + (c_custkey * 7) % 20 AS DOUBLE) AS maxy
FROM customer""",
    "moved": """
SELECT pid, dataset, minx + d AS minx, miny + d AS miny, maxx + d AS maxx, maxy + d AS maxy
FROM (SELECT *, CASE WHEN pid % 7 = 0 THEN 13 ELSE 0 END AS d FROM (SELECT c_custkey AS pid, lower(c_mktsegment) AS dataset, CAST(25 * (c_custkey % 40) + (c_custkey * 3) % 7 - 3 AS DOUBLE) AS minx,
       CAST(25 * floor((c_custkey % 2000) / 40) + (c_custkey * 5) % 5 - 2 AS DOUBLE) AS miny, CAST(25 * (c_custkey % 40) + (c_custkey * 3) % 7 + 5 + c_nationkey % 20 AS DOUBLE) AS maxx,
       CAST(25 * floor((c_custkey % 2000) / 40) + 4 + (c_custkey * 7) % 20 AS DOUBLE) AS maxy
FROM customer) s) t""",
    "segs": """
SELECT s_suppkey AS seg_id, CASE WHEN s_nationkey % 5 = 0 THEN 'Motorway' ELSE 'Local Road' END AS road_function,
       CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS x1, CAST((s_suppkey * 53) % 1250 AS DOUBLE) AS y1,
       CAST((s_suppkey * 37) % 1000 + s_nationkey - 12 AS DOUBLE) AS x2, CAST((s_suppkey * 53) % 1250 + (s_suppkey * 11) % 25 - 12 AS DOUBLE) AS y2
FROM supplier""",
    "scenes": """
SELECT o_orderkey AS scene, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 100 AS INT) AS cloud, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS minx, CAST((o_orderkey * 53) % 1200 AS DOUBLE) AS miny,
       CAST((o_orderkey * 37) % 1000 + 100 AS DOUBLE) AS maxx, CAST((o_orderkey * 53) % 1200 + 100 AS DOUBLE) AS maxy
FROM orders""",
    "cand": """
SELECT e.vec_id AS label, CAST(20 + (e.vec_id * 13) % 600 AS DOUBLE) AS area,
       CASE CAST(e.vec_id % 4 AS INT) WHEN 0 THEN 'sw' WHEN 1 THEN 'ne' WHEN 2 THEN 'se' ELSE 'nw' END AS quadrant, CAST(e.vec_id % 25 AS INT) AS tile_1km,
       CASE WHEN e.label < 6 THEN 1 ELSE 0 END AS is_building,
       round(CAST(((e.vec_id * 37) % 101) AS DOUBLE) / 100 * 0.6 + CASE WHEN e.label < 6 THEN 0.4 ELSE 0 END, 2) AS prob, CAST((e.vec_id * 7) % 20 AS DOUBLE) / 10 AS line_ratio
FROM embeddings e""",
}


#: Rows up to which the table that pixels look up is sent to every task.
LOOKUP_ROWS = 100_000


def _looked_up(table: DataFrame) -> DataFrame:
    """A table that is joined to pixels by key: broadcast when its counted rows stay within ``LOOKUP_ROWS``; its files say little about them."""
    return F.broadcast(table) if table.count() <= LOOKUP_ROWS else by_key(table)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; the tables are scanned with only the columns it uses."""
    text = SQL[name]
    for table in TABLES[name]:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    if name == "px":
        tables["part"] = _looked_up(tables["part"])
    return by_key(spark.sql(text, **tables))


def with_fixtures(names: tuple[str, ...], query: str) -> str:
    """``query`` (which may begin with ``WITH [RECURSIVE] more``) after the named fixtures' expressions."""
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    text = query.strip()
    recursive = ""
    if text.upper().startswith("WITH "):
        text = text[5:].strip()
        if text.upper().startswith("RECURSIVE "):
            recursive, text = "RECURSIVE ", text[10:]
        return f"WITH {recursive}{parts}, {text}"
    return f"WITH {parts} {text}"
