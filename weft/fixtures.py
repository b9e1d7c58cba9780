"""Graphs made from the relational test tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .model import Kind
from .operators.graph import Graph

SQL = {
    "gn_nodes": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region FROM {nation}",
    "gn_edges": """SELECT CAST(a.n_nationkey AS BIGINT) AS n1, CAST(b.n_nationkey AS BIGINT) AS n2, 'UND' AS slot, a.n_regionkey AS val
FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "gm_edges": """SELECT CAST(a.n_nationkey AS BIGINT) AS n1, CAST(b.n_nationkey AS BIGINT) AS n2, 'UND' AS slot, a.n_regionkey AS val
FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
UNION ALL SELECT CAST(k AS BIGINT), CAST(nx AS BIGINT), 'SRC', r
FROM (SELECT n_nationkey AS k, n_regionkey AS r, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nx FROM {nation}) t WHERE nx IS NOT NULL
UNION ALL SELECT CAST(k AS BIGINT), CAST(nx AS BIGINT), 'TGT', r
FROM (SELECT n_nationkey AS k, n_regionkey AS r, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nx FROM {nation}) t WHERE nx IS NOT NULL AND k % 2 = 0""",
    "ge_nodes": "SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS id, event_type AS name FROM (SELECT DISTINCT event_type FROM {events}) d",
    "ge_edges": """SELECT least(f, t) AS n1, greatest(f, t) AS n2, CASE WHEN f <= t THEN 'SRC' ELSE 'TGT' END AS slot, count(*) AS val
FROM (SELECT a.id AS f, b.id AS t
  FROM (SELECT event_type AS fe, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS te FROM {events}) x
  JOIN (SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS id, event_type FROM (SELECT DISTINCT event_type FROM {events}) d) a ON a.event_type = x.fe
  JOIN (SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS id, event_type FROM (SELECT DISTINCT event_type FROM {events}) d) b ON b.event_type = x.te) y
GROUP BY f, t""",
    "gos_nodes": """SELECT o_orderkey AS id, 'order' AS kind, o_orderpriority AS label FROM {orders}
UNION ALL SELECT 1000000000 + s_suppkey, 'supplier', CAST(s_nationkey AS VARCHAR(10)) FROM {supplier}""",
    "gos_edges": """SELECT l_orderkey AS n1, 1000000000 + l_suppkey AS n2, 'SRC' AS slot, sum(l_quantity) AS val
FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "gop_nodes": """SELECT o_orderkey AS id, 'order' AS kind, o_orderpriority AS label FROM {orders}
UNION ALL SELECT 2000000000 + p_partkey, 'part', p_brand FROM {part}""",
    "gop_edges": """SELECT l_orderkey AS n1, 2000000000 + l_partkey AS n2, 'SRC' AS slot, sum(l_quantity) AS val
FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "gup_edges": """SELECT l_orderkey AS n1, 2000000000 + l_partkey AS n2, 'UND' AS slot, count(*) AS val
FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "gps_nodes": """SELECT 1000000000 + s_suppkey AS id, 'supplier' AS kind, CAST(s_nationkey AS VARCHAR(10)) AS label FROM {supplier}
UNION ALL SELECT 2000000000 + p_partkey, 'part', p_brand FROM {part}""",
    "gps_edges": """SELECT 1000000000 + l_suppkey AS n1, 2000000000 + l_partkey AS n2, 'UND' AS slot, count(*) AS val
FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "guu_nodes": "SELECT DISTINCT user_id AS id FROM {events}",
    "guu_edges": """SELECT a.user_id AS n1, b.user_id AS n2, 'UND' AS slot, count(*) AS val
FROM {events} a JOIN {events} b ON a.event_type = b.event_type AND a.user_id < b.user_id AND date_trunc('minute', a.ts) = date_trunc('minute', b.ts)
GROUP BY a.user_id, b.user_id""",
}
TABLES = ("nation", "supplier", "part", "orders", "lineitem", "events")
GRAPHS = {"gn": (Kind.UNDIR, "gn_nodes"), "gm": (Kind.ANYDIR, "gn_nodes"), "ge": (Kind.DIR, "ge_nodes"), "gos": (Kind.DIR, "gos_nodes"), "gop": (Kind.DIR, "gop_nodes"), "gup": (Kind.UNDIR, "gop_nodes"), "gps": (Kind.UNDIR, "gps_nodes"), "guu": (Kind.UNDIR, "guu_nodes")}


def _frame(spark: SparkSession, sf_dir: str, name: str):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in SQL[name]}
    return spark.sql(SQL[name].replace("VARCHAR(10)", "STRING"), **tables)


_loaded: dict[tuple[str, str, str], Graph] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The graph, made from all rows of its tables. It is stored when it is first asked for, and searched from there in the same application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _loaded:
        kind, nodes = GRAPHS[name]
        _loaded[key] = Graph.from_frames(kind, _frame(spark, sf_dir, nodes), _frame(spark, sf_dir, f"{name}_edges")).stored()
    return _loaded[key]


def ctes(name: str) -> str:
    """WITH nodes, edges, half, pair of a fixture, in DuckDB's SQL."""
    _, nodes = GRAPHS[name]
    plain = {t: t for t in TABLES}
    return f"""WITH nodes AS ({SQL[nodes].format(**plain)}), edges AS ({SQL[f"{name}_edges"].format(**plain)}),
half AS (SELECT n1 AS src, n2 AS dst, slot, val FROM edges
  UNION ALL SELECT n2, n1, CASE slot WHEN 'SRC' THEN 'TGT' WHEN 'TGT' THEN 'SRC' ELSE slot END, val FROM edges WHERE n1 <> n2 OR slot <> 'UND'),
pair AS (SELECT src, dst, count(*) AS k, coalesce(bool_or(slot = 'UND'), false) AS u, coalesce(bool_or(slot = 'SRC'), false) AS s, coalesce(bool_or(slot = 'TGT'), false) AS t,
  max(CASE WHEN slot = 'UND' THEN val END) AS vu, max(CASE WHEN slot = 'SRC' THEN val END) AS vs, max(CASE WHEN slot = 'TGT' THEN val END) AS vt FROM half GROUP BY src, dst)
"""
