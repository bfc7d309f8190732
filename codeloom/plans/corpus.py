"""Queries of the core operators for the numbered problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import Hierarchy, hierarchy
from ..session import table


def _imports(spark: SparkSession, sf_dir: str) -> Hierarchy:
    rows = table(spark, sf_dir, "relationships").where("lower(trim(relation_type)) = 'imports' AND callee_function_id IS NOT NULL")
    return hierarchy(rows.select("caller_function_id", "callee_function_id"), "caller_function_id", "callee_function_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _imports(spark, sf_dir).nodes
    return nodes.select(F.col("node").alias("function_id"), F.col("root").alias("root_id"), "depth", F.col("path").alias("full_path"), "status")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).descendants().select("ancestor", "node", F.col("distance").cast("long").alias("distance"))


QUERIES = {f.__name__: f for f in (p5_found, p5_descendants)}

_TREE = """
WITH RECURSIVE e AS (SELECT callee_function_id AS c, min(caller_function_id) AS p FROM relationships
                     WHERE lower(trim(relation_type)) = 'imports' AND callee_function_id IS NOT NULL GROUP BY 1),
n AS (SELECT c AS id FROM e UNION SELECT p FROM e WHERE p IS NOT NULL),
t AS (SELECT id, id AS root, 0::BIGINT AS depth, id::VARCHAR AS path FROM n WHERE id NOT IN (SELECT c FROM e WHERE p IS NOT NULL)
      UNION ALL SELECT e.c, t.root, t.depth + 1, t.path || '/' || e.c FROM e JOIN t ON e.p = t.id),
rest AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM t)),
walk AS (SELECT c AS id, p AS cur FROM e WHERE c IN (SELECT id FROM rest) UNION SELECT walk.id, e.p FROM walk JOIN e ON e.c = walk.cur),
loops AS (SELECT DISTINCT id FROM walk WHERE id = cur)
"""

ORACLE = {
    "p5_found": _TREE
    + """SELECT id AS function_id, root AS root_id, depth, path AS full_path, 'tree' AS status FROM t
UNION ALL SELECT id, -1, -1, '', CASE WHEN id IN (SELECT id FROM loops) THEN 'on_cycle' ELSE 'below_cycle' END FROM rest""",
    "p5_descendants": _TREE.replace("loops AS", "up AS (SELECT c AS node, p AS ancestor, 1::BIGINT AS distance FROM e WHERE p IS NOT NULL AND c IN (SELECT id FROM t) UNION ALL SELECT up.node, e.p, up.distance + 1 FROM up JOIN e ON e.c = up.ancestor WHERE e.p IS NOT NULL),\nloops AS")
    + "SELECT ancestor, node, distance FROM up",
}
