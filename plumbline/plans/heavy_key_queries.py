"""Queries on skewed keys of scene points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import heavy_keys
from plumbline.plans.catalogue import query, table

_POINTS = """points AS (
  SELECT field_name, key_value, id, min(CASE WHEN isnan(d) THEN NULL ELSE d END) AS d FROM (
    SELECT 'partition_id' AS field_name, CAST(partition_id AS BIGINT) AS key_value, id, CAST(dist_centroid AS DOUBLE) AS d FROM scene_point
    UNION ALL SELECT 'nk', CAST(nk AS BIGINT), id, CAST(dist_centroid AS DOUBLE) FROM scene_point) WHERE id IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "p2_found",
    f"""WITH {_POINTS}, total AS (SELECT count(DISTINCT id) AS t FROM scene_point)
SELECT field_name, key_value FROM points, total WHERE key_value IS NOT NULL GROUP BY 1, 2, t HAVING count(*) > 0.04 * t""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.heavy_values(table(spark, sf_dir, "scene_point"))


@query("p2_key_stats", f"WITH {_POINTS} SELECT field_name, key_value, count(*) AS n_points, round(avg(d), 6) AS dist_avg FROM points GROUP BY 1, 2")
def p2_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = heavy_keys.scene_key_stats(table(spark, sf_dir, "scene_point"))
    return stats.select("field_name", "key_value", "n_points", F.round("value_avg", 6).alias("dist_avg"))


@query(
    "p2_above_mean",
    f"""WITH {_POINTS}, m AS (SELECT field_name, key_value, count(*) AS n_points, avg(d) AS a FROM points GROUP BY 1, 2)
SELECT p.field_name, p.key_value, m.n_points, sum(CASE WHEN p.d > m.a THEN 1 ELSE 0 END)::BIGINT AS n_above
FROM points p JOIN m ON p.field_name = m.field_name AND p.key_value IS NOT DISTINCT FROM m.key_value GROUP BY 1, 2, 3""",
)
def p2_above_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.points_above_mean(table(spark, sf_dir, "scene_point"))
