"""Queries of scenes, colours, identifiers and corpus operations, with their SQL twins.

They use the corpus of ``audit_queries``: ``embeddings`` with its label as cell, a third of the rows deleted by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import canary, generate, health, hubness, ivf, knn, sampling, scene, validate, verdict
from plumbline.plans.audit_queries import _COSINE, _E, _SCENE, _SELF, _SIZES, _U, SEED, batches, corpus, queries, rounded, scene_of, self_neighbours, supplier_sizes, usable
from plumbline.plans.catalogue import query, table
from plumbline.sources.base import fetch_vectors
from plumbline.sources.tables import TableSource

RAMP = ("#0b1d51", "#2aa198", "#f6e58d", "#c0392b")
_STOPS = "[[11, 29, 81], [42, 161, 152], [246, 229, 141], [192, 57, 43]]"


@query("normalised_vectors", f"{_COSINE} SELECT id, list_transform(v, lambda x: round(x, 6)) AS vec FROM u")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable vectors scaled to norm 1, after the check that they have it."""
    unit = ivf.normalised(usable(batches(spark, sf_dir)))
    validate.check_unit(unit)
    return unit.select("id", F.transform("vec", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


@query(
    "batch_validation",
    """WITH b AS (SELECT id, min(struct_pack(t := loaded_at, v := vec)).v AS v FROM vector_batch WHERE id IS NOT NULL GROUP BY 1),
f AS (SELECT coalesce(len(v) = 48, FALSE) AS fits, v IS NULL OR len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS fine, coalesce(len(list_filter(v, lambda x: x <> 0)) = 0, FALSE) AS zero FROM b)
SELECT count(*) AS n_live, count(*) FILTER (WHERE NOT fits) AS n_wrong_dim, count(*) FILTER (WHERE NOT fine) AS n_not_finite, count(*) FILTER (WHERE fits AND fine AND zero) AS n_degenerate FROM f""",
)
def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit would complain of in the stored batches: every sort of dirt occurs."""
    return validate.validation_counts(batches(spark, sf_dir), 48, "COSINE")


@query(
    "colour_ramp",
    f"""WITH {_E}, {_SCENE}, n AS (SELECT id, (partition_id - min(partition_id) OVER ()) / (max(partition_id) OVER () - min(partition_id) OVER ()) AS v FROM s),
t AS (SELECT id, v * 3 AS t, least(floor(v * 3), 2)::INT AS a FROM n), r AS (SELECT id, t, a, {_STOPS} AS stops FROM t)
SELECT id, '#' || lower(printf('%02x%02x%02x', round(stops[a + 1][1] + (stops[a + 2][1] - stops[a + 1][1]) * (t - a))::INT, round(stops[a + 1][2] + (stops[a + 2][2] - stops[a + 1][2]) * (t - a))::INT,
  round(stops[a + 1][3] + (stops[a + 2][3] - stops[a + 1][3]) * (t - a))::INT)) AS colour FROM r""",
)
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = scene.colour_attribute(scene_of(spark, sf_dir), "partition_id")[0]
    return values.select("id", V.colour_ramp(F.col("value"), list(RAMP)).alias("colour"))


_MODES = "SELECT id, 'point_class' AS mode, (cls - min(cls) OVER ()) / nullif(max(cls) OVER () - min(cls) OVER (), 0)::DOUBLE AS value FROM s UNION ALL SELECT id, 'dist_centroid', (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) FROM z UNION ALL SELECT id, 'nk', NULL FROM s"


@query(
    "colour_modes",
    f"WITH {_E}, {_SCENE}, c AS (SELECT avg(x) AS a, avg(y) AS b, avg(z) AS d FROM s), z AS (SELECT id, sqrt(pow(x - a, 2) + pow(y - b, 2) + pow(z - d, 2)) AS d FROM s, c), m AS ({_MODES}) SELECT id, mode, round(value, 6) AS value FROM m",
)
def colour_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other attributes a scene may be coloured by; one that it lacks has no values."""
    s = scene.with_centroid_distance(scene_of(spark, sf_dir))
    parts = [scene.colour_attribute(s, m)[0].select("id", F.lit(m).alias("mode"), F.round("value", 6).alias("value")) for m in ("point_class", "dist_centroid", "nk")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "contrast_of_types",
    """WITH c AS (SELECT DISTINCT '#' || substr(md5(p_type), 1, 6) AS a, '#' || substr(md5(p_brand), 1, 6) AS b FROM part),
k AS (SELECT a, b, [CAST('0x' || substr(a, 2, 2) AS INT), CAST('0x' || substr(a, 4, 2) AS INT), CAST('0x' || substr(a, 6, 2) AS INT)] AS p, [CAST('0x' || substr(b, 2, 2) AS INT), CAST('0x' || substr(b, 4, 2) AS INT), CAST('0x' || substr(b, 6, 2) AS INT)] AS q FROM c),
l AS (SELECT a, b, list_transform(p, lambda x: CASE WHEN x / 255 <= 0.03928 THEN x / 255 / 12.92 ELSE pow((x / 255 + 0.055) / 1.055, 2.4) END) AS p, list_transform(q, lambda x: CASE WHEN x / 255 <= 0.03928 THEN x / 255 / 12.92 ELSE pow((x / 255 + 0.055) / 1.055, 2.4) END) AS q FROM k),
m AS (SELECT a, b, 0.2126 * p[1] + 0.7152 * p[2] + 0.0722 * p[3] AS x, 0.2126 * q[1] + 0.7152 * q[2] + 0.0722 * q[3] AS y FROM l)
SELECT a, b, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) AS contrast FROM m""",
)
def contrast_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of colours that follow from the types and brands of parts."""
    colour = lambda c: F.concat(F.lit("#"), F.substring(F.md5(F.col(c).cast("binary")), 1, 6))
    pairs = table(spark, sf_dir, "part").select(colour("p_type").alias("a"), colour("p_brand").alias("b")).distinct()
    return pairs.select("a", "b", F.round(V.contrast_ratio(F.col("a"), F.col("b")), 6).alias("contrast"))


@query(
    "eased_flight",
    f"WITH {_E}, {_SCENE}, t AS (SELECT id, x, y, partition_id / 10.0 AS t FROM s) SELECT id, round(x + (y - x) * (t * t * (3 - 2 * t)), 6) AS at FROM t",
)
def eased_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eased interpolation between two coordinates."""
    s = scene_of(spark, sf_dir)
    return s.select("id", F.round(V.lerp(F.col("x"), F.col("y"), V.smoothstep(F.col("partition_id") / 10.0)), 6).alias("at"))


@query(
    "camera_targets",
    f"""WITH {_E}, {_SCENE}, w AS (SELECT partition_id FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
k AS (SELECT 'overview' AS name, x, y, z FROM s UNION ALL SELECT 'hub_cluster', x, y, z FROM s WHERE cls = 1 UNION ALL SELECT 'worst_partition', x, y, z FROM s WHERE partition_id = (SELECT partition_id FROM w)),
c AS (SELECT name, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM k GROUP BY 1), r AS (SELECT name, cx, cy, cz, greatest(0.15, max(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)))) AS radius FROM k JOIN c USING (name) GROUP BY 1, 2, 3, 4)
SELECT name, TRUE AS available, round(cx, 6) AS x, round(cy, 6) AS y, round(cz, 6) AS z, round(radius / tan(radians(45) / 2) * 1.25, 6) AS away FROM r UNION ALL SELECT 'antihub_periphery', FALSE, 0, 0, 0, 0""",
)
def camera_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each camera preset looks at and from how far."""
    rows = []
    for p in scene.camera_presets(scene_of(spark, sf_dir)).values():
        away = sum((a - b) ** 2 for a, b in zip(p.position, p.target)) ** 0.5
        rows.append((p.name, p.available, *(round(v, 6) for v in p.target), round(away, 6)))
    return spark.createDataFrame(rows, "name string, available boolean, x double, y double, z double, away double")


@query("chunk_plan", "WITH n AS (SELECT count(DISTINCT id) AS n FROM scene_point), t AS (SELECT least(n, 7000) AS t FROM n) SELECT i AS chunk, CASE WHEN i = 0 THEN least(t, 500) ELSE least(2000, t - 500 - 2000 * (i - 1)) END AS size FROM t, range(100) r(i) WHERE i = 0 AND t > 0 OR t > 500 + 2000 * (i - 1) AND i > 0")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "scene_point").agg(F.countDistinct("id")).first()[0]
    sizes = scene.plan_chunks(n, scene.resolve_budget(7000, 10_000), 500, 2000)
    return spark.createDataFrame(list(enumerate(sizes)), "chunk bigint, size bigint")


@query(
    "chart_partition_sizes",
    f"WITH {_SIZES}, w AS (SELECT CASE WHEN max(size) + 1 <= 64 THEN 1 ELSE ceil((max(size) + 1) / 64)::BIGINT END AS width, max(size) AS mx FROM s), a AS (SELECT unnest(CASE WHEN width = 1 THEN range(0, mx + 1) ELSE [0] END) AS b, width FROM w), h AS (SELECT (size // width) * width AS b, width, count(*) AS n FROM s, w GROUP BY 1, 2) SELECT coalesce(a.b, h.b) AS bucket_start, coalesce(a.width, h.width) AS width, coalesce(n, 0) AS n FROM a FULL JOIN h ON a.b = h.b",
)
def chart_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart of partition sizes of a scene whose points are the line items."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("partition_id"))
    return scene.distribution_charts(points)["partition_sizes"]


@query(
    "churn_skewed",
    f"""WITH {_E.split(',' + chr(10))[0]}, c AS (SELECT cell, row_number() OVER (ORDER BY cell) AS r, count(*) AS n FROM e GROUP BY 1), t AS (SELECT round(0.3 * sum(n)) AS want, sum(1 / r) AS w FROM c),
q AS (SELECT cell, n, want, want / r / w AS raw FROM c, t), f AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY floor(raw) - raw, cell) AS o, want - sum(floor(raw)) OVER () AS extra FROM q),
k AS (SELECT cell, base + CASE WHEN o <= extra THEN 1 ELSE 0 END AS quota FROM f), d AS (SELECT id, e.cell, {_U.format(p="churn", c="id")} AS u, row_number() OVER (PARTITION BY e.cell ORDER BY {_U.format(p="churn", c="id")}, id) AS r, quota FROM e JOIN k ON e.cell = k.cell),
x AS (SELECT id, u, r <= quota AS gone FROM d), l AS (SELECT (SELECT want FROM t) - count(*) FILTER (WHERE gone) AS short FROM x)
SELECT id FROM x WHERE gone UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY u, id) AS i FROM x WHERE NOT gone) z, l WHERE i <= short""",
)
def churn_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions that fall with the rank of the cell, made up where a cell is too small."""
    c = corpus(spark, sf_dir).withColumn("deleted", F.lit(False))
    return generate.apply_churn(c, 0.3, 1.0, SEED).filter("deleted").select("id")


@query("fetched_vectors", f"WITH {_E} SELECT row_number() OVER (ORDER BY {_U.format(p='fetch', c='id')}, id) - 1 AS place, id, list_transform(v, lambda x: round(x, 6)) AS vec FROM e ORDER BY 1 LIMIT 40")
def fetched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the order in which their ids were asked for."""
    c = corpus(spark, sf_dir)
    ids = [r["id"] for r in sampling.sample_ids(c, 40, SEED, "fetch").orderBy(sampling.keyed_hash(SEED, "fetch"), "id").collect()]
    return fetch_vectors(c, ids).select("place", "id", F.transform("vec", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


@query("payload_by_label", f"WITH {_E} SELECT cell, count(*) AS n FROM e GROUP BY 1")
def payload_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload values of a source, counted."""
    src = TableSource(corpus(spark, sf_dir), "embeddings", {"id": "id", "column": "vec", "metric": "COSINE"})
    return src.payload("cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("id_decoding", "SELECT doc_id, source AS key FROM documents")
def id_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to dense ids and back."""
    docs = table(spark, sf_dir, "documents")
    encoded = validate.encode_ids(docs.select(F.col("source").alias("key")))
    numbered = docs.join(encoded, F.col("source") == F.col("key"), "left").select("doc_id", "id")
    return validate.decode_ids(numbered, encoded).select("doc_id", "key")


@query(
    "source_counts",
    f"WITH {_E} SELECT count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS deleted, count(*) AS total, count(*) AS indexed, TRUE AS exact FROM e",
)
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = TableSource(corpus(spark, sf_dir), "embeddings", {"id": "id", "column": "vec", "metric": "COSINE", "deleted": "deleted"})
    return spark.createDataFrame([src.counts()], "live bigint, deleted bigint, total bigint, indexed bigint, exact boolean")


@query(
    "dfi_states",
    f"""WITH {_E}, f AS (SELECT cell, avg(CAST(deleted AS INT)) AS d FROM e GROUP BY 1) SELECT CAST(cell AS VARCHAR) AS fragment, 'dfi' AS metric, round(d, 6) AS value, CASE WHEN d > 0.3 THEN 'FAIL' WHEN d > 0.15 THEN 'WARN' ELSE 'OK' END AS state, 'high' AS evidence, NULL::VARCHAR AS reason FROM f
UNION ALL SELECT 'none', 'dfi', NULL, 'UNAVAILABLE', 'high', 'empty_index' UNION ALL SELECT 'unknown', 'dfi', NULL, 'UNAVAILABLE', 'low', 'deleted_counts_unavailable'""",
)
def dfi_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every fragment, of an empty index and of one that cannot count its deletions."""
    c = corpus(spark, sf_dir)
    parts = health.dfi_by_fragment(c, "cell").filter("fragment <> 'ALL'")
    named = lambda rows, name, **kw: health.dfi_metric(rows, **kw).select(F.lit(name).alias("fragment"), "metric", "value", "state", "evidence", "reason")
    limits = health.evaluate(F.col("dfi"), F.lit(0.15), F.lit(0.30), F.lit("higher_is_worse"))
    rows = parts.select("fragment", F.lit("dfi").alias("metric"), F.col("dfi").alias("value"), limits.alias("state"), F.lit("high").alias("evidence"), F.lit(None).cast("string").alias("reason"))
    every = rows.unionByName(named(health.dfi_total(c.limit(0)), "none")).unionByName(named(health.dfi_total(c), "unknown", exact=False, capable=False))
    return rounded(every, "value")


@query(
    "run_comparability",
    """WITH r AS (SELECT engine, metric_space, dimension, index_kind FROM audit_run WHERE run_id IS NOT NULL GROUP BY ALL), p AS (SELECT a.engine AS e1, b.engine AS e2, a.metric_space AS m1, b.metric_space AS m2, a.dimension AS d1, b.dimension AS d2, a.index_kind AS k1, b.index_kind AS k2 FROM r a, r b)
SELECT e1 IS DISTINCT FROM e2 AS engine, k1 IS DISTINCT FROM k2 AS index_kind, m1 IS DISTINCT FROM m2 AS metric_space, d1 IS DISTINCT FROM d2 AS dimension, count(*) AS n FROM p GROUP BY 1, 2, 3, 4""",
)
def run_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two kinds of stored runs differ in each field that makes them incomparable; the kinds are a short list."""
    fields = ("engine", "index_kind", "metric_space", "dimension")
    kinds = [r.asDict() for r in table(spark, sf_dir, "audit_run").filter("run_id IS NOT NULL").select(*fields).distinct().collect()]
    found: dict[tuple, int] = {}
    for a in kinds:
        for b in kinds:
            bad = verdict.comparable(a, b)
            key = tuple(f in bad for f in fields)
            found[key] = found.get(key, 0) + 1
    return spark.createDataFrame([(*k, n) for k, n in found.items()], ", ".join(f"{f} boolean" for f in fields) + ", n bigint")


@query(
    "count_changes",
    """WITH c AS (SELECT sum(live)::BIGINT AS live, sum(deleted)::BIGINT AS deleted, sum(total)::BIGINT AS total FROM audit_run WHERE run_id % 2 = 0), b AS (SELECT sum(live)::BIGINT AS live, sum(deleted)::BIGINT AS deleted, sum(total)::BIGINT AS total FROM audit_run WHERE run_id % 2 = 1)
SELECT 'deleted' AS name, c.deleted - b.deleted AS change FROM c, b UNION ALL SELECT 'live', c.live - b.live FROM c, b UNION ALL SELECT 'total', c.total - b.total FROM c, b""",
)
def count_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the summed index counts from the odd runs to the even ones."""
    rows = table(spark, sf_dir, "audit_run")
    side = lambda odd: rows.filter(F.col("run_id") % 2 == odd).agg(*[F.sum(c).alias(c) for c in ("live", "deleted", "total")]).first().asDict()
    return spark.createDataFrame(list(verdict.count_deltas(side(0), side(1)).items()), "name string, change bigint")


@query(
    "hubness_states",
    f"""{_SELF}, t AS (SELECT count(*) AS s, sum(n_k) AS total, avg(CASE WHEN n_k = 0 THEN 1.0 ELSE 0.0 END) AS never FROM nk), h AS (SELECT sum(n_k) AS top FROM (SELECT n_k, row_number() OVER (ORDER BY n_k DESC) AS r FROM nk), t WHERE r <= ceil(s * 0.01)),
v AS (SELECT 'hub_share_top1pct' AS metric, top / total AS value, 0.20 AS warn, 0.35 AS fail, s FROM t, h UNION ALL SELECT 'antihub_fraction', never, 0.25, 0.40, s FROM t)
SELECT metric, round(value, 6) AS value, CASE WHEN s >= 10000 THEN 'medium' ELSE 'low' END AS evidence, s <> 20000 AS uncalibrated, CASE WHEN value > fail THEN 'FAIL' WHEN value > warn THEN 'WARN' ELSE 'OK' END AS state, NULL::VARCHAR AS reason FROM v""",
)
def hubness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hubness metrics with the guard of small samples waived."""
    c = corpus(spark, sf_dir)
    stats = hubness.statistics(hubness.n_k(self_neighbours(c), c))
    return rounded(hubness.metrics(stats, 10, {"hub_share_top1pct": (0.20, 0.35), "antihub_fraction": (0.25, 0.40)}, enforce_min_sample=False), "value")


@query(
    "nk_total",
    f"{_SELF} SELECT count(*) AS s, sum(n_k)::BIGINT AS total FROM nk",
)
def nk_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariant of neighbour counts: as many namings as members times k."""
    c = corpus(spark, sf_dir)
    return hubness.assert_total(hubness.n_k(self_neighbours(c), c), 10)


@query(
    "eligible_ids",
    f"WITH {_E}, a AS (SELECT * FROM e WHERE cell IN (2, 5, 7)), p AS (SELECT id AS qid, v AS qv FROM a ORDER BY {_U.format(p='canary', c='id')}, id LIMIT 200), t AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(qv, v), 12), id) AS r FROM p, a WHERE id <> qid) SELECT qid, count(*) AS n, round(sum(r)::DOUBLE, 6) AS ranks, min(id) AS first_id FROM t WHERE r <= 10 GROUP BY 1",
)
def eligible_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the rows of a few payload values only."""
    c = corpus(spark, sf_dir)
    keep = c.filter(F.col("cell").isin(2, 5, 7)).select("id")
    rows = c.join(keep, "id", "left_semi")
    found = knn.exact_knn(rows, queries(rows), 10)
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("rank") + 1).cast("double"), 6).alias("ranks"), F.min("id").alias("first_id"))


@query("largest_suppliers", f"WITH {_SIZES} SELECT cell, size FROM s ORDER BY size DESC, cell LIMIT 25")
def largest_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.largest_cells(supplier_sizes(spark, sf_dir), 25)


@query(
    "group_query_sets",
    f"WITH e AS (SELECT vec_id AS id, label::BIGINT AS grp FROM embeddings) SELECT grp, id AS qid FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_U.format(p='group', c='id')}, id) AS r FROM e) WHERE r <= 7",
)
def group_query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that a grouped canary asks of each payload value."""
    return canary.group_queries(corpus(spark, sf_dir).withColumn("payload", F.col("cell")), "payload", 7, SEED).select("grp", "qid")
