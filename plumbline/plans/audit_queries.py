"""Queries of the audit operators on the test tables, with their SQL twins.

``embeddings`` is the corpus (unit vectors, so COSINE), its label the IVF cell and payload; tombstones are the rows whose
keyed md5 number is below 0.35; queries are the first 200 ids by keyed md5, as many
as an audit takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import all_finite, is_zero
from plumbline.operators import canary, health, hubness, ivf, knn, probe, sampling, scene, validate, verdict
from plumbline.plans.catalogue import query, table
from plumbline.session import materialise
from plumbline.sources.tables import TableSource

SEED, K, N_QUERIES, NPROBE, EF = 1337, 10, 200, 2, 16
THRESHOLDS = {"hub_share_top1pct": (0.20, 0.35), "antihub_fraction": (0.25, 0.40)}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vec, cell, deleted)``."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("cell"))
    return e.withColumn("deleted", sampling.keyed_hash(SEED, "churn") < 0.35)


def queries(rows: DataFrame) -> DataFrame:
    """The query set, evaluated once."""
    return materialise(sampling.sample_ids(rows, N_QUERIES, SEED, "canary").select(F.col("id").alias("qid"), "vec"), "queries")


def engine(rows: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """The IVF's own answers: asked for one more, without the query itself."""
    return ivf.drop_self(ivf.ivf_search(rows.withColumn("deleted", F.lit(False)), ivf.partition_centroids(rows, False), asked, k + 1, NPROBE), k)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_U = "CAST('0x' || substr(md5('1337:{p}:' || {c}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
_E = f"""e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS cell, {_U.format(p="churn", c="vec_id")} < 0.35 AS deleted FROM embeddings),
q AS (SELECT id AS qid, v AS qv FROM e ORDER BY {_U.format(p="canary", c="id")}, id LIMIT 200)"""
_CENT = """cent AS (SELECT cell, list(m ORDER BY pos) AS c FROM (SELECT cell, pos, avg(x) AS m FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2) GROUP BY 1),
probed AS (SELECT qid, qv, cell FROM (SELECT qid, qv, cent.cell, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(qv, c), 12), cent.cell) AS r FROM q, cent) WHERE r <= 2)"""


def _knn(name: str, source: str = "e", metric: str = "COSINE", k: int = K, queries_: str = "q") -> str:
    d = {"COSINE": "1 - list_dot_product(qv, v)", "DOT": "-list_dot_product(qv, v)", "L2": "list_distance(qv, v)"}[metric]
    return f"""{name} AS (SELECT qid, r - 1 AS rank, id, dist FROM (SELECT qid, id, round({d}, 12) AS dist, row_number() OVER (PARTITION BY qid ORDER BY round({d}, 12), id) AS r
  FROM {queries_}, {source} WHERE id <> qid) WHERE r <= {k})"""


_GOT = """got AS (SELECT qid, r - 1 AS rank, id, dist FROM (SELECT qid, e.id, round(1 - list_dot_product(qv, v), 12) AS dist, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(qv, v), 12), e.id) AS r
  FROM probed JOIN e ON e.cell = probed.cell WHERE e.id <> qid) WHERE r <= 10)"""
_PERQ = """per AS (SELECT q.qid, t.n_eff, coalesce(g.hits, 0) / t.n_eff AS recall_id, least(coalesce(g.near, 0) / t.n_eff, 1.0) AS recall_dist, CAST(coalesce(g.n, 0) < t.n_eff AS INT) AS short_return, coalesce(g.tie, 0) AS boundary_tie
  FROM q JOIN (SELECT qid, max(dist) AS d_k, count(*) AS n_eff FROM truth GROUP BY 1) t ON q.qid = t.qid
  LEFT JOIN (SELECT got.qid, count(*) AS n, count(truth.id) AS hits, sum(CAST(got.dist <= d.d_k + 1e-6 * abs(d.d_k) AS INT)) AS near, max(CAST(got.dist <= d.d_k + 1e-6 * abs(d.d_k) AND truth.id IS NULL AS INT)) AS tie
    FROM got JOIN (SELECT qid, max(dist) AS d_k FROM truth GROUP BY 1) d ON got.qid = d.qid LEFT JOIN truth ON truth.qid = got.qid AND truth.id = got.id GROUP BY 1) g ON g.qid = q.qid)"""
_WITH_CANARY = f"WITH {_E}, {_CENT}, {_knn('truth')}, {_GOT}, {_PERQ}"


@query(
    "vector_validation",
    f"""WITH {_E} SELECT count(*) AS n_live, count(*) FILTER (WHERE len(v) <> 64) AS n_wrong_dim, count(*) FILTER (WHERE len(list_filter(v, lambda x: NOT isfinite(x))) > 0) AS n_not_finite,
count(*) FILTER (WHERE list_dot_product(v, v) = 0) AS n_degenerate FROM e""",
)
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_counts(corpus(spark, sf_dir), 64, "COSINE")


@query("sample_ids", f"WITH {_E} SELECT qid FROM q")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(corpus(spark, sf_dir)).select("qid")


def _exact(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir)
        return rounded(knn.exact_knn(c, queries(c), K, metric), "dist")

    return run


for _m in ("COSINE", "L2", "DOT"):
    query(f"exact_knn_{_m.lower()}", f"WITH {_E}, {_knn('t', metric=_m)} SELECT qid, rank, id, round(dist, 6) AS dist FROM t")(_exact(_m))


@query("knn_strategies_agree", "SELECT 0::BIGINT AS n_differ")
def knn_strategies_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    a, b = (knn.exact_knn(c, queries(c), K, "L2", strategy=s).select("qid", "rank", "id") for s in ("arrow", "expression"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("n_differ"))


@query("ivf_search", f"WITH {_E}, {_CENT}, {_GOT} SELECT qid, rank, id, round(dist, 6) AS dist FROM got")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return rounded(engine(c, queries(c)), "dist")


@query(
    "ivf_tombstoned",
    f"""WITH {_E}, {_CENT.replace("FROM e)", "FROM e WHERE NOT deleted)")},
s AS (SELECT qid, id, deleted, dist FROM (SELECT qid, e.id, deleted, round(1 - list_dot_product(qv, v), 12) AS dist, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(qv, v), 12), e.id) AS r
  FROM probed JOIN e ON e.cell = probed.cell) WHERE r <= 16 AND NOT deleted)
SELECT qid, r - 1 AS rank, id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM s) WHERE r <= 10 AND id <> qid""",
)
def ivf_tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return rounded(ivf.ivf_tombstoned(c, ivf.partition_centroids(c), queries(c), K, NPROBE, EF).filter("id <> qid"), "dist")


def _scored(c: DataFrame) -> DataFrame:
    asked = queries(c)
    return canary.per_query(knn.exact_knn(c, asked, K), engine(c, asked), c, asked, K, "COSINE")


@query("canary_per_query", f"{_WITH_CANARY} SELECT qid, n_eff, round(recall_id, 6) AS recall_id, round(recall_dist, 6) AS recall_dist, short_return, boundary_tie FROM per")
def canary_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(corpus(spark, sf_dir)).select("qid", "n_eff", "recall_id", "recall_dist", "short_return", "boundary_tie"), "recall_id", "recall_dist")


@query(
    "canary_summary",
    f"""{_WITH_CANARY} SELECT 'canary_recall' AS metric, round(avg(recall_dist), 6) AS value, round(avg(recall_id), 6) AS recall_id, count(*) AS n_queries, sum(short_return)::BIGINT AS short_returns,
CASE WHEN count(*) < 30 THEN 'low' ELSE 'medium' END AS evidence, CASE WHEN avg(recall_dist) < 0.7 THEN 'FAIL' WHEN avg(recall_dist) < 0.85 THEN 'WARN' ELSE 'OK' END AS state FROM per""",
)
def canary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = canary.summary(_scored(corpus(spark, sf_dir)))
    return rounded(s.select("metric", "value", "recall_id", "n_queries", "short_returns", "evidence", "state"), "value", "recall_id")


_GROUPED = f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS grp FROM embeddings),
q AS (SELECT grp, id AS qid, v AS qv FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_U.format(p="group", c="id")}, id) AS r FROM e) WHERE r <= 10),
truth AS (SELECT * FROM (SELECT q.grp, qid, id, round(1 - list_dot_product(qv, v), 12) AS dist, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(qv, v), 12), id) AS r FROM q JOIN e ON q.grp = e.grp WHERE id <> qid) WHERE r <= 10),
cent AS (SELECT cell, list(m ORDER BY pos) AS c FROM (SELECT cell, pos, avg(x) AS m FROM (SELECT grp AS cell, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2) GROUP BY 1),
probed AS (SELECT qid, qv, cell FROM (SELECT qid, qv, cent.cell, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(qv, c), 12), cent.cell) AS r FROM q, cent) WHERE r <= 2),
got AS (SELECT * FROM (SELECT qid, e.id, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(qv, v), 12), e.id) AS r FROM probed JOIN e ON e.grp = probed.cell WHERE e.id <> qid) WHERE r <= 10)"""


@query(
    "canary_by_group",
    _GROUPED + """ SELECT q.grp, count(DISTINCT q.qid) AS n_queries, round(count(got.id) / count(truth.id), 6) AS recall_id
FROM q JOIN truth ON q.qid = truth.qid LEFT JOIN got ON got.qid = truth.qid AND got.id = truth.id GROUP BY 1""",
)
def canary_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfiltered answers of the IVF held against the truth within each payload value."""
    c = corpus(spark, sf_dir).withColumn("payload", F.col("cell"))
    asked = canary.group_queries(c, "payload", 10, SEED)
    truth = canary.group_truth(c, "payload", asked, K, "COSINE")
    got = engine(c, asked.select("qid", "vec")).join(asked.select("grp", "qid"), "qid")
    s = canary.summary(canary.per_query(truth, got, c, asked, K, "COSINE", "grp"), 0.85, 0.70, "grp")
    return rounded(s.select("grp", "n_queries", "recall_id"), "recall_id")


@query("canary_filtered", f"""WITH {_E.replace("FROM embeddings", "FROM embeddings WHERE CAST(label AS VARCHAR) = '3'")}, {_knn('t')} SELECT qid, rank, id, round(dist, 6) AS dist FROM t""")
def canary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).filter(validate.payload_equals("cell", "3"))
    return rounded(knn.exact_knn(c, queries(c), K), "dist")


_BOOT = f"""{_WITH_CANARY}, i AS (SELECT recall_dist AS v, row_number() OVER (ORDER BY qid) - 1 AS i FROM per),
d AS (SELECT b, CAST(floor(CAST('0x' || substr(md5('1337:' || b || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * n) AS BIGINT) AS i FROM range(1000) x(b), (SELECT unnest(range(0, count(*))) AS j, count(*) AS n FROM i) y),
m AS (SELECT b, avg(v) AS m FROM d JOIN i USING (i) GROUP BY 1)
SELECT round((SELECT avg(v) FROM i), 6) AS mean, round(least(quantile_cont(m, 0.025), (SELECT avg(v) FROM i)), 6) AS ci_low, round(greatest(quantile_cont(m, 0.975), (SELECT avg(v) FROM i)), 6) AS ci_high FROM m"""


@query("bootstrap_ci", _BOOT)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(canary.bootstrap_ci95(_scored(corpus(spark, sf_dir)).select("qid", "recall_dist")), "mean", "ci_low", "ci_high")


def self_neighbours(c: DataFrame, k: int = K) -> DataFrame:
    return knn.exact_knn(c, c.select(F.col("id").alias("qid"), "vec"), k)


_SELF = f"WITH {_E.split('q AS')[0]} q AS (SELECT id AS qid, v AS qv FROM e), {_knn('nb')}, nk AS (SELECT e.id, count(nb.qid) AS n_k FROM e LEFT JOIN nb ON nb.id = e.id GROUP BY 1)"


@query("hubness_nk", f"{_SELF} SELECT id, n_k FROM nk")
def hubness_nk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return hubness.n_k(self_neighbours(c), c)


@query(
    "hubness_summary",
    f"""{_SELF}, m AS (SELECT count(*) AS s, avg(n_k) AS mu, stddev_pop(n_k) AS sd, quantile_cont(n_k, 0.5) AS med FROM nk)
SELECT (SELECT s FROM m) AS s, round((SELECT sum(n_k) FROM (SELECT n_k, row_number() OVER (ORDER BY n_k DESC) AS r FROM nk) WHERE r <= ceil((SELECT s FROM m) * 0.01)) / sum(n_k), 6) AS hub_share_top1pct,
round(avg(CASE WHEN n_k = 0 THEN 1.0 ELSE 0.0 END), 6) AS antihub_fraction, round(avg(pow((n_k - (SELECT mu FROM m)) / (SELECT sd FROM m), 3)), 6) AS skewness, max(n_k) AS max_nk, round(quantile_cont(n_k, 0.99), 6) AS p99_nk, round(quantile_cont(n_k, 0.5), 6) AS median_nk,
(SELECT count(*) FROM nk WHERE n_k > (SELECT med FROM m) + 5 * (SELECT quantile_cont(abs(n_k - (SELECT med FROM m)), 0.5) FROM nk)) AS mad_outliers FROM nk""",
)
def hubness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return rounded(hubness.statistics(hubness.n_k(self_neighbours(c), c)), "hub_share_top1pct", "antihub_fraction", "skewness", "p99_nk", "median_nk")


@query(
    "hubness_guard",
    "SELECT m AS metric, NULL::DOUBLE AS value, 'UNAVAILABLE' AS state, 'sample_too_small' AS reason FROM (SELECT unnest(['hub_share_top1pct', 'antihub_fraction']) AS m) WHERE (SELECT count(*) FROM embeddings) > 0",
)
def hubness_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample below the guard has no value."""
    c = sampling.sample_ids(corpus(spark, sf_dir), hubness.MIN_SAMPLE - 1, SEED, "hubness")
    m = hubness.metrics(hubness.statistics(hubness.n_k(self_neighbours(c), c)), K, THRESHOLDS)
    return m.select("metric", "value", "state", "reason")


@query(
    "hub_offenders",
    f"""{_SELF} SELECT 'hub' AS kind, id, n_k FROM (SELECT * FROM nk WHERE n_k > 0 ORDER BY n_k DESC, id LIMIT 1000)
UNION ALL SELECT 'antihub', id, n_k FROM (SELECT * FROM nk WHERE n_k = 0 ORDER BY id LIMIT 1000)""",
)
def hub_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return hubness.offenders(hubness.n_k(self_neighbours(c), c))


@query(
    "nk_histogram",
    f"""{_SELF}, w AS (SELECT CASE WHEN max(n_k) + 1 <= 64 THEN 1 ELSE ceil((max(n_k) + 1) / 64)::BIGINT END AS width, max(n_k) AS mx FROM nk),
s AS (SELECT unnest(CASE WHEN width = 1 THEN range(0, mx + 1) ELSE [0] END) AS bucket_start, width FROM w), h AS (SELECT (n_k // width) * width AS bucket_start, width, count(*) AS n FROM nk, w GROUP BY 1, 2)
SELECT coalesce(s.bucket_start, h.bucket_start) AS bucket_start, coalesce(s.width, h.width) AS width, coalesce(n, 0) AS n FROM s FULL JOIN h ON s.bucket_start = h.bucket_start""",
)
def nk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return hubness.histogram(hubness.n_k(self_neighbours(c), c), "n_k")


@query("duplicate_vectors", "SELECT (count(*) - count(DISTINCT embedding))::BIGINT + (SELECT count(*) FROM embeddings WHERE label = 0) AS n_duplicates FROM embeddings")
def duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    copies = c.filter("cell = 0").withColumn("id", F.col("id") + 1_000_000)
    return hubness.duplicate_vectors(c.unionByName(copies))


@query("norm_ratio", "WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT round(quantile_cont(n, 0.99) / quantile_cont(n, 0.5), 6) AS norm_p99_ratio FROM n")
def norm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hubness.norm_ratio(corpus(spark, sf_dir)), "norm_p99_ratio")


@query("dfi_total", f"WITH {_E} SELECT count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS dead, round(avg(CAST(deleted AS INT)), 6) AS dfi FROM e")
def dfi_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.dfi_total(corpus(spark, sf_dir)), "dfi")


@query("dfi_by_fragment", f"WITH {_E} SELECT coalesce(CAST(cell AS VARCHAR), 'ALL') AS fragment, count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS dead, round(avg(CAST(deleted AS INT)), 6) AS dfi FROM e GROUP BY ROLLUP (cell)")
def dfi_by_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.dfi_by_fragment(corpus(spark, sf_dir), "cell"), "dfi")


_SIZES = "s AS (SELECT l_suppkey AS cell, count(*) AS size FROM lineitem GROUP BY 1)"


def supplier_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(F.count(F.lit(1)).alias("size"))


@query(
    "partition_cv",
    f"WITH {_SIZES} SELECT count(*) AS n_cells, sum(size)::BIGINT AS total, round(stddev_pop(size) / avg(size), 6) AS cv, round(max(size) / avg(size), 6) AS max_over_mean, round(quantile_cont(size, 0.99) / avg(size), 6) AS p99_over_mean, round(avg(CASE WHEN size = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_fraction FROM s",
)
def partition_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.partition_statistics(supplier_sizes(spark, sf_dir)).drop("gini"), "cv", "max_over_mean", "p99_over_mean", "empty_fraction")


@query("partition_gini", f"WITH {_SIZES}, r AS (SELECT size, row_number() OVER (ORDER BY size) AS i, count(*) OVER () AS n, sum(size) OVER () AS t FROM s) SELECT round(max((2 * x - (n + 1) * t) / (n * t)), 6) AS gini FROM (SELECT sum(i * size) OVER () AS x, n, t FROM r)")
def partition_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.partition_statistics(supplier_sizes(spark, sf_dir)).select("gini"), "gini")


@query("partition_top10", f"WITH {_SIZES} SELECT cell, size FROM s ORDER BY size DESC, cell LIMIT 10")
def partition_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.largest_cells(supplier_sizes(spark, sf_dir))


@query("cell_sizes", f"WITH {_E} SELECT c AS cell, count(e.id) AS size FROM range(12) t(c) LEFT JOIN e ON e.cell = t.c AND NOT deleted GROUP BY 1")
def cell_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.cell_sizes(corpus(spark, sf_dir), 12)


@query("partition_centroids", f"WITH {_E}, {_CENT.split(',' + chr(10))[0].replace('FROM e)', 'FROM e WHERE NOT deleted)')} SELECT cell, list_transform(c, lambda x: round(x, 6)) AS centroid FROM cent")
def partition_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ivf.partition_centroids(corpus(spark, sf_dir))
    return c.select("cell", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("kmeans_assign", f"WITH {_E}, {_CENT.split(',' + chr(10))[0]} SELECT id, cell FROM (SELECT id, cent.cell, row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c), 12), cent.cell) AS r FROM e, cent) WHERE r = 1")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return ivf.assign_cells(c, ivf.partition_centroids(c, False), "L2")


@query(
    "kmeans_round",
    f"""WITH {_E}, c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cell, v AS c FROM (SELECT id, v FROM e ORDER BY {_U.format(p="kmeans", c="id")}, id LIMIT 8)),
a AS (SELECT id, v, cell FROM (SELECT id, v, c0.cell, row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c), 12), c0.cell) AS r FROM e, c0) WHERE r = 1),
m AS (SELECT cell, list(round(x, 6) ORDER BY pos) AS centroid FROM (SELECT cell, pos, avg(x) AS x FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a) GROUP BY 1, 2) GROUP BY 1)
SELECT c0.cell, coalesce(m.centroid, list_transform(c0.c, lambda x: round(x, 6))) AS centroid FROM c0 LEFT JOIN m ON c0.cell = m.cell""",
)
def kmeans_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroids after one round from a seeded start."""
    c = ivf.kmeans(corpus(spark, sf_dir), 8, rounds=1, seed=SEED)
    return c.select("cell", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("kmeans_fit")
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return ivf.assign_cells(c, ivf.kmeans(c, 8), "L2").groupBy("cell").agg(F.count(F.lit(1)).alias("size"))


@query(
    "probe_roles",
    f"""WITH {_E}, {_CENT}, live AS (SELECT * FROM e WHERE NOT deleted), {_knn('truth', 'live')}, {_GOT}
SELECT coalesce(t.qid, g.qid) AS qid, coalesce(t.id, g.id) AS id, CASE WHEN t.id IS NOT NULL AND g.id IS NOT NULL THEN 'hit' WHEN t.id IS NOT NULL THEN 'missed' WHEN e.deleted THEN 'dead' ELSE 'unexpected' END AS role
FROM truth t FULL JOIN got g ON t.qid = g.qid AND t.id = g.id JOIN e ON e.id = coalesce(t.id, g.id)""",
)
def probe_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    asked = queries(c)
    return probe.probe_roles(knn.exact_knn(c.filter("NOT deleted"), asked, K), engine(c, asked), c)


@query(
    "hub_cannibalisation",
    f"""{_SELF}, h AS (SELECT id, n_k FROM nk ORDER BY n_k DESC, id LIMIT 5)
SELECT h.id, h.n_k, h.n_k > 500 AS truncated, list(nb.qid ORDER BY nb.qid)[1:500] AS qids FROM h JOIN nb ON nb.id = h.id GROUP BY 1, 2""",
)
def hub_cannibalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    nb = self_neighbours(c)
    return probe.hub_cannibalisation(nb, hubness.offenders(hubness.n_k(nb, c), 5).filter("kind = 'hub'"))


@query("ghost_neighbourhood", f"WITH {_E}, {_knn('t')} SELECT qid, count(*) AS n, count(*) FILTER (WHERE NOT deleted) AS n_live, count(*) FILTER (WHERE deleted) AS n_dead, round(avg(CAST(deleted AS INT)), 6) AS blocked_fraction FROM t JOIN e USING (id) GROUP BY 1")
def ghost_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return rounded(probe.ghost_neighbourhood(knn.exact_knn(c, queries(c), K), c), "blocked_fraction")


def scene_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene whose positions are the first three coordinates; hubs are cell 0, tombstones the deleted rows."""
    c = corpus(spark, sf_dir)
    cls = F.when(F.col("deleted"), 3).when(F.col("cell") == 0, 1).otherwise(0).cast("tinyint")
    return c.select("id", *[F.col("vec")[i].cast("double").alias(a) for i, a in enumerate("xyz")], cls.alias("point_class"), F.col("cell").cast("int").alias("partition_id"))


_SCENE = f"""s AS (SELECT id, v[1] AS x, v[2] AS y, v[3] AS z, CASE WHEN deleted THEN 3 WHEN cell = 0 THEN 1 ELSE 0 END AS cls, cell AS partition_id, {_U.format(p="scene", c="id")} AS u FROM e)"""
_VOX = "least(greatest(floor((x + 1) * 0.5 * 11), 0), 10) * 121 + least(greatest(floor((y + 1) * 0.5 * 11), 0), 10) * 11 + least(greatest(floor((z + 1) * 0.5 * 11), 0), 10)"


@query(
    "voxel_decimate",
    f"""WITH {_E}, {_SCENE}, p AS (SELECT id FROM s WHERE cls IN (1, 2, 4, 5, 6, 7)), b AS (SELECT 200 - (SELECT count(*) FROM p) AS n),
o AS (SELECT *, row_number() OVER (PARTITION BY {_VOX.replace("11)", "g)").replace("10)", "g - 1)").replace("* 121", "* g * g").replace("* 11 +", "* g +")} ORDER BY id) = 1 AS rep FROM s, (SELECT greatest(8, least(256, round(pow(greatest(1, n) * 8, 1.0 / 3)))) AS g FROM b) WHERE cls IN (0, 3)),
r AS (SELECT id, row_number() OVER (ORDER BY NOT rep, u, id) AS i FROM o)
SELECT id FROM p UNION ALL SELECT id FROM r, b WHERE i <= n""",
)
def voxel_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.decimate(scene_of(spark, sf_dir), 200, SEED).select("id")


@query("scene_classes", f"WITH {_E}, {_SCENE} SELECT cls::TINYINT AS point_class, count(*) AS n FROM s GROUP BY 1")
def scene_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene_of(spark, sf_dir).groupBy("point_class").agg(F.count(F.lit(1)).alias("n"))


@query("centroid_distance", f"WITH {_E}, {_SCENE}, c AS (SELECT avg(x) AS a, avg(y) AS b, avg(z) AS d FROM s) SELECT id, round(sqrt(pow(x - a, 2) + pow(y - b, 2) + pow(z - d, 2)), 6) AS dist_centroid FROM s, c")
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scene.with_centroid_distance(scene_of(spark, sf_dir)).select("id", "dist_centroid"), "dist_centroid")


@query("colour_attribute", f"WITH {_E}, {_SCENE}, n AS (SELECT min(partition_id) AS lo, max(partition_id) AS hi FROM s) SELECT id, round((partition_id - lo) / (hi - lo), 6) AS value FROM s, n")
def colour_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scene.colour_attribute(scene_of(spark, sf_dir), "partition_id")[0], "value")


@query("worst_partition", f"WITH {_E}, {_SCENE} SELECT partition_id::INT AS partition_id, count(*) AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def worst_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.worst_partition(scene_of(spark, sf_dir))


@query("pca_projection")
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import projection

    c = corpus(spark, sf_dir)
    return projection.transform(c, projection.fit(c)).withColumns({a: F.round(a, 4) for a in "xyz"})


@query(
    "pca_variance",
    f"""WITH {_E}, x AS (SELECT generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e)
SELECT round(sum(s), 6) AS total_variance, TRUE AS orthonormal, TRUE AS eigenvectors FROM (SELECT pos, var_samp(x) AS s FROM x GROUP BY 1)""",
)
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variance by the fitted ratios, whether the basis is orthonormal, and whether it projects to the variances it claims."""
    from plumbline.operators import projection

    c = corpus(spark, sf_dir)
    p = projection.fit(c)
    top = p.scale**2 / 3
    total = top / p.explained[0]
    held = [[float(v) for v in p.basis[:, i]] for i in range(3)]
    along = c.select(*[F.aggregate(F.zip_with("vec", F.lit(h), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x).alias(f"c{i}") for i, h in enumerate(held)])
    seen = along.agg(*[F.var_samp(f"c{i}").alias(f"v{i}") for i in range(3)], *[F.covar_samp(f"c{i}", f"c{j}").alias(f"k{i}{j}") for i in range(3) for j in range(i)])
    fits = F.lit(True)
    for i in range(3):
        fits = fits & (F.abs(F.col(f"v{i}") - p.explained[i] * total) < 1e-6 * total)
        for j in range(i):
            fits = fits & (F.abs(f"k{i}{j}") < 1e-6 * total)
    orthonormal = bool(abs(p.basis.T @ p.basis - projection.np.eye(3)).max() < 1e-9)
    return seen.select(F.round(F.lit(total), 6).alias("total_variance"), F.lit(orthonormal).alias("orthonormal"), fits.alias("eigenvectors"))


_REPORTED = """r AS (SELECT run_id, lower(regexp_replace(metric_id, '^\\s+|\\s+$', '', 'g')) AS metric, min(struct_pack(t := reported_at, v := metric_value, w := thresholds.warn, f := thresholds.fail, d := thresholds.direction, e := evidence_strength)) AS x FROM metric_result GROUP BY 1, 2),
m AS (SELECT run_id, metric, CASE WHEN isfinite(x.v) THEN x.v END AS value, x.e AS evidence, x.w AS warn, x.f AS fail, CASE WHEN x.d = 'lower_is_worse' THEN -1 ELSE 1 END AS sign FROM r),
st AS (SELECT *, CASE WHEN value IS NULL THEN 'UNAVAILABLE' WHEN value * sign > fail * sign THEN 'FAIL' WHEN value * sign > warn * sign THEN 'WARN' ELSE 'OK' END AS state FROM m)"""


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, metric, value, evidence, state)`` of the stored reports, each (run, metric) at its first report, evaluated anew."""
    name = F.lower(F.regexp_replace("metric_id", r"^\s+|\s+$", ""))
    first = F.min(F.struct("reported_at", "metric_value", "thresholds.warn", "thresholds.fail", "thresholds.direction", "evidence_strength")).alias("r")
    rows = table(spark, sf_dir, "metric_result").groupBy("run_id", name.alias("metric")).agg(first)
    value = F.when(~F.isnan("r.metric_value") & (F.abs("r.metric_value") < float("inf")), F.col("r.metric_value"))
    state = F.coalesce(verdict.evaluate(value, F.col("r.warn"), F.col("r.fail"), F.col("r.direction")), F.lit("UNAVAILABLE"))
    return rows.select("run_id", "metric", value.alias("value"), F.col("r.evidence_strength").alias("evidence"), state.alias("state"))


@query("metric_states", f"WITH {_REPORTED} SELECT run_id, metric, value, evidence, state FROM st")
def metric_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(spark, sf_dir)


_VERDICT = """CASE max(CASE WHEN state = 'FAIL' AND evidence = 'low' THEN 1 WHEN state = 'FAIL' THEN 2 WHEN state = 'WARN' THEN 1 WHEN state = 'OK' THEN 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN'
  ELSE CASE WHEN count(*) FILTER (WHERE state = 'UNAVAILABLE') > 0 THEN 'INCONCLUSIVE' ELSE 'OK' END END"""


@query(
    "verdict_rollup",
    f"""WITH {_REPORTED}, v AS (SELECT run_id, {_VERDICT} AS verdict, count(*) FILTER (WHERE state <> 'UNAVAILABLE') AS n_checked, count(*) FILTER (WHERE state = 'UNAVAILABLE') AS n_unavailable FROM st GROUP BY 1)
SELECT run_id, verdict, CASE verdict WHEN 'OK' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END AS exit_code, n_checked, n_unavailable FROM v""",
)
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every stored run."""
    return verdict.aggregate(reported(spark, sf_dir), False, "run_id")


@query(
    "baseline_delta",
    """WITH r AS (SELECT run_id, trim(lower(regexp_replace(metric_id, '^\\s+|\\s+$', '', 'g'))) AS metric, min(struct_pack(t := reported_at, v := metric_value)) AS x FROM metric_result GROUP BY 1, 2),
v AS (SELECT run_id, metric, CASE WHEN isfinite(x.v) THEN x.v END AS value FROM r), c AS (SELECT metric, avg(value) AS cur FROM v WHERE run_id % 2 = 0 GROUP BY 1), b AS (SELECT metric, avg(value) AS base FROM v WHERE run_id % 2 = 1 GROUP BY 1),
d AS (SELECT coalesce(c.metric, b.metric) AS metric, cur, base, cur - base AS delta FROM c FULL JOIN b ON c.metric = b.metric),
t AS (SELECT * FROM (VALUES ('canary_recall', 0.05, 0.10, -1), ('hub_share_top1pct', 0.05, 0.10, 1), ('antihub_fraction', 0.05, 0.10, 1), ('dfi', 0.05, 0.10, 1), ('partition_size_cv', 0.20, 0.40, 1)) x(metric, warn, fail, sign))
SELECT d.metric, round(cur, 6) AS current_value, round(base, 6) AS baseline_value, round(delta, 6) AS delta, CASE WHEN delta IS NULL OR sign IS NULL THEN 'UNAVAILABLE' WHEN round(delta, 9) * sign > fail THEN 'FAIL' WHEN round(delta, 9) * sign > warn THEN 'WARN' ELSE 'OK' END AS delta_state FROM d LEFT JOIN t ON d.metric = t.metric""",
)
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metric values of the odd runs as baseline of the even ones."""
    name = F.lower(F.regexp_replace("metric_id", r"^\s+|\s+$", ""))
    rows = table(spark, sf_dir, "metric_result").groupBy("run_id", name.alias("metric")).agg(F.min(F.struct("reported_at", "metric_value")).alias("r"))
    v = rows.select("run_id", "metric", F.when(~F.isnan("r.metric_value") & (F.abs("r.metric_value") < float("inf")), F.col("r.metric_value")).alias("value"))
    mean = lambda odd: v.filter(F.col("run_id") % 2 == odd).groupBy("metric").agg(F.avg("value").alias("value"))
    return rounded(verdict.baseline_delta(mean(0), mean(1)), "current_value", "baseline_value", "delta")


@query("churn_exact", f"WITH {_E.split(',' + chr(10))[0]}, r AS (SELECT id, row_number() OVER (ORDER BY {_U.format(p='churn', c='id')}, id) AS i, count(*) OVER () AS n FROM e) SELECT id FROM r WHERE i <= round(0.35 * n)")
def churn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import generate

    c = corpus(spark, sf_dir).withColumn("deleted", F.lit(False))
    return generate.apply_churn(c, 0.35, 0.0, SEED).filter("deleted").select("id")


@query("id_encoding", "SELECT source AS key, dense_rank() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def id_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.encode_ids(table(spark, sf_dir, "documents").select(F.col("source").alias("key")))


@query(
    "windowed_dfi",
    """SELECT date_trunc('hour', ts) AS window_start, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS inserted, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS deleted,
round(sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 0 END), 0), 6) AS dfi FROM events GROUP BY 1""",
)
def windowed_dfi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change stream: views insert, errors delete."""
    from plumbline.streaming import dfi

    op = F.when(F.col("event_type") == "view", "insert").when(F.col("event_type") == "error", "delete").otherwise("other")
    return rounded(dfi.windowed_dfi(table(spark, sf_dir, "events").select("ts", op.alias("op"))), "dfi")


_POINTS = f"""p AS (SELECT id, min(struct_pack(t := loaded_at, x := x, y := y, z := z, c := point_class)) AS r FROM scene_point WHERE id IS NOT NULL GROUP BY 1),
s AS (SELECT id, r.x::DOUBLE AS x, r.y::DOUBLE AS y, r.z::DOUBLE AS z, coalesce(r.c IN (1, 2, 4, 5, 6, 7), FALSE) AS first, {_U.format(p="scene", c="id")} AS u FROM p)"""


def stored_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored points of all runs as one scene, each id once."""
    rows = table(spark, sf_dir, "scene_point").filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("loaded_at", "x", "y", "z", "point_class")).alias("r"))
    return rows.select("id", *[F.col(f"r.{a}").cast("double").alias(a) for a in "xyz"], F.coalesce("r.point_class", F.lit(0)).cast("tinyint").alias("point_class"))


@query("scene_chunk", f"WITH {_POINTS}, r AS (SELECT id, row_number() OVER (ORDER BY NOT first, u, id) AS i FROM s) SELECT id FROM r WHERE i > 200 AND i <= 700")
def scene_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second chunk of a scene that fits the budget as a whole, at chunks of 200 and 500 points."""
    return scene.chunk(stored_scene(spark, sf_dir), scene.HARD_BUDGET, 1, SEED, 200, 500).select("id")


@query(
    "scene_classify",
    f"""{_SELF}, h AS (SELECT id FROM nk WHERE n_k > 0 ORDER BY n_k DESC, id LIMIT 40), a AS (SELECT id FROM nk WHERE n_k = 0)
SELECT id, (CASE WHEN deleted THEN 3 WHEN id IN (SELECT id FROM h) THEN 1 WHEN id IN (SELECT id FROM a) THEN 2 ELSE 0 END)::TINYINT AS point_class FROM e""",
)
def scene_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes from the tombstones, the forty largest hubs and every anti-hub."""
    c = corpus(spark, sf_dir)
    nk = materialise(hubness.n_k(self_neighbours(c), c), "nk")
    return scene.classify(c.select("id", "deleted"), hubness.offenders(nk, 40).filter("kind = 'hub'"), nk.filter("n_k = 0")).select("id", "point_class")


# --- dirty vectors of differing norms --------------------------------------------------------------------------------

_BATCH = """b AS (SELECT id, min(struct_pack(t := loaded_at, v := vec)).v::DOUBLE[] AS v FROM vector_batch WHERE id IS NOT NULL AND len(vec) = 48 GROUP BY 1),
f AS (SELECT id, v FROM b WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 48)"""
_PICK = f"q AS (SELECT id AS qid, v AS qv FROM u ORDER BY {_U.format(p='canary', c='id')}, id LIMIT 200)"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_batch`` as it was first loaded, every id once, dirty vectors included."""
    return table(spark, sf_dir, "vector_batch").filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("loaded_at", "vec")).alias("r")).select("id", F.col("r.vec").alias("vec"))


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter((F.size("vec") == 48) & all_finite("vec") & ~is_zero("vec"))


@query("exact_knn_dirty", f"WITH {_BATCH}, u AS (SELECT * FROM f WHERE list_dot_product(v, v) > 0), {_PICK}, {_knn('t', 'f', 'L2')} SELECT qid, rank, id, round(dist, 4) AS dist FROM t")
def exact_knn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, short, NaN and infinite vectors stand among the rows and take no part."""
    rows = batches(spark, sf_dir)
    return knn.exact_knn(rows, queries(usable(rows)), K, "L2").withColumn("dist", F.round("dist", 4))


_COSINE = f"""WITH {_BATCH}, u AS (SELECT id, list_transform(v, lambda x: (x / n)::FLOAT::DOUBLE) AS v FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM f) WHERE n > 0), {_PICK}, {_knn('t', 'u')}"""


@query("engine_exact_cosine", f"{_COSINE} SELECT qid, rank, id, round(dist, 6) AS dist FROM t")
def engine_exact_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat source under COSINE answers by angle, whatever the norms of its rows and queries."""
    rows = batches(spark, sf_dir)
    source = TableSource(rows.filter(F.size("vec") == 48), "vector_batch", {"id": "id", "column": "vec", "metric": "COSINE"})
    return rounded(ivf.drop_self(source.search(queries(usable(rows)), K + 1), K), "dist")


@query(
    "canary_counters",
    f"""{_COSINE}, g AS (SELECT qid, rank, CASE WHEN rank = 3 THEN -1 WHEN rank = 5 THEN first_value(id) OVER (PARTITION BY qid ORDER BY rank) WHEN rank = 7 THEN 4000000000000 + qid ELSE id END AS id FROM t WHERE rank < 9),
o AS (SELECT qid, id, count(*) - 1 AS dup FROM g WHERE id >= 0 GROUP BY 1, 2)
SELECT o.qid, count(*) AS n_returned, sum(dup)::BIGINT AS n_duplicate, count(*) FILTER (WHERE t.id IS NULL)::BIGINT AS n_invalid, 1 AS short_return, round(count(t.id) / 10, 6) AS recall_id FROM o LEFT JOIN t ON t.qid = o.qid AND t.id = o.id GROUP BY 1""",
)
def canary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with padding, a repeated and an unknown id, one place short."""
    rows = ivf.normalised(usable(batches(spark, sf_dir)))
    asked = queries(rows)
    truth = knn.exact_knn(rows, asked, K)
    first = F.first("id").over(Window.partitionBy("qid").orderBy("rank"))
    bent = F.when(F.col("rank") == 3, F.lit(-1)).when(F.col("rank") == 5, first).when(F.col("rank") == 7, F.col("qid") + 4_000_000_000_000).otherwise(F.col("id"))
    got = truth.withColumn("id", bent).filter("rank < 9")
    per = canary.per_query(truth, got, rows, asked, K, "COSINE")
    return rounded(per.select("qid", (F.lit(8) - F.col("n_duplicate")).cast("bigint").alias("n_returned"), "n_duplicate", "n_invalid", "short_return", "recall_id"), "recall_id")


@query(
    "probe_summary",
    f"""WITH {_E}, {_CENT}, live AS (SELECT * FROM e WHERE NOT deleted), {_knn('truth', 'live')}, {_GOT}, r AS (SELECT coalesce(t.qid, g.qid) AS qid, t.id IS NOT NULL AS t, g.id IS NOT NULL AS g, e.deleted
  FROM truth t FULL JOIN got g ON t.qid = g.qid AND t.id = g.id JOIN e ON e.id = coalesce(t.id, g.id))
SELECT qid, count(*) FILTER (WHERE t) AS n_true, count(*) FILTER (WHERE t AND g) AS n_hit, count(*) FILTER (WHERE t AND NOT g) AS n_missed, count(*) FILTER (WHERE NOT t AND deleted) AS n_dead,
count(*) FILTER (WHERE NOT t AND NOT deleted) AS n_unexpected, round(count(*) FILTER (WHERE t AND g) / count(*) FILTER (WHERE t), 6) AS recall_id FROM r GROUP BY 1""",
)
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probe.probe_summary(probe_roles(spark, sf_dir)), "recall_id")


@query(
    "partition_metric",
    f"""WITH {_SIZES}, m AS (SELECT stddev_pop(size) / avg(size) AS cv, count(*) AS n FROM s)
SELECT 'partition_size_cv' AS metric, round(cv, 6) AS value, CASE WHEN n < 8 THEN 'low' ELSE 'high' END AS evidence, CASE WHEN cv > 2.0 THEN 'FAIL' WHEN cv > 1.2 THEN 'WARN' ELSE 'OK' END AS state, NULL::VARCHAR AS reason FROM m
UNION ALL SELECT 'partition_size_cv', NULL, CASE WHEN n < 8 THEN 'low' ELSE 'high' END, 'UNAVAILABLE', 'not_applicable' FROM m
UNION ALL SELECT 'partition_size_cv', NULL, 'low', 'UNAVAILABLE', 'single_partition' FROM m""",
)
def partition_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of an IVF's cells, of an index without cells, and of a single cell."""
    sizes = supplier_sizes(spark, sf_dir)
    stats = health.partition_statistics(sizes)
    one = health.partition_statistics(sizes.agg(F.sum("size").alias("size")))
    rows = health.partition_metric(stats).unionByName(health.partition_metric(stats, index_kind="HNSW")).unionByName(health.partition_metric(one))
    return rounded(rows, "value")


@query(
    "verdict_gate",
    f"""WITH {_REPORTED}, s AS (SELECT metric, min(value) FILTER (WHERE run_id % 2 = 0) AS cur, min(value) FILTER (WHERE run_id % 2 = 1) AS base FROM st GROUP BY 1),
t AS (SELECT * FROM (VALUES ('canary_recall', 0.85, 0.70, 0.05, 0.10, -1), ('hub_share_top1pct', 0.20, 0.35, 0.05, 0.10, 1), ('antihub_fraction', 0.25, 0.40, 0.05, 0.10, 1), ('dfi', 0.15, 0.30, 0.05, 0.10, 1), ('partition_size_cv', 1.20, 2.00, 0.20, 0.40, 1)) x(metric, warn, fail, dw, df, sign)),
z AS (SELECT s.metric, CASE WHEN cur IS NULL OR sign IS NULL THEN 'UNAVAILABLE' WHEN cur * sign > fail * sign THEN 'FAIL' WHEN cur * sign > warn * sign THEN 'WARN' ELSE 'OK' END AS a,
  CASE WHEN cur IS NULL OR base IS NULL OR sign IS NULL THEN 'UNAVAILABLE' WHEN round(cur - base, 9) * sign > df THEN 'FAIL' WHEN round(cur - base, 9) * sign > dw THEN 'WARN' ELSE 'OK' END AS d FROM s LEFT JOIN t USING (metric)),
v AS (SELECT {_VERDICT.replace("state", "a").replace("evidence", "'high'")} AS absolute, {_VERDICT.replace("state", "d").replace("evidence", "'high'")} AS delta FROM z),
o AS (SELECT * FROM (VALUES ('OK', 0), ('INCONCLUSIVE', 1), ('WARN', 2), ('FAIL', 3)) x(verdict, i))
SELECT absolute, delta, (SELECT verdict FROM o WHERE i = (SELECT max(i) FROM o WHERE verdict IN (absolute, delta))) AS "both" FROM v""",
)
def verdict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest value of each metric over even runs, gated alone, against the odd runs, and by both."""
    from plumbline.plans.config import BASE_THRESHOLDS

    rules = spark.createDataFrame([(m, *t) for m, t in BASE_THRESHOLDS.items()], "metric string, warn double, fail double, direction string")
    values = reported(spark, sf_dir)

    def side(odd: int) -> DataFrame:
        every = values.groupBy("metric").agg(F.min(F.when(F.col("run_id") % 2 == odd, F.col("value"))).alias("value")).join(rules, "metric", "left")
        state = F.coalesce(verdict.evaluate(F.col("value"), F.col("warn"), F.col("fail"), F.col("direction")), F.lit("UNAVAILABLE"))
        return materialise(every.select("metric", "value", F.when(F.col("direction").isNull(), "UNAVAILABLE").otherwise(state).alias("state"), F.lit("high").alias("evidence")), "side")

    now, before = side(0), side(1)
    return spark.createDataFrame([tuple(verdict.gate(now, before, m) for m in ("absolute", "delta", "both"))], "absolute string, delta string, both string")
