"""Queries of the subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import diverse, encoding, geometric, mixing, neighbours, permanent, quantiles, residue
from plumbline.plans.catalogue import table
from plumbline.session import materialise, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED = 1337
#: Arrivals that p1_sample replays: ranges of chunks, inserted one after the other.
ARRIVALS = 4
#: Setting that names the folder in which the numbers and thresholds of p1_sample stay from run to run, one folder per population.
NUMBERS_FOLDER = "spark.plumbline.numbers.folder"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query(
    "p1_sample",
    """WITH seeds AS (SELECT run_id, min(seed) AS seed FROM audit_run WHERE seed IS NOT NULL GROUP BY 1),
n AS (SELECT p.id, CAST('0x' || substr(md5(min(s.seed) || ':' || p.id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM scene_point p JOIN seeds s ON p.run_id = s.run_id WHERE p.id IS NOT NULL GROUP BY p.id)
SELECT CAST(request_id AS BIGINT) AS request_id, keep_share AS threshold, id FROM lod_request, n
WHERE keep_share IS NOT NULL AND NOT isnan(keep_share) AND u < keep_share""",
)
def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, points, seeds = _population(spark, sf_dir)
    for arrival in range(ARRIVALS):
        numbers.insert(permanent.seeded_points(points.filter(F.col("_batch") == arrival), seeds))
    numbers.raise_thresholds(table(spark, sf_dir, "lod_request"))
    return numbers.select()


def _population(spark: SparkSession, sf_dir: str) -> tuple[permanent.NumberTable, DataFrame, DataFrame]:
    """A number table, the points by arrival and the seeds of their runs."""
    points = permanent.batch_of(table(spark, sf_dir, "scene_point"), ARRIVALS)
    seeds = permanent.run_seeds(points, table(spark, sf_dir, "audit_run"))
    return permanent.NumberTable(spark, spark.conf.get(NUMBERS_FOLDER, None) or new_folder(spark, "permanent")), points, seeds


@query(
    "p1_growth",
    f"""WITH seeds AS (SELECT run_id, min(seed) AS seed FROM audit_run WHERE seed IS NOT NULL GROUP BY 1), top AS (SELECT max(chunk_index) AS m FROM scene_point),
f AS (SELECT p.id, coalesce(floor(p.chunk_index * {ARRIVALS} / (m + 1)), {ARRIVALS - 1}) AS b, min(s.seed) AS seed FROM scene_point p, top, seeds s WHERE p.run_id = s.run_id AND p.id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT id, min(b) AS b, CAST('0x' || substr(md5(arg_min(seed, b) || ':' || id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM f GROUP BY 1)
SELECT CAST(i AS INT) AS arrival, CAST(request_id AS BIGINT) AS request_id, count(*) AS n_selected, 0::BIGINT AS n_lost FROM range({ARRIVALS}) a(i), lod_request, n
WHERE keep_share IS NOT NULL AND NOT isnan(keep_share) AND u < keep_share AND b <= i GROUP BY 1, 2""",
)
def p1_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each arrival and per request: how many ids are selected, and how many of those selected before are not any more."""
    _, points, seeds = _population(spark, sf_dir)
    numbers = permanent.NumberTable(spark, new_folder(spark, "growth"))
    numbers.raise_thresholds(table(spark, sf_dir, "lod_request"))
    out, before = None, None
    for arrival in range(ARRIVALS):
        numbers.insert(permanent.seeded_points(points.filter(F.col("_batch") == arrival), seeds))
        now = materialise(numbers.select().select("request_id", "id"), "selected")
        n = now.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_selected"))
        if before is None:
            row = n.withColumn("n_lost", F.lit(0).cast("bigint"))
        else:
            lost = before.join(now, ["request_id", "id"], "left_anti").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_lost"))
            row = n.join(lost, "request_id", "full").select("request_id", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"))
        row = row.select(F.lit(arrival).alias("arrival"), "request_id", "n_selected", "n_lost")
        out, before = row if out is None else out.unionByName(row), now
    return out


def _query_set(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("id") % 20 == 0)


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, sf_dir, "vector_batch")).select("id_a", "id_b")


@query("p3_knn")
def p3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "vector_batch")
    return neighbours.knn_rows(neighbours.nearest(vectors, _query_set(vectors)))


@query("p3_recall")
def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "vector_batch")
    found, truth = (neighbours.nearest(vectors, _query_set(vectors), exact=e) for e in (False, True))
    return neighbours.recall(found, truth)


@query("p4_subset")
def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diverse.varied_subsets(table(spark, sf_dir, "scene_point"), table(spark, sf_dir, "lod_request"))


_VALUES = r"""c AS (SELECT row_id, min(struct_pack(w := written_at, m := metric_id, x := metric_value)) AS r FROM calibration_row WHERE row_id IS NOT NULL GROUP BY 1),
t AS (SELECT run_id, lower(regexp_replace(metric_id, '^\s+|\s+$', '', 'g')) AS metric, min(struct_pack(w := reported_at, x := detail.recall_dist)) AS r FROM metric_result GROUP BY 1, 2),
vals AS (SELECT 'metric' AS scope, lower(regexp_replace(r.m, '^\s+|\s+$', '', 'g')) AS group_key, r.x AS v FROM c
  UNION ALL SELECT 'recall_day', strftime(r.w AT TIME ZONE 'UTC', '%Y-%m-%d'), r.x FROM t
  UNION ALL SELECT 'recall_total', 'all', r.x FROM t),
ranked AS (SELECT scope, group_key, v, row_number() OVER (PARTITION BY scope, group_key ORDER BY v) AS r, count(*) OVER (PARTITION BY scope, group_key) AS n
  FROM vals WHERE v IS NOT NULL AND isfinite(v))"""
_QS = "(SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE, 0.999::DOUBLE]) AS q)"


def _percentiles(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The values by scope and group, and their quantiles from sketches of buffers of ``k``; the total comes from the days' sketches."""
    values = quantiles.metric_values(table(spark, sf_dir, "calibration_row")).unionByName(quantiles.recall_values(table(spark, sf_dir, "metric_result")))
    sketched = materialise(quantiles.sketches(values, k), "sketches")
    total = quantiles.combine(sketched.filter("scope = 'recall_day'"), "recall_total", "all", k)
    return values, quantiles.read_quantiles(sketched.unionByName(total), k=k)


@query("p5_percentiles", f"WITH {_VALUES} SELECT scope, group_key, q, v AS value, n, 0::BIGINT AS rank_error FROM ranked, {_QS} WHERE r = greatest(1, ceil(q * n))")
def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir, quantiles.BUFFER)[1]


@query("p5_bounds", f"WITH {_VALUES} SELECT DISTINCT scope, group_key, q, n, TRUE AS within, n > 128 AS collapsed FROM ranked, {_QS} WHERE n <= 64 OR n > 128")
def p5_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from buffers of 64 values, whose ranks are counted out: groups of up to 64 are exact, those above 128 were collapsed."""
    values, read = _percentiles(spark, sf_dir, 64)
    read = materialise(read, "read")
    total = values.filter("scope = 'recall_day'").select(F.lit("recall_total").alias("scope"), F.lit("all").alias("group_key"), "v")
    checked = quantiles.rank_bounds(values.unionByName(total), read).filter("n <= 64 OR n > 128")
    return checked.select("scope", "group_key", "q", "n", "within", (F.col("rank_error") > 0).alias("collapsed"))


@query("p6_sample")
def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "metric_result").filter(quantiles.clean("metric_id") == "canary_recall")
    return geometric.fixed_size_samples(table(spark, sf_dir, "vector_batch"), results.select("sampling.queries"), SEED)


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_texts(table(spark, sf_dir, "documents"), encoding.vocabulary())


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_target")
    listed = mixing.listed_documents(table(spark, sf_dir, "documents"), targets)
    counted = materialise(mixing.once_each(encoding.count_tokens(listed, encoding.vocabulary(), ["doc_id", "source_key"])), "tokens")
    return counted, mixing.fill(counted, targets)


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, filled = _mixture(spark, sf_dir)
    return filled.filter("clamped_round = 1").select("source")


@query("p8_mixture")
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, filled = _mixture(spark, sf_dir)
    return mixing.uses(counted, filled, SEED)


@query("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, filled = _mixture(spark, sf_dir)
    return mixing.report(filled, mixing.uses(counted, filled, SEED))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.flag_residue(table(spark, sf_dir, "documents"), ["doc_id"]).filter("is_residue").select("doc_id")


@query("p9_kept")
def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.flag_residue(table(spark, sf_dir, "documents"), ["doc_id", "source"]).filter("NOT is_residue").groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"))


@query("p9_spans")
def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched stretches of the documents that are left out, in places of their cleaned text, and the share that they make up."""
    flagged = residue.flag_residue(table(spark, sf_dir, "documents"), ["doc_id"]).filter("is_residue")
    return flagged.select("doc_id", F.round("coverage", 6).alias("coverage"), F.explode("spans").alias("s")).select("doc_id", "coverage", "s.sort", "s.start", "s.stop")
