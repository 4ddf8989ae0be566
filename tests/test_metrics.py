import pytest
from pyspark.sql import functions as F

from plumbline.operators import canary, health, hubness, ivf, knn, probe, validate, verdict
from plumbline.plans.config import AuditConfig, ConfigError, load_config, profile_for, select_metrics
from tests.test_knn import POINTS, frame


def answers(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, rank int, id bigint")


def test_a_tie_at_the_border_counts_for_distance_recall_only(spark):
    c = frame(spark, POINTS)
    q = frame(spark, [(100 + i, (0.1, 0.1)) for i in range(5)], "qid")
    truth = knn.exact_knn(c, q, 2, "L2")
    got = answers(spark, [(100 + i, r, j) for i in range(5) for r, j in enumerate((0, 2))])
    per = canary.per_query(truth, got, c, q, 2, "L2")
    s = canary.summary(per).first()
    assert (s["recall_id"], s["value"], s["boundary_ties"], s["evidence"], s["state"]) == (0.5, 1.0, 5, "low", "OK")


def test_bad_answers_are_counted(spark):
    c = frame(spark, POINTS)
    q = frame(spark, [(100, (0.1, 0.1)), (101, (0.1, 0.1))], "qid")
    truth = knn.exact_knn(c, q, 3, "L2")
    got = answers(spark, [(100, 0, 0), (100, 1, 0), (100, 2, -1), (100, 3, 99)])
    known = spark.createDataFrame([(99,)], "id bigint")
    r = {x["qid"]: x for x in canary.per_query(truth, got, c, q, 3, "L2", known=known).collect()}
    assert (r[100]["n_duplicate"], r[100]["n_invalid"], r[100]["n_vanished"], r[100]["short_return"]) == (1, 1, 1, 1)
    assert (r[101]["recall_id"], r[101]["short_return"]) == (0.0, 1)  # a query without any answer
    s = canary.summary(canary.per_query(truth, got, c, q, 3, "L2")).first()
    assert (s["state"], s["value"], s["reason"]) == ("UNAVAILABLE", None, "too_few_queries")


def test_dot_distances_below_zero_keep_their_last_neighbour(spark):
    c = frame(spark, [(1, (2.0, 0.0)), (2, (3.0, 0.0))])
    q = frame(spark, [(9, (1.0, 0.0))], "qid")
    truth = knn.exact_knn(c, q, 2, "DOT")
    got = answers(spark, [(9, 0, 2), (9, 1, 1)])
    assert canary.per_query(truth, got, c, q, 2, "DOT").first()["recall_dist"] == 1.0


def test_hubness_by_hand(spark):
    c = frame(spark, [(0, (0.0,)), (1, (1.0,)), (2, (2.0,)), (3, (10.0,))])
    nb = knn.exact_knn(c, c.withColumnRenamed("id", "qid"), 1, "L2")
    nk = hubness.n_k(nb, c)
    assert {r["id"]: r["n_k"] for r in nk.collect()} == {0: 1, 1: 2, 2: 1, 3: 0}
    hubness.assert_total(nk, 1)
    s = hubness.statistics(nk).first()
    assert (s["antihub_fraction"], s["hub_share_top1pct"], s["skewness"]) == (0.25, 0.5, pytest.approx(0.0))
    with pytest.raises(hubness.InvariantError):
        hubness.assert_total(nk, 2)


def test_equal_counts_have_no_skewness_and_empty_samples_no_share(spark):
    same = spark.createDataFrame([(i, 5) for i in range(10)], "id bigint, n_k bigint")
    s = hubness.statistics(same).first()
    assert s["skewness"] is None and s["hub_share_top1pct"] == pytest.approx(0.1) and s["mad_outliers"] == 0
    e = hubness.statistics(same.limit(0)).first()
    assert (e["hub_share_top1pct"], e["antihub_fraction"]) == (0.0, 0.0)


def test_histogram_widths(spark):
    h = lambda v: sorted(tuple(r) for r in hubness.histogram(spark.createDataFrame([(x,) for x in v], "n bigint"), "n").collect())
    assert h([0, 2, 2]) == [(0, 1, 1), (1, 1, 0), (2, 1, 2)]
    wide = h([1000, 1000, 3])
    assert wide == [(0, 16, 1), (992, 16, 2)]


def test_partition_statistics_by_hand(spark):
    sizes = spark.createDataFrame(list(enumerate([500, 500, 500, 80000])), "cell bigint, size bigint")
    s = health.partition_statistics(sizes).first()
    assert s["cv"] == pytest.approx(1.6895464932727084) and s["max_over_mean"] == pytest.approx(3.9263803680981595)
    assert health.partition_metric(health.partition_statistics(sizes)).first()["evidence"] == "low"
    none = health.partition_statistics(sizes.withColumn("size", F.lit(0).cast("bigint")))
    assert health.partition_metric(none).first()["reason"] == "empty_index"
    assert health.partition_metric(health.partition_statistics(sizes), index_kind="HNSW").first()["reason"] == "not_applicable"
    assert health.partition_metric(health.partition_statistics(sizes.limit(1))).first()["reason"] == "single_partition"


def test_dfi_edges(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", None), (None, True)], "f string, deleted boolean")
    assert tuple(health.dfi_total(rows).first()) == (2, 2, 0.5)
    parts = {r["fragment"]: r["dead"] for r in health.dfi_by_fragment(rows, "f").collect()}
    assert parts == {"a": 1, "b": 0, None: 1, "ALL": 2}
    empty = health.dfi_total(rows.limit(0))
    assert empty.first()["dfi"] is None and health.dfi_metric(empty).first()["reason"] == "empty_index"
    assert health.dfi_metric(health.dfi_total(rows), entrypoint_tombstoned=True).first()["state"] == "FAIL"
    assert health.dfi_metric(health.dfi_total(rows), capable=False).first()["state"] == "UNAVAILABLE"


@pytest.mark.parametrize(
    ("value", "direction", "state"),
    [(0.85, "lower_is_worse", "OK"), (0.8499, "lower_is_worse", "WARN"), (0.70, "lower_is_worse", "WARN"), (0.6999, "lower_is_worse", "FAIL"), (0.70, "higher_is_worse", "OK"), (0.8, "higher_is_worse", "WARN"), (0.85, "higher_is_worse", "WARN"), (0.86, "higher_is_worse", "FAIL")],
)
def test_a_value_on_a_threshold_is_on_the_healthy_side(spark, value, direction, state):
    warn, fail = (0.85, 0.70) if direction == "lower_is_worse" else (0.70, 0.85)
    assert spark.range(1).select(verdict.evaluate(F.lit(value), F.lit(warn), F.lit(fail), F.lit(direction))).first()[0] == state


@pytest.mark.parametrize(
    ("rows", "strict", "want"),
    [
        ([("OK", "high")], False, "OK"), ([("OK", "high"), ("UNAVAILABLE", "low")], False, "INCONCLUSIVE"), ([("OK", "high"), ("UNAVAILABLE", "low")], True, "FAIL"),
        ([("FAIL", "low")], False, "WARN"), ([("FAIL", "medium"), ("UNAVAILABLE", "low")], False, "FAIL"), ([("WARN", "high"), ("UNAVAILABLE", "low")], False, "WARN"),
        ([("DISABLED", "low")], False, "INCONCLUSIVE"), ([], False, "INCONCLUSIVE"),
    ],
)
def test_verdicts(spark, rows, strict, want):
    m = spark.createDataFrame([(f"m{i}", None, *r) for i, r in enumerate(rows)], "metric string, value double, state string, evidence string")
    r = verdict.aggregate(m, strict).first()
    assert (r["verdict"], r["exit_code"]) == (want, verdict.EXIT[want])


def test_baseline(spark):
    cols = "metric string, value double, state string, evidence string"
    old = spark.createDataFrame([("dfi", 0.10, "OK", "high"), ("gone", 1.0, "OK", "high")], cols)
    new = spark.createDataFrame([("dfi", 0.151, "WARN", "high"), ("canary_recall", 0.9, "OK", "high")], cols)
    d = {r["metric"]: r["delta_state"] for r in verdict.baseline_delta(new, old).collect()}
    assert d == {"dfi": "WARN", "gone": "UNAVAILABLE", "canary_recall": "UNAVAILABLE"}
    assert verdict.gate(new, old, "absolute") == "WARN" and verdict.worst_verdict("OK", "INCONCLUSIVE") == "INCONCLUSIVE"
    assert verdict.comparable({"k": 10}, {"k": 5}) == ["k"]


def test_ivf_over_all_cells_is_exact_and_tombstones_cost_answers(spark):
    rows = frame(spark, POINTS).withColumn("cell", F.col("id") % 2).withColumn("deleted", F.col("id") == 0)
    q = frame(spark, [(100, (0.1, 0.1))], "qid")
    cent = ivf.partition_centroids(rows, live_only=False)
    all_cells = ivf.ivf_search(rows, cent, q, 3, 2, "L2")
    assert [r["id"] for r in all_cells.orderBy("rank").collect()] == [1, 2, 3]
    assert ivf.ivf_tombstoned(rows, cent, q, 3, 2, 2, "L2").count() == 1  # one of two candidates is dead
    assert ivf.ivf_search(rows, cent, q, 3, 1, "L2").count() <= 3


def test_kmeans_finds_separate_clusters(spark):
    pts = [(i, (0.01 * i, 0.0)) for i in range(10)] + [(10 + i, (5.0 + 0.01 * i, 5.0)) for i in range(10)]
    c = frame(spark, pts)
    cells = {r["id"]: r["cell"] for r in ivf.assign_cells(c, ivf.kmeans(c, 2), "L2").collect()}
    assert len({cells[i] for i in range(10)}) == 1 and len(set(cells.values())) == 2


def test_probe_roles(spark):
    c = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "id bigint, deleted boolean")
    t = spark.createDataFrame([(9, 0, 1), (9, 1, 2)], "qid bigint, rank int, id bigint")
    g = answers(spark, [(9, 0, 1), (9, 1, 3), (9, 2, 4), (9, 3, -1), (9, 4, 77)])
    roles = probe.probe_roles(t, g, c)
    assert {r["id"]: r["role"] for r in roles.collect()} == {1: "hit", 2: "missed", 3: "dead", 4: "unexpected", 77: "dead"}
    assert probe.probe_summary(roles).first()["recall_id"] == 0.5


def test_inverse_lists_are_capped_but_counted(spark):
    nb = spark.createDataFrame([(q, 1) for q in range(7)], "qid bigint, id bigint")
    hubs = spark.createDataFrame([(1,), (2,)], "id bigint")
    r = {x["id"]: x for x in probe.hub_cannibalisation(nb, hubs, cap=3).collect()}
    assert (r[1]["n_k"], r[1]["truncated"], r[1]["qids"]) == (7, True, [0, 1, 2]) and r[2]["qids"] == []


def test_validation(spark):
    c = frame(spark, [(1, (1.0, 0.0)), (2, (0.0, 0.0)), (3, (float("nan"), 1.0)), (4, None), (5, (1.0,))])
    assert tuple(validate.validation_counts(c, 2, "COSINE").first()) == (5, 2, 1, 1)
    with pytest.raises(validate.UsageError) as e:
        validate.check(c.filter("id IN (1, 3)"), 2, "L2")
    assert e.value.ids == [3]
    with pytest.raises(validate.UsageError):
        validate.check(c.filter("id = 1"), 2, "L2")
    rows = spark.createDataFrame([(1, "7"), (2, "07"), (3, "x"), (4, None)], "id bigint, f string")
    assert [r["id"] for r in rows.filter(validate.payload_equals("f", "7")).orderBy("id").collect()] == [1, 2]


def test_ids_are_dense_and_in_key_order(spark):
    keys = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "key string")
    assert {r["key"]: r["id"] for r in validate.encode_ids(keys).collect()} == {"a": 0, "b": 1, "c": 2}


def test_configuration(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[plumbline]\nk = 5\nqueries = 7\n")
    c = load_config(str(f), {"PLUMBLINE_K": "6", "OTHER": "1"}, {"seed": 2})
    assert (c.k, c.queries, c.seed) == (6, 7, 2)
    assert [profile_for(d) for d in (64, 65, 384, 1024, 1025)] == ["low", "medium", "medium", "high", "ultra_high"]
    assert AuditConfig().for_dimension(768)["partition_size_cv"][:2] == (1.30, 2.10)
    own = load_config(environ={}, overrides={"thresholds": {"partition_size_cv": (1.0, 3.0)}})
    assert own.for_dimension(768)["partition_size_cv"][:2] == (1.0, 3.0)
    for bad in ({"nope": 1}, {"k": 0}, {"gate_mode": "x"}, {"thresholds": {"dfi": (0.5, 0.1)}}):
        with pytest.raises(ConfigError):
            load_config(environ={}, overrides=bad)
    assert select_metrics(skip=["dfi"]) == ("canary_recall", "hub_share_top1pct", "antihub_fraction", "partition_size_cv")
    with pytest.raises(ConfigError):
        select_metrics(["dfi"], ["dfi"])
