"""Paths that large, dirty or skewed inputs take must answer as the small ones do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import canary, heavy_keys, ivf, knn, probe, scene, validate
from plumbline.plans.audit import run_audit
from plumbline.plans.config import AuditConfig
from plumbline.sources.tables import TableSource


def vectors(spark, rows, name="id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} bigint, vec array<float>")


@pytest.mark.parametrize("bound", [session.BROADCAST_ROWS, 0])
def test_a_null_key_matches_nothing_on_either_path(spark, bound, monkeypatch):
    monkeypatch.setattr(heavy_keys, "small_enough", lambda df: session.small_enough(df, bound))
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2, 3, None, None])], "k int, id bigint")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (9, "z")], "k int, v string")
    got = heavy_keys.sized_join(big, small, ["k"], "id")
    assert got.columns == ["k", "id", "v"]
    assert sorted((r["k"], r["id"], r["v"]) for r in got.collect()) == [(1, i, "a") for i in range(40)] + [(2, 40, "b")]
    assert heavy_keys.sized_join(big.limit(0), small, ["k"], "id").count() == 0


def test_broadcasts_are_bounded_by_rows_and_by_bytes(spark):
    wide = spark.range(50).select("id", F.expr("array_repeat(1.0f, 1000)").alias("v"), F.lit("é" * 10).alias("s"), F.struct(F.lit(None).cast("string").alias("x")).alias("t"))
    assert session.small_enough(wide) and session.small_enough(wide.limit(0))
    assert not session.small_enough(wide, rows=49) and not session.small_enough(wide, size=300_000)
    odd = spark.createDataFrame([(1, {"a": 1}, [["x", None], None])], "`a.``b` int, m map<string,int>, n array<array<string>>")
    assert session.small_enough(odd) and not session.small_enough(odd, size=50)


def test_settled_rows_are_the_same_in_memory_and_on_disk(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2.5, True), (None, None, None)], "a bigint, b double, c boolean")
    held = session.settle(df)
    monkeypatch.setattr(session, "SETTLED_ROWS", 1)
    written = session.settle(df)
    assert held.schema == df.schema and sorted(held.collect(), key=str) == sorted(written.collect(), key=str) == sorted(df.collect(), key=str)


@pytest.mark.parametrize("strategy", ["arrow", "expression"])
@pytest.mark.parametrize("metric", ["L2", "DOT"])
def test_rows_that_are_not_finite_take_no_part_and_spoil_nothing(spark, strategy, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    bad = [(900, [float("nan")] + [0.0] * 5), (901, [float("inf")] * 6), (902, None), (903, [0.0] * 5), (904, [None] + [0.0] * 5)]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + bad, "id bigint, vec array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, x[0].tolist()), (950, [float("nan")] * 6), (951, None)], "qid bigint, vec array<float>")
    clean = knn.exact_knn(vectors(spark, list(enumerate(x))), asked, 5, metric, strategy=strategy)
    dirty = knn.exact_knn(rows, asked, 5, metric, strategy=strategy)
    assert dirty.exceptAll(clean).count() == 0 and dirty.count() == clean.count() == 5


def test_numbers_whose_squares_overflow_are_compared_in_double(spark):
    rows = vectors(spark, [(1, (3e38, 0)), (2, (1.0, 0)), (3, (-3e38, 0))])
    got = knn.exact_knn(rows, vectors(spark, [(9, (3e38, 1))], "qid"), 3, "L2").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3]


@pytest.mark.parametrize("mb", [0, 1, 256])
def test_the_working_set_changes_no_result(spark, mb):
    x = np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32)
    q = x[:7]
    a = knn.block_top(np.arange(7), q, np.arange(300), x, 4, "L2", True, mb)
    b = knn.block_top(np.arange(7), q, np.arange(300), x, 4, "L2", True)
    assert all((p == r).all() for p, r in zip(knn.keep_top(*a, 4), knn.keep_top(*b, 4)))


@pytest.mark.parametrize("cell", [None, "cell"])
def test_a_cosine_source_answers_by_angle(spark, cell):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12)) * rng.lognormal(0, 2, size=(400, 1))
    rows = spark.createDataFrame([(i, [float(t) for t in v], i % 4) for i, v in enumerate(x)], "id bigint, vec array<float>, cell bigint")
    src = TableSource(rows, "x", {"id": "id", "metric": "COSINE"} | ({"cell": cell} if cell else {}))
    rep = run_audit(src, AuditConfig(queries=30, metrics_enabled=("canary_recall",)), {"nprobe": 4})
    assert rep.metrics[0].value == 1.0 and rep.metrics[0].detail["snapshot_inconsistent"] is False


@pytest.mark.parametrize("shipped", [knn.SHIPPED_QUERIES, 0])
def test_groups_and_cells_by_matrix_or_by_join(spark, shipped, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 5)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), ["a", "b", None][i % 3], i % 3, i % 7 == 0) for i, v in enumerate(x)], "id bigint, vec array<float>, g string, cell bigint, deleted boolean")
    q = canary.group_queries(rows, "g", 4, 1)
    want = {}
    for r in q.collect():
        mine = [i for i in range(120) if i % 3 == (0 if r["grp"] == "a" else 1) and i != r["qid"]]
        d = {i: round(float(np.sqrt(((x[i].astype(float) - x[r["qid"]].astype(float)) ** 2).sum())), 12) for i in mine}
        want[r["grp"], r["qid"]] = sorted(mine, key=lambda i: (d[i], i))[:3]
    monkeypatch.setattr(knn, "SHIPPED_QUERIES", shipped)
    got = {}
    for r in sorted(canary.group_truth(rows, "g", q, 3, "L2").collect(), key=lambda r: r["rank"]):
        got.setdefault((r["grp"], r["qid"]), []).append(r["id"])
    assert got == want
    asked = rows.filter("id < 3").select(F.col("id").alias("qid"), "vec")
    found = ivf.ivf_tombstoned(rows, ivf.partition_centroids(rows, False), asked, 5, 3, 9, "L2").collect()
    for qid in range(3):
        d = np.round(np.sqrt(((x.astype(float) - x[qid].astype(float)) ** 2).sum(1)), 12)
        order = [i for i in np.lexsort((np.arange(120), d))[:9] if i % 7][:5]
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["qid"] == qid] == order


def test_the_vectors_of_a_corpus_are_not_shuffled_for_returned_ids(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(500, 4))
    vectors(spark, list(enumerate(x))).write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    q = corpus.filter("id < 9").select(F.col("id").alias("qid"), "vec")
    got = canary.returned_distances(knn.exact_knn(corpus, q, 3, "L2"), corpus, q, "L2")
    plan = got._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("vec" in line for line in shuffles)
    scan = plan[: plan.index("Scan parquet")].splitlines()
    assert not any("SortMergeJoin" in line for line in scan[-4:])
    assert got.filter("dist IS NULL OR NOT live").count() == 0 and got.count() == 27


def test_every_hub_gets_its_class(spark):
    n = 25_000  # more than any list of a report
    points = spark.range(n + 5).select("id", (F.col("id") == 3).alias("deleted"))
    got = scene.classify(points, spark.range(n).unionByName(spark.range(10)), spark.range(n, n + 2))
    counts = {r["point_class"]: r["count"] for r in got.groupBy("point_class").count().collect()}
    assert counts == {1: n - 1, 3: 1, 2: 2, 0: 3}


def test_all_groups_are_counted_and_the_worst_are_named(spark, monkeypatch, tmp_path):
    from plumbline.plans import audit

    monkeypatch.setattr(audit, "WORST_GROUPS", 3)
    rows = spark.createDataFrame([(i, [float(i % 9), float(i % 5), float(i)], i % 8) for i in range(240)], "id bigint, vec array<float>, part bigint")
    src = TableSource(rows, "x", {"id": "id"})
    cfg = AuditConfig(queries=6, k=3, group_by="part", groups_path=str(tmp_path / "g"), metrics_enabled=("canary_recall",))
    rep = run_audit(src, cfg)
    d = rep.metrics[0].detail
    assert d["groups_total"] == 8 and sum(d["group_states"].values()) == 8 and len(d["groups"]) == 3 and any("worst of 8" in w for w in rep.warnings)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 8


def test_payload_values_are_data(spark):
    rows = spark.createDataFrame([("3", 3), ("3'", 3), ("x", None)], "`a`` b` string, n bigint")
    assert rows.filter(validate.payload_equals("a` b", "3'")).count() == 1
    assert rows.filter(validate.payload_equals("n", "03")).count() == 2 and rows.filter(validate.payload_equals("n", "3'")).count() == 0


def test_ids_come_back_from_their_numbers(spark):
    keys = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "key string")
    table = validate.encode_ids(keys)
    got = validate.decode_ids(spark.createDataFrame([(0,), (1,), (7,), (None,)], "id bigint"), table).collect()
    assert {r["id"]: r["key"] for r in got} == {0: "a", 1: "b", 7: None, None: None}


def test_unit_vectors_are_checked(spark):
    validate.check_unit(vectors(spark, [(1, (0.6, 0.8))]))
    with pytest.raises(validate.UsageError) as e:
        validate.check_unit(vectors(spark, [(1, (0.6, 0.8)), (2, (0.6, 0.9))]))
    assert e.value.ids == [2]


def test_cell_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ivf, "HELD_SUMS", 8)
    monkeypatch.setattr(ivf, "SCORES", 4)
    x = np.random.default_rng(9).normal(size=(300, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), i % 5, False) for i, v in enumerate(x)] + [(999, None, 1, False), (998, [1.0] * 3, None, False)], "id bigint, vec array<float>, cell bigint, deleted boolean").repartition(13)
    got = {r["cell"]: r["centroid"] for r in ivf.partition_centroids(rows).collect()}
    assert sorted(got) == list(range(5)) and all(got[c] == pytest.approx(x[c::5].astype(float).mean(0).tolist()) for c in got)
    near = {r["id"]: r["cell"] for r in ivf.assign_cells(rows, ivf.partition_centroids(rows), "L2").collect()}
    c = np.array([got[i] for i in range(5)])
    assert all(near[i] == ((c - x[i]) ** 2).sum(1).argmin() for i in range(300))
    assert ivf.kmeans(rows.limit(0), 3).count() == 0


def test_probe_of_unknown_ids(spark):
    t = spark.createDataFrame([(1, 10)], "qid bigint, id bigint")
    g = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, -1)], "qid bigint, id bigint")
    c = spark.createDataFrame([(10, None), (11, False), (11, False), (12, True)], "id bigint, deleted boolean")
    assert sorted((r["id"], r["role"]) for r in probe.probe_roles(t, g, c).collect()) == [(10, "hit"), (11, "unexpected"), (12, "dead")]
