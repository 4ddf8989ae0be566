import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import geometric as G
from plumbline.llm import quantiles as Q


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=700), st.integers(2, 40), st.integers(1, 6))
def test_rank_error_stays_within_the_bound_through_merges(values, k, parts):
    whole = Q.Sketch(k)
    for chunk in np.array_split(np.array(values, float), parts):
        s = Q.Sketch(k)
        s.add(chunk)
        whole.merge(Q.Sketch.of(type("R", (), dict(zip(("n", "rank_error", "levels", "lengths", "vals"), s.row()))), k))
    v = np.sort(values)
    assert whole.n == len(v) and sum((1 << h) * len(b) for h, b in whole.full.items()) + whole.n_loose == len(v)
    for q in (0.0, 0.25, 0.5, 0.9, 0.999, 1.0):
        rank, got = max(1, math.ceil(q * len(v))), whole.quantile(q)
        low, high = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
        assert low - whole.rank_error <= rank <= high + whole.rank_error
    if len(v) <= k:
        assert whole.rank_error == 0 and whole.quantile(0.5) == v[max(1, math.ceil(len(v) / 2)) - 1]


def test_groups_hot_groups_dirt_and_daily_totals(spark):
    rng = np.random.default_rng(1)
    rows = [("d", "hot", float(x)) for x in rng.normal(size=5000)] + [("d", None, 1.0), ("d", "bad", float("nan")), ("d", "bad", None), ("d", "bad", float("inf"))] + [("d", f"g{i}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "scope string, group_key string, v double").repartition(6)
    sk = Q.sketches(df, k=64)
    got = {(r["group_key"], r["q"]): r for r in Q.read_quantiles(sk, k=64).collect()}
    v = np.sort([r[2] for r in rows[:5000]])
    hot = got["hot", 0.99]
    assert hot["n"] == 5000 and abs(np.searchsorted(v, hot["value"]) + 1 - 4950) <= hot["rank_error"] < 400
    assert ("bad", 0.5) not in got and got[None, 0.5]["value"] == 1.0 and got["g7", 0.9]["value"] == 7.0
    total = Q.read_quantiles(Q.combine(sk, "all", "all", k=64), k=64).filter("q = 0.5").collect()
    assert len(total) == 1 and total[0]["n"] == 5041
    assert Q.sketches(df.limit(0)).count() == 0


def test_more_partitions_than_places_and_flushed_sketches(spark, monkeypatch):
    """No merge gets more than FAN_IN sketches of a group, whatever the number of partitions, and no value is lost."""
    monkeypatch.setattr(Q, "HELD", 40)
    most = []
    tree = Q.merge_tree
    monkeypatch.setattr(Q, "merge_tree", lambda parts, width, k: (most.append((width, parts.groupBy("scope", "group_key", F.floor(F.col("part") / Q.FAN_IN)).count().agg(F.max("count")).first()[0])), tree(parts, width, k))[1])
    df = spark.range(4000).select(F.lit("s").alias("scope"), (F.col("id") % 5).cast("string").alias("group_key"), (F.col("id") * 7 % 4001).cast("double").alias("v")).repartition(60)
    got = Q.read_quantiles(Q.sketches(df, k=16), k=16)
    assert most[0][0] >= 60 and most[0][1] <= Q.FAN_IN
    checked = Q.rank_bounds(df, got).collect()
    assert len(checked) == 20 and all(r["within"] and r["n"] == 800 and 0 < r["rank_error"] < 400 for r in checked)


def test_rows_sent_twice_count_once(spark):
    c = spark.createDataFrame([(1, " DFI", 1.0, 1), (1, " DFI", 1.0, 2), (2, "dfi\t", 3.0, 1), (None, "dfi", 9.0, 1)], "row_id bigint, metric_id string, metric_value double, written_at int")
    assert sorted(tuple(r) for r in Q.metric_values(c).collect()) == [("metric", "dfi", 1.0), ("metric", "dfi", 3.0)]
    r = spark.createDataFrame([(1, "x", "2024-01-01 23:59:59", 0.5), (1, "X ", "2024-01-02 00:00:00", 0.5), (2, "x", "2024-01-02 00:00:00", None)], "run_id bigint, metric_id string, t string, d double")
    r = r.select("run_id", "metric_id", F.to_timestamp("t").alias("reported_at"), F.struct(F.col("d").alias("recall_dist")).alias("detail"))
    assert sorted(tuple(x) for x in Q.recall_values(r).collect() if x["v"] is not None) == [("recall_day", "2024-01-01", 0.5)]


@pytest.mark.parametrize("buffer", [1, 7, 50])
def test_the_geometric_file_is_uniform(buffer):
    hits = np.zeros(200)
    for t in range(400):
        kept = {}
        f = G.GeometricFile(50, buffer, np.random.default_rng([buffer, t]), kept.__setitem__)
        for part in np.array_split(np.arange(200), 9):
            f.offer(part)
        s = np.concatenate([kept[segment][:n] for segment, n in f.live()])
        assert len(s) == len(set(s.tolist())) == 50 and f.seen == 200
        hits[s] += 1
    # 400 draws of a quarter: mean 100, deviation 8.7 per id; old and new ids are as likely
    assert abs(hits[:60].mean() - 100) < 4 and abs(hits[-60:].mean() - 100) < 4 and hits.min() > 60 and hits.max() < 140


def test_segments_shrink_and_add_up():
    for n in (1, 2, 10, 1000):
        sizes = G.segment_sizes(n, 4)
        assert sum(sizes) == n and all(a >= b for a, b in zip(sizes, sizes[1:-1]))


def test_short_streams_and_sizes(spark):
    s = spark.createDataFrame([(i, i % 5) for i in range(100)] + [(3, 9), (None, 1)], "id bigint, batch_no int")
    wanted = lambda *x: spark.createDataFrame([(v,) for v in x], "queries int")
    got = G.fixed_size_samples(s, wanted(10, 40, 500, 0, -1, None, 10))
    n = {r["queries"]: (r["n"], r["d"]) for r in got.groupBy("queries").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()}
    assert n == {10: (10, 10), 40: (40, 40), 500: (100, 100)}
    again = G.fixed_size_samples(s.repartition(6), wanted(10, 40, 500))
    assert again.exceptAll(got).count() == 0
    assert G.fixed_size_samples(s.limit(0), wanted(5)).count() == 0 and G.fixed_size_samples(s, wanted()).count() == 0


def test_every_id_is_equally_likely(spark):
    s = spark.range(60).select("id", (F.col("id") % 7).cast("int").alias("batch_no"))
    hits = np.zeros(60)
    for seed in range(30):
        for r in G.fixed_size_samples(s, spark.createDataFrame([(20,)], "queries int"), seed=seed, shards=3).collect():
            hits[r["id"]] += 1
    assert hits.sum() == 600 and hits.min() >= 1 and hits.max() <= 20
