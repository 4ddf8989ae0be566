import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import knn

POINTS = [(0, (0.0, 0.0)), (1, (1.0, 0.0)), (2, (0.0, 1.0)), (3, (10.0, 0.0)), (4, (10.0, 1.0)), (5, (0.0, 10.0))]


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], f"{name} bigint, vec array<float>")


def found(df):
    return {(r["qid"], r["rank"]): r["id"] for r in df.collect()}


@pytest.mark.parametrize("strategy", ["arrow", "expression"])
def test_ties_go_to_the_lower_id(spark, strategy):
    got = knn.exact_knn(frame(spark, POINTS), frame(spark, [(100, (0.1, 0.1))], "qid"), 2, "L2", strategy=strategy).collect()
    assert [(r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 0), (1, 1)]
    assert max(r["dist"] for r in got) == pytest.approx(0.905539, abs=1e-6)


@pytest.mark.parametrize("metric", ["L2", "COSINE", "DOT"])
def test_strategies_and_blocks_agree_with_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)).astype(np.float32)
    c, q = frame(spark, list(enumerate(x))), frame(spark, list(enumerate(x[:20])), "qid")
    x64 = x.astype(np.float64)
    want = {}
    for i in range(20):
        d = np.sqrt(((x64 - x64[i]) ** 2).sum(1)) if metric == "L2" else (1 - x64 @ x64[i] if metric == "COSINE" else -(x64 @ x64[i]))
        d[i] = np.inf
        want |= {(i, r): j for r, j in enumerate(np.lexsort((np.arange(150), np.round(d, 12)))[:7])}
    assert found(knn.exact_knn(c, q, 7, metric)) == want
    assert found(knn.exact_knn(c, q, 7, metric, strategy="expression")) == want
    monkeypatch.setattr(knn, "MANY_QUERIES", 5)
    few = c.filter("id < 20").repartition(3)
    turned = found(knn.exact_knn(few, q.unionByName(q.limit(3)).repartition(4), 7, metric))
    monkeypatch.setattr(knn, "MANY_QUERIES", 10**6)
    assert turned == found(knn.exact_knn(few, q, 7, metric)) and len(turned) == 140
    monkeypatch.setattr(knn, "SHIPPED_QUERIES", 5)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    assert found(knn.exact_knn(c.repartition(5), q, 7, metric)) == want


def test_edges(spark):
    c = frame(spark, [*POINTS, (1, (1.0, 0.0)), (7, None), (None, (3.0, 3.0))])
    q = frame(spark, [(1, (1.0, 0.0)), (8, None)], "qid")
    got = knn.exact_knn(c, q, 50, "L2").collect()
    assert sorted(r["id"] for r in got) == [0, 2, 3, 4, 5]  # itself, null vectors and null ids take no part; k > n is short
    empty = frame(spark, [])
    assert knn.exact_knn(empty, q, 3, "L2").count() == 0
    assert knn.exact_knn(c, frame(spark, [], "qid"), 3, "L2").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(0, 5)), max_size=60), st.integers(1, 5))
def test_keep_top_keeps_the_smallest(rows, k):
    q, i, d = (np.array([r[j] for r in rows], dtype=float if j == 2 else np.int64) for j in range(3))
    got = list(zip(*(c.tolist() for c in knn.keep_top(q, i, d, k))))
    want = []
    for qid in sorted({r[0] for r in rows}):
        want += [(qid, b, a) for a, b in sorted({(float(r[2]), r[1]) for r in rows if r[0] == qid})[:k]]
    assert got == want


@pytest.mark.parametrize("shipped", [knn.SHIPPED_QUERIES, 0])
def test_a_first_row_of_wrong_length_is_left_out_alone(spark, shipped, monkeypatch):
    monkeypatch.setattr(knn, "SHIPPED_QUERIES", shipped)
    corpus = frame(spark, [(99, (1.0, 2.0, 3.0)), *POINTS]).coalesce(1)
    asked = frame(spark, [(0, (0.0, 0.0)), (4, (10.0, 1.0))], "qid")
    got = found(knn.exact_knn(corpus, asked, 1, "L2"))
    assert got == {(0, 0): 1, (4, 0): 3}
