import numpy as np
import pytest

from plumbline.llm import diverse as D

COLS = "run_id bigint, id bigint, x float, y float, z float, point_class tinyint, loaded_at int, cell int"


def greedy_brute(p, cls, picks):
    """Determinants by definition: the row with the largest ratio of determinants, the first of equal ones."""
    k = np.exp(-((p[:, None] - p[None]) ** 2).sum(2) / (2 * D.WIDTH**2)) * np.where(cls[:, None] == cls[None], 1, D.OTHER_CLASS)
    chosen = []
    for _ in range(picks):
        base = np.linalg.det(k[np.ix_(chosen, chosen)]) if chosen else 1.0
        gains = [np.linalg.det(k[np.ix_([*chosen, i], [*chosen, i])]) / base if i not in chosen else -1 for i in range(len(p))]
        if max(gains) < 1e-4:
            break
        chosen.append(int(np.argmax(np.round(gains, 6))))
    return chosen


def test_incremental_gains_are_ratios_of_determinants():
    rng = np.random.default_rng(1)
    p, cls, cell = rng.random((60, 3)), rng.integers(0, 3, 60), np.repeat([0, 1, 2], [30, 29, 1])
    rows, gains = D.greedy(cell, p, cls, 6)
    for c in range(3):
        at = np.nonzero(cell == c)[0]
        mine = [r for r in rows if cell[r] == c]
        assert mine == [int(at[i]) for i in greedy_brute(p[at].astype(np.float32), cls[at], 6)]
        g = [x for r, x in zip(rows, gains) if cell[r] == c]
        assert g[0] == 1 and all(a >= b - 1e-5 for a, b in zip(g, g[1:]))
    copies = D.greedy(np.zeros(5, int), np.zeros((5, 3)), np.zeros(5, int))
    assert copies[0].tolist() == [0]


def points(spark, n=3000, seed=2):
    rng = np.random.default_rng(seed)
    xyz = np.where(rng.random((n, 1)) < 0.8, rng.normal(0.5, 0.01, (n, 3)), rng.uniform(-1, 1, (n, 3)))  # a crowd
    cls = np.where(rng.random(n) < 0.99, 0, rng.integers(1, 8, n))
    rows = [(1 + i % 2, i, *map(float, xyz[i]), int(cls[i]), 0, 9) for i in range(n)]
    rows += [(r[0], r[1], *r[2:6], 1, 9) for r in rows[:100]]  # sent twice
    rows += [(1, 50_001, None, 0.0, 0.0, 3, 0, 9), (1, 50_002, float("nan"), 0.0, 0.0, None, 0, 9), (None, 50_003, 0.0, 0.0, 0.0, 1, 0, 9), (1, None, 0.0, 0.0, 0.0, 1, 0, 9)]
    return spark.createDataFrame(rows, COLS)


def test_sizes_classes_regions_and_layout(spark):
    pts = points(spark)
    req = spark.createDataFrame([(1, 20), (2, 200), (3, 1501), (4, 10**6), (5, 0), (6, None)], "request_id int, requested_budget bigint")
    got = D.varied_subsets(pts, req).toPandas()
    n = {1: 1502, 2: 1500}
    for (run, request), g in got.groupby(["run_id", "request_id"]):
        assert len(g) == g["id"].nunique() == min(g["requested_budget"].iloc[0], n[run])
    assert set(got["request_id"]) == {1, 2, 3, 4} and set(got["run_id"]) == {1, 2}
    info = pts.toPandas().drop_duplicates("id").set_index("id")
    for run in (1, 2):
        small = info.loc[got[(got["run_id"] == run) & (got["request_id"] == 1)]["id"]]
        assert set(small["point_class"].dropna()) == set(info[info["run_id"] == run]["point_class"].dropna())
        assert (small[["x", "y", "z"]].sub(0.5).abs().max(axis=1) > 0.05).mean() > 0.6  # the crowd holds 80 % of the points
    again = D.varied_subsets(pts.repartition(7), req).toPandas()
    key = ["run_id", "request_id", "id"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


def test_coinciding_points_still_give_the_full_number(spark):
    pts = spark.createDataFrame([(1, i, 0.0, 0.0, 0.0, 0, 0, 0) for i in range(300)], COLS)
    req = spark.createDataFrame([(1, 120)], "request_id int, requested_budget bigint")
    assert D.varied_subsets(pts, req).select("id").distinct().count() == 120
    assert D.varied_subsets(pts.limit(0), req).count() == 0


def block_table(rng, n, blocks):
    import pyarrow as pa

    block = np.sort(rng.integers(0, blocks, n))
    ints = {"block": block.astype(np.int32), "_shard": np.zeros(n, np.int32), "cls": np.zeros(n, np.int32), "levels": np.full(n, 1 << 4, np.int32)}
    return pa.table({"run_id": np.ones(n, np.int64), "cell": (block * 512 + rng.integers(0, 512, n)) << (3 * (D.DEPTH - D.BLOCK_LEVEL - 3)), "id": np.arange(n), "u": rng.permutation(n), **ints, **{a: rng.random(n).astype(np.float32) for a in "xyz"}})


@pytest.mark.parametrize("unit", [64, 10**6])
def test_the_size_of_a_task_unit_does_not_matter(unit, monkeypatch):
    import pyarrow as pa

    t = block_table(np.random.default_rng(3), 400, 12)
    monkeypatch.setattr(D, "UNIT", unit)
    out = pa.Table.from_batches(list(D._core_sets(iter(t.to_batches(max_chunksize=37)))))
    monkeypatch.setattr(D, "UNIT", 10**9)
    whole = pa.Table.from_batches(list(D._core_sets(iter(t.to_batches()))))
    assert sorted(out.column("id").to_pylist()) == sorted(whole.column("id").to_pylist())


def test_a_block_in_pieces_covers_every_cell_and_is_copied_a_bounded_number_of_times(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "UNIT", 500)
    copied = [0]
    t = block_table(np.random.default_rng(4), 20_000, 1)
    pieces = list(D._core_sets(iter(t.to_batches(max_chunksize=100))))
    assert len(pieces) >= 30 and max(p.num_rows for p in pieces) <= 700
    out = pa.Table.from_batches(pieces)
    assert len(set(out.column("id").to_pylist())) == out.num_rows
    assert set(out.column("cell").to_pylist()) == {c >> (3 * (D.DEPTH - 4)) for c in t.column("cell").to_pylist()}
    one = pa.Table.from_batches(list(D._whole_groups(iter(pa.table({"k": np.zeros(5000, np.int64), "id": np.zeros(5000, np.int64)}).to_batches(max_chunksize=10)), ["k"], lambda x: copied.append(x.num_rows) or iter(x.to_batches()), "id")))
    assert one.num_rows == 5000 and copied == [0, 5000]  # one id alone is never cut


def log_determinant(p, cls, level):
    q = p * 2.0**level
    k = np.exp(-((q[:, None] - q[None]) ** 2).sum(2) / (2 * D.WIDTH**2)) * np.where(cls[:, None] == cls[None], 1, D.OTHER_CLASS)
    return np.linalg.slogdet(k + 1e-6 * np.eye(len(k)))[1]


def test_the_united_pass_has_a_larger_determinant_than_cells_alone(monkeypatch):
    """Eight cells of uniform points: the last pass against the cells' own choices of equal number, and against chance."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, level = 4000, 4
    p = (rng.random((n, 3)) / 8).astype(np.float32)  # one parent of level 3
    cell = sum(((p[:, i] * 16).astype(np.int64) << i) for i in range(3))
    order = np.lexsort((np.arange(n), cell))
    p, cell = p[order], cell[order]
    zero = np.zeros(n, np.int64)
    core, gains = D.greedy(D._runs(cell), p * np.float32(2**level), zero)
    alone = core[np.lexsort((core, -gains))][:40]
    t = pa.table({"run_id": zero[core], "level": np.full(len(core), level, np.int32), "parent": zero[core], "cell": cell[core], "id": core, "u": core, "cls": zero[core].astype(np.int32), **{a: p[core, i] for i, a in enumerate("xyz")}})
    t = t.sort_by([("cell", "ascending"), ("u", "ascending")]).combine_chunks()
    out = pa.Table.from_batches(list(D._united(iter(t.to_batches()))))
    got = out.to_pandas().sort_values(["gain", "id"], ascending=[False, True])
    united = got["id"].to_numpy()[:40]
    assert got[got["lead"]].shape[0] == 8
    d = [log_determinant(p[np.sort(x)].astype(float), zero[x], level) for x in (united, alone, rng.choice(n, 40, replace=False))]
    assert d[0] > -5 > max(d[1:])  # choices of single cells meet at the borders and are worse than chance


@pytest.mark.parametrize("far", [1.0, 1000.0, -1e30])
def test_crowded_cells_are_varied_too(spark, far):
    rng = np.random.default_rng(4)
    xyz = np.where(np.arange(2000)[:, None] < 1900, rng.normal(0.0005, 2e-6, (2000, 3)), rng.uniform(0, 0.001, (2000, 3)))  # one cell of 64 a side
    pts = spark.createDataFrame([(1, i, *map(float, v), 0, 0, 0) for i, v in enumerate(xyz)] + [(1, 2000, far, far, far, 0, 0, 0)], COLS)
    req = spark.createDataFrame([(1, 200), (2, 600)], "request_id int, requested_budget bigint")
    got = D.varied_subsets(pts, req).toPandas()
    for request, budget in ((1, 200), (2, 600)):
        ids = set(got[got["request_id"] == request]["id"])
        assert len(ids) == budget and 2000 in ids
        assert len(ids & set(range(1900, 2000))) >= 95  # a random choice has 10 and 30


def test_all_positions_come_before_copies(spark):
    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.random((300, 3)), np.full((700, 3), 0.5), 0.25 + np.arange(50)[:, None] * 1e-5 * np.ones((1, 3))])
    pts = spark.createDataFrame([(1, i, *map(float, v), 0, 0, 0) for i, v in enumerate(xyz)], COLS)
    req = spark.createDataFrame([(1, 360)], "request_id int, requested_budget bigint")
    ids = {r["id"] for r in D.varied_subsets(pts, req).collect()}
    assert len(ids) == 360 and len(ids - set(range(300, 1000))) == 350
