from pyspark.sql import functions as F

from plumbline.llm.permanent import NumberTable, batch_of, run_seeds, seeded_points
from plumbline.session import new_folder


def table(spark):
    return NumberTable(spark, new_folder(spark, "t"))


def picked(t):
    return {(r["request_id"], r["id"]) for r in t.select().collect()}


def test_growing_data_and_thresholds_keep_what_was_selected(spark):
    rows = spark.range(3000).select("id", F.lit(7).alias("seed"))
    whole = table(spark)
    whole.insert(rows)
    req = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, None), (4, float("nan"))], "request_id int, keep_share double")
    whole.raise_thresholds(req)
    parts = table(spark)
    seen = set()
    parts.raise_thresholds(req)
    for low in (0, 1000, 2000):
        parts.insert(rows.filter((F.col("id") >= low) & (F.col("id") < low + 1500)).repartition(5))  # batches overlap
        now = picked(parts)
        assert seen <= now
        seen = now
    assert seen == picked(whole) and {r for r, _ in seen} == {1, 2}
    assert abs(len([1 for r, _ in seen if r == 2]) - 1500) < 150
    parts.raise_thresholds(spark.createDataFrame([(2, 0.01), (1, 0.2)], "request_id int, keep_share double"))
    assert seen <= picked(parts)  # a lower wish does not lower a threshold


def test_first_number_stays_and_dirty_rows_wait(spark):
    t = table(spark)
    t.insert(spark.createDataFrame([(1, 5), (1, 3), (2, None), (None, 4)], "id bigint, seed bigint"))
    one = t.numbers().collect()
    assert len(one) == 1
    t.insert(spark.createDataFrame([(1, 9), (2, 6)], "id bigint, seed bigint"))
    t.insert(spark.createDataFrame([], "id bigint, seed bigint"))
    both = {r["id"]: r["u"] for r in t.numbers().collect()}
    assert both[1] == one[0]["u"] and set(both) == {1, 2}
    assert t.select().count() == 0


def test_points_get_the_seed_of_their_run(spark):
    points = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (3, 12), (None, 13), (1, None)], "run_id bigint, id bigint").withColumn("seed", F.lit(-1))
    runs = spark.createDataFrame([(1, 5), (1, 5), (2, None), (4, 1)], "run_id bigint, seed bigint")
    seeds = run_seeds(points, runs)
    assert {tuple(r) for r in seeded_points(points, seeds).collect()} == {(10, 5)}
    assert seeded_points(points.limit(0), run_seeds(points.limit(0), runs)).count() == 0


def test_the_query_keeps_what_it_selected_in_an_earlier_run(spark, tmp_path):
    from plumbline.llm import queries as Q

    spark.range(500).selectExpr("1L AS run_id", "id", "CAST(id % 9 AS INT) AS chunk_index").write.parquet(f"{tmp_path}/scene_point.parquet")
    spark.createDataFrame([(1, 7)], "run_id bigint, seed bigint").write.parquet(f"{tmp_path}/audit_run.parquet")
    got = []
    spark.conf.set(Q.NUMBERS_FOLDER, f"file://{tmp_path}/kept")
    try:
        for share in (0.5, 0.2):
            spark.createDataFrame([(1, share)], "request_id int, keep_share double").write.mode("overwrite").parquet(f"{tmp_path}/lod_request.parquet")
            spark.catalog.clearCache()
            got.append({r["id"] for r in Q.p1_sample(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.unset(Q.NUMBERS_FOLDER)
    assert got[0] == got[1] and len(got[0]) > 200


def test_chunks_arrive_in_order(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([0, 1, 2, 3, 4, 9, None])], "id bigint, chunk_index int")
    assert [r["_batch"] for r in batch_of(rows, 3).orderBy("id").collect()] == [0, 0, 0, 0, 1, 2, 2]
    assert batch_of(rows.limit(0), 3).count() == 0 and {r["_batch"] for r in batch_of(rows.filter("chunk_index IS NULL"), 3).collect()} == {2}


def test_many_requests_and_odd_shares(spark):
    t = table(spark)
    t.insert(spark.range(300).select("id", F.lit(1).alias("seed")))
    shares = [(i, i / 20_000) for i in range(12_000)] + [(20_000, 1.0), (20_001, 7.5), (20_002, 0.0), (20_003, -1.0)]
    t.raise_thresholds(spark.createDataFrame(shares, "request_id int, keep_share double"))
    got = {r["request_id"]: r["count"] for r in t.select().groupBy("request_id").count().collect()}
    u = sorted(r["u"] for r in t.numbers().collect())
    want = {r: sum(x < s for x in u) for r, s in shares if any(x < s for x in u)}
    assert got == want and got[20_000] == got[20_001] == 300


def test_known_thresholds_are_not_written_again(spark):
    t = table(spark)
    req = spark.createDataFrame([(1, 0.3), (1, 0.2)], "request_id int, keep_share double")
    for _ in range(3):
        t.raise_thresholds(req)
    assert t._read(t._thresholds, "request_id bigint, threshold double").count() == 1
    plan = t.select()._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
