"""Whole plans: queries against their SQL, an audit, the command line and the service."""

import json
import math
import os
import time
import urllib.request

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import cli, service
from plumbline.operators import generate, knn, order_stats
from plumbline.operators.validate import UsageError
from plumbline.plans import audit_queries, catalogue, heavy_key_queries, scene_queries  # noqa: F401
from plumbline.plans import report as R
from plumbline.plans.audit import gate, run_audit
from plumbline.plans import calibrate
from plumbline.plans.calibrate import hubness_sweep
from plumbline.plans.config import AuditConfig
from plumbline.sources.tables import TableSource

DATA = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(catalogue.ORACLE[name])
    got = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted((str([plain(r[c]) for c in cols]) for r in got.collect()))
    assert rows == sorted(str([plain(v) for v in r]) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def a_source(spark, name="tombstoned", rows=1500, **options):
    return TableSource(generate.scenario(spark, name, rows), name, {"id": "id", "column": "vec", "cell": "cell", "deleted": "deleted", **options})


def test_an_audit_from_source_to_gate(spark):
    src = a_source(spark)
    cfg = AuditConfig(queries=20, hubness_sample_size=400)
    rep = run_audit(src, cfg, {"nprobe": 1, "ef_budget": 8})
    by = {m.id: m for m in rep.metrics}
    assert by["dfi"].state == "FAIL" and by["dfi"].value == pytest.approx(0.35) and rep.verdict == "FAIL"
    assert by["hub_share_top1pct"].unavailable_reason == "sample_too_small"
    assert by["canary_recall"].value is not None and by["canary_recall"].evidence_strength == "low" and by["canary_recall"].detail["ci95"][0] <= by["canary_recall"].value
    schema, doc = R.json_schema()["properties"], json.loads(R.to_json(rep))
    assert all(set(doc[part]) <= set(schema[part]["properties"]) and set(schema[part]["required"]) <= set(doc[part]) and not schema[part]["additionalProperties"] for part in ("target", "run", "counts"))
    assert all(set(m) <= set(schema["metrics"]["items"]["properties"]) for m in doc["metrics"]) and set(doc) <= set(schema)
    again = run_audit(src, cfg, {"nprobe": 1, "ef_budget": 8})
    volatile = lambda r: R.to_json(R.Report(r.target, {}, r.counts, r.metrics, r.verdict, r.warnings))
    assert volatile(rep) == volatile(again)
    assert gate(rep, again, spark, "delta") == "INCONCLUSIVE"  # metrics without a value have no delta
    log = src.corpus().filter("NOT deleted AND id < 40").select(F.col("id").alias("qid"), "vec")
    only = run_audit(src, AuditConfig(metrics_enabled=("canary_recall",)), {"nprobe": 4}, queries=log)
    assert {m.state for m in only.metrics[1:]} == {"DISABLED"} and only.metrics[0].evidence_strength in ("high", "low")


def test_bad_corpora_end_an_audit(spark):
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 1.0])], "id bigint, vec array<float>")
    with pytest.raises(UsageError):
        run_audit(TableSource(bad, "x", {}))


def test_a_failing_metric_does_not_end_the_others(spark):
    src = a_source(spark, rows=300)
    src.partitions = lambda: 1 / 0
    rep = run_audit(src, AuditConfig(queries=6, metrics_enabled=("dfi", "partition_size_cv")))
    assert [m.state for m in rep.metrics] == ["DISABLED", "DISABLED", "DISABLED", "FAIL", "UNAVAILABLE"]


def test_calibration_sweep(spark):
    c = generate.generate_corpus(spark, 300, 8, 4)
    rows = hubness_sweep(c, [100, 200], [3, 5], "L2").collect()
    assert calibrate.to_markdown([r.asDict() for r in rows]).count("\n") == 6
    assert {(r["sample_size"], r["k_hub"], r["s"]) for r in rows} == {(100, 3, 100), (100, 5, 100), (200, 3, 200), (200, 5, 200)}


def test_command_line(tmp_path, spark, capsys):
    generate.generate_corpus(spark, 300, 8, 4).write.parquet(str(tmp_path / "c"))
    target = f"parquet://{tmp_path}/c?cell=cell&deleted=deleted&id=id"
    out = str(tmp_path / "r.json")
    assert cli.run(["baseline", target, "--queries", "30", "--nprobe", "4", "--output", out]) == 0
    code = cli.run(["audit", target, "--queries", "30", "--nprobe", "4", "--skip", "hub_share_top1pct", "--skip", "antihub_fraction", "--baseline", out, "--gate", "absolute", "--format", "json"])
    assert code == 0 and json.loads(capsys.readouterr().out)["verdict"] == "OK"
    assert cli.run(["export", out, "--format", "markdown"]) in (0, 1, 2, 3) and "# Audit" in capsys.readouterr().out
    with pytest.raises(UsageError):
        cli.run(["audit", target, "--filter", "broken"])


def test_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "FINISH", 20)
    monkeypatch.setattr(order_stats, "ACCURACY", 50)
    v = np.random.default_rng(1).lognormal(0, 3, 2000)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    qs = [0.0, 0.5, 0.99, 0.999, 1.0]
    assert order_stats.quantiles(df, "v", qs) == pytest.approx(np.quantile(v, qs).tolist())
    assert order_stats.quantiles(df.limit(0), "v", [0.5]) == [None]
    assert order_stats.quantiles(spark.createDataFrame([(2.0,)] * 100, "v double"), "v", [0.1, 0.9]) == [2.0, 2.0]
    ends = sorted([float("-inf")] * 35 + [1.0] * 27 + [2.0] * 27 + [float("inf")] * 32 + [1e-300, 1e300] * 4)
    far = spark.createDataFrame([(x,) for x in ends], "v double")
    places = (0, 34, 35, 38, 39, 66, 92, 93, 96, 97, 128)
    assert order_stats.quantiles(far, "v", [r / 128 for r in places]) == [ends[r] for r in places]


def test_a_deadline_gives_a_partial_answer(spark):
    c = generate.generate_corpus(spark, 400, 8, 4)
    q = c.filter("id < 5").select(F.col("id").alias("qid"), "vec")
    whole = knn.exact_knn(c, q, 5, "L2")
    full, cut = knn.exact_knn_within(c, q, 5, "L2", 1e9, slices=3)
    assert not cut and full.exceptAll(whole).count() == 0 and full.count() == 25
    part, cut = knn.exact_knn_within(c, q, 5, "L2", 0.0, slices=4)
    assert cut and part.groupBy("qid").agg(F.max("dist").alias("d")).join(whole.groupBy("qid").agg(F.max("dist").alias("w")), "qid").filter("d < w").count() == 0


def test_progress_and_probe_guard():
    now = [0.0]
    p = service.Progress(lambda: now[0])
    p.update("canary", 0.5, "password=hunter22")
    now[0] = 10.0
    f = p.frame()
    p.update("scan", 0.1)
    assert p.frame()["stage"] == "canary" and f["eta_seconds"] == pytest.approx(10.0) and "hunter22" not in f["detail"]
    p.finish("broken")
    p.update("report")
    assert p.frame()["state"] == "failed"
    calls = []
    g = service.ProbeGuard(lambda i, k: calls.append(i) or {"id": i, "k": k}, lambda: now[0])
    assert g.ask({"id": 1})[0] == 200 and g.ask({"id": 1})[0] == 200 and calls == [1]
    for bad in ({}, {"id": "1"}, {"id": True}, {"id": 1, "k": 0}, {"id": 1, "k": 101}, {"id": 1, "vec": []}):
        assert g.ask(bad)[0] == 400
    assert [g.ask({"id": i})[0] for i in range(40)].count(429) == 12
    now[0] = 75.0
    assert g.ask({"id": 5})[0] == 200


def test_service_answers():
    rep = R.Report({"engine": "t"}, {}, {"live": 1}, (), "OK")
    state = service.State(report=rep, scene=b"123", charts={"a": 1}, audit=lambda p: (p.update("scan"), time.sleep(0.2), rep)[2])
    server = service.serve(state, port=0)
    import threading

    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: urllib.request.urlopen(base + p, timeout=5).read()
    assert json.loads(get("/api/health")) == {"status": "ok"} and get("/api/scene") == b"123" and b"audit_verdict" in get("/metrics")
    assert state.start_audit() and not state.start_audit()
    assert service.respond(state, "POST", "/api/audit")[0] == 409 and service.respond(state, "GET", "/api/presets")[0] == 404
    assert service.respond(state, "POST", "/api/probe", b"{")[0] == 400
    server.shutdown()
