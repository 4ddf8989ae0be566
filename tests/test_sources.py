"""Targets that open by their address: JDBC against an embedded database, HTTP against a local stub, files, lakes, generated ones."""

import json
import threading
import urllib.request
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import service
from plumbline.functions import vectors as V
from plumbline.operators import generate
from plumbline.operators.validate import UsageError
from plumbline.plans import calibrate, export, scene_build, scene_codec
from plumbline.plans.audit import run_audit
from plumbline.plans.config import AuditConfig
from plumbline.sources import base, engines, lake, postgres
from plumbline.sources.base import open_target


class Embedded(postgres.PostgresSource):
    """The same source against a database that has no catalogue of vector indexes and no distance operators."""

    def _catalogue(self):
        return {"type": "vector(2)", "method": "ivfflat", "opclass": "vector_l2_ops", "index": "items_idx", "options": ["lists=2"], "read_only": True, "superuser": True}


@pytest.fixture(scope="module")
def database(spark):
    url = "jdbc:derby:memory:vectors"
    jvm = spark.sparkContext._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    connection.createStatement().executeUpdate('CREATE SCHEMA "s"')
    connection.createStatement().executeUpdate('CREATE TABLE "s"."items" ("id" BIGINT, "emb" VARCHAR(200), "kind" VARCHAR(9))')
    for i in range(40):
        connection.createStatement().executeUpdate(f"INSERT INTO \"s\".\"items\" VALUES ({i * 3}, '[{i},{i % 5}]', 'k{i % 2}')")
    connection.close()
    return url


def test_a_relational_table_over_jdbc(spark, database):
    t = engines.parse_sql_target("postgres://u:hunter2secret@h/db?table=s.items&vector=emb")
    src = Embedded(spark, t, database, "{}")
    d = src.descriptor()
    assert (d.engine, d.index_kind, d.metric_space, d.dimension, d.index_name) == ("postgres", "IVF", "L2", 2, "items_idx") and "hunter2" not in str(d.to_dict())
    assert src.meta["options"] == {"lists": "2"} and "superuser" in src.warnings[0]
    rows = src.corpus()
    assert rows.rdd.getNumPartitions() > 1  # split by ranges of the id
    assert {r["id"]: r["vec"] for r in rows.collect()} == {i * 3: [float(i), float(i % 5)] for i in range(40)}
    assert src.payload("kind").filter("kind = 'k1'").count() == 20
    assert src.capabilities().proxy_counts and src.partitions() is None
    sql = src._nearest([1.0, 2.0], 5)
    assert sql == """SELECT "id" FROM "s"."items" ORDER BY "emb" <-> '[1.0,2.0]' LIMIT 5"""
    base.assert_read_only(src)
    with pytest.raises(ConnectionError):
        Embedded(spark, t, "jdbc:derby:memory:nothing", "{}").rows("SELECT 1")


def test_searches_of_a_relational_table(spark, database):
    class Searching(Embedded):
        plan = [{"Plan": {"Node Type": "Limit", "Plans": [{"Node Type": "Index Scan"}]}}]

        def rows(self, sql):
            return [(json.dumps(self.plan),)] if sql.startswith("EXPLAIN") else super().rows(sql)

        def _nearest(self, vec, k):  # the embedded database has no distances: the first ids stand for the answer
            return f'SELECT "id" FROM "s"."items" WHERE "id" >= {int(vec[0])} FETCH FIRST {k} ROWS ONLY'

    src = Searching(spark, engines.parse_sql_target("postgres://h/db?table=s.items&vector=emb"), database, "{}")
    asked = spark.createDataFrame([(q, [float(q), 0.0]) for q in range(30)], "qid bigint, vec array<float>")
    found = src.search(asked, 3).collect()
    assert len(found) == 90 and {r["rank"] for r in found} == {0, 1, 2} and min(r["id"] for r in found if r["qid"] == 29) == 30
    assert src.search(asked.limit(0), 3).count() == 0
    src.plan = [{"Plan": {"Node Type": "Seq Scan"}}]
    with pytest.raises(UsageError, match="index_not_used"):
        src.search(asked, 3)


POINTS = {i: [float(i), float(i % 7), 1.0] for i in range(2, 250, 2)}


class Stub(BaseHTTPRequestHandler):
    names = False
    log: list = []

    def log_message(self, *a):
        pass

    def _answer(self, body, status=200):
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def ids(self):
        return [f"00000000-0000-0000-0000-{i:012d}" if self.names and i > 100 else i for i in POINTS]

    def do_GET(self):
        if self.path.startswith("/telemetry"):
            return self._answer({"result": {"collections": {"collections": [{"id": "c", "shards": [{"num_deleted_vectors": 3}, {"num_deleted_vectors": 4}]}, {"id": "other", "num_deleted_vectors": 100}]}}})
        if self.path != "/collections/c" or self.headers["api-key"] != "longkey":
            return self._answer({}, 404)
        return self._answer({"result": {"points_count": len(POINTS), "indexed_vectors_count": 90, "config": {"params": {"vectors": {"emb": {"size": 3, "distance": "Euclid"}}}}}})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        ids, vec = self.ids(), list(POINTS.values())
        if self.path.endswith("/scroll"):
            at = ids.index(body["offset"]) if "offset" in body else 0
            part = range(at, min(at + body["limit"], len(ids)))
            points = [{"id": ids[i], "vector": {"emb": vec[i]} if body["with_vector"] else None, "payload": {"kind": f"k{i % 2}", "n": i} if body["with_payload"] else None} for i in part]
            return self._answer({"result": {"points": points, "next_page_offset": ids[part.stop] if part.stop < len(ids) else None}})
        self.log.append(body)
        q = np.array(body["vector"]["vector"])
        order = np.argsort([((np.array(v) - q) ** 2).sum() for v in vec], kind="stable")[: body["limit"]]
        return self._answer({"result": [{"id": ids[i], "score": 0.0} for i in order]})


@pytest.fixture(scope="module")
def stub():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"qdrant://127.0.0.1:{server.server_address[1]}/c?api_key=longkey"
    server.shutdown()


@pytest.mark.parametrize("names", [False, True])
def test_a_collection_over_http(spark, stub, names, monkeypatch):
    from plumbline.sources import rest

    monkeypatch.setattr(rest, "PAGE", 50)
    Stub.names = names
    src = open_target(spark, stub)
    d = src.descriptor()
    assert (d.index_kind, d.metric_space, d.dimension) == ("HNSW", "L2", 3) and "longkey" not in str(d.to_dict())
    assert src.counts() == {"live": 124, "deleted": 7, "total": 131, "indexed": 90, "exact": True} and src.capabilities().filtered_search
    assert len(src.pages()) == 3
    rows = src.corpus().collect()
    assert len({r["id"] for r in rows}) == 124 and sorted(r["vec"] for r in rows) == sorted(POINTS.values())
    if not names:
        assert {r["id"]: r["vec"] for r in rows} == POINTS
    assert src.payload("kind").groupBy("kind").count().count() == 2
    asked = src.corpus().filter("id < 20").select(F.col("id").alias("qid"), "vec")
    found = src.search(asked, 2, {"hnsw_ef": 64, "filter": {"kind": "k1"}})
    assert {r["qid"] for r in found.filter("rank = 0 AND qid = id").collect()} == {r["qid"] for r in asked.collect()}
    rep = run_audit(src, AuditConfig(queries=10, k=3, metrics_enabled=("canary_recall", "dfi")))
    assert rep.metrics[0].value == 1.0 and rep.metrics[3].value == pytest.approx(7 / 131)


def test_a_filtered_search_sends_the_filter(spark, stub):
    Stub.names, Stub.log = False, []
    src = open_target(spark, stub)
    src.search(spark.createDataFrame([(1, [0.0, 0.0, 0.0])], "qid bigint, vec array<float>"), 2, {"hnsw_ef": 64, "exact": True, "filter": {"kind": "k1"}}).collect()
    assert Stub.log == [{"limit": 2, "with_payload": False, "params": {"hnsw_ef": 64, "exact": True}, "filter": {"must": [{"key": "kind", "match": {"value": "k1"}}]}, "vector": {"name": "emb", "vector": [0.0, 0.0, 0.0]}}]
    for bad in (stub.replace("/c?", "/nothing?"), "qdrant://:memory:/c"):
        with pytest.raises(UsageError):
            open_target(spark, bad)
    with pytest.raises(ConnectionError):
        open_target(spark, "qdrant://127.0.0.1:1/c")


def test_vector_files_and_archives(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(20, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>")
    export.write_fvecs(rows, str(tmp_path / "a.fvecs"))
    np.save(tmp_path / "b.npy", x)
    (tmp_path / "w.txt").write_text("b 1 2\na 3 4\n")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "a.fvecs", "sets/a.fvecs")
    for uri in (f"fvecs://{tmp_path}/a.fvecs", f"npy://{tmp_path}/b.npy", f"fvecs://{tmp_path}/z.zip?member=sets/*.fvecs&metric=L2"):
        src = open_target(spark, uri)
        assert src.descriptor().dimension == 4 and sorted(r["vec"] for r in src.corpus().collect()) == sorted(x.tolist())
    assert sorted((r["id"], r["vec"]) for r in open_target(spark, f"words://{tmp_path}/w.txt").corpus().collect()) == [(0, [3.0, 4.0]), (1, [1.0, 2.0])]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out", "x")
    with pytest.raises(UsageError):
        export.unpack(spark, str(tmp_path / "bad.zip"))


def test_lake_tables_with_versions_and_statistics(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "_rowid bigint, emb array<float>")
    rows.write.parquet(str(tmp_path / "set" / "data.lance"))
    (tmp_path / "set" / "data.lance" / "index.json").write_text(json.dumps({"kind": "IVF", "metric": "L2", "library": "0.9.1", "fragments": [{"physical_rows": 20, "num_deletions": 2}, {"physical_rows": 15, "num_deletions": None}], "partition_sizes": [20, 15]}))
    src = open_target(spark, f"lance://{tmp_path}/set?format=parquet&version=3")
    assert src.descriptor().version == "3" and src.descriptor().index_kind == "IVF" and "outside" in src.warnings[0]
    assert src.counts() == {"live": 33, "deleted": 2, "total": 35, "indexed": 33, "exact": True}
    assert sorted(r["size"] for r in src.partitions().collect()) == [15, 20]
    found = src.search(src.corpus().filter("id = 4").select(F.col("id").alias("qid"), "vec"), 2, {"nprobes": 4, "refine_factor": 3})
    assert [r["id"] for r in found.orderBy("rank").collect()] == [4, 3]
    assert lake.resolve(spark, f"{tmp_path}/set") == f"{tmp_path}/set/data.lance"
    with pytest.raises(UsageError):
        open_target(spark, f"lance://{tmp_path}/set")  # no reader of that format here
    with pytest.raises(UsageError):
        open_target(spark, f"lance://{tmp_path}?format=parquet")


@pytest.mark.parametrize("name", list(generate.SCENARIOS))
def test_scenarios_are_judged_as_they_should_be(spark, name):
    src = open_target(spark, f"synthetic://{name}?size=small")
    rep = run_audit(src, AuditConfig(queries=60, hubness_sample_size=1500))
    want = generate.SCENARIOS[name]
    assert {m: s for m, s in {m.id: m.state for m in rep.metrics}.items() if m in want.states} == want.states and rep.verdict == want.verdict


def test_scenarios_come_in_sizes_and_can_be_kept(spark, tmp_path):
    tiny = open_target(spark, "synthetic://tombstoned?size=tiny")
    assert tiny.corpus().count() == 2000
    export.save_index(tiny, str(tmp_path / "kept"))
    again = open_target(spark, f"parquet://{tmp_path}/kept")
    assert again.descriptor().index_kind == "IVF" and again.counts() == tiny.counts()
    asked = tiny.corpus().filter("id % 70 = 0").select(F.col("id").alias("qid"), "vec")
    a, b = tiny.search(asked, 5, {"nprobe": 2}), again.search(asked, 5, {"nprobe": 2, "ef_budget": 8})
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0
    for bad in ("synthetic://nothing", "synthetic://tiny?size=huge"):
        with pytest.raises(UsageError):
            open_target(spark, bad)


def test_growth_to_a_wanted_cv(spark):
    rows = generate.generate_corpus(spark, 800, 4, 8)
    grown = generate.skew_partitions(rows, None, 5, target_cv=0.6)
    sizes = np.array([r["count"] for r in grown.groupBy("cell").count().collect()], float)
    assert sizes.std() / sizes.mean() == pytest.approx(0.6, abs=0.05)
    assert generate.growth_for_cv([10, 1], 0.5) == 1.0
    with pytest.raises(ValueError):
        generate.growth_for_cv([5, 5], 3.0)


def test_generated_numbers_are_normal_and_follow_from_the_id():
    x = generate._normal(1, "p", np.arange(20_000), 9)
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs(np.corrcoef(x.T) - np.eye(9)).max() < 0.04
    assert (generate._normal(1, "p", np.array([77]), 9) == x[77]).all() and not (generate._normal(2, "p", np.array([77]), 9) == x[77]).any()
    assert generate._normal(1, "p", np.empty(0, np.int64), 3).shape == (0, 3)


def test_sources_that_write_are_refused():
    class Bad:
        def delete_points(self): ...

    with pytest.raises(UsageError, match="delete_points"):
        base.assert_read_only(Bad())


def test_vectors_in_the_order_asked_for(spark):
    c = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "id bigint, vec array<float>")
    assert [r["id"] for r in base.fetch_vectors(c, [7, 2, 2, 5]).collect()] == [7, 2, 2, 5]


def test_a_scene_from_a_source(spark):
    src = open_target(spark, "synthetic://tombstoned?rows=600")
    nk = spark.range(100).select("id", (F.col("id") % 3).alias("n_k"))
    built = scene_build.assemble(src, nk=nk, budget=200)
    scene = scene_codec.decode(built.encoded())
    assert scene.n_points == 200 == scene.lod["actual_count"] and scene.lod["total_available"] == 600 and not scene.lod["complete"] and scene.lod["has_tombstones"]
    assert set(scene.buffers) == set(scene_codec.BUFFERS) and abs(scene.buffers["positions"]).max() <= 1 and set(scene.buffers["classes"].tolist()) <= {0, 1, 2, 3}
    assert built.presets["overview"].available and {"partition_sizes", "nk"} <= set(built.charts)
    rep = run_audit(src, AuditConfig(queries=5, metrics_enabled=("dfi",)))
    hidden = open_target(spark, "synthetic://capability_limited?rows=300")
    plain = scene_build.assemble(hidden, rep, budget=1000)
    assert not plain.lod["has_tombstones"] and plain.lod["tombstone_reason"] and plain.lod["complete"] and plain.lod["actual_count"] == 300


def test_a_served_source_with_progress_over_a_web_socket(spark):
    src = open_target(spark, "synthetic://tombstoned?rows=300")
    state = service.state_of(src, AuditConfig(queries=6, metrics_enabled=("canary_recall", "dfi")), budget=100)
    server = service.serve(state, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    assert state.start_audit()
    import socket

    with socket.create_connection(("127.0.0.1", port), timeout=90) as s:
        s.sendall(b"GET /api/progress/ws HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\n\r\n")
        data = b""
        while b"\x88\x00" not in data[-2:]:
            data += s.recv(65536)
    head, _, body = data.partition(b"\r\n\r\n")
    assert b"101" in head and b"s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in head
    frames = []
    while body[:1] == b"\x81":
        n, at = (body[1], 2) if body[1] < 126 else (int.from_bytes(body[2:4], "big"), 4)
        frames.append(json.loads(body[at : at + n]))
        body = body[at + n :]
    assert frames[-1]["state"] == "done" and [f["fraction"] for f in frames] == sorted(f["fraction"] for f in frames)
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{port}{p}").read()
    assert scene_codec.decode(get("/api/scene")).n_points == 100 and json.loads(get("/api/report"))["verdict"] == "FAIL" and json.loads(get("/api/presets"))["overview"]["available"]
    live = src.corpus().filter("NOT deleted").agg(F.min("id")).first()[0]
    status, kind, answer = service.respond(state, "POST", "/api/probe", json.dumps({"id": live, "k": 5}).encode())
    assert status == 200 and sum(len(json.loads(answer)["roles"][r]) for r in ("hit", "missed")) == 5
    assert service.respond(state, "POST", "/api/probe", b'{"id": 999999}')[0] == 404
    server.shutdown()


def test_a_sweep_over_data_sets(spark, tmp_path):
    sources = {n: open_target(spark, f"synthetic://{n}?rows=200") for n in ("tiny", "tombstoned")}
    rows = calibrate.sweep(sources, [100, 150], [5], AuditConfig(queries=6, metrics_enabled=("dfi", "hub_share_top1pct")))
    assert rows.count() == 20 and rows.filter("metric_id = 'dfi' AND metric_state = 'FAIL'").count() == 2
    calibrate.to_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 20


def test_half_precision_and_colours(spark):
    x = np.array([0.0, -0.0, 1.0, -2.5, 65504.0, 6e-8, 1e-5, np.inf, -np.inf, np.nan, 0.333], np.float16)
    df = spark.createDataFrame([(bytearray(x.astype("<f2").tobytes()),), (bytearray(b"abc"),), (None,)], "b binary")
    got = [r[0] for r in df.select(V.from_half(F.col("b"), len(x))).collect()]
    assert np.array_equal(np.array(got[0], np.float32), x.astype(np.float32), equal_nan=True) and got[1:] == [None, None]
    ramp = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,), (9.0,), (None,), (float("nan"),)], "v double").select(V.colour_ramp(F.col("v"), ["#000000", "#ff8000", "#ffffff"])).collect()
    assert [r[0] for r in ramp] == ["#000000", "#804000", "#ff8000", "#ffffff", "#ffffff", None, None]
