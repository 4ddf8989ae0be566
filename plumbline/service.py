"""A thin HTTP layer over library results, with progress of a running audit and admission of point probes.

Nothing is computed per request but probes; the rest is what the last audit left.
"""

from __future__ import annotations

import base64
import hashlib
import json
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from plumbline.operators.validate import UsageError
from plumbline.plans import report as R
from plumbline.plans.redact import redact

#: Stages of an audit in order; limits of probes.
STAGES = ("open", "scan", "validate", "ground_truth", "canary", "hubness", "dfi", "partitions", "report")
MAX_K, PROBES, WINDOW_SECONDS, CACHED = 100, 30, 60.0, 256


class Progress:
    """Progress that never goes back, with an estimate of the rest; ends in done or failed."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._clock, self._began, self._lock = clock, clock(), threading.Lock()
        self.stage, self.fraction, self.detail, self.state = STAGES[0], 0.0, "", "running"

    def update(self, stage: str, part: float = 0.0, detail: str = "") -> None:
        with self._lock:
            if self.state != "running":
                return
            at = (STAGES.index(stage) + min(1.0, max(0.0, part))) / len(STAGES)
            if at >= self.fraction:
                self.stage, self.fraction, self.detail = stage, at, redact(detail)[:200]

    def finish(self, error: str | None = None) -> None:
        with self._lock:
            self.state, self.detail = ("failed", redact(error)[:200]) if error else ("done", "")
            self.fraction = self.fraction if error else 1.0

    def frame(self) -> dict:
        with self._lock:
            spent = self._clock() - self._began
            eta = spent * (1 - self.fraction) / self.fraction if self.state == "running" and self.fraction > 0 else None
            return {"stage": self.stage, "fraction": round(self.fraction, 4), "eta_seconds": eta, "detail": self.detail, "state": self.state}


class ProbeGuard:
    """Admits probes by id: a sliding window of calls and a cache of recent answers."""

    def __init__(self, probe: Callable[[int, int], dict], clock: Callable[[], float] = time.monotonic):
        self._probe, self._clock, self._lock = probe, clock, threading.Lock()
        self._calls: deque[float] = deque()
        self._cache: OrderedDict[tuple[int, int], dict] = OrderedDict()

    def ask(self, body: dict) -> tuple[int, dict]:
        """``(status, answer)``: 400 for anything but an id and k of 1..100, 429 beyond 30 calls a minute."""
        if set(body) - {"id", "k"} or type(body.get("id")) is not int or type(body.get("k", 10)) is not int or not 1 <= body.get("k", 10) <= MAX_K:
            return 400, {"error": "a probe has an integer id and k from 1 to 100"}
        with self._lock:
            now = self._clock()
            while self._calls and now - self._calls[0] >= WINDOW_SECONDS:
                self._calls.popleft()
            if len(self._calls) >= PROBES:
                return 429, {"error": "too many probes", "retry_after": WINDOW_SECONDS - (now - self._calls[0])}
            self._calls.append(now)
            key = (body["id"], body.get("k", 10))
            if key in self._cache:
                self._cache.move_to_end(key)
                return 200, self._cache[key]
        try:
            answer = self._probe(*key)
        except UsageError as e:
            return 404, {"error": redact(str(e))}
        with self._lock:
            self._cache[key] = answer
            while len(self._cache) > CACHED:
                self._cache.popitem(last=False)
        return 200, answer


class State:
    """What the server serves; ``audit`` runs one audit at a time in the background."""

    def __init__(self, report: R.Report | None = None, scene: bytes | None = None, charts: dict | None = None, presets: dict | None = None, guard: ProbeGuard | None = None, audit: Callable[[Progress], R.Report] | None = None):
        self.report, self.scene, self.charts, self.presets, self.guard, self.audit = report, scene, charts, presets, guard, audit
        self.progress = Progress()
        self._busy = threading.Lock()

    def start_audit(self) -> bool:
        if not self.audit or not self._busy.acquire(blocking=False):
            return False
        self.progress = Progress()

        def run() -> None:
            try:
                self.report = self.audit(self.progress)
                self.progress.finish()
            except Exception as e:  # noqa: BLE001 - shown to the caller
                self.progress.finish(str(e) or type(e).__name__)
            finally:
                self._busy.release()

        threading.Thread(target=run, daemon=True).start()
        return True


def respond(state: State, method: str, path: str, body: bytes = b"") -> tuple[int, str, bytes]:
    """``(status, content type, bytes)`` of a request."""
    as_json = lambda code, x: (code, "application/json", json.dumps(x, default=str).encode())
    missing = as_json(404, {"error": "not available"})
    if method == "POST" and path == "/api/audit":
        return as_json(202, {"started": True}) if state.start_audit() else as_json(409, {"error": "an audit runs already, or none can be started"})
    if method == "POST" and path == "/api/probe":
        try:
            doc = json.loads(body or b"{}")
        except ValueError:
            return as_json(400, {"error": "the body is no JSON"})
        return as_json(*state.guard.ask(doc if isinstance(doc, dict) else {})) if state.guard else missing
    if method != "GET":
        return as_json(405, {"error": "unknown method"})
    if path == "/api/health":
        return as_json(200, {"status": "ok"})
    if path == "/api/progress":
        return as_json(200, state.progress.frame())
    if path == "/api/report" and state.report:
        return 200, "application/json", R.to_json(state.report).encode()
    if path == "/metrics" and state.report:
        return 200, "text/plain; version=0.0.4", R.to_prometheus(state.report).encode()
    if path == "/api/scene" and state.scene is not None:
        return 200, "application/octet-stream", state.scene
    for name in ("charts", "presets"):
        if path == f"/api/{name}" and getattr(state, name) is not None:
            return as_json(200, getattr(state, name))
    return missing


#: Seconds between looks at the progress while it is followed.
INTERVAL = 0.1


def accept_key(key: str) -> str:
    """The answer to a web-socket handshake."""
    return base64.b64encode(hashlib.sha1((key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest()).decode()


def text_frame(text: str) -> bytes:
    """A whole text message from the server, which is not masked."""
    data = text.encode()
    n = len(data)
    size = bytes([n]) if n < 126 else bytes([126]) + n.to_bytes(2, "big") if n < 1 << 16 else bytes([127]) + n.to_bytes(8, "big")
    return b"\x81" + size + data


def state_of(source, config, params: dict | None = None, budget: int | None = None) -> State:
    """What is served for a source: audits on demand, the scene of the last one, and probes of live ids."""
    from plumbline.operators import ivf, knn, probe
    from plumbline.plans.audit import run_audit
    from plumbline.plans.scene_build import assemble

    state = State()
    spark = source.corpus().sparkSession

    def audit(progress: Progress) -> R.Report:
        order = {"canary_recall": "canary", "hub_share_top1pct": "hubness", "antihub_fraction": "hubness", "dfi": "dfi", "partition_size_cv": "partitions"}
        progress.update("scan")
        report = run_audit(source, config, params, on_metric=lambda m: progress.update(order[m.id], 0.5, f"{m.id} {m.state}"))
        progress.update("report")
        built = assemble(source, report, budget=budget, seed=config.seed)
        state.scene = built.encoded()
        state.charts = {name: [r.asDict() for r in rows.orderBy("bucket_start").collect()] for name, rows in built.charts.items()}  # 64 buckets or so
        state.presets = {name: {**p.__dict__, "available": p.available} for name, p in built.presets.items()}
        return report

    def point(id_: int, k: int) -> dict:
        from pyspark.sql import functions as F

        rows = source.corpus()
        live = rows.filter(~F.col("deleted"))
        metric = source.descriptor().metric_space
        live = ivf.normalised(live) if metric == "COSINE" else live
        asked = live.filter(F.col("id") == id_).select(F.col("id").alias("qid"), "vec").limit(1)
        if asked.isEmpty():
            raise UsageError(f"{id_} is no live id")
        truth = knn.exact_knn(live, asked, k, metric)
        got = ivf.drop_self(source.search(asked, k + 1, params).withColumn("dist", F.col("rank").cast("double")), k)
        roles = probe.probe_roles(truth, got, rows).collect()  # at most 2 k rows
        return {"id": id_, "k": k, "roles": {role: sorted(r["id"] for r in roles if r["role"] == role) for role in ("hit", "missed", "dead", "unexpected")}}

    spark.sparkContext.setLocalProperty("spark.job.description", "service")
    state.audit, state.guard = audit, ProbeGuard(point)
    return state


def serve(state: State, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server bound to ``host``; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _follow(self) -> None:
            """Progress over a web socket: a text message whenever something changed, the last one when the audit has ended."""
            self.send_response(101)
            for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", accept_key(self.headers["Sec-WebSocket-Key"]))):
                self.send_header(name, value)
            self.end_headers()
            self.close_connection = True
            told = None
            try:
                while True:
                    now = state.progress.frame()
                    shown = {k: v for k, v in now.items() if k != "eta_seconds"}
                    if shown != told:
                        self.wfile.write(text_frame(json.dumps(now)))
                        told = shown
                    if now["state"] != "running":
                        self.wfile.write(b"\x88\x00")  # the closing frame
                        return
                    time.sleep(INTERVAL)
            except OSError:
                return  # nobody listens any more

        def _do(self) -> None:
            if self.command == "GET" and self.path.split("?")[0] == "/api/progress/ws":
                if "websocket" in self.headers.get("Upgrade", "").lower() and self.headers.get("Sec-WebSocket-Key"):
                    return self._follow()
                self.send_error(426)
                return None
            n = min(int(self.headers.get("Content-Length") or 0), 65_536)
            status, kind, data = respond(state, self.command, self.path.split("?")[0], self.rfile.read(n) if n else b"")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            return None

        do_GET = do_POST = _do

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
