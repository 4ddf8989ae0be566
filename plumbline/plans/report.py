"""The audit report and its renderers: JSON, Prometheus text, Markdown and terminal."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime

from plumbline.operators.verdict import EXIT, count_deltas, warning_changes
from plumbline.plans.redact import leaks, redact

SCHEMA_VERSION = "1.1"
STATES = {"OK": 0, "WARN": 1, "FAIL": 2, "UNAVAILABLE": 3, "DISABLED": 4}


class ReportError(ValueError):
    """A report that does not keep its invariants."""


@dataclass(frozen=True)
class Metric:
    """UNAVAILABLE has a reason and no value, DISABLED has no value, the other states have one."""

    id: str
    state: str
    value: float | None = None
    unit: str = "ratio"
    thresholds: dict | None = None
    sampling: dict = field(default_factory=dict)
    detail: dict = field(default_factory=dict)
    evidence_strength: str = "medium"
    explanation: str = ""
    unavailable_reason: str | None = None

    def __post_init__(self) -> None:
        if self.state not in STATES:
            raise ReportError(f"unknown state {self.state}")
        if self.state == "UNAVAILABLE" and (self.value is not None or not self.unavailable_reason):
            raise ReportError(f"{self.id}: an unavailable metric has a reason and no value")
        if self.state == "DISABLED" and self.value is not None:
            raise ReportError(f"{self.id}: a disabled metric has no value")
        if self.state in ("OK", "WARN", "FAIL") and self.value is None:
            raise ReportError(f"{self.id}: a {self.state} metric has a value")


@dataclass(frozen=True)
class Report:
    target: dict
    run: dict
    counts: dict
    metrics: tuple[Metric, ...]
    verdict: str
    warnings: tuple[str, ...] = ()
    schema_version: str = SCHEMA_VERSION

    def __post_init__(self) -> None:
        if self.verdict not in EXIT:
            raise ReportError(f"unknown verdict {self.verdict}")
        if leaks(json.dumps(asdict(self), default=str)):
            raise ReportError("the report holds a secret")

    def compare(self, before: Report) -> dict:
        """Changes of verdict, metric values, counts and warnings against an earlier report."""
        old, new = ({m.id: m.value for m in r.metrics} for r in (before, self))
        deltas = {m: new[m] - old[m] if new.get(m) is not None and old.get(m) is not None else None for m in sorted({*old, *new})}
        added, removed = warning_changes(list(self.warnings), list(before.warnings))
        numbers = lambda c: {k: v for k, v in c.items() if isinstance(v, int) and not isinstance(v, bool)}
        return {"verdict": [before.verdict, self.verdict], "metrics": deltas, "counts": count_deltas(numbers(self.counts), numbers(before.counts)), "warnings_added": added, "warnings_removed": removed}


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, dict):
        return {str(k): _plain(x[k]) for k in sorted(x, key=str)}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return redact(x) if isinstance(x, str) else x


def to_json(report: Report) -> str:
    """Byte-identical for equal reports: sorted keys, six decimals, one final line end."""
    return json.dumps(_plain(asdict(report)), indent=2, ensure_ascii=False) + "\n"


def from_json(text: str) -> Report:
    """Load a report; unknown keys and other major versions are refused."""
    doc = json.loads(text)
    known = set(Report.__dataclass_fields__)
    if bad := set(doc) - known:
        raise ReportError(f"unknown keys: {sorted(bad)}")
    if str(doc.get("schema_version", "")).split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise ReportError("the report has another major version")
    metrics = []
    for m in doc["metrics"]:
        if bad := set(m) - set(Metric.__dataclass_fields__):
            raise ReportError(f"unknown keys of a metric: {sorted(bad)}")
        metrics.append(Metric(**m))
    return Report(**(doc | {"metrics": tuple(metrics), "warnings": tuple(doc.get("warnings", ()))}))


def json_schema() -> dict:
    """JSON Schema (draft 2020-12) of a report."""
    text, number = {"type": "string"}, {"type": ["number", "null"]}
    metric = {
        "type": "object", "additionalProperties": False, "required": ["id", "state"],
        "properties": {
            "id": text, "state": {"enum": list(STATES)}, "value": number, "unit": text, "thresholds": {"type": ["object", "null"]}, "sampling": {"type": "object"}, "detail": {"type": "object"},
            "evidence_strength": {"enum": ["high", "medium", "low"]}, "explanation": text, "unavailable_reason": {"type": ["string", "null"]},
        },
    }
    count = {"type": ["integer", "null"]}
    closed = lambda required, **properties: {"type": "object", "additionalProperties": False, "required": required, "properties": properties}
    target = closed(["engine", "index_name", "metric_space"], engine=text, index_name=text, index_kind=text, metric_space={"enum": ["COSINE", "L2", "DOT"]}, dimension={"type": "integer", "minimum": 0}, location=text, version=text)
    run = closed([], seed={"type": "integer"}, started_at={"type": "string", "format": "date-time"}, duration_seconds={"type": "number", "minimum": 0}, tool_version=text, config={"type": "object"})
    counts = closed([], live=count, deleted=count, total=count, indexed=count, degenerate=count, exact={"type": "boolean"})
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False,
        "required": ["target", "run", "counts", "metrics", "verdict", "schema_version"],
        "properties": {"target": target, "run": run, "counts": counts, "metrics": {"type": "array", "items": metric}, "verdict": {"enum": list(EXIT)}, "warnings": {"type": "array", "items": text}, "schema_version": text},
    }


def _labels(**labels) -> str:
    escaped = {k: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for k, v in sorted(labels.items())}
    return "{" + ",".join(f'{k}="{v}"' for k, v in escaped.items()) + "}"


def to_prometheus(report: Report, prefix: str = "plumbline") -> str:
    """Text format of the exporter: every gauge once with its help, a metric's gauge only if it has a value."""
    t = report.target
    base = {"engine": t.get("engine", ""), "index": t.get("index_name", ""), "metric_space": t.get("metric_space", ""), "target": redact(str(t.get("location", "")))}
    gauges: dict[str, tuple[str, list[str]]] = {}

    def gauge(name: str, text: str, value: str, **labels) -> None:
        gauges.setdefault(name, (text, []))[1].append(f"{prefix}_{name}{_labels(**base, **labels)} {value}")

    gauge("up", "1 if the audit came to its end.", "1")
    gauge("audit_verdict", "0 OK, 1 WARN, 2 FAIL, 3 INCONCLUSIVE.", str(EXIT[report.verdict]))
    gauge("audit_duration_seconds", "Wall-clock time of the audit.", f"{float(report.run.get('duration_seconds', 0)):.6f}")
    if started := report.run.get("started_at"):
        gauge("audit_timestamp_seconds", "When the audit began.", f"{datetime.fromisoformat(str(started).replace('Z', '+00:00')).timestamp():.3f}")
    for c in ("live", "deleted"):
        if report.counts.get(c) is not None:
            gauge(f"vectors_{c}", f"Vectors that are {c}.", str(report.counts[c]))
    for m in report.metrics:
        if m.value is not None:
            gauge(m.id, f"Value of {m.id}.", f"{m.value:.6f}")
        gauge("metric_state", "0 OK, 1 WARN, 2 FAIL, 3 UNAVAILABLE, 4 DISABLED.", str(STATES[m.state]), metric=m.id)
        gauge("metric_unavailable", "1 if the metric could not be had.", str(int(m.state == "UNAVAILABLE")), metric=m.id)
    out = []
    for name, (text, lines) in gauges.items():
        out += [f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} gauge", *lines]
    return "\n".join(out) + "\n"


def _value(m: Metric) -> str:
    return f"{m.value:.4f}" if m.value is not None else "n/a"


def to_markdown(report: Report) -> str:
    t = report.target
    lines = [f"# Audit of {redact(str(t.get('index_name', '')))}", "", f"**Verdict: {report.verdict}**", "", f"Engine {t.get('engine')}, {t.get('index_kind')}, {t.get('metric_space')}, {t.get('dimension')} dimensions; {report.counts.get('live')} live vectors, {report.counts.get('deleted')} deleted.", ""]
    lines += ["| metric | value | state | evidence | reason |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {m.id} | {_value(m)} | {m.state} | {m.evidence_strength} | {m.unavailable_reason or ''} |" for m in report.metrics]
    if report.warnings:
        lines += ["", "## Warnings", "", *[f"- {redact(w)}" for w in report.warnings]]
    return "\n".join(lines) + "\n"


#: Terminal colours of states and verdicts.
COLOURS = {"OK": "32", "WARN": "33", "FAIL": "31", "UNAVAILABLE": "35", "DISABLED": "90", "INCONCLUSIVE": "35"}


def to_text(report: Report, colour: bool = True) -> str:
    paint = lambda s: f"\x1b[{COLOURS[s]}m{s}\x1b[0m" if colour else s
    lines = [f"Audit of {redact(str(report.target.get('location', report.target.get('index_name', ''))))}: {paint(report.verdict)}"]
    for m in report.metrics:
        limits = f" (warn {m.thresholds['warn']}, fail {m.thresholds['fail']})" if m.thresholds else ""
        lines.append(f"  {m.id:<20} {_value(m):>10}  {paint(m.state)}  evidence {m.evidence_strength}{limits}")
        if m.explanation or m.unavailable_reason:
            lines.append(f"      {m.explanation or m.unavailable_reason}")
        for name in ("top_offenders", "largest_cells"):
            if m.detail.get(name):
                lines.append(f"      {name}: {', '.join(map(str, m.detail[name][:10]))}")
    lines += [f"  ! {redact(w)}" for w in report.warnings]
    return "\n".join(lines) + "\n"
