"""A whole audit: from a source to a report. Every metric is one small result; only those come to the driver."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import __version__
from plumbline.operators import canary, health, hubness, ivf, knn, sampling, validate, verdict
from plumbline.plans.config import AuditConfig
from plumbline.plans.report import Metric, Report
from plumbline.session import broadcast_if_small, materialise
from plumbline.sources.base import Source


def _metric(name: str, row, rule: tuple, **extra) -> Metric:
    limits = {"warn": rule[0], "fail": rule[1], "direction": rule[2]}
    value = None if row["value"] is None else float(row["value"])
    return Metric(name, row["state"], value, thresholds=limits, evidence_strength=row["evidence"], unavailable_reason=row["reason"], **extra)


def _guarded(name: str, enabled: bool, run) -> Metric:
    """A disabled metric is DISABLED; one that fails is UNAVAILABLE with the reason; a lost connection ends the audit."""
    if not enabled:
        return Metric(name, "DISABLED")
    try:
        return run()
    except ConnectionError:
        raise
    except Exception as e:  # noqa: BLE001 - one metric must not end the others
        return Metric(name, "UNAVAILABLE", evidence_strength="low", unavailable_reason=f"{type(e).__name__}: {e}"[:300])


#: Groups of a grouped canary that a report names, the worst first; all are counted.
WORST_GROUPS = 1000


def grouped_canary(source: Source, grouped: DataFrame, per_group: int, cfg: AuditConfig, params: dict | None, limits: tuple[float, float]) -> DataFrame:
    """One row a group of ``grouped(id, vec, _grp)``: recall of the source's answers within the group, over up to ``per_group`` queries of it."""
    metric = source.descriptor().metric_space
    q = materialise(canary.group_queries(grouped, "_grp", per_group, cfg.seed), "group-queries")
    truth = canary.group_truth(grouped, "_grp", q, cfg.k, metric)
    got = ivf.drop_self(source.search(q.select("qid", "vec"), cfg.k + 1, params).withColumn("dist", F.col("rank").cast("double")), cfg.k).join(broadcast_if_small(q.select("grp", "qid")), "qid")
    return canary.summary(canary.per_query(truth, got, grouped, q, cfg.k, metric, "grp"), *limits, "grp")


def run_audit(source: Source, config: AuditConfig | None = None, params: dict | None = None, queries: DataFrame | None = None, on_metric=None) -> Report:
    """Audit a source. ``queries(qid, vec)`` replaces the sampled queries by a query log."""
    cfg, began = config or AuditConfig(), time.time()
    desc, can, counts = source.descriptor(), source.capabilities(), source.counts()
    warnings: list[str] = []
    rows = source.corpus()
    if cfg.filter_field:
        keep = source.payload(cfg.filter_field).filter(validate.payload_equals(cfg.filter_field, cfg.filter_value or ""))
        rows = rows.join(keep.select("id"), "id", "left_semi")
    live = rows.filter(~F.col("deleted"))
    if cfg.filter_field or not getattr(source, "snapshot", False):
        live = materialise(live, "live")  # else the source's own files serve, column by column
    degenerate = validate.check(live, desc.dimension, desc.metric_space)
    if degenerate:
        warnings.append(f"{degenerate} vectors have norm 0 and are left out")
    if desc.metric_space == "COSINE":
        live = ivf.normalised(live)
        validate.check_unit(live)
        queries = ivf.normalised(queries) if queries is not None else None
    n_queries, n_hub, cut = sampling.degrade(counts["live"], desc.dimension, cfg.queries, cfg.hubness_sample_size, cfg.max_memory_mb)
    if cut:
        warnings.append("the samples were cut to keep the memory budget")
    rules = cfg.for_dimension(desc.dimension)
    asked = queries if queries is not None else sampling.sample_ids(live, n_queries, cfg.seed, "canary").select(F.col("id").alias("qid"), "vec")
    asked = materialise(asked, "queries")
    on = set(cfg.metrics_enabled)

    def do_canary() -> Metric:
        truncated = False
        if cfg.max_seconds:
            truth, truncated = knn.exact_knn_within(live, asked, cfg.k, desc.metric_space, cfg.max_seconds, working_set_mb=cfg.block_working_set_mb)
        else:
            truth = knn.exact_knn(live, asked, cfg.k, desc.metric_space, working_set_mb=cfg.block_working_set_mb)
        truth = materialise(truth, "truth")
        if truncated:
            warnings.append("the true neighbours are truncated by the time limit")
        got = ivf.drop_self(source.search(asked, cfg.k + 1, params).withColumn("dist", F.col("rank").cast("double")), cfg.k)
        scored = materialise(canary.per_query(truth, got, live, asked, cfg.k, desc.metric_space, known=source.corpus()), "scored")
        warn, fail, _ = rules["canary_recall"]
        s = canary.summary(scored, warn, fail, truncated=truncated, query_source="file" if queries is not None else "corpus").first()
        gone = scored.agg(F.sum("n_vanished")).first()[0] or 0
        if gone:
            warnings.append(f"the snapshot is inconsistent: {gone} returned ids were there at the start and are gone")
        ci = canary.bootstrap_ci95(scored, seed=cfg.seed).first() if s["value"] is not None else None
        detail = {c: s[c] for c in ("recall_id", "short_returns", "duplicate_returns", "returned_invalid", "boundary_ties")} | {"snapshot_inconsistent": bool(gone)}
        if ci:
            detail["ci95"] = [ci["ci_low"], ci["ci_high"]]
        if cfg.group_by:
            detail |= by_group()
        return _metric("canary_recall", s, rules["canary_recall"], sampling={"queries": s["n_queries"], "k": cfg.k, "sample_seed": cfg.seed}, detail=detail)

    def by_group() -> dict:
        """All groups counted by state, the worst of them by name; the rest are named in the table that is left, if one is wanted."""
        grouped = live.join(source.payload(cfg.group_by).select("id", F.col(cfg.group_by).cast("string").alias("_grp")), "id")
        s = materialise(grouped_canary(source, grouped, n_queries, cfg, params, rules["canary_recall"][:2]), "groups")
        states = {r["state"]: r["count"] for r in s.groupBy("state").count().collect()}
        worst = s.orderBy(F.col("value").asc_nulls_last(), "grp").limit(WORST_GROUPS).collect()
        total = sum(states.values())
        if cfg.groups_path:
            s.write.mode("overwrite").parquet(cfg.groups_path)
        if total > len(worst):
            warnings.append(f"the report names the {len(worst)} worst of {total} groups" + (f"; all are in {cfg.groups_path}" if cfg.groups_path else "; set groups_path for all"))
        return {"groups": [{"group": r["grp"], "value": r["value"], "state": r["state"]} for r in worst], "group_states": states, "groups_total": total}

    hub_rows: dict = {}

    def do_hub(name: str) -> Metric:
        if not hub_rows:
            sample = materialise(sampling.sample_ids(live, n_hub, cfg.seed, "hubness"), "hub-sample")
            as_queries = sample.select(F.col("id").alias("qid"), "vec")
            if cfg.hubness_source == "engine":
                found = ivf.drop_self(source.search(as_queries, cfg.k_hub + 1, params).withColumn("dist", F.col("rank").cast("double")).join(sample.select("id"), "id", "left_semi"), cfg.k_hub)
            else:
                found = knn.exact_knn(sample, as_queries, cfg.k_hub, desc.metric_space)
            nk = materialise(hubness.n_k(found, sample), "nk")
            s = sample.count()
            if cfg.hubness_source == "truth" and s > cfg.k_hub:
                hubness.assert_total(nk, cfg.k_hub)
            stats = hubness.statistics(nk)
            limits = {m: rules[m][:2] for m in ("hub_share_top1pct", "antihub_fraction")}
            hub_rows.update({r["metric"]: r for r in hubness.metrics(stats, cfg.k_hub, limits).collect()})
            hub_rows["detail"] = stats.first().asDict() | {"top_offenders": [r["id"] for r in hubness.offenders(nk, 20).filter("kind = 'hub'").collect()]}
            if hub_rows[name]["uncalibrated"]:
                warnings.append("hubness is not calibrated for this sample size or k")
        return _metric(name, hub_rows[name], rules[name], detail=hub_rows["detail"], sampling={"sample": n_hub, "k_hub": cfg.k_hub})

    def do_dfi() -> Metric:
        c = live.sparkSession.createDataFrame([(counts["live"], counts["deleted"] or 0)], "live bigint, dead bigint").withColumn("dfi", F.col("dead") / F.nullif(F.col("live") + F.col("dead"), F.lit(0)))
        warn, fail, _ = rules["dfi"]
        return _metric("dfi", health.dfi_metric(c, warn, fail, counts.get("exact", False), can.proxy_counts, can.deleted_counts and counts["deleted"] is not None).first(), rules["dfi"])

    def do_partitions() -> Metric:
        sizes = source.partitions()
        if sizes is None:
            kind = "not_applicable" if desc.index_kind not in ("IVF", "IVF_PQ") else "partitions_unavailable"
            return Metric("partition_size_cv", "UNAVAILABLE", evidence_strength="low", unavailable_reason=kind)
        stats = health.partition_statistics(sizes)
        warn, fail, _ = rules["partition_size_cv"]
        return _metric("partition_size_cv", health.partition_metric(stats, warn, fail, desc.index_kind).first(), rules["partition_size_cv"], detail=stats.first().asDict() | {"largest_cells": [r["cell"] for r in health.largest_cells(sizes).collect()]})

    steps = {"canary_recall": do_canary, "hub_share_top1pct": lambda: do_hub("hub_share_top1pct"), "antihub_fraction": lambda: do_hub("antihub_fraction"), "dfi": do_dfi, "partition_size_cv": do_partitions}
    metrics = []
    for name, run in steps.items():
        metrics.append(_guarded(name, name in on, run))
        if on_metric:
            on_metric(metrics[-1])
    table = live.sparkSession.createDataFrame([(m.id, m.value, m.state, m.evidence_strength) for m in metrics], "metric string, value double, state string, evidence string")
    overall = verdict.aggregate(table, cfg.strict_unavailable).first()["verdict"]
    run_info = {"seed": cfg.seed, "started_at": datetime.fromtimestamp(began, UTC).isoformat(), "duration_seconds": time.time() - began, "tool_version": __version__, "config": cfg.to_dict()}
    return Report(desc.to_dict(), run_info, counts | {"degenerate": degenerate}, tuple(metrics), overall, tuple(dict.fromkeys(warnings)))


def gate(report: Report, baseline: Report, spark, mode: str = "both", strict: bool = False) -> str:
    """Verdict against a baseline report; INCONCLUSIVE if the two cannot be compared."""
    key = lambda r: r.target | {k: r.run.get("config", {}).get(k) for k in ("k", "k_hub", "hubness_sample_size")}
    if mode != "absolute" and verdict.comparable(key(report), key(baseline)):
        return "INCONCLUSIVE"
    frame = lambda r: spark.createDataFrame([(m.id, m.value, m.state, m.evidence_strength) for m in r.metrics], "metric string, value double, state string, evidence string")
    return verdict.gate(frame(report), frame(baseline), mode, strict)
