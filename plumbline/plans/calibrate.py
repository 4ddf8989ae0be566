"""Calibration sweeps: hubness over sample sizes and k, and whole audits over named data sets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import hubness, knn, sampling
from plumbline.plans.audit import run_audit
from plumbline.plans.config import AuditConfig, profile_for
from plumbline.sources.base import Source


def hubness_sweep(corpus: DataFrame, sizes: list[int], ks: list[int], metric: str, seed: int = 1337) -> DataFrame:
    """``(sample_size, k_hub, s, hub_share_top1pct, antihub_fraction, ...)`` for each size and k.

    The largest k is searched once per size and cut for the smaller ones. The sweep is a short list; samples are bounded
    by their sizes.
    """
    out = None
    for size in sizes:
        sample = sampling.sample_ids(corpus, size, seed, "hubness")
        found = knn.exact_knn(sample, sample.select(F.col("id").alias("qid"), "vec"), max(ks), metric)
        for k in ks:
            stats = hubness.statistics(hubness.n_k(found.filter(F.col("rank") < k), sample)).select(F.lit(size).alias("sample_size"), F.lit(k).alias("k_hub"), "*")
            out = stats if out is None else out.unionByName(stats)
    return out


def sweep(sources: dict[str, Source], sizes: list[int], k_hubs: list[int], config: AuditConfig | None = None, params: dict | None = None) -> DataFrame:
    """One row a metric of each audit of ``{dataset_id: source}`` at each sample size and k_hub; the list of audits is short."""
    base = config or AuditConfig()
    rows = []
    for name, source in sources.items():
        d = source.descriptor()
        for size in sizes:
            for k_hub in k_hubs:
                report = run_audit(source, replace(base, hubness_sample_size=size, k_hub=k_hub), params)
                for m in report.metrics:
                    rows.append((name, report.counts.get("live"), d.dimension, d.metric_space, d.index_kind, size, k_hub, base.k, base.queries, base.seed, profile_for(d.dimension), m.id, m.state, m.value, m.unavailable_reason, m.evidence_strength, report.verdict))
    spark = next(iter(sources.values())).corpus().sparkSession
    return spark.createDataFrame(rows, COLUMNS)


#: Columns of a sweep's table.
COLUMNS = "dataset_id string, n bigint, dimension int, metric_space string, index_kind string, hubness_sample_size int, k_hub int, k int, queries int, seed bigint, profile string, metric_id string, metric_state string, metric_value double, unavailable_reason string, evidence_strength string, verdict string"


def to_csv(rows: DataFrame, path: str) -> None:
    """A sweep as one CSV file with a header, in a folder."""
    rows.coalesce(1).orderBy("dataset_id", "hubness_sample_size", "k_hub", "metric_id").write.mode("overwrite").option("header", True).csv(path)


def to_markdown(rows: list[dict]) -> str:
    """A table of sweep rows, in the order of their first row's columns."""
    if not rows:
        return ""
    cols = list(rows[0])
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "n/a" if v is None else str(v)
    lines = ["| " + " | ".join(cols) + " |", "|" + "-|" * len(cols), *["| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows]]
    return "\n".join(lines) + "\n"
