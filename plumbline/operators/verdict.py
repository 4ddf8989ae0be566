"""States, the overall verdict, exit codes and comparison with a baseline.

``metrics(metric, value, state, evidence)`` is one row a metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXIT = {"OK": 0, "WARN": 1, "FAIL": 2, "INCONCLUSIVE": 3}
USAGE_EXIT, INTERNAL_EXIT = 4, 70
#: Largest tolerated change against a baseline, (warn, fail, direction).
DELTAS = {
    "canary_recall": (-0.05, -0.10, "lower_is_worse"), "hub_share_top1pct": (0.05, 0.10, "higher_is_worse"), "antihub_fraction": (0.05, 0.10, "higher_is_worse"),
    "dfi": (0.05, 0.10, "higher_is_worse"), "partition_size_cv": (0.20, 0.40, "higher_is_worse"),
}
COMPARABLE = ("engine", "index_kind", "metric_space", "dimension", "k", "k_hub", "hubness_sample_size")


def evaluate(value: Column, warn: Column, fail: Column, direction: Column) -> Column:
    """OK, WARN or FAIL; a value on a threshold is on the healthy side; null for a null value."""
    beyond = lambda t: F.when(direction == "lower_is_worse", value < t).otherwise(value > t)
    return F.when(value.isNull(), F.lit(None)).when(beyond(fail), "FAIL").when(beyond(warn), "WARN").otherwise("OK")


def severity(state: Column) -> Column:
    return F.when(state == "FAIL", 2).when(state == "WARN", 1).when(state == "OK", 0)


def aggregate(metrics: DataFrame, strict_unavailable: bool = False, *groups: str) -> DataFrame:
    """One row ``(verdict, exit_code, n_checked, n_unavailable)``, or one for each of the ``groups``.

    Disabled metrics do not count; a FAIL on low evidence counts as a WARN; the worst wins. An unavailable metric turns
    an OK into INCONCLUSIVE, or anything into FAIL if strict. Nothing checked is INCONCLUSIVE.
    """
    weighed = F.when((F.col("state") == "FAIL") & (F.col("evidence") == "low"), 1).otherwise(severity(F.col("state")))
    rows = metrics.filter(F.col("state") != "DISABLED")
    a = (rows.groupBy(*groups) if groups else rows.groupBy()).agg(F.max(weighed).alias("worst"), F.count(weighed).alias("n_checked"), F.coalesce(F.sum((F.col("state") == "UNAVAILABLE").cast("int")), F.lit(0)).alias("n_unavailable"))
    missing = F.col("n_unavailable") > 0
    verdict = (
        F.when(missing & F.lit(strict_unavailable), "FAIL").when(F.col("worst") == 2, "FAIL").when(F.col("worst") == 1, "WARN")
        .when(F.col("worst").isNull() | missing, "INCONCLUSIVE").otherwise("OK")
    )
    return a.select(*groups, verdict.alias("verdict"), exit_code(verdict).alias("exit_code"), "n_checked", "n_unavailable")


def exit_code(verdict: Column) -> Column:
    return F.when(verdict == "OK", 0).when(verdict == "WARN", 1).when(verdict == "FAIL", 2).otherwise(3)


def worst_verdict(a: str, b: str) -> str:
    """The worse of two verdicts; INCONCLUSIVE is worse than OK only."""
    order = ["OK", "INCONCLUSIVE", "WARN", "FAIL"]
    return max(a, b, key=order.index)


def baseline_delta(current: DataFrame, baseline: DataFrame, deltas: dict[str, tuple[float, float, str]] | None = None) -> DataFrame:
    """``(metric, current_value, baseline_value, delta, delta_state)`` over the metrics of either side.

    A metric without a value on one side has a null delta and the state UNAVAILABLE.
    """
    rules = deltas or DELTAS
    table = current.sparkSession.createDataFrame([(m, *t) for m, t in rules.items()], "metric string, warn double, fail double, direction string")
    both = current.select("metric", F.col("value").alias("current_value")).join(baseline.select("metric", F.col("value").alias("baseline_value")), "metric", "full")
    delta = F.col("current_value") - F.col("baseline_value")
    state = F.coalesce(evaluate(F.round(delta, 9), F.col("warn"), F.col("fail"), F.col("direction")), F.lit("UNAVAILABLE"))
    return both.join(F.broadcast(table), "metric", "left").select("metric", "current_value", "baseline_value", delta.alias("delta"), F.when(F.col("direction").isNull(), "UNAVAILABLE").otherwise(state).alias("delta_state"))


def comparable(current: dict, baseline: dict) -> list[str]:
    """The fields in which two runs differ so that they cannot be compared; empty if they can."""
    return [f for f in COMPARABLE if current.get(f) != baseline.get(f)]


def gate(current: DataFrame, baseline: DataFrame, mode: str = "both", strict_unavailable: bool = False) -> str:
    """Verdict under a gate: 'absolute', 'delta', or 'both' (the worse of the two)."""
    absolute = aggregate(current, strict_unavailable).first()["verdict"]
    if mode == "absolute":
        return absolute
    changed = baseline_delta(current, baseline).select("metric", F.col("delta_state").alias("state"), F.lit("high").alias("evidence"))
    delta = aggregate(changed, strict_unavailable).first()["verdict"]
    return delta if mode == "delta" else worst_verdict(absolute, delta)


def count_deltas(current: dict[str, int], baseline: dict[str, int]) -> dict[str, int | None]:
    """Changes of the index counts; None where a side is unknown."""
    both = {*current, *baseline}
    return {c: current[c] - baseline[c] if current.get(c) is not None and baseline.get(c) is not None else None for c in sorted(both)}


def warning_changes(current: list[str], baseline: list[str]) -> tuple[list[str], list[str]]:
    """Warnings added and removed, in order and once each."""
    return [w for w in dict.fromkeys(current) if w not in baseline], [w for w in dict.fromkeys(baseline) if w not in current]
