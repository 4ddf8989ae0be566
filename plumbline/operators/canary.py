"""Canary recall: an index's own answers against exact neighbours.

``queries(qid, vec)``, ``corpus(id, vec)`` (live rows), ``truth(qid, rank, id, dist)``, ``returned(qid, rank, id)``. All
operators also take extra group columns, so that one plan serves all groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import TIE_DECIMALS, distance
from plumbline.operators import knn
from plumbline.operators.sampling import bootstrap_means
from plumbline.operators.verdict import evaluate
from plumbline.session import broadcast_if_small, settle

RTOL = 1e-6
MIN_QUERIES = 5


def returned_distances(returned: DataFrame, corpus: DataFrame, queries: DataFrame, metric: str, *groups: str) -> DataFrame:
    """True distance of each returned id from the corpus; null for an id that is not live. Engine distances are ignored.

    Negative (padding) ids and repeated ids of a query are removed, keeping the best rank; ``n_duplicate`` counts them.
    An id that the corpus has twice gets the smaller distance. The few returned ids meet the corpus where it is scanned,
    so its vectors are not shuffled, unless the ids are too many to broadcast.
    """
    keys = [*groups, "qid"]
    rows = returned.filter(F.col("id") >= 0)
    once = settle(rows.groupBy(*keys, "id").agg(F.min("rank").alias("rank"), (F.count(F.lit(1)) - 1).alias("n_duplicate")), "returned")
    asked = queries.select(*keys, F.col("vec").alias("qvec"))
    met = corpus.select("id", "vec").filter(F.col("vec").isNotNull()).join(broadcast_if_small(once.select(*keys, "id")), "id").join(broadcast_if_small(asked), keys)
    near = met.select(*keys, "id", F.round(distance("qvec", "vec", metric), TIE_DECIMALS).alias("dist")).groupBy(*keys, "id").agg(F.min("dist").alias("dist"), F.lit(True).alias("_live"))
    return once.join(near, [*keys, "id"], "left").select(*keys, "rank", "id", "n_duplicate", "dist", F.coalesce("_live", F.lit(False)).alias("live"))


def per_query(truth: DataFrame, returned: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, metric: str, *groups: str, known: DataFrame | None = None) -> DataFrame:
    """Per query: ``n_eff, recall_id, recall_dist`` and counters of short, duplicate, invalid, vanished and tied answers.

    A returned id counts for recall_dist if it is as near as the last true neighbour, within a relative 1e-6. ``known(id)``
    are the ids at the start of the run; one of them that is gone now is ``n_vanished`` besides invalid. Queries without
    true neighbours have null recalls.
    """
    keys = [*groups, "qid"]
    ends = truth.groupBy(*keys).agg(F.max("dist").alias("d_k"), F.count(F.lit(1)).alias("n_eff"))
    got = returned_distances(returned, corpus, queries, metric, *groups)
    if known is not None:
        got = got.join(known.select("id", F.lit(True).alias("_known")), "id", "left")
    else:
        got = got.withColumn("_known", F.lit(False))
    hits = got.join(truth.select(*keys, "id", F.lit(1).alias("hit")), [*keys, "id"], "left").join(ends.select(*keys, "d_k"), keys, "left")
    near = F.col("dist") <= F.col("d_k") + RTOL * F.abs("d_k")
    per = hits.groupBy(*keys).agg(
        F.sum(F.coalesce("hit", F.lit(0))).alias("hits"),
        F.sum(F.coalesce(near.cast("int"), F.lit(0))).alias("near"),
        F.count(F.lit(1)).alias("n_returned"),
        F.sum("n_duplicate").alias("n_duplicate"),
        F.sum((~F.col("live")).cast("int")).alias("n_invalid"),
        F.sum((~F.col("live") & F.coalesce("_known", F.lit(False))).cast("int")).alias("n_vanished"),
        F.max((near & F.col("hit").isNull()).cast("int")).alias("boundary_tie"),
    )
    zero = {c: 0 for c in ("hits", "near", "n_returned", "n_duplicate", "n_invalid", "n_vanished", "boundary_tie")}
    full = queries.select(*keys).join(ends, keys, "left").join(per, keys, "left").fillna({"n_eff": 0, **zero})
    n = F.nullif("n_eff", F.lit(0))
    return full.select(
        *keys, "n_eff", (F.col("hits") / n).alias("recall_id"), F.when(n.isNotNull(), F.least(F.col("near") / n, F.lit(1.0))).alias("recall_dist"),
        (F.col("n_returned") < F.col("n_eff")).cast("int").alias("short_return"), "n_duplicate", "n_invalid", "n_vanished", "boundary_tie",
    )


def summary(scored: DataFrame, warn: float = 0.85, fail: float = 0.70, *groups: str, truncated: bool = False, query_source: str = "corpus") -> DataFrame:
    """One row a group: mean recalls, counters, evidence and state.

    Fewer than 5 queries, or none with a true neighbour, is UNAVAILABLE with a null value and a reason. Evidence is low
    if truncated or under 30 queries, high for a query log, else medium; a FAIL on low evidence is a WARN.
    """
    rows = scored.groupBy(*groups) if groups else scored.groupBy()
    a = rows.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("recall_dist").alias("mean"), F.avg("recall_id").alias("recall_id"), F.sum("short_return").alias("short_returns"),
        F.sum("n_duplicate").alias("duplicate_returns"), F.sum("n_invalid").alias("returned_invalid"), F.sum("boundary_tie").alias("boundary_ties"),
    )
    reason = F.when(F.col("n_queries") < MIN_QUERIES, "too_few_queries").when(F.col("mean").isNull(), "no_true_neighbours")
    evidence = F.when(F.lit(truncated) | (F.col("n_queries") < 30), "low").when(F.lit(query_source == "file"), "high").otherwise("medium")
    value = F.when(reason.isNull(), F.col("mean"))
    state = evaluate(value, F.lit(warn), F.lit(fail), F.lit("lower_is_worse"))
    state = F.when(reason.isNotNull(), "UNAVAILABLE").when((evidence == "low") & (state == "FAIL"), "WARN").otherwise(state)
    return a.select(
        *groups, F.lit("canary_recall").alias("metric"), value.alias("value"), F.when(reason.isNull(), F.col("recall_id")).alias("recall_id"), "n_queries", "short_returns",
        "duplicate_returns", "returned_invalid", "boundary_ties", evidence.alias("evidence"), state.alias("state"), reason.alias("reason"),
    )


def bootstrap_ci95(scored: DataFrame, value_col: str = "recall_dist", resamples: int = 1000, seed: int = 1337) -> DataFrame:
    """One row ``(mean, ci_low, ci_high)``: percentile interval of resampled means, widened to contain the mean."""
    values = scored.filter(F.col(value_col).isNotNull())
    means = bootstrap_means(values.select("qid", value_col), value_col, resamples, seed)
    low, high = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))).first()[0] or (None, None)  # one mean a resample
    mean = values.agg(F.avg(value_col)).first()[0]
    row = (mean, min(low, mean), max(high, mean)) if mean is not None else (None, None, None)
    return scored.sparkSession.createDataFrame([row], "mean double, ci_low double, ci_high double")


def group_queries(corpus: DataFrame, group: str, per_group: int, seed: int) -> DataFrame:
    """``(grp, qid, vec)``: up to ``per_group`` queries of each payload value, by keyed hash; null values are left out."""
    from plumbline.operators.sampling import keyed_hash

    rows = corpus.filter(F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col("id").alias("qid"), "vec")
    r = F.row_number().over(Window.partitionBy("grp").orderBy(keyed_hash(seed, "group", "qid"), "qid"))
    return rows.withColumn("_r", r).filter(F.col("_r") <= per_group).drop("_r")


def group_truth(corpus: DataFrame, group: str, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Exact neighbours within each query's own group: one plan for all groups.

    Each batch of the corpus is compared with the queries of the groups that it has, by one matrix product a group. More
    than ``knn.SHIPPED_QUERIES`` queries are joined with their groups instead.
    """
    rows = corpus.select(F.col(group).alias("grp"), "id", "vec").filter(F.col("grp").isNotNull())
    asked = queries.select("grp", "qid", F.col("vec").alias("qvec"))
    held = asked.limit(knn.SHIPPED_QUERIES + 1).toArrow()
    if held.num_rows <= knn.SHIPPED_QUERIES:
        found = knn.grouped_top(rows, held, k, metric)
    else:
        pairs = rows.join(asked, "grp").filter((F.col("id") != F.col("qid")) & (F.size("vec") == F.size("qvec")))
        found = pairs.select("grp", "qid", "id", F.round(distance("qvec", "vec", metric), TIE_DECIMALS).alias("dist"))
    return knn.rank_top(found, k, "grp")
