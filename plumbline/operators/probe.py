"""Point probes: what one query should have found, inverse neighbour lists and tombstones among the neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, settle

INVERSE_CAP = 500


def probe_roles(truth: DataFrame, returned: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(qid, id, role)`` over true and returned ids: hit, missed, dead (returned but not live) or unexpected.

    Negative ids are padding and repeated ids count once. ``corpus(id, deleted)``; an unknown id is dead.
    """
    t = truth.select("qid", "id", F.lit(True).alias("_true")).distinct()
    r = returned.filter(F.col("id") >= 0).select("qid", "id", F.lit(True).alias("_got")).distinct()
    pairs = settle(t.join(r, ["qid", "id"], "full"), "probe")
    # the few ids meet the corpus where it is scanned; only what was met goes on
    live = corpus.filter(~F.coalesce(F.col("deleted"), F.lit(False))).select("id").join(broadcast_if_small(pairs.select("id").distinct()), "id", "left_semi")
    both = pairs.join(live.distinct().withColumn("_live", F.lit(True)), "id", "left")
    role = F.when(F.col("_true") & F.col("_got"), "hit").when(F.col("_true"), "missed").when(F.col("_live").isNull(), "dead").otherwise("unexpected")
    return both.select("qid", "id", role.alias("role"))


def probe_summary(roles: DataFrame) -> DataFrame:
    """``(qid, n_true, n_hit, n_missed, n_dead, n_unexpected, recall_id)``; recall is null without true neighbours."""
    n = lambda *names: F.sum(F.col("role").isin(*names).cast("bigint"))
    a = roles.groupBy("qid").agg(n("hit", "missed").alias("n_true"), n("hit").alias("n_hit"), n("missed").alias("n_missed"), n("dead").alias("n_dead"), n("unexpected").alias("n_unexpected"))
    return a.withColumn("recall_id", F.col("n_hit") / F.nullif("n_true", F.lit(0)))


def hub_cannibalisation(neighbours: DataFrame, hubs: DataFrame, cap: int = INVERSE_CAP) -> DataFrame:
    """``(id, n_k, truncated, qids)`` per hub: the queries that name it, smallest first and at most ``cap`` of them (a view).

    ``n_k`` is not capped. A hub that nobody names has an empty list.
    """
    named = neighbours.join(broadcast_if_small(hubs.select("id").distinct()), "id", "left_semi").select("id", "qid").distinct()
    n = named.groupBy("id").agg(F.count(F.lit(1)).alias("n_k"))
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("qid"))).filter(F.col("_r") <= cap)
    lists = first.groupBy("id").agg(F.sort_array(F.collect_list("qid")).alias("qids"))
    out = hubs.select("id").distinct().join(n, "id", "left").join(lists, "id", "left")
    count = F.coalesce("n_k", F.lit(0))
    return out.select("id", count.alias("n_k"), (count > cap).alias("truncated"), F.coalesce("qids", F.array().cast("array<bigint>")).alias("qids"))


def ghost_neighbourhood(neighbours_all: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(qid, n, n_live, n_dead, blocked_fraction)`` of neighbours among live and dead rows together."""
    pairs = settle(neighbours_all.select("qid", "id"), "ghosts")
    met = corpus.select("id", F.coalesce("deleted", F.lit(False)).alias("deleted")).join(broadcast_if_small(pairs.select("id").distinct()), "id", "left_semi")
    flags = pairs.join(met, "id")
    dead = F.sum(F.col("deleted").cast("bigint"))
    return flags.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - dead).alias("n_live"), dead.alias("n_dead"), (dead / F.count(F.lit(1))).alias("blocked_fraction"))


def resolve_tombstone_layer(can_count_deleted: bool, deleted: int | None, rows_known: bool) -> tuple[bool, str | None]:
    """Whether a scene may show tombstones, and why not: they are never made up."""
    if not can_count_deleted or deleted is None:
        return False, "deleted counts are UNAVAILABLE for this target"
    if not rows_known:
        return False, "the target tells how many rows are deleted, not which"
    return True, None


def assert_no_fabricated_tombstones(scene: DataFrame, allowed: bool, tombstone_class: int = 3) -> None:
    """Raise if a scene shows tombstones although it may not."""
    if not allowed and not scene.filter(F.col("point_class") == tombstone_class).isEmpty():
        raise AssertionError("the scene shows tombstones that the target did not report")
