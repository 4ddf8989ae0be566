"""Mixing sources to target weights by capped water-filling.

A source asks for its share of the mixture's size. A source that would have to be repeated more often than allowed is
clamped at its most; what it leaves is given to the others in proportion to their shares, until none is over its most.
Whole repetitions take every document, the fractional rest takes a seeded share of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.quantiles import clean
from plumbline.operators.heavy_keys import sized_join
from plumbline.session import broadcast_if_small, hash_unit, materialise

def once_each(counted: DataFrame) -> DataFrame:
    """``counted(doc_id, source_key, n_tokens)`` with each doc_id once (its smallest row if they differ); rows without a
    doc_id are left out, since nothing could say how often they were used."""
    one = counted.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("source_key", "n_tokens")).alias("r"))
    return one.select("doc_id", "r.source_key", "r.n_tokens")


def source_tokens(counted: DataFrame) -> DataFrame:
    """``(source_key, own_tokens, own_documents)`` of ``counted(doc_id, source_key, n_tokens)``, pre-aggregated before the shuffle."""
    return counted.groupBy("source_key").agg(F.sum("n_tokens").alias("own_tokens"), F.count(F.lit(1)).alias("own_documents"))


def listed_documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents whose trimmed, lower-cased source is listed, with ``source_key``."""
    keys = targets.select(clean("source").alias("source_key")).filter("source_key IS NOT NULL").distinct()
    return documents.withColumn("source_key", clean("source")).join(broadcast_if_small(keys), "source_key", "left_semi")


def fill(counted: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Water-filling over ``targets(source, target_share, max_uses)``, one row a source.

    ``(source, source_key, target_share, max_uses, own_tokens, given, epochs, clamped_round)``: ``clamped_round`` is 0 for
    a source that was never clamped and 1 if its own share was already too much.

    ``total`` defaults to the tokens of all listed documents, each once. A null share counts as 0, a null or negative
    ``max_uses`` as 0. A source listed twice is taken once, with the sum of its shares and the smaller cap. Shares need
    not add up to 1; if every source is clamped, the mixture stays below ``total``. A round is one aggregate over the
    sources, however many there are: it gives the level, tokens per unit of share, of those that are free still.
    """
    rows = targets.filter("source IS NOT NULL").groupBy(clean("source").alias("source_key")).agg(
        F.min("source").alias("source"),
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.min(F.greatest(F.coalesce("max_uses", F.lit(0)), F.lit(0))).alias("max_uses"),
    )
    own = source_tokens(counted).select("source_key", F.col("own_tokens").alias("_own"))
    sources = materialise(rows.join(own, "source_key", "left").withColumn("own_tokens", F.coalesce("_own", F.lit(0)).cast("bigint")).drop("_own"), "sources")
    if total is None:
        total = float(sources.agg(F.coalesce(F.sum("own_tokens"), F.lit(0))).first()[0])
    most = (F.col("max_uses") * F.col("own_tokens")).cast("double")
    levels, clamped = [float(total)], None
    while True:
        over = F.array(*[F.col("target_share") * F.lit(v) > most for v in levels])
        turn = F.coalesce(F.array_position(over, True), F.lit(0)).cast("int")  # the first round in which the level was too high
        a = sources.agg(F.sum((turn > 0).cast("int")).alias("n"), F.sum(F.when(turn > 0, most)).alias("fixed"), F.sum(F.when(turn == 0, F.col("target_share"))).alias("weight")).first()
        if a["n"] == clamped:
            break
        clamped = a["n"]
        levels.append(max(0.0, total - (a["fixed"] or 0.0)) / a["weight"] if a["weight"] else 0.0)
    given = F.when(turn > 0, most).otherwise(F.col("target_share") * levels[-1])
    epochs = F.when(F.col("own_tokens") > 0, F.least(given / F.col("own_tokens"), F.col("max_uses").cast("double"))).otherwise(0.0)
    return sources.select("source", "source_key", "target_share", "max_uses", "own_tokens", given.alias("given"), epochs.alias("epochs"), turn.alias("clamped_round"))


def uses(counted: DataFrame, filled: DataFrame, seed: int) -> DataFrame:
    """``(doc_id, source_key, n_tokens, uses)`` of the documents used at least once, none more often than its source's cap."""
    drawn = (hash_unit(F.lit(seed), F.col("doc_id")) < F.col("epochs") - F.floor("epochs")).cast("int")
    with_uses = sized_join(counted, filled.select("source_key", "epochs"), ["source_key"], "doc_id").withColumn("uses", (F.floor("epochs") + drawn).cast("int"))
    return with_uses.filter("uses > 0").select("doc_id", "source_key", "n_tokens", "uses")


def report(filled: DataFrame, used: DataFrame) -> DataFrame:
    """Per source: target share, own tokens, planned and reached repetitions and the share that was really reached."""
    got = used.groupBy("source_key").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    got = materialise(got, "mixed")  # one row a source
    rows = filled.join(got, "source_key", "left").fillna(0, ["mixed_tokens", "most_uses"])
    total = got.agg(F.sum("mixed_tokens")).first()[0] or 1
    share = F.col("mixed_tokens") / F.lit(total)
    return rows.select("source", "target_share", "max_uses", "own_tokens", "epochs", "clamped_round", "mixed_tokens", "most_uses", share.alias("actual_share"))
