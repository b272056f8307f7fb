"""Coordination risk of a token from its statistics and its top buyers' clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scores as S
from flowlens.operators.lookups import lookup_join


def linked_buyers(
    buyers: DataFrame,
    members: DataFrame,
    sizes: DataFrame,
    history: DataFrame | None = None,
    keys: Sequence[str] = ("mint",),
) -> DataFrame:
    """How the top buyers per ``keys`` are linked.

    ``buyers``: (keys, user_wallet), already cut to a top list. ``members``: (node, component).
    ``sizes``: (component, size). ``history``: (user_wallet, cluster_id) of earlier runs. Counts the
    full size of every cluster of two or more that a buyer is in, plus buyers linked only in history.
    """
    keys = list(keys)
    found = lookup_join(
        buyers.select(*keys, "user_wallet"),
        members.withColumnRenamed("node", "user_wallet"),
        ["user_wallet"],
    )
    found = lookup_join(found, sizes.select("component", "size"), ["component"])
    if history is None:
        found = found.withColumn("cluster_id", F.lit(None).cast("string"))
    else:
        found = lookup_join(found, history.select("user_wallet", "cluster_id"), ["user_wallet"])
    large = F.coalesce(F.col("size") >= 2, F.lit(False))
    listed = found.groupBy(*keys).agg(F.count("*").alias("buyers_listed"))
    current = (
        found.filter(large)
        .groupBy(*keys, "component")
        .agg(F.max("size").alias("size"))
        .groupBy(*keys)
        .agg(F.sum("size").alias("in_clusters"), F.max("size").alias("largest"))
    )
    past = (
        found.filter(F.col("cluster_id").isNotNull())
        .groupBy(*keys, "cluster_id")
        .agg(F.count("*").alias("n"), F.count_if(~large).alias("only_past"))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("n") >= 2, F.col("only_past")).otherwise(0)).alias("past_only"),
            F.max("n").alias("past_largest"),
        )
    )
    return (
        listed.join(current, keys, "left")
        .join(past, keys, "left")
        .select(
            *keys,
            "buyers_listed",
            (F.coalesce("in_clusters", F.lit(0)) + F.coalesce("past_only", F.lit(0))).alias(
                "linked"
            ),
            F.coalesce("largest", "past_largest", F.lit(1)).alias("largest"),
        )
        .withColumn("cluster_score", S.clustering(F.col("linked"), F.col("buyers_listed")))
    )


def scored(stats: DataFrame) -> DataFrame:
    """Add the score's parts, total, confidence, level and evidence.

    ``stats`` has the statistics of a window and the columns of ``linked_buyers``.
    """
    share, ratio = F.col("top_3_volume_share"), F.col("buy_sell_ratio")
    parts = stats.withColumns(
        {
            "concentration_score": S.concentration(share),
            "cluster_score": F.coalesce("cluster_score", F.lit(0.0)),
            "timing_score": S.timing(F.col("buy_count"), F.col("unique_buyers")),
            "new_wallet_score": S.new_wallets(F.col("new_wallet_pct")),
            "ratio_score": S.ratio(ratio),
        }
    )
    total = parts.withColumn(
        "total_score",
        S.total(
            F.col("concentration_score"),
            F.col("cluster_score"),
            F.col("timing_score"),
            F.col("new_wallet_score"),
            F.col("ratio_score"),
        ),
    )
    return total.withColumns(
        {
            "score_confidence": S.confidence(
                F.col("buy_count"), F.coalesce("buyers_listed", F.lit(0)), F.col("volume_sol")
            ),
            "risk_level": S.level(F.col("total_score")),
            "evidence": S.evidence(
                share,
                F.coalesce("linked", F.lit(0)),
                F.coalesce("buyers_listed", F.lit(0)),
                F.coalesce("largest", F.lit(1)),
                F.col("buy_count"),
                F.col("unique_buyers"),
                F.col("new_wallet_pct"),
                ratio,
            ),
        }
    )


def factors(scored: DataFrame) -> DataFrame:
    """Add the three largest score parts as text."""
    return scored.withColumn(
        "top_factors",
        S.top_factors(
            {
                name: F.col(f"{name}_score")
                for name in ("concentration", "cluster", "timing", "new_wallet", "ratio")
            }
        ),
    )
