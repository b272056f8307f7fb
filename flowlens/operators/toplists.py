"""Rankings and summaries of a token's trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import bucket_start, ratio_or, wide
from flowlens.operators.lookups import top_per_key
from flowlens.operators.running import lists_as_of, next_case, running_totals


def top_buyers(swaps: DataFrame, limit: int = 10, since: int | None = None) -> DataFrame:
    """Largest buyers per mint by quote amount, with buys, base amount and mean entry market cap.

    ``mcap_at_swap`` is averaged where the column exists, over exact sums of millionths.
    """
    buys = swaps.filter(F.col("side") == "buy")
    if since is not None:
        buys = buys.filter(F.col("block_time") >= since)
    mcap = F.col("mcap_at_swap") if "mcap_at_swap" in swaps.columns else F.lit(None).cast("double")
    per_wallet = buys.groupBy(F.col("base_mint").alias("mint"), "user_wallet").agg(
        F.count("*").alias("buy_count"),
        F.sum(wide(F.col("quote_amount"))).alias("total_quote"),
        F.sum(wide(F.col("base_amount"))).alias("total_base"),
        F.try_divide(
            F.sum(wide(F.round(mcap * 1e6))).cast("double") / F.lit(1e6),
            F.count(mcap).cast("double"),
        ).alias("avg_entry_mcap"),
    )
    return top_per_key(
        per_wallet, ["mint"], [F.desc("total_quote"), F.asc("user_wallet")], limit
    )


def dominant_venue(swaps: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Most frequent known venue per mint; ties by name."""
    counts = (
        swaps.filter(F.col("venue").isNotNull() & (F.col("venue") != unknown))
        .groupBy(F.col("base_mint").alias("mint"), "venue")
        .agg(F.count("*").alias("swap_count"))
    )
    return top_per_key(counts, ["mint"], [F.desc("swap_count"), F.asc("venue")], 1).drop("rank")


def recent_swaps(
    swaps: DataFrame, mint: str, since: int | None = None, limit: int = 100
) -> DataFrame:
    """Newest trades of one mint."""
    hit = swaps.filter(F.col("base_mint") == mint)
    if since is not None:
        hit = hit.filter(F.col("block_time") >= since)
    return hit.orderBy(F.desc("block_time"), F.desc("slot")).limit(limit)


def vwap_recent(
    swaps: DataFrame,
    last: int = 5,
    quote: str = "",
    order: Sequence[str] = ("block_time", "slot"),
) -> DataFrame:
    """Quote per base over the buys in ``quote`` among each mint's last trades."""
    newest = top_per_key(swaps, ["base_mint"], [F.desc(c) for c in order], last)
    used = newest.filter((F.col("side") == "buy") & (F.col("quote_mint") == quote))
    sums = used.groupBy(F.col("base_mint").alias("mint")).agg(
        F.count("*").alias("buys_used"),
        F.sum(wide(F.col("quote_amount"))).alias("total_quote"),
        F.sum(wide(F.col("base_amount"))).alias("total_base"),
    )
    price = ratio_or(F.col("total_quote").cast("double") / 1e9, F.col("total_base"), F.lit(None))
    return sums.withColumn("price_per_unit", price)


# --- as of a time --------------------------------------------------------------------------
#
# Lists for many (mint, win_end): trades are first reduced to panes, whose ends the cases share, and only
# panes that close by ``win_end`` count, so nothing after a case can change it. ``running`` says how.


def pane_end(pane: int) -> Column:
    return bucket_start(F.col("block_time"), pane) + pane


def top_buyers_as_of(swaps: DataFrame, cases: DataFrame, pane: int, limit: int = 10) -> DataFrame:
    """``top_buyers`` per (mint, win_end) of ``cases``, from the trades before ``win_end``."""
    mcap = F.col("mcap_at_swap") if "mcap_at_swap" in swaps.columns else F.lit(None).cast("double")
    panes = (
        swaps.filter(F.col("side") == "buy")
        .groupBy(F.col("base_mint").alias("mint"), pane_end(pane).alias("pane_end"), "user_wallet")
        .agg(
            F.count("*").alias("buys"),
            F.sum(wide(F.col("quote_amount"))).alias("quote"),
            F.sum(wide(F.col("base_amount"))).alias("base"),
            F.sum(wide(F.round(mcap * 1e6))).alias("caps"),
            F.count(mcap).alias("capped"),
        )
    )
    totals = running_totals(next_case(panes, cases), ["user_wallet"], ["buys", "quote", "base", "caps", "capped"])
    per_wallet = totals.select(
        "mint",
        "win_end",
        "user_wallet",
        F.col("buys").alias("buy_count"),
        F.col("quote").cast("decimal(38,0)").alias("total_quote"),
        F.col("base").cast("decimal(38,0)").alias("total_base"),
        F.try_divide(F.col("caps").cast("double") / F.lit(1e6), F.col("capped").cast("double")).alias("avg_entry_mcap"),
    )
    order = [F.desc("total_quote"), F.asc("user_wallet")]
    return lists_as_of(per_wallet, cases, ["user_wallet"], order, limit)


def dominant_venue_as_of(swaps: DataFrame, cases: DataFrame, pane: int, unknown: str = "unknown") -> DataFrame:
    """``dominant_venue`` per (mint, win_end) of ``cases``."""
    panes = (
        swaps.filter(F.col("venue").isNotNull() & (F.col("venue") != unknown))
        .groupBy(F.col("base_mint").alias("mint"), pane_end(pane).alias("pane_end"), "venue")
        .agg(F.count("*").alias("swap_count"))
    )
    totals = running_totals(next_case(panes, cases), ["venue"], ["swap_count"])
    order = [F.desc("swap_count"), F.asc("venue")]
    return lists_as_of(totals, cases, ["venue"], order, 1).drop("rank")


def vwap_as_of(
    swaps: DataFrame, cases: DataFrame, pane: int, last: int = 5, quote: str = "",
    order: Sequence[str] = ("block_time", "slot"),
) -> DataFrame:
    """``vwap_recent`` per (mint, win_end) of ``cases``: of each pane only its last trades can matter."""
    newest_first = [F.desc(c) for c in order]
    slim = swaps.select(F.col("base_mint").alias("mint"), *order, "side", "quote_mint", "quote_amount", "base_amount")
    panes = top_per_key(
        slim.withColumn("pane_end", pane_end(pane)), ["mint", "pane_end"], newest_first, last
    ).drop("rank")
    newest = lists_as_of(next_case(panes, cases).drop("pane_end"), cases, [], newest_first, last)
    used = newest.filter((F.col("side") == "buy") & (F.col("quote_mint") == quote))
    sums = used.groupBy("mint", "win_end").agg(
        F.sum(wide(F.col("quote_amount"))).alias("total_quote"),
        F.sum(wide(F.col("base_amount"))).alias("total_base"),
    )
    price = ratio_or(F.col("total_quote").cast("double") / 1e9, F.col("total_base"), F.lit(None))
    return sums.withColumn("price_per_unit", price)
