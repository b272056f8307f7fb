"""Time-bucketed counters and rolling statistics per token.

Everything is built from one aggregate per (mint, pane, wallet). Spark combines it on the map side,
so a hot mint reaches the exchange as wallets, not as trades. Longer windows are made of panes by
``sliding``, without a copy of a pane per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import bucket_start, ratio_or, sol, wide
from flowlens.operators.lookups import lookup_join, top_per_key
from flowlens.operators.sliding import sliding_peaks, sliding_top_wallets, sliding_totals
from flowlens.session import materialize


def wallet_panes(swaps: DataFrame, pane: int, volume: str = "quote_amount") -> DataFrame:
    """Trades per (mint, pane of ``pane`` seconds, wallet)."""
    buy = F.col("side") == "buy"
    amount = F.col(volume).cast("bigint")
    return swaps.groupBy(
        F.col("base_mint").alias("mint"),
        bucket_start(F.col("block_time"), pane).alias("pane"),
        "user_wallet",
    ).agg(
        F.count_if(buy).alias("buys"),
        F.count_if(~buy).alias("sells"),
        F.sum(F.when(buy, amount).otherwise(0)).alias("buy_lamports"),
        F.sum(F.when(~buy, amount).otherwise(0)).alias("sell_lamports"),
        F.min("block_time").alias("first_time"),
    )


def pane_table(swaps: DataFrame, pane: int, volume: str = "quote_amount") -> DataFrame:
    """``wallet_panes`` written once to the shared folder.

    The statistics of a window read the panes several times (totals, ranking, first-seen, each
    window length). Column pruning and inferred filters differ between those uses, so Spark would
    not share one exchange and would scan the trades anew for each. The table is the reduced state
    that all of them start from.
    """
    return materialize(wallet_panes(swaps, pane, volume))[0]


def _volume(basis: str) -> Column:
    if basis == "both":
        return F.col("buy_lamports") + F.col("sell_lamports")
    if basis == "buy":
        return F.col("buy_lamports")
    raise ValueError("basis must be 'both' or 'buy'")


def window_totals(wallets: DataFrame, keys: Sequence[str], basis: str = "both") -> DataFrame:
    """Counts, distinct wallets and volume per key from one row per wallet."""
    return wallets.groupBy(*keys).agg(
        F.sum("buys").alias("buy_count"),
        F.sum("sells").alias("sell_count"),
        F.count_if(F.col("buys") > 0).alias("unique_buyers"),
        F.count_if(F.col("sells") > 0).alias("unique_sellers"),
        F.sum(wide(_volume(basis))).alias("volume_lamports"),
        F.min("first_time").alias("first_time"),
    )


def with_ratios(totals: DataFrame) -> DataFrame:
    """Volume in SOL, volume per buy, and buys per sell (infinite without sells)."""
    return (
        totals.withColumn("volume_sol", sol(F.col("volume_lamports")))
        .withColumn("avg_buy_size", ratio_or(F.col("volume_sol"), F.col("buy_count"), 0.0))
        .withColumn(
            "buy_sell_ratio", ratio_or(F.col("buy_count"), F.col("sell_count"), float("inf"))
        )
    )


def bucket_counters(swaps: DataFrame, size: int, volume: str = "quote_amount") -> DataFrame:
    """Buys, sells and both volumes per mint and bucket: one exchange, combined on the map side."""
    buy = F.col("side") == "buy"
    amount = wide(F.col(volume))
    return swaps.groupBy(
        F.col("base_mint").alias("mint"),
        bucket_start(F.col("block_time"), size).alias("bucket"),
    ).agg(
        F.count_if(buy).alias("buy_count"),
        F.count_if(~buy).alias("sell_count"),
        F.sum(amount).alias("volume_lamports"),
        F.sum(F.when(buy, amount)).alias("buy_lamports"),
    )


def unique_wallets(swaps: DataFrame, size: int, approx: bool = False) -> DataFrame:
    """Distinct buyers and sellers per mint and bucket, exact or by sketch.

    The sketch column merges across buckets with ``hll_union_agg``.
    """
    buy = F.col("side") == "buy"
    keys = [
        F.col("base_mint").alias("mint"),
        bucket_start(F.col("block_time"), size).alias("bucket"),
    ]
    if not approx:
        per_wallet = swaps.groupBy(*keys, "user_wallet").agg(
            F.max(buy).alias("bought"), F.max(~buy).alias("sold")
        )
        return per_wallet.groupBy("mint", "bucket").agg(
            F.count_if("bought").alias("unique_buyers"), F.count_if("sold").alias("unique_sellers")
        )
    sketches = swaps.groupBy(*keys).agg(
        F.hll_sketch_agg(F.when(buy, F.col("user_wallet"))).alias("buyers"),
        F.hll_sketch_agg(F.when(~buy, F.col("user_wallet"))).alias("sellers"),
    )
    return sketches.select(
        "mint",
        "bucket",
        F.hll_sketch_estimate("buyers").alias("unique_buyers"),
        F.hll_sketch_estimate("sellers").alias("unique_sellers"),
        F.col("buyers").alias("buyer_sketch"),
        F.col("sellers").alias("seller_sketch"),
    )


def rolling_stats(
    swaps: DataFrame,
    pane: int,
    length: int,
    volume: str = "quote_amount",
    basis: str = "both",
    unique_mode: str = "union",
) -> DataFrame:
    """Statistics of the last ``length`` seconds at every pane end.

    ``unique_mode='max_bucket'`` counts distinct wallets as the largest single pane, not as the
    union over the window.
    """
    panes = wallet_panes(swaps, pane, volume)
    if unique_mode == "union":
        return with_ratios(sliding_totals(panes, pane, length, _volume(basis)))
    if unique_mode != "max_bucket":
        raise ValueError("unique_mode must be 'union' or 'max_bucket'")
    return with_ratios(sliding_peaks(window_totals(panes, ["mint", "pane"], basis), pane, length))


def wallet_first_seen(swaps: DataFrame) -> DataFrame:
    """First trade of each wallet."""
    return swaps.groupBy("user_wallet").agg(F.min("block_time").alias("first_seen"))


def wallet_first_seen_refreshed(swaps: DataFrame, ttl: int, stamped: bool = False) -> DataFrame:
    """First trade of each wallet since it was last unseen for ``ttl`` seconds: every trade renews the record.

    One row per wallet and session. Works on streams that carry event time ``ts`` (``stamped``); Spark merges
    sessions within each task before the exchange, so a busy wallet is a few rows there.
    """
    rows = swaps if stamped else swaps.withColumn("ts", F.timestamp_seconds("block_time"))
    session = F.session_window("ts", f"{ttl} seconds").alias("session")
    found = rows.groupBy("user_wallet", session).agg(F.min("block_time").alias("first_seen"))
    return found.select("user_wallet", "first_seen")


def first_seen_of_panes(panes: DataFrame) -> DataFrame:
    """First trade of each wallet out of panes."""
    return panes.groupBy("user_wallet").agg(F.min("first_time").alias("first_seen"))


def top_wallets(panes: DataFrame, pane: int, length: int, n: int, basis: str = "both") -> DataFrame:
    """The ``n`` wallets of largest volume per (mint, win_end); ties by wallet."""
    found = sliding_top_wallets(panes, pane, length, n, _volume(basis))
    return found.withColumn("volume_lamports", F.col("lamports").cast("bigint")).drop("lamports")


def token_stats(
    swaps: DataFrame,
    pane: int,
    length: int,
    volume: str = "quote_amount",
    basis: str = "both",
    first_seen: DataFrame | None = None,
    top_share: int = 3,
    top_new: int | None = None,
) -> DataFrame:
    """All statistics of a token window: counts, distinct wallets, volume, concentration, new wallets.

    One row per (mint, win_end). ``first_seen`` has one row per wallet; by default it is the first
    trade in ``swaps``. All wallets of the window are looked at for new ones; with ``top_new`` only
    those of largest volume.
    """
    panes = pane_table(swaps, pane, volume)
    return stats_of_panes(panes, pane, length, basis, first_seen, top_share, top_new)


def stats_of_panes(
    panes: DataFrame,
    pane: int,
    length: int,
    basis: str = "both",
    first_seen: DataFrame | None = None,
    top_share: int = 3,
    top_new: int | None = None,
) -> DataFrame:
    """``token_stats`` from ready panes (computed or read from a stored pane table)."""
    seen = first_seen_of_panes(panes) if first_seen is None else first_seen
    totals = with_ratios(sliding_totals(panes, pane, length, _volume(basis), seen if top_new is None else None))
    biggest = sliding_top_wallets(panes, pane, length, top_share, _volume(basis)).groupBy("mint", "win_end").agg(
        F.sum("lamports").alias("top_lamports")
    )
    if top_new is None:
        tops = biggest
    else:
        judged = sliding_top_wallets(panes, pane, length, top_new, _volume(basis))
        new = F.col("first_seen") >= F.col("win_end") - length
        newcomers = (
            lookup_join(judged.select("mint", "win_end", "user_wallet"), seen, ["user_wallet"], salts=1)
            .groupBy("mint", "win_end")
            .agg(F.count_if(new).alias("new_wallet_count"))
        )
        tops = biggest.join(newcomers, ["mint", "win_end"], "full")
    return (
        totals.join(tops, ["mint", "win_end"], "left")
        .withColumn("new_wallet_count", F.coalesce("new_wallet_count", F.lit(0)))
        .withColumn(
            "top_3_volume_share", ratio_or(F.col("top_lamports"), F.col("volume_lamports"), 0.0)
        )
        .withColumn(
            "new_wallet_pct", ratio_or(F.col("new_wallet_count"), F.col("unique_buyers"), 0.0)
        )
        .drop("top_lamports")
    )


# Statistic column -> name used in rules.
RULE_FIELD = {
    "buy_count": "buy_count",
    "sell_count": "sell_count",
    "unique_buyers": "unique_buyers",
    "unique_sellers": "unique_sellers",
    "volume_sol": "buy_volume_sol",
    "avg_buy_size": "avg_buy_size",
    "buy_sell_ratio": "buy_sell_ratio",
    "top_3_volume_share": "top_3_buyers_volume_share",
    "new_wallet_pct": "new_wallet_pct",
}


def two_windows(short: DataFrame, long: DataFrame) -> DataFrame:
    """Short-window and long-window statistics that end at the same time, under rule names.

    Both sides come out of aggregates on (mint, win_end), so the join needs no new exchange.
    """

    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            "mint",
            "win_end",
            *[F.col(c).alias(f"{name}_{suffix}") for c, name in RULE_FIELD.items()],
        )

    return named(short, "5m").join(named(long, "1h"), ["mint", "win_end"], "inner")


def active_mints(swaps: DataFrame, now: int, max_age: int) -> DataFrame:
    """Mints with a trade in the last ``max_age`` seconds before ``now``."""
    recent = swaps.filter((F.col("block_time") <= now) & (F.col("block_time") >= now - max_age))
    return recent.groupBy(F.col("base_mint").alias("mint")).agg(
        F.max("block_time").alias("last_seen"), F.count("*").alias("swap_count")
    )
