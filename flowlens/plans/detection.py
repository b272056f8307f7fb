"""Detection as one query over all mints: statistics, rules, gates, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from flowlens.functions.columns import wide
from flowlens.operators import alerts as A
from flowlens.operators import graph as G
from flowlens.operators.asof import latest_before
from flowlens.operators.keyed import KeyedTable
from flowlens.operators.lookups import first_known, lookup_join
from flowlens.operators.rules import first_match, mcap_gate
from flowlens.operators.scoring import factors, linked_buyers, scored
from flowlens.operators.state import cooled_down
from flowlens.operators.stats import pane_table, stats_of_panes, two_windows
from flowlens.operators.toplists import (
    dominant_venue_as_of,
    pane_end,
    top_buyers,
    top_buyers_as_of,
    vwap_as_of,
)
from flowlens.session import materialize
from flowlens.sources.rules import Rule


def stats_pair(
    swaps: DataFrame, short: int, long: int, volume: str = "quote_amount", basis: str = "both"
) -> DataFrame:
    """Rule statistics of the short and the long window at every short-window end."""
    panes = pane_table(swaps, short, volume)
    return two_windows(
        stats_of_panes(panes, short, short, basis), stats_of_panes(panes, short, long, basis)
    )


def hits(
    swaps: DataFrame,
    rules: Sequence[Rule],
    short: int,
    long: int,
    volume: str = "quote_amount",
    with_reason: bool = True,
) -> DataFrame:
    """First rule that fires per mint and window end."""
    return first_match(stats_pair(swaps, short, long, volume), rules, with_reason)


def gated_hits(
    matched: DataFrame,
    quotes: DataFrame,
    minimum: float,
    cooldown: int | None = None,
    max_age: int = 3600,
    order: Sequence[str] = ("block_time", "slot"),
) -> DataFrame:
    """Hits that pass the market-cap gate and, if given, the cool-down, with their ``mcap_sol``.

    ``quotes``: (mint, mcap_sol, ``order``). A hit is judged by the last quote before its window's end
    that is at most ``max_age`` seconds old; later quotes can't change it.
    """
    matched, _ = materialize(matched)
    asked = matched.withColumn("asked_at", F.col("win_end") - 1)
    known = latest_before(asked, quotes, "mint", "mcap_sol", max_age, ("asked_at",), order)
    passed = mcap_gate(known.drop("asked_at", "mcap_sol_time"), minimum=minimum)
    return passed if cooldown is None else cooled_down(passed, cooldown)


def wallet_activity(swaps: DataFrame) -> DataFrame:
    """Per wallet: volume in lamports and number of buys."""
    return swaps.groupBy(F.col("user_wallet").alias("node")).agg(
        F.sum(F.col("quote_amount").cast("decimal(38,0)")).alias("volume_lamports"),
        F.count_if(F.col("side") == "buy").alias("buy_count"),
    )


def alert_rows(
    passed: DataFrame,
    swaps: DataFrame,
    members: DataFrame,
    supply: DataFrame,
    quote: str,
    pane: int,
    history: DataFrame | None = None,
    profiles: Sequence[DataFrame] = (),
    degraded: Column | None = None,
    buyers_kept: int = 5,
    unknown_venue: str = "unknown",
) -> DataFrame:
    """Full alert rows for hits: top buyers, clusters, score, venue, price and market cap.

    ``passed`` has short-window statistics under rule names and the gate's ``mcap_sol``. ``members`` is
    the result of ``components``; ``supply`` has (base_mint, supply, decimals); ``pane`` is the short window.
    ``profiles`` have (mint and some of token_name, token_symbol, token_image): the first that knows a field
    gives it. ``degraded`` is a condition over the hit: was enrichment down then?

    Everything is as of the hit: lists, clusters, venue and price come from the trades before its
    ``win_end``. The market cap is the one the gate saw, else supply times the mean of the last trades.

    The hits, the trades of their mints and the top buyers are each used several times, so they are
    written once: the trades are scanned for the hot mints only once, however many lists follow.
    """
    keys = ["mint", "win_end"]
    passed, _ = materialize(passed)
    hot = passed.select(F.col("mint").alias("base_mint")).distinct()
    activity = swaps.groupBy(F.col("user_wallet").alias("node"), pane_end(pane).alias("pane_end")).agg(
        F.sum(wide(F.col("quote_amount"))).alias("lamports")
    )
    swaps, _ = materialize(lookup_join(swaps, hot, ["base_mint"], "left_semi"))
    tops, _ = materialize(top_buyers_as_of(swaps, passed, pane, buyers_kept))
    listed = tops.select(*keys, F.col("user_wallet").alias("node"))
    summaries = G.cluster_summary(G.clusters_as_of(listed, members, activity, keys, "win_end"), keys)
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    links = linked_buyers(tops, members, sizes, history, keys)
    vwap = lookup_join(
        vwap_as_of(swaps, passed, pane, quote=quote), supply.withColumnRenamed("base_mint", "mint"), ["mint"]
    ).select(
        *keys,
        (F.col("price_per_unit") * F.pow(F.lit(10.0), F.col("decimals"))).alias("price_sol"),
        (F.col("price_per_unit") * F.col("supply").cast("double")).alias("vwap_mcap"),
    )
    seen = passed.select(*keys, F.when(F.col("mcap_sol") > 0, F.col("mcap_sol")).alias("seen"))
    price = lookup_join(seen, vwap, keys).select(
        *keys, "price_sol", F.coalesce("seen", "vwap_mcap").alias("mcap_sol")
    )
    stats = passed.select(
        "mint",
        "win_end",
        "trigger_name",
        "trigger_reason",
        F.col("buy_count_5m").alias("buy_count"),
        F.col("unique_buyers_5m").alias("unique_buyers"),
        F.col("buy_volume_sol_5m").alias("volume_sol"),
        F.col("buy_sell_ratio_5m").alias("buy_sell_ratio"),
        F.col("top_3_buyers_volume_share_5m").alias("top_3_volume_share"),
        F.col("new_wallet_pct_5m").alias("new_wallet_pct"),
    )
    rated = factors(scored(lookup_join(stats, links, keys)))
    built = A.build_alerts(
        rated,
        A.buyer_lists(tops, buyers_kept, keys),
        summaries.select(*keys, "cluster_summary"),
        dominant_venue_as_of(swaps, passed, pane, unknown_venue).select(*keys, "venue"),
        price,
    )
    known = first_known(built, profiles, "mint", ["token_name", "token_symbol", "token_image"])
    sizes_of = supply.select(F.col("base_mint").alias("mint"), F.col("supply").alias("token_supply"))
    return lookup_join(known, sizes_of, ["mint"]).withColumn(
        "enrichment_degraded", F.lit(False) if degraded is None else degraded
    )


def enrich_hot(
    hot: DataFrame,
    swaps: DataFrame,
    transfers: DataFrame,
    order: Sequence[str],
    buyers: int = 10,
    max_hops: int = 2,
) -> dict[str, DataFrame]:
    """Enrichment of hot mints: trace the funding of their top buyers and cluster them.

    Returns ``funding`` (wallet, ultimate_funder, hops), ``members`` (node, component) and
    ``clusters`` (component, size, volume_lamports, buy_count).
    """
    mints = hot.select(F.col("mint").alias("base_mint")).distinct()
    hot_swaps, _ = materialize(lookup_join(swaps, mints, ["base_mint"], "left_semi"))
    wallets = top_buyers(hot_swaps, buyers).select(F.col("user_wallet").alias("wallet")).distinct()
    firsts = G.earliest_funder(transfers, order)
    traced = G.trace_funding(firsts, wallets, max_hops)
    funding, _ = materialize(traced.select("wallet", "ultimate_funder", "hops"))
    edges = funding.select("wallet", F.col("ultimate_funder").alias("funder"))
    members = G.components(wallets.select(F.col("wallet").alias("node")), edges)
    activity = wallet_activity(hot_swaps)
    return {
        "funding": funding,
        "members": members,
        "clusters": G.cluster_stats(members, activity),
    }


def write_funding(profiles: KeyedTable, funding: DataFrame, version: int) -> None:
    """Write the funders that an enrichment traced into the profiles (``wallet``, ``funded_by``, ``funding_hop``, others).

    ``funding``: (wallet, ultimate_funder, hops). Wallets without a profile, and profiles without a traced funder, stay as
    they are; only the parts of the table that hold a traced wallet are read and rewritten.
    """
    traced = funding.filter(F.col("ultimate_funder").isNotNull()).select(
        F.col("wallet").alias(profiles.key), F.col("ultimate_funder").alias("funded_by"), F.col("hops").alias("funding_hop")
    )
    profiles.update(traced, version, ["funded_by", "funding_hop"])
