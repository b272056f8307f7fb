"""Counters, rolling statistics and rankings over trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.columns import day_text, sol
from flowlens.functions.text import finite_ratio
from flowlens.operators import stats as S
from flowlens.operators import toplists as TL
from flowlens.operators.asof import latest_before, latest_value
from flowlens.operators.gate import first_sight
from flowlens.operators.lookups import lookup_join
from flowlens.operators.metrics import labelled_counts
from flowlens.plans import reports as R
from flowlens.plans.detection import stats_pair
from flowlens.workload import views as V
from flowlens.workload.registry import query

DAY = V.DAY

# Wallet panes of one day, windows made of them, and the statistics of one window length.
PANES = f"""panes as (
  select base_mint as mint, block_time // {DAY} * {DAY} + {DAY} as win_end, user_wallet,
    count(*) filter (side = 'buy') as buys, count(*) filter (side = 'sell') as sells,
    sum(quote_amount) as lamports
  from swaps group by all)"""


def windows_sql(name: str, days: int) -> str:
    return f"""{name} as (
  select mint, win_end + i * {DAY} as win_end, user_wallet, sum(buys) as buys, sum(sells) as sells,
    sum(lamports) as lamports
  from panes, range({days}) as r(i) group by all)"""


def stats_sql(name: str, windows: str, days: int, top_new: int | None = None) -> str:
    """CTEs ``{name}_top`` and ``{name}``: all statistics per (mint, win_end)."""
    new = f"first_seen >= win_end - {days * DAY}" + (f" and r <= {top_new}" if top_new else "")
    return f"""{name}_seen as (
    select user_wallet, min(block_time) as first_seen from swaps group by all),
  {name}_top as (
    select w.*, row_number() over (partition by mint, win_end order by lamports desc, user_wallet) as r,
      first_seen
    from {windows} w join {name}_seen using (user_wallet)),
  {name} as (
    select mint, win_end, sum(buys)::bigint as buy_count, sum(sells)::bigint as sell_count,
      count(*) filter (buys > 0) as unique_buyers, count(*) filter (sells > 0) as unique_sellers,
      sum(lamports)::bigint as volume_lamports,
      sum(lamports)::bigint::double / 1e9 as volume_sol,
      case when sum(buys) > 0 then (sum(lamports)::bigint::double / 1e9) / sum(buys)::double else 0.0::double end
        as avg_buy_size,
      case when sum(sells) > 0 then sum(buys)::double / sum(sells)::double else 'inf'::double end
        as buy_sell_ratio,
      coalesce((sum(lamports) filter (r <= 3))::bigint::double
        / nullif(sum(lamports)::bigint::double, 0), 0.0::double) as top_3_volume_share,
      count(*) filter ({new}) as new_wallet_count,
      coalesce((count(*) filter ({new}))::double
        / nullif(count(*) filter (buys > 0), 0)::double, 0.0::double) as new_wallet_pct
    from {name}_top group by mint, win_end)"""


STATS = f"{V.SWAPS}, {PANES}, {stats_sql('stats', 'panes', 1)}"
_PAIR_NAMES = {
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
_PAIR_COLUMNS = ", ".join(
    f"{a}.{c} as {n}_{s}" for a, s in (("s", "5m"), ("l", "1h")) for c, n in _PAIR_NAMES.items()
)
PAIR = f"""{STATS}, {windows_sql('week', 7)}, {stats_sql('long', 'week', 7)},
  pair as (select s.mint, s.win_end, {_PAIR_COLUMNS}
    from stats s join long l on l.mint = s.mint and l.win_end = s.win_end)"""


@query(
    "bucket_counters",
    f"""with {V.SWAPS} select base_mint as mint, block_time // 3600 * 3600 as bucket,
    count(*) filter (side = 'buy') as buy_count, count(*) filter (side = 'sell') as sell_count,
    sum(quote_amount)::bigint as volume_lamports,
    coalesce(sum(quote_amount) filter (side = 'buy'), 0)::bigint as buy_lamports
    from swaps group by all""",
)
def bucket_counters(spark, folder):
    out = S.bucket_counters(V.swaps(spark, folder), 3600)
    return out.select(
        "mint",
        "bucket",
        "buy_count",
        "sell_count",
        F.col("volume_lamports").cast("bigint").alias("volume_lamports"),
        F.coalesce("buy_lamports", F.lit(0)).cast("bigint").alias("buy_lamports"),
    )


@query(
    "unique_wallets",
    f"""with {V.SWAPS} select base_mint as mint, block_time // {DAY} * {DAY} as bucket,
    count(distinct user_wallet) filter (side = 'buy') as unique_buyers,
    count(distinct user_wallet) filter (side = 'sell') as unique_sellers
    from swaps group by all""",
)
def unique_wallets(spark, folder):
    return S.unique_wallets(V.swaps(spark, folder), DAY)


@query(
    "unique_wallets_sketch",
    f"""with {V.SWAPS} select base_mint as mint,
    count(distinct user_wallet) filter (side = 'buy') as unique_buyers,
    count(distinct user_wallet) filter (side = 'sell') as unique_sellers, true as close
    from swaps group by all""",
)
def unique_wallets_sketch(spark, folder):
    """Daily sketches merged to one estimate per mint, held against the exact counts."""
    trades = V.swaps(spark, folder)
    merged = S.unique_wallets(trades, DAY, approx=True).groupBy("mint").agg(
        F.hll_sketch_estimate(F.hll_union_agg("buyer_sketch")).alias("buyers"),
        F.hll_sketch_estimate(F.hll_union_agg("seller_sketch")).alias("sellers"),
    )
    exact = (
        trades.groupBy(F.col("base_mint").alias("mint"), "user_wallet")
        .agg(F.max(F.col("side") == "buy").alias("bought"), F.max(F.col("side") == "sell").alias("sold"))
        .groupBy("mint")
        .agg(F.count_if("bought").alias("unique_buyers"), F.count_if("sold").alias("unique_sellers"))
    )
    off = [F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), F.col(b) * 0.05) for a, b in (("buyers", "unique_buyers"), ("sellers", "unique_sellers"))]
    return exact.join(merged, "mint").select("mint", "unique_buyers", "unique_sellers", (off[0] & off[1]).alias("close"))


@query(
    "rolling_stats",
    f"""with {V.SWAPS}, {PANES}, {windows_sql('week', 7)}, {stats_sql('long', 'week', 7)}
    select mint, win_end, buy_count, sell_count, unique_buyers, unique_sellers, volume_sol,
      avg_buy_size, case when isinf(buy_sell_ratio) then 999.0 else buy_sell_ratio end as buy_sell_ratio
    from long""",
)
def rolling_stats(spark, folder):
    out = S.rolling_stats(V.swaps(spark, folder), DAY, 7 * DAY)
    return out.withColumn("buy_sell_ratio", finite_ratio(F.col("buy_sell_ratio"))).drop(
        "volume_lamports"
    )


@query(
    "rolling_stats_max_bucket",
    f"""with {V.SWAPS}, {PANES}, days as (
      select mint, win_end, count(*) filter (buys > 0) as ub, count(*) filter (sells > 0) as us,
        sum(buys) as b, sum(sells) as s from panes group by all)
    select mint, win_end + i * {DAY} as win_end, sum(b)::bigint as buy_count, sum(s)::bigint as sell_count,
      max(ub) as unique_buyers, max(us) as unique_sellers
    from days, range(7) as r(i) group by mint, win_end + i * {DAY}""",
)
def rolling_stats_max_bucket(spark, folder):
    """Distinct wallets as the largest single day of the window."""
    out = S.rolling_stats(V.swaps(spark, folder), DAY, 7 * DAY, unique_mode="max_bucket")
    return out.select(
        "mint", "win_end", "buy_count", "sell_count", "unique_buyers", "unique_sellers"
    )


def _top(found):
    return found.select("mint", "win_end", "user_wallet", "volume_lamports", F.col("rank").cast("bigint").alias("rank"))


@query(
    "top_wallets_by_volume",
    f"""with {V.SWAPS}, {PANES} select mint, win_end, user_wallet, lamports::bigint as volume_lamports,
    row_number() over (partition by mint, win_end order by lamports desc, user_wallet) as "rank"
    from panes qualify "rank" <= 5""",
)
def top_wallets_by_volume(spark, folder):
    panes = S.wallet_panes(V.swaps(spark, folder), DAY)
    return _top(S.top_wallets(panes, DAY, DAY, 5))


@query(
    "top_wallets_sliding",
    f"""with {V.SWAPS}, {PANES}, {windows_sql('week', 7)}
    select mint, win_end, user_wallet, lamports::bigint as volume_lamports,
    row_number() over (partition by mint, win_end order by lamports desc, user_wallet) as "rank"
    from week qualify "rank" <= 5""",
)
def top_wallets_sliding(spark, folder):
    """Largest wallets of every window of seven days: candidates by pane, verified by exact sums."""
    panes = S.pane_table(V.swaps(spark, folder), DAY)
    return _top(S.top_wallets(panes, DAY, 7 * DAY, 5))


@query("top3_share", f"with {STATS} select mint, win_end, top_3_volume_share from stats")
def top3_share(spark, folder):
    return S.token_stats(V.swaps(spark, folder), DAY, DAY).select(
        "mint", "win_end", "top_3_volume_share"
    )


@query(
    "wallet_first_seen",
    f"""with recursive {V.SWAPS}, seen as (
      select user_wallet, min(block_time) as first_seen from swaps group by all
      union all
      select n.user_wallet, n.first_seen from seen s, lateral (
        select user_wallet, min(block_time) as first_seen from swaps w
        where w.user_wallet = s.user_wallet and w.block_time >= s.first_seen + {7 * DAY}
        group by user_wallet) n)
    select user_wallet, first_seen from seen""",
)
def wallet_first_seen(spark, folder):
    """First sight of each wallet, forgotten after seven days."""
    trades = V.swaps(spark, folder).select("user_wallet", "block_time")
    out = first_sight(trades, ["user_wallet"], "block_time", 7 * DAY)
    return out.select("user_wallet", F.col("block_time").alias("first_seen"))


@query(
    "new_wallets",
    f"""with {V.SWAPS}, {PANES}, {windows_sql('week', 7)}, {stats_sql('long', 'week', 7)}
    select mint, win_end, new_wallet_count, new_wallet_pct from long""",
)
def new_wallets(spark, folder):
    return S.token_stats(V.swaps(spark, folder), DAY, 7 * DAY).select(
        "mint", "win_end", "new_wallet_count", "new_wallet_pct"
    )


@query(
    "new_wallets_top_100",
    f"""with {V.SWAPS}, {PANES}, {windows_sql('week', 7)}, {stats_sql('long', 'week', 7, 100)}
    select mint, win_end, new_wallet_count, new_wallet_pct from long""",
)
def new_wallets_top_100(spark, folder):
    """New wallets among the hundred of largest volume only: the original's shortcut."""
    return S.token_stats(V.swaps(spark, folder), DAY, 7 * DAY, top_new=100).select(
        "mint", "win_end", "new_wallet_count", "new_wallet_pct"
    )


@query(
    "token_stats",
    f"""with {STATS} select * replace (
    case when isinf(buy_sell_ratio) then 999.0 else buy_sell_ratio end as buy_sell_ratio) from stats""",
)
def token_stats(spark, folder):
    out = S.token_stats(V.swaps(spark, folder), DAY, DAY)
    return out.withColumn("buy_sell_ratio", finite_ratio(F.col("buy_sell_ratio"))).withColumn(
        "volume_lamports", F.col("volume_lamports").cast("bigint")
    )


@query(
    "token_stats_two_windows",
    f"""with {PAIR} select * replace (
    case when isinf(buy_sell_ratio_5m) then 999.0 else buy_sell_ratio_5m end as buy_sell_ratio_5m,
    case when isinf(buy_sell_ratio_1h) then 999.0 else buy_sell_ratio_1h end as buy_sell_ratio_1h)
    from pair""",
)
def token_stats_two_windows(spark, folder):
    out = stats_pair(V.swaps(spark, folder), V.SHORT, V.LONG)
    ratios = ("buy_sell_ratio_5m", "buy_sell_ratio_1h")
    return out.withColumns({c: finite_ratio(F.col(c)) for c in ratios})


@query(
    "ratio_sanitize",
    f"""with {V.SWAPS} select base_mint as mint, block_time // 3600 as hour,
    case when count(*) filter (side = 'sell') = 0 then 999.0::double
      else (count(*) filter (side = 'buy'))::double / (count(*) filter (side = 'sell'))::double end as ratio
    from swaps group by all""",
)
def ratio_sanitize(spark, folder):
    counts = S.with_ratios(S.bucket_counters(V.swaps(spark, folder), 3600))
    return counts.select(
        "mint",
        F.floor(F.col("bucket") / 3600).alias("hour"),
        finite_ratio(F.col("buy_sell_ratio")).alias("ratio"),
    )


@query(
    "active_mints",
    f"""with {V.SWAPS} select base_mint as mint, max(block_time) as last_seen, count(*) as swap_count
    from swaps where block_time between {V.NOW_EVENTS - 2 * DAY} and {V.NOW_EVENTS} group by all""",
)
def active_mints(spark, folder):
    return S.active_mints(V.swaps(spark, folder), V.NOW_EVENTS, 2 * DAY)


@query(
    "top_buyers",
    f"""with {V.SWAPS}, w as (
      select base_mint as mint, user_wallet, count(*) as buy_count, sum(quote_amount)::bigint as total_quote,
        sum(base_amount)::bigint as total_base
      from swaps where side = 'buy' and block_time >= {V.NOW_EVENTS - 14 * DAY} group by all)
    select *, row_number() over (partition by mint order by total_quote desc, user_wallet) as "rank"
    from w qualify "rank" <= 10""",
)
def top_buyers(spark, folder):
    out = TL.top_buyers(V.swaps(spark, folder), 10, since=V.NOW_EVENTS - 14 * DAY)
    return out.select(
        "mint",
        "user_wallet",
        "buy_count",
        F.col("total_quote").cast("bigint").alias("total_quote"),
        F.col("total_base").cast("bigint").alias("total_base"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "dominant_venue",
    f"""with {V.SWAPS}, c as (
      select base_mint as mint, venue, count(*) as swap_count from swaps where venue <> 'error' group by all)
    select * from c qualify row_number() over (partition by mint order by swap_count desc, venue) = 1""",
)
def dominant_venue(spark, folder):
    return TL.dominant_venue(V.swaps(spark, folder), unknown="error")


VWAP = """vwap as (
  select base_mint as mint, count(*) as buys_used, sum(quote_amount)::bigint as total_quote,
    sum(base_amount)::bigint as total_base
  from (select * from swaps
    qualify row_number() over (partition by base_mint order by block_time desc, slot desc) <= 5)
  where side = 'buy' and quote_mint = 'WSOL' group by all)"""


@query(
    "vwap_recent",
    f"""with {V.SWAPS}, {VWAP}
    select *, (total_quote::double / 1e9) / total_base::double as price_per_unit from vwap""",
)
def vwap_recent(spark, folder):
    out = TL.vwap_recent(V.swaps(spark, folder), 5, quote="WSOL")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("total_quote", "total_base")})


@query(
    "recent_swaps",
    f"""with {V.SWAPS} select signature, user_wallet, side, quote_amount, block_time from swaps
    where base_mint = 'm3' and block_time >= {V.NOW_EVENTS - 7 * DAY}
    order by block_time desc, slot desc limit 100""",
)
def recent_swaps(spark, folder):
    out = TL.recent_swaps(V.swaps(spark, folder), "m3", V.NOW_EVENTS - 7 * DAY, 100)
    return out.select("signature", "user_wallet", "side", "quote_amount", "block_time")


# Hot mints for the joins below: at least half as many buys again as sells on the last days.
HOT = f"""hot as (select base_mint as mint from swaps
  where block_time >= {V.NOW_EVENTS - 2 * DAY} group by 1 having count(*) filter (side = 'buy') * 2 > count(*) filter (side = 'sell') * 3)"""


def hot_mints(trades):
    recent = trades.filter(F.col("block_time") >= V.NOW_EVENTS - 2 * DAY)
    buy = F.col("side") == "buy"
    counted = recent.groupBy(F.col("base_mint").alias("mint")).agg(
        F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells")
    )
    return counted.filter("buys * 2 > sells * 3").select("mint")


@query(
    "hot_swaps",
    f"""with {V.SWAPS}, {HOT} select signature, base_mint, user_wallet, quote_amount
    from swaps where base_mint in (select mint from hot)""",
)
def hot_swaps(spark, folder):
    trades = V.swaps(spark, folder)
    hot = hot_mints(trades).withColumnRenamed("mint", "base_mint")
    out = lookup_join(trades, hot, ["base_mint"], "left_semi")
    return out.select("signature", "base_mint", "user_wallet", "quote_amount")


@query(
    "hot_token_stats",
    f"""with {STATS}, {HOT} select mint, win_end, buy_count, unique_buyers, volume_sol,
    mint in (select mint from hot) as is_hot from stats""",
)
def hot_token_stats(spark, folder):
    """Daily statistics of all mints with a flag for the hot ones."""
    trades = V.swaps(spark, folder)
    stats = S.token_stats(trades, DAY, DAY)
    flagged = lookup_join(stats, hot_mints(trades).withColumn("is_hot", F.lit(True)), ["mint"])
    return flagged.select(
        "mint",
        "win_end",
        "buy_count",
        "unique_buyers",
        "volume_sol",
        F.coalesce("is_hot", F.lit(False)).alias("is_hot"),
    )


# Market caps known from WSOL buys: quote per base times a supply of 10^9.
MCAPS = """mcaps as (select base_mint, block_time, slot,
  (quote_amount::double / 1e9) / base_amount::double * 1000000.0::double as mcap
  from swaps where side = 'buy' and quote_mint = 'WSOL')"""


def mcap_quotes(trades):
    price = sol(F.col("quote_amount")) / F.col("base_amount").cast("double")
    return trades.filter("side = 'buy' and quote_mint = 'WSOL'").select(
        "base_mint", "block_time", "slot", (price * F.lit(1000000.0)).alias("mcap")
    )


@query(
    "mcap_asof",
    f"""with {V.SWAPS}, {MCAPS}, both_sides as (
      select base_mint, block_time as t, 0 as kind, slot, struct_pack(t := block_time, m := mcap) as seen
        from mcaps
      union all
      select base_mint, block_time, 1, slot, null from swaps where side = 'sell'),
    filled as (select *, last_value(seen ignore nulls) over (partition by base_mint
      order by t, kind, slot rows between unbounded preceding and current row) as hit from both_sides)
    select slot, base_mint, case when t - hit.t <= 21600 then hit.m end as mcap,
      coalesce(case when t - hit.t <= 21600 then hit.t end, 0) as mcap_time
    from filled where kind = 1""",
)
def mcap_asof(spark, folder):
    """Sells with the latest earlier market cap of at most six hours of age."""
    trades = V.swaps(spark, folder)
    sells = trades.filter("side = 'sell'").select("base_mint", "block_time", "slot")
    out = latest_before(
        sells,
        mcap_quotes(trades),
        "base_mint",
        "mcap",
        21_600,
        fact_order=("block_time", "slot"),
        value_order=("block_time", "slot"),
    )
    return out.select(
        "slot", "base_mint", "mcap", F.coalesce("mcap_time", F.lit(0)).alias("mcap_time")
    )


@query(
    "latest_mcap",
    f"""with {V.SWAPS}, {MCAPS} select base_mint, block_time, mcap from mcaps
    where block_time > {V.NOW_EVENTS - 3 * DAY} and block_time <= {V.NOW_EVENTS}
    qualify row_number() over (partition by base_mint order by block_time desc, slot desc) = 1""",
)
def latest_mcap(spark, folder):
    quotes = mcap_quotes(V.swaps(spark, folder))
    return latest_value(
        quotes, "base_mint", ["mcap"], ["block_time", "slot"], V.NOW_EVENTS, 3 * DAY
    ).select("base_mint", "block_time", "mcap")


@query(
    "swaps_per_day",
    f"""with {V.SWAPS} select strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') as day, count(*) as swaps
    from swaps group by all""",
)
def swaps_per_day(spark, folder):
    trades = V.swaps(spark, folder)
    return trades.groupBy(day_text(F.col("block_time")).alias("day")).agg(F.count("*").alias("swaps"))


@query(
    "mints_per_day",
    f"""with {V.SWAPS} select strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') as day,
    count(distinct m) as mints from (select block_time, base_mint as m from swaps
      union all select block_time, quote_mint from swaps where quote_mint <> 'WSOL') group by all""",
)
def mints_per_day(spark, folder):
    """Distinct mints touched per day; a trade in dollars touches the dollar token too."""
    trades = V.swaps(spark, folder)
    touched = F.array_distinct(
        F.array_compact(F.array("base_mint", F.nullif("quote_mint", F.lit("WSOL"))))
    )
    return (
        trades.select(day_text(F.col("block_time")).alias("day"), F.explode(touched).alias("mint"))
        .groupBy("day")
        .agg(F.count_distinct("mint").alias("mints"))
    )


@query(
    "live_swaps",
    f"""with {V.SWAPS} select slot, signature[1:16] || '...' as signature, base_mint as mint,
    user_wallet[1:8] || '...' || right(user_wallet, 4) as wallet, side,
    quote_amount::double / 1e9 as amount_sol, venue, block_time
    from swaps where block_time between {V.NOW_EVENTS - 2 * DAY} and {V.NOW_EVENTS}
    order by block_time desc, slot desc limit 50""",
)
def live_swaps(spark, folder):
    return R.live_swaps(V.swaps(spark, folder), V.NOW_EVENTS, 2 * DAY, 50)


@query(
    "labelled_counters",
    f"""with {V.SWAPS} select coalesce(side, 'all') as side, coalesce(venue, 'all') as venue, count(*) as n
    from swaps group by cube (side, venue)""",
)
def labelled_counters(spark, folder):
    return labelled_counts(V.swaps(spark, folder), ["side", "venue"])


@query(
    "processing_lag",
    f"""with {V.SWAPS} select venue, arg_max(block_time, slot) as last_block_time,
    {V.NOW_EVENTS} - arg_max(block_time, slot) as lag_seconds from swaps group by all""",
)
def processing_lag(spark, folder):
    """Age of the last record per venue."""
    last = V.swaps(spark, folder).groupBy("venue").agg(
        F.max_by("block_time", "slot").alias("last_block_time")
    )
    return last.withColumn("lag_seconds", F.lit(V.NOW_EVENTS) - F.col("last_block_time"))


@query(
    "dedup_ttl_signature",
    f"""with {V.SWAPS} select signature, block_time from swaps
    union all select signature, block_time + 700 from swaps where slot % 5 = 0""",
)
def dedup_ttl_signature(spark, folder):
    """The gate by signature: repeats within 600 s of the first sight fall, later ones pass."""
    trades = V.swaps(spark, folder).select("signature", "slot", "block_time")
    later = lambda every, by: trades.filter(F.col("slot") % every == 0).withColumn("block_time", F.col("block_time") + by)
    seen = trades.unionByName(later(3, 100)).unionByName(later(5, 700)).unionByName(later(7, 0))
    return first_sight(seen, ["signature"], "block_time", 600)


@query(
    "dedup_ttl",
    f"""with recursive {V.SWAPS}, seen as (
      select venue, min(block_time) as t from swaps group by all
      union all
      select n.venue, n.t from seen s, lateral (
        select venue, min(block_time) as t from swaps w
        where w.venue = s.venue and w.block_time >= s.t + 600 group by venue) n)
    select s.venue, s.t as block_time, min(w.slot) as slot from seen s
    join swaps w on w.venue = s.venue and w.block_time = s.t group by all""",
)
def dedup_ttl(spark, folder):
    """Events whose key was not seen in the 600 s after the last one let through."""
    trades = V.swaps(spark, folder)
    return first_sight(trades, ["venue"], "block_time", 600, order=["slot"], carry=["slot"])


