"""Wallet clusters, funding traces and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scores as SC
from flowlens.operators import graph as G
from flowlens.operators.clusters import ClusterStore
from flowlens.operators.keyed import KeyedTable
from flowlens.operators.lookups import lookup_join
from flowlens.operators.scoring import factors, linked_buyers, scored
from flowlens.operators.stats import token_stats
from flowlens.operators.toplists import pane_end, top_buyers_as_of
from flowlens.plans.detection import enrich_hot, write_funding
from flowlens.session import materialize, shared_dir
from flowlens.sources.tables import read_table
from flowlens.workload import views as V
from flowlens.workload.q_stats import HOT, STATS, hot_mints
from flowlens.workload.registry import query

DAY = V.DAY

CUSTOMER_MEMBERS = f"""{V.CUSTOMER_EDGES}, nodes as (select c_custkey as node from customer),
  {V.components_sql('nodes', 'edges')}"""
CUSTOMER_STATS = f"""{CUSTOMER_MEMBERS},
  activity as (select o_custkey as node, sum(round(o_totalprice * 100)::bigint)::bigint * 10000000 as lamports,
    count(*) as buys from orders group by all),
  clusters as (select component, count(*) as size, coalesce(sum(lamports), 0)::bigint as volume_lamports,
    coalesce(sum(buys), 0)::bigint as buy_count from members left join activity using (node) group by all)"""


def customer_members(spark, folder):
    nodes = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("node"))
    return G.components(nodes, V.customer_edges(spark, folder))


def customer_stats(spark, folder, members):
    cents = F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)")
    activity = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("node")).agg(
        (F.sum(cents) * 10_000_000).alias("volume_lamports"), F.count("*").alias("buy_count")
    )
    return G.cluster_stats(members, activity)


@query("wallet_clusters", f"with recursive {CUSTOMER_MEMBERS} select node, component from members")
def wallet_clusters(spark, folder):
    """Component of every wallet, lone wallets included."""
    return customer_members(spark, folder)


@query("clusters_after_batches", f"with recursive {CUSTOMER_MEMBERS} select node, component from members")
def clusters_after_batches(spark, folder):
    """Clusters kept up to date by three batches of links, the second one delivered twice."""
    nodes = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("node"))
    links, _ = materialize(V.customer_edges(spark, folder))
    store = ClusterStore(spark, shared_dir(spark), nodes.schema["node"].dataType, parts=8)
    batch = F.pmod(F.xxhash64("wallet", "funder"), F.lit(3))
    for version, k in enumerate((0, 1, 1, 2)):
        store.add(links.filter(batch == k), k, nodes if version == 0 else None)
    return store.read()


@query(
    "wallets_connected",
    f"""with recursive {CUSTOMER_MEMBERS} select l_orderkey as pair_id, l_linenumber as n, o_custkey as x,
    l_suppkey as y, a.component = b.component as connected
    from (select distinct l_orderkey, l_linenumber, l_suppkey from lineitem)
    join orders on o_orderkey = l_orderkey
    left join members a on a.node = o_custkey left join members b on b.node = l_suppkey""",
)
def wallets_connected(spark, folder):
    """Are the two wallets of given pairs linked?"""
    members, _ = materialize(customer_members(spark, folder))
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("x")
    )
    pairs = lines.distinct().join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("pair_id"),
        F.col("l_linenumber").alias("n"),
        "x",
        F.col("l_suppkey").alias("y"),
    )
    return G.same_cluster(pairs, members)


@query("cluster_stats", f"with recursive {CUSTOMER_STATS} select * from clusters")
def cluster_stats(spark, folder):
    """Lamports are bigint as in SQL, unless a component's sum passes its range (SQL fails there): then all are decimals."""
    return G.whole_amounts(customer_stats(spark, folder, customer_members(spark, folder)), "volume_lamports")


@query(
    "cluster_overview",
    f"""with recursive {CUSTOMER_STATS} select sum(size)::bigint as total_wallets, count(*) as total_clusters,
    count(*) filter (size >= 2) as large_clusters, sum(size)::double / count(*)::double as avg_cluster_size,
    max(size) as max_cluster_size from clusters""",
)
def cluster_overview(spark, folder):
    return G.cluster_overview(customer_stats(spark, folder, customer_members(spark, folder)))


@query(
    "clusters_for_wallets",
    f"""with recursive {CUSTOMER_STATS} select distinct n_nationkey::bigint as nation, component, size, buy_count
    from customer join nation on n_nationkey = c_nationkey join members on node = c_custkey
    join clusters using (component)""",
)
def clusters_for_wallets(spark, folder):
    """Distinct clusters of one wallet list per nation."""
    members, _ = materialize(customer_members(spark, folder))
    stats = customer_stats(spark, folder, members)
    lists = read_table(spark, folder, "customer")
    listed = lists.select(
        F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_custkey").alias("node")
    )
    return G.clusters_of(listed, members, stats, "nation").select(
        "nation", "component", "size", "buy_count"
    )


_TWO = "(round((volume_lamports::double / 1e9)::decimal(38, 9), 2)::decimal(38, 2))::varchar"


@query(
    "cluster_summary",
    f"""with recursive {CUSTOMER_STATS}, found as (
      select distinct c_nationkey::bigint as nation, clusters.* from customer
      join members on node = c_custkey join clusters using (component)),
    ranked as (select *, row_number() over (partition by nation order by volume_lamports desc, component) as r from found),
    totals as (select nation, sum(size)::bigint as wallets, count(*) as clusters from found group by all)
    select nation, wallets, clusters, wallets || ' wallets in ' || clusters || ' cluster'
      || case when clusters > 1 then 's' else '' end || ': ' || top
      || case when clusters > 5 then ' (+' || (clusters - 5) || ' more clusters)' else '' end as cluster_summary
    from totals join (select nation, string_agg('Cluster ' || chr((64 + r)::int) || ' (' || size || ' wallet'
      || case when size > 1 then 's' else '' end || ', ' || {_TWO} || ' SOL)', ', ' order by r) as top
      from ranked where r <= 5 group by nation) using (nation)""",
)
def cluster_summary(spark, folder):
    members, _ = materialize(customer_members(spark, folder))
    stats = customer_stats(spark, folder, members)
    lists = read_table(spark, folder, "customer")
    listed = lists.select(
        F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_custkey").alias("node")
    )
    return G.cluster_summary(G.clusters_of(listed, members, stats, "nation"), "nation")


@query(
    "funding_edges",
    f"""with {V.LINES}, fell as (select signature, payer, sum(sol) - 5000 as moved from lines group by all),
    gains as (select distinct signature, l_suppkey as s from lines where l_suppkey <> 0 or l_suppkey % 5 = 0)
    select g.signature, 's' || s as wallet, payer as funder from gains g join fell using (signature)
    where moved < 0""",
)
def funding_edges(spark, folder):
    """Accounts that gained, with the first account in key order that lost."""
    edges = G.funding_edges(V.tx(spark, folder, suppliers=True))
    return edges.select("signature", "wallet", "funder")


@query(
    "funding_trace",
    f"""with {V.TRANSFERS}, first_hops as (select * from transfers
      qualify row_number() over (partition by wallet order by block_time, slot, idx, funder) = 1)
    select wallet, funder as ultimate_funder, 1::bigint as hops from first_hops""",
)
def funding_trace(spark, folder):
    """First funder of each customer; suppliers have none, so the trace ends there."""
    moves = V.transfers(spark, folder)
    firsts = G.earliest_funder(moves, ["block_time", "slot", "idx"])
    out = G.trace_funding(firsts, moves.select("wallet").distinct(), 2)
    return out.select("wallet", "ultimate_funder", F.col("hops").cast("bigint").alias("hops"))


USER_FIRST = f"""{V.USER_TRANSFERS}, first_hops as (select wallet, funder from user_transfers
  where wallet <> funder qualify row_number() over (partition by wallet order by block_time, slot, funder) = 1)"""


@query(
    "funding_trace_two_hops",
    f"""with {V.SWAPS}, {USER_FIRST} select a.wallet, a.funder as funder_1, coalesce(b.funder, a.funder) as ultimate_funder,
    case when b.funder is null then 1 else 2 end::bigint as hops
    from first_hops a left join first_hops b on b.wallet = a.funder""",
)
def funding_trace_two_hops(spark, folder):
    moves = V.user_transfers(V.swaps(spark, folder))
    firsts = G.earliest_funder(moves, ["block_time", "slot"])
    out = G.trace_funding(firsts, moves.select("wallet").distinct(), 2)
    return out.select(
        "wallet", "funder_1", "ultimate_funder", F.col("hops").cast("bigint").alias("hops")
    )


@query(
    "enrich_hot",
    f"""with recursive {V.SWAPS}, {HOT}, hot_trades as (
      select * from swaps where base_mint in (select mint from hot)),
    buyers as (select base_mint, user_wallet, sum(quote_amount) as q from hot_trades where side = 'buy' group by base_mint, user_wallet
      qualify row_number() over (partition by base_mint order by q desc, user_wallet) <= 10),
    wallets as (select distinct user_wallet as node from buyers), {USER_FIRST},
    edges as (select a.wallet, coalesce(b.funder, a.funder) as funder from first_hops a
      left join first_hops b on b.wallet = a.funder where a.wallet in (select node from wallets)),
    nodes as (select node from wallets union select wallet from edges union select funder from edges),
    {V.components_sql('nodes', 'edges')},
    activity as (select user_wallet as node, sum(quote_amount)::bigint as lamports,
      count(*) filter (side = 'buy') as buys from hot_trades group by all)
    select component, count(*) as size, coalesce(sum(lamports), 0)::bigint as volume_lamports,
      coalesce(sum(buys), 0)::bigint as buy_count from members left join activity using (node) group by all""",
)
def enrich(spark, folder):
    """Clusters of the top buyers of hot tokens, linked by who funded them."""
    trades = V.swaps(spark, folder)
    out = enrich_hot(
        hot_mints(trades), trades, V.user_transfers(trades), ["block_time", "slot"], 10, 2
    )
    return G.whole_amounts(out["clusters"], "volume_lamports")


# --- scores --------------------------------------------------------------------------------

USER_MEMBERS = f"""{V.USER_EDGES}, {V.components_sql('users', 'user_edges')},
  sizes as (select component, count(*) as size from members group by all)"""
# Clusters of an earlier run: users by number modulo 40.
# Top buyers, and so links, are those of the trades before each window's end.
LINKS = f"""{USER_MEMBERS},
  buyers as (select s.mint, s.win_end, user_wallet, user_id, sum(quote_amount) as q
    from (select mint, win_end from stats) s join swaps w on w.base_mint = s.mint and w.block_time < s.win_end
    where side = 'buy' group by s.mint, s.win_end, user_wallet, user_id
    qualify row_number() over (partition by s.mint, s.win_end order by q desc, user_wallet) <= 5),
  bought as (select mint, win_end, user_wallet, component, size, 'h' || (user_id % 3) as cluster_id
    from buyers join members on node = user_wallet join sizes using (component)),
  past as (select mint, win_end, cluster_id, count(*) as n, count(*) filter (size < 2) as only_past from bought group by all),
  in_past as (select mint, win_end, sum(case when n >= 2 then only_past else 0 end) as past_only, max(n) as past_largest
    from past group by all),
  in_now as (select mint, win_end, sum(size) as in_clusters
    from (select distinct mint, win_end, component, size from bought where size >= 2) group by all),
  links as (select mint, win_end, count(*) as buyers_listed,
    (coalesce(any_value(in_clusters), 0) + any_value(past_only))::bigint as linked,
    coalesce(max(size) filter (size >= 2), any_value(past_largest)) as largest
    from bought left join in_now using (mint, win_end) left join in_past using (mint, win_end) group by mint, win_end),
  clustered as (select *, case when linked::double / buyers_listed::double >= 5e-1
      then least(1.0::double, linked::double / buyers_listed::double + 2e-1)
    when linked::double / buyers_listed::double >= 2e-1 then linked::double / buyers_listed::double + 1e-1
    else 0.0::double end as cluster_score from links)"""
SCORE_STEPS = """parts as (select s.*, coalesce(c.buyers_listed, 0) as buyers_listed, coalesce(c.linked, 0) as linked,
    coalesce(c.largest, 1) as largest, coalesce(c.cluster_score, 0.0::double) as cluster_score,
    case when top_3_volume_share >= 8e-1 then 1e0 when top_3_volume_share >= 6e-1 then 8e-1
      when top_3_volume_share >= 4e-1 then 5e-1 when top_3_volume_share >= 2e-1 then 2e-1 else 0e0 end as concentration_score,
    case when unique_buyers = 0 then 0e0 when buy_count::double / unique_buyers >= 10 then 1e0
      when buy_count::double / unique_buyers >= 5 then 7e-1 when buy_count::double / unique_buyers >= 3 then 4e-1
      when buy_count::double / unique_buyers >= 2 then 2e-1 else 0e0 end as timing_score,
    case when new_wallet_pct >= 7e-1 then 1e0 when new_wallet_pct >= 5e-1 then 7e-1
      when new_wallet_pct >= 3e-1 then 4e-1 else 0e0 end as new_wallet_score,
    case when buy_sell_ratio >= 20 then 1e0 when buy_sell_ratio >= 10 then 8e-1
      when buy_sell_ratio >= 5 then 5e-1 when buy_sell_ratio >= 3 then 3e-1 else 0e0 end as ratio_score,
    from stats s left join clustered c on c.mint = s.mint and c.win_end = s.win_end),
  scored as (select *, (concentration_score * 25 + cluster_score * 30 + timing_score * 15 + new_wallet_score * 15
      + ratio_score * 15) / 100e0 as total_score,
    greatest(10 - case when buy_count < 5 then 3 when buy_count < 10 then 2 when buy_count < 20 then 1 else 0 end
      - case when buyers_listed < 3 then 2 when buyers_listed < 5 then 1 else 0 end
      - case when volume_sol < 1 then 2 when volume_sol < 5 then 1 else 0 end, 1) / 10e0 as score_confidence
    from parts),
  leveled as (select *, case when total_score >= 7e-1 then 'HIGH' when total_score >= 4e-1 then 'MEDIUM'
      when total_score >= 2e-1 then 'LOW' else 'MINIMAL' end as risk_level,
    case when total_score >= 8e-1 then 'CRITICAL' when total_score >= 6e-1 then 'HIGH'
      when total_score >= 4e-1 then 'MEDIUM' when total_score >= 2e-1 then 'LOW' else 'MINIMAL' end as alert_level
    from scored)"""
SCORED = f"{STATS}, {LINKS}, {SCORE_STEPS}"


def fixed_sql(value: str, places: int) -> str:
    return f"(round(({value})::decimal(38, 9), {places})::decimal(38, {places}))::varchar"


def percent_sql(value: str) -> str:
    return f"({fixed_sql(f'({value}) * 100', 0)} || '%')"


_FINITE = "case when isinf(buy_sell_ratio) then 0 else buy_sell_ratio end"
_SHARE = "(case when buyers_listed = 0 then 0e0 else linked::double / buyers_listed::double end)"
_FREQ = "(case when unique_buyers = 0 then 0e0 else buy_count::double / unique_buyers::double end)"
EVIDENCE = f"""evidenced as (select *, list_filter([
    case when top_3_volume_share >= 8e-1 then 'Very high concentration: top 3 = ' || {percent_sql('top_3_volume_share')}
      when top_3_volume_share >= 6e-1 then 'High concentration: top 3 = ' || {percent_sql('top_3_volume_share')} end,
    case when {_SHARE} >= 5e-1 then 'High clustering: ' || {percent_sql(_SHARE)}
        || ' in linked wallets, largest cluster = ' || largest
      when {_SHARE} >= 2e-1 then 'Some clustering: ' || {percent_sql(_SHARE)} || ' in linked wallets' end,
    case when {_FREQ} >= 10 then 'High buy frequency: ' || {fixed_sql(_FREQ, 1)} || ' buys/wallet'
      when {_FREQ} >= 5 then 'Elevated buy frequency: ' || {fixed_sql(_FREQ, 1)} || ' buys/wallet' end,
    case when new_wallet_pct >= 7e-1 then 'Very high new wallet %: ' || {percent_sql('new_wallet_pct')}
      when new_wallet_pct >= 5e-1 then 'High new wallet %: ' || {percent_sql('new_wallet_pct')} end,
    case when isinf(buy_sell_ratio) then 'All buys, no sells'
      when buy_sell_ratio >= 20 then 'Extreme buy ratio: ' || {fixed_sql(_FINITE, 1)} || 'x'
      when buy_sell_ratio >= 10 then 'Very high buy ratio: ' || {fixed_sql(_FINITE, 1)} || 'x' end
  ], lambda x: x is not null) as evidence from leveled)"""


def user_members(trades):
    nodes = V.users(trades).select("node")
    return G.components(nodes, V.user_edges(trades))


def user_history(trades):
    return V.users(trades).select(
        F.col("node").alias("user_wallet"),
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("cluster_id"),
    )


def links(trades, cases):
    members, _ = materialize(user_members(trades))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    tops = top_buyers_as_of(trades, cases, DAY, 5)
    return linked_buyers(tops, members, sizes, user_history(trades), ["mint", "win_end"])


def scored_days(spark, folder):
    trades = V.swaps(spark, folder)
    stats, _ = materialize(token_stats(trades, DAY, DAY))
    return scored(lookup_join(stats, links(trades, stats), ["mint", "win_end"]))


@query(
    "cluster_score",
    f"""with recursive {STATS}, {LINKS} select mint, win_end, buyers_listed, linked, largest, cluster_score from clustered""",
)
def cluster_score(spark, folder):
    """Links among the top buyers of each token as of every day."""
    trades = V.swaps(spark, folder)
    days = trades.select(
        F.col("base_mint").alias("mint"), pane_end(DAY).alias("win_end")
    ).distinct()
    return links(trades, days)


_PARTS = "concentration_score, cluster_score, timing_score, new_wallet_score, ratio_score"


@query(
    "risk_score",
    f"""with recursive {SCORED} select mint, win_end, {_PARTS}, total_score, score_confidence from scored""",
)
def risk_score(spark, folder):
    return scored_days(spark, folder).select(
        "mint", "win_end", *_PARTS.split(", "), "total_score", "score_confidence"
    )


@query(
    "risk_level",
    f"with recursive {SCORED} select mint, win_end, risk_level, alert_level from leveled",
)
def risk_level(spark, folder):
    return scored_days(spark, folder).select(
        "mint", "win_end", "risk_level", SC.level(F.col("total_score"), "alert").alias("alert_level")
    )


@query(
    "risk_evidence",
    f"""with recursive {SCORED}, {EVIDENCE} select mint, win_end, array_to_string(evidence, ' | ') as evidence,
    'CTO Risk: ' || risk_level || ' (' || {percent_sql('total_score')} || ')'
      || array_to_string(list_transform(evidence[1:3], lambda e: chr(10) || '  ' || e), '') as summary
    from evidenced""",
)
def risk_evidence(spark, folder):
    rows = scored_days(spark, folder)
    return rows.select(
        "mint",
        "win_end",
        F.array_join("evidence", " | ").alias("evidence"),
        SC.summary(F.col("total_score"), F.col("evidence")).alias("summary"),
    )


_FACTORS = " union all ".join(
    f"select mint, win_end, {i} as place, '{label}' as label, {name}_score as v from scored"
    for i, (name, label) in enumerate(
        {
            "concentration": "Concentration",
            "cluster": "Cluster",
            "timing": "Timing",
            "new_wallet": "New Wallet",
            "ratio": "Ratio",
        }.items()
    )
)
FACTORS = f"""factor_rows as ({_FACTORS}), factor_text as (
  select mint, win_end, coalesce(string_agg(label || ': ' || {percent_sql('v')}, ', ' order by r)
    filter (v > 1e-1), '') as factors
  from (select *, row_number() over (partition by mint, win_end order by v desc, place) as r from factor_rows)
  where r <= 3 group by all)"""


@query(
    "score_top_factors",
    f"with recursive {SCORED}, {FACTORS} select mint, win_end, factors from factor_text",
)
def score_top_factors(spark, folder):
    """The three largest parts of each score."""
    rows = factors(scored_days(spark, folder))
    return rows.select("mint", "win_end", F.array_join("top_factors", ", ").alias("factors"))


@query(
    "enrich_profiles",
    f"""with {V.SWAPS}, {HOT}, buyers as (select base_mint, user_wallet, sum(quote_amount) as q from swaps
      where side = 'buy' and base_mint in (select mint from hot) group by base_mint, user_wallet
      qualify row_number() over (partition by base_mint order by q desc, user_wallet) <= 10),
    wallets as (select distinct user_wallet as node from buyers), {USER_FIRST},
    traced as (select a.wallet, coalesce(b.funder, a.funder) as funder, case when b.funder is null then 1 else 2 end as hops
      from first_hops a left join first_hops b on b.wallet = a.funder where a.wallet in (select node from wallets))
    select p.wallet, coalesce(funder, 'none') as funded_by, coalesce(hops, 0)::int as funding_hop, trades
    from (select user_wallet as wallet, count(*) as trades from swaps group by all) p left join traced using (wallet)""",
)
def enrich_profiles(spark, folder):
    """Wallet profiles after the enrichment of hot tokens has written the funders that it traced."""
    trades = V.swaps(spark, folder)
    start = trades.groupBy(F.col("user_wallet").alias("wallet")).agg(
        F.lit("none").alias("funded_by"), F.lit(0).alias("funding_hop"), F.count("*").alias("trades")
    )
    table = KeyedTable(spark, shared_dir(spark), "wallet", start.schema, parts=8)
    table.upsert(start, 0, ["funding_hop", "trades"], ["funded_by"])
    out = enrich_hot(hot_mints(trades), trades, V.user_transfers(trades), ["block_time", "slot"], 10, 2)
    write_funding(table, out["funding"], 1)
    return table.read()
