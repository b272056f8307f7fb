"""Alert rows, their text, delivery and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.constants import RISK_COLOUR, RISK_SIGN, RULE_TEXT, VENUE_SIGN, VENUE_TEXT
from flowlens.functions.text import (
    duration_text,
    gain_text,
    mcap_text,
    ratio_text,
    report_date,
    sol_text,
    usd_text,
)
from flowlens.operators import alerts as A
from flowlens.operators.alerts import DEGRADED_TEXT
from flowlens.operators.keyed import KeyedTable
from flowlens.operators.lookups import first_known, first_source
from flowlens.operators.rules import first_match
from flowlens.operators.state import cooled_down
from flowlens.operators.toplists import top_buyers
from flowlens.plans.detection import alert_rows, gated_hits, stats_pair
from flowlens.session import materialize, shared_dir
from flowlens.sources.tables import read_table
from flowlens.workload import views as V
from flowlens.workload.q_graph import (
    CUSTOMER_MEMBERS,
    EVIDENCE,
    LINKS,
    SCORE_STEPS,
    customer_members,
    fixed_sql,
    percent_sql,
    user_history,
    user_members,
)
from flowlens.workload.q_rules import (
    COOLED,
    GATED_HITS,
    RULES,
    cap_quotes,
    reason_sql,
)
from flowlens.workload.registry import query

DAY = V.DAY

# --- alerts from hits ----------------------------------------------------------------------

# Digit of the mint drives supply and symbol.
_DIGIT = "base_mint[2:]::bigint"
ALERT_STEPS = f"""{LINKS}, {SCORE_STEPS}, {EVIDENCE},
  cases as (select h.* from hits h join cooled using (mint, win_end)),
  before as (select c.win_end, s.* from cases c join swaps s on s.base_mint = c.mint and s.block_time < c.win_end),
  wallet_buys as (select base_mint as mint, win_end, user_wallet, count(*) as buy_count, sum(quote_amount)::bigint as total_quote,
      (sum(round((quote_amount::double / 1e9) / base_amount::double * 1000000.0::double * 1e6)::bigint)
        filter (quote_mint = 'WSOL'))::bigint::double / 1e6 / count(*) filter (quote_mint = 'WSOL')::double as avg_mcap
    from before where side = 'buy' group by base_mint, win_end, user_wallet),
  tops as (select *, row_number() over (partition by mint, win_end order by total_quote desc, user_wallet) as r
    from wallet_buys qualify r <= 5),
  lines as (select mint, win_end, r, user_wallet || ' - ' || {fixed_sql('total_quote::double / 1e9', 2)} || ' SOL'
      || case when avg_mcap > 0 then ' @ ' || case when avg_mcap * 200 >= 1e6 then '$' || {fixed_sql('avg_mcap * 200.0::double / 1e6', 1)} || 'M'
        when avg_mcap * 200 >= 1e3 then '$' || {fixed_sql('avg_mcap * 200.0::double / 1e3', 0)} || 'K'
        else '$' || {fixed_sql('avg_mcap * 200.0::double', 0)} end else '' end as line from tops),
  line_lists as (select mint, win_end, string_agg(line, ' ; ' order by r) as buyers,
    string_agg(r || '. ' || line, chr(10) order by r) filter (r <= 3) as first_three from lines group by mint, win_end),
  listed as (select distinct mint, win_end, component from tops join members on node = user_wallet),
  found as (select l.mint, l.win_end, l.component, count(distinct m.node) as size, coalesce(sum(s.quote_amount), 0)::bigint as lamports
    from listed l join members m using (component)
    left join swaps s on s.user_wallet = m.node and s.block_time < l.win_end group by all),
  found_ranked as (select *, row_number() over (partition by mint, win_end order by lamports desc, component) as r from found),
  summaries as (select mint, win_end, sum(size) || ' wallets in ' || count(*) || ' cluster'
      || case when count(*) > 1 then 's' else '' end || ': '
      || string_agg('Cluster ' || chr((64 + r)::int) || ' (' || size || ' wallet' || case when size > 1 then 's' else '' end
        || ', ' || {fixed_sql('lamports::double / 1e9', 2)} || ' SOL)', ', ' order by r) filter (r <= 5) as cluster_summary
    from found_ranked group by mint, win_end),
  vwap as (select base_mint as mint, win_end, sum(quote_amount)::bigint as total_quote, sum(base_amount)::bigint as total_base
    from (select * from before
      qualify row_number() over (partition by base_mint, win_end order by block_time desc, slot desc) <= 5)
    where side = 'buy' and quote_mint = 'WSOL' group by all),
  priced as (select mint, win_end, (total_quote::double / 1e9) / total_base::double * pow(10.0::double, 3) as price_sol,
      (total_quote::double / 1e9) / total_base::double * ((1 + mint[2:]::bigint) * 1000000)::double as vwap_mcap from vwap),
  venues as (select base_mint as mint, win_end, venue from before where venue <> 'error' group by base_mint, win_end, venue
    qualify row_number() over (partition by base_mint, win_end order by count(*) desc, venue) = 1),
  raised as (select h.mint, h.win_end, h.trigger_name, {reason_sql().replace('trigger_name', 'h.trigger_name', 1)} as trigger_reason,
      e.* exclude (mint, win_end), buyers, first_three, cluster_summary, venue, price_sol,
      coalesce(case when h.mcap_sol > 0 then h.mcap_sol end, vwap_mcap) as mcap_sol,
      case when h.mint[2:]::bigint % 2 = 0 then 'S' || h.mint[2:] when h.mint[2:]::bigint % 3 = 0 then 'Q' || h.mint[2:] end as token_symbol,
      case when h.mint[2:]::bigint % 3 = 0 then 'Token ' || h.mint[2:] end as token_name,
      case when h.mint[2:]::bigint % 3 = 0 then 'i' || h.mint[2:] end as token_image,
      (1 + h.mint[2:]::bigint) * 1000000 as token_supply, h.win_end // {DAY} % 7 = 0 as enrichment_degraded
    from cases h
    join evidenced e on e.mint = h.mint and e.win_end = h.win_end
    left join line_lists l on l.mint = h.mint and l.win_end = h.win_end
    left join summaries s on s.mint = h.mint and s.win_end = h.win_end
    left join priced p on p.mint = h.mint and p.win_end = h.win_end
    left join venues v on v.mint = h.mint and v.win_end = h.win_end)"""
# Cool-down applies to hits that passed the gate, so the gate comes first here.
RAISED = f"{GATED_HITS}, {COOLED}, {ALERT_STEPS}"


def raised(spark, folder):
    """Alert rows from trades: rules, gate, cool-down, buyers, clusters, score, price."""
    trades = V.swaps(spark, folder)
    hits = first_match(stats_pair(trades, V.SHORT, V.LONG), RULES)
    passed = gated_hits(hits, cap_quotes(trades), 500, 3 * DAY, max_age=3 * DAY)
    members, _ = materialize(user_members(trades))
    digit = F.substring("base_mint", 2, 9).cast("bigint")
    mints = trades.select("base_mint").distinct()
    supply = mints.select(
        "base_mint", ((digit + 1) * 1_000_000).alias("supply"), F.lit(3).alias("decimals")
    )
    name = digit.cast("string")
    mint = F.col("base_mint").alias("mint")
    stored = mints.select(mint, F.when(digit % 2 == 0, F.concat(F.lit("S"), name)).alias("token_symbol"), F.lit("").alias("token_name"))
    listed = mints.filter(digit % 3 == 0).select(
        mint,
        F.concat(F.lit("Token "), name).alias("token_name"),
        F.concat(F.lit("Q"), name).alias("token_symbol"),
        F.concat(F.lit("i"), name).alias("token_image"),
    )
    price = (F.col("quote_amount").cast("double") / 1e9) / F.col("base_amount").cast("double")
    with_caps = trades.withColumn(
        "mcap_at_swap", F.when(F.col("quote_mint") == "WSOL", price * F.lit(1000000.0))
    )
    return alert_rows(
        passed,
        with_caps,
        members,
        supply,
        quote="WSOL",
        pane=V.SHORT,
        history=user_history(trades),
        profiles=[stored, listed],
        degraded=F.floor(F.col("win_end") / DAY) % 7 == 0,
        unknown_venue="error",
    )


@query(
    "alerts_build",
    f"""with recursive {RAISED} select ('0x' || md5(mint || '|' || trigger_name || '|' || win_end)[1:15])::bigint as alert_id,
    mint, win_end, trigger_name, trigger_reason, buy_count, unique_buyers,
    volume_sol, total_score, score_confidence, buyers, cluster_summary, venue, coalesce(price_sol, -1.0::double) as price_sol,
    coalesce(mcap_sol, -1.0::double) as mcap_sol, coalesce(token_symbol, '-') as token_symbol,
    coalesce(token_name, '-') as token_name, coalesce(token_image, '-') as token_image, token_supply, enrichment_degraded from raised""",
)
def alerts_build(spark, folder):
    return raised(spark, folder).select(
        "alert_id",
        "mint",
        "win_end",
        "trigger_name",
        "trigger_reason",
        "buy_count",
        "unique_buyers",
        "volume_sol",
        "total_score",
        "score_confidence",
        F.array_join(A.buyer_lines(F.col("top_buyers")), " ; ").alias("buyers"),
        "cluster_summary",
        "venue",
        F.coalesce("price_sol", F.lit(-1.0)).alias("price_sol"),
        F.coalesce("mcap_sol", F.lit(-1.0)).alias("mcap_sol"),
        *[F.coalesce(c, F.lit("-")).alias(c) for c in ("token_symbol", "token_name", "token_image")],
        "token_supply",
        "enrichment_degraded",
    )


_RATIO_TEXT = f"""case when buy_sell_ratio > 1000 then 'ALL BUYS (no sells)'
  when buy_sell_ratio > 100 then {fixed_sql('case when isinf(buy_sell_ratio) then 0 else buy_sell_ratio end', 0)} || 'x (almost no sells)'
  when buy_sell_ratio > 10 then {fixed_sql('case when isinf(buy_sell_ratio) then 0 else buy_sell_ratio end', 0)} || 'x'
  else {fixed_sql('case when isinf(buy_sell_ratio) then 0 else buy_sell_ratio end', 1)} || 'x' end"""
# Wording from the same table as the Spark form; a title is the rule's name in capitals.
_RULE_TEXT_SQL = "case trigger_name " + " ".join(f"when '{r.name}' then '{RULE_TEXT[r.name]}'" for r in RULES) + " end"
_TITLE_SQL = "case trigger_name " + " ".join(f"when '{r.name}' then '{r.name.replace('_', ' ').title()}'" for r in RULES) + " end"


_SIGN_SQL = "case alert_level " + " ".join(f"when '{k}' then '{v}'" for k, v in RISK_SIGN.items()) + " end"
_COLOUR_SQL = "case alert_level " + " ".join(f"when '{k}' then {v}" for k, v in RISK_COLOUR.items()) + " end::int"
_VENUE_SQL = (
    "case venue " + " ".join(f"when '{k}' then '{v} {VENUE_TEXT[k]}'" for k, v in VENUE_SIGN.items())
    + f" else '{VENUE_SIGN['unknown']} {VENUE_TEXT['unknown']}' end"
)


@query(
    "alerts_render",
    f"""with recursive {RAISED} select mint, win_end,
    '[ALERT] ' || coalesce(token_symbol, mint[1:8]) || ' | ' || trigger_name || ' | Vol: ' || {fixed_sql('volume_sol', 1)}
      || ' SOL | Buyers: ' || unique_buyers || ' | CTO: ' || {percent_sql('total_score')} as plain,
    {_SIGN_SQL} || ' ' || alert_level || ' RISK - ' || coalesce('$' || token_symbol, mint[1:8] || '...') || chr(10) || {_TITLE_SQL} || chr(10)
      || {_RULE_TEXT_SQL} || chr(10) || {fixed_sql('volume_sol', 1)} || ' SOL from ' || unique_buyers || ' wallets' || chr(10)
      || buy_count || ' buys | ' || {_RATIO_TEXT} || ' ratio' || chr(10) || 'CTO Score: ' || {percent_sql('total_score')} || chr(10)
      || array_to_string(evidence[1:2], chr(10)) || chr(10) || first_three || chr(10) || mint as chat
    from raised""",
)
def alerts_render(spark, folder):
    return A.rendered(raised(spark, folder)).select("mint", "win_end", "plain", "chat")


@query(
    "alert_payload",
    f"""with recursive {RAISED} select mint, win_end, {_SIGN_SQL} || ' ' || coalesce('$' || token_symbol, mint[1:8] || '...') as title, alert_level as risk,
    {_COLOUR_SQL} as color, {_VENUE_SQL} as venue,
    floor(total_score * 100)::int as score_pct, cluster_summary as clusters, buyers,
    coalesce(case when token_name <> coalesce(token_symbol, '') then token_name end, '-') as name, coalesce(token_image, '-') as thumbnail,
    coalesce(case when enrichment_degraded then '{DEGRADED_TEXT}' end, '-') as warning, win_end as "timestamp", mint as footer,
    {_RULE_TEXT_SQL} as pattern from raised""",
)
def alert_payload(spark, folder):
    """Fields read back out of the structured alert payload."""
    p = F.from_json(
        "payload",
        "title string, color int, venue string, risk string, score_pct int, clusters string, buyers array<string>, name string,"
        " thumbnail string, warning string, timestamp long, footer string, pattern string",
    )
    out = A.rendered(raised(spark, folder)).select("mint", "win_end", p.alias("p"))
    return out.select(
        "mint",
        "win_end",
        "p.title",
        "p.color",
        "p.venue",
        "p.risk",
        "p.score_pct",
        "p.clusters",
        F.array_join("p.buyers", " ; ").alias("buyers"),
        *[F.coalesce(f"p.{c}", F.lit("-")).alias(c) for c in ("name", "thumbnail", "warning")],
        "p.timestamp",
        "p.footer",
        "p.pattern",
    )


_FLAGS = f"""list_filter([
    case when contains(lower(trigger_reason), 'unique_buyers') and buy_count::double / greatest(unique_buyers, 1)::double > 3
      then {fixed_sql('buy_count::double / greatest(unique_buyers, 1)::double', 1)} || ' buys per wallet (coordinated?)' end,
    case when isinf(buy_sell_ratio) then 'All buys, zero sells' when buy_sell_ratio > 10
      then {fixed_sql('case when isinf(buy_sell_ratio) then 0 else buy_sell_ratio end', 0)} || 'x more buys than sells' end,
    case when unique_buyers <= 5 and volume_sol > 5
      then 'Only ' || unique_buyers || ' wallets moved ' || {fixed_sql('volume_sol', 1)} || ' SOL' end],
  lambda x: x is not null)"""


@query(
    "alert_evidence",
    f"""with recursive {RAISED} select mint, win_end,
    array_to_string(list_concat({_FLAGS}, evidence[1:2])[1:4], ' | ') as flags from raised""",
)
def alert_evidence(spark, folder):
    rows = raised(spark, folder)
    return rows.select("mint", "win_end", F.array_join(A.red_flags(rows), " | ").alias("flags"))


@query(
    "avg_entry_mcap",
    f"""with {V.SWAPS}, w as (select base_mint as mint, user_wallet, sum(quote_amount) as q,
        (sum(round((quote_amount::double / 1e9) / base_amount::double * 1000000.0::double * 1e6)::bigint)
          filter (quote_mint = 'WSOL'))::bigint::double / 1e6 / count(*) filter (quote_mint = 'WSOL')::double as m
      from swaps where side = 'buy' group by base_mint, user_wallet),
    t as (select *, row_number() over (partition by mint order by q desc, user_wallet) as r from w qualify r <= 5),
    l as (select mint, list(m order by r) filter (m > 0) as ms from t group by mint)
    select mint, list_reduce(ms, lambda a, b: a + b) / len(ms) as avg_entry from l""",
)
def avg_entry_mcap(spark, folder):
    """Plain mean of the positive entry market caps in each top-buyer array."""
    trades = V.swaps(spark, folder)
    price = (F.col("quote_amount").cast("double") / 1e9) / F.col("base_amount").cast("double")
    capped = trades.withColumn(
        "mcap_at_swap", F.when(F.col("quote_mint") == "WSOL", price * F.lit(1000000.0))
    )
    lists = A.buyer_lists(top_buyers(capped, 5), 5)
    return lists.select("mint", A.entry_mcap(F.col("top_buyers")).alias("avg_entry"))


# --- delivery ------------------------------------------------------------------------------


@query(
    "alert_delivery_flags",
    """select o_orderkey as alert_id, coalesce(bool_or(l_returnflag = 'A'), false) as discord,
      o_orderstatus = 'P' or coalesce(bool_or(l_linestatus = 'F'), false) as telegram
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus""",
)
def alert_delivery_flags(spark, folder):
    stored = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("alert_id"),
        F.lit(False).alias("discord"),
        (F.col("o_orderstatus") == "P").alias("telegram"),
    )
    receipts = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("alert_id"),
        (F.col("l_returnflag") == "A").alias("discord"),
        (F.col("l_linestatus") == "F").alias("telegram"),
    )
    return A.delivery_flags(stored, receipts)


@query(
    "alert_rate_cap",
    f"""with {V.SWAPS}, sends as (select case when venue in ('click', 'view') then 'discord' else 'telegram' end as channel,
        slot as alert_id, block_time // 100 as sent_at from swaps)
    select channel, sent_at // 60 as minute, alert_id from sends
    qualify row_number() over (partition by channel, minute order by sent_at, alert_id)
      <= case channel when 'discord' then 6 else 4 end""",
)
def alert_rate_cap(spark, folder):
    """Sends within the cap of their channel and minute."""
    sends = V.swaps(spark, folder).select(
        F.when(F.col("venue").isin("click", "view"), "discord").otherwise("telegram").alias("channel"),
        F.col("slot").alias("alert_id"),
        F.floor(F.col("block_time") / 100).alias("sent_at"),
    )
    return A.capped_per_minute(sends, {"discord": 6, "telegram": 4}).select(
        "channel", "minute", "alert_id"
    )


# --- profiles ------------------------------------------------------------------------------

_CUT = 883612800  # 1998-01-01


@query(
    "token_profile_upsert",
    f"""with {V.ALERTS}, old as (select mint, min(created_at) as first_seen, max(created_at) as last_seen, count(*) as n,
        min(trigger_name) as reason, max(token_symbol) as symbol from alerts where created_at < {_CUT} group by all),
    new as (select mint, min(created_at) as first_seen, max(created_at) as last_seen, count(*) as n,
        case when count(*) % 2 = 0 then max(trigger_name) end as reason, max(token_symbol) as symbol
      from alerts where created_at >= {_CUT} group by all)
    select mint, coalesce(o.first_seen, n.first_seen) as first_seen, coalesce(n.last_seen, o.last_seen) as last_seen,
      coalesce(n.n, o.n) as n, coalesce(n.reason, o.reason, '-') as reason, coalesce(n.symbol, o.symbol, '-') as symbol
    from old o full join new n using (mint)""",
)
def token_profile_upsert(spark, folder):
    """Profiles after merging newer activity."""
    alerts = V.alerts(spark, folder)

    def profile(rows, reason):
        return rows.groupBy("mint").agg(
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.count("*").alias("n"),
            reason.alias("reason"),
            F.max("token_symbol").alias("symbol"),
        )

    old = profile(alerts.filter(F.col("created_at") < _CUT), F.min("trigger_name"))
    new = profile(
        alerts.filter(F.col("created_at") >= _CUT),
        F.when(F.count("*") % 2 == 0, F.max("trigger_name")),
    )
    table = KeyedTable(spark, shared_dir(spark), "mint", old.schema, parts=8)
    for version, rows in enumerate((old, new)):
        table.upsert(rows, version, ["last_seen", "n"], ["reason", "symbol"], ["first_seen"])
    out = table.read()
    return out.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("reason", "symbol")})


@query(
    "wallet_profile_upsert",
    """with old as (select c_custkey as wallet, c_name as label, c_nationkey as cluster_id, c_acctbal as funded
        from customer where c_mktsegment <> 'BUILDING'),
      new as (select o_custkey as wallet, 'W' || o_custkey as label, case when o_custkey % 2 = 0 then (o_custkey % 50)::int end as cluster_id,
        max(o_totalprice) as funded, count(*) as trades from orders group by all)
    select wallet, coalesce(o.label, n.label) as label, coalesce(n.cluster_id, o.cluster_id, -1) as cluster_id,
      coalesce(n.funded, o.funded) as funded, coalesce(n.trades, 0) as trades from old o full join new n using (wallet)""",
)
def wallet_profile_upsert(spark, folder):
    old = read_table(spark, folder, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("wallet"),
        F.col("c_name").alias("label"),
        F.col("c_nationkey").alias("cluster_id"),
        F.col("c_acctbal").alias("funded"),
        F.lit(None).cast("bigint").alias("trades"),
    )
    new = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("wallet")).agg(
        F.concat(F.lit("W"), F.first("o_custkey").cast("string")).alias("label"),
        F.when(
            F.first("o_custkey") % 2 == 0, (F.first("o_custkey") % 50).cast("int")
        ).alias("cluster_id"),
        F.max("o_totalprice").alias("funded"),
        F.count("*").alias("trades"),
    )
    table = KeyedTable(spark, shared_dir(spark), "wallet", old.schema, parts=8)
    for version, rows in enumerate((old, new)):
        table.upsert(rows, version, ["trades"], ["cluster_id", "funded"], ["label"])
    out = table.read()
    return out.withColumns(
        {
            "cluster_id": F.coalesce("cluster_id", F.lit(-1)),
            "trades": F.coalesce("trades", F.lit(0)),
        }
    )


_SPAN = "least(3, (extract(year from o_orderdate)::int - 1992) // 2)"


@query(
    "profile_batches",
    f"""with dated as (select o_custkey as wallet, {_SPAN} as b, o_totalprice from orders),
      batches as (select wallet, b, 'W' || wallet || '-' || b as label,
        case when (wallet + b) % 2 = 0 then max(o_totalprice) end as funded, count(*) as trades from dated group by wallet, b)
    select wallet, arg_min(label, b) as label, coalesce(arg_max(funded, b) filter (funded is not null), -1.0) as funded,
      arg_max(trades, b) as trades from batches group by wallet""",
)
def profile_batches(spark, folder):
    """Wallet profiles in a keyed table: four batches, each rewriting only the parts that hold its wallets."""
    orders = read_table(spark, folder, "orders")
    span = F.least(F.lit(3), F.floor((F.year("o_orderdate") - 1992) / 2).cast("int"))
    rows, _ = materialize(
        orders.groupBy(F.col("o_custkey").alias("wallet"), span.alias("b")).agg(
            F.max("o_totalprice").alias("funded"), F.count("*").alias("trades")
        )
    )
    changes = rows.select(
        "wallet", "b", F.concat(F.lit("W"), F.col("wallet").cast("string"), F.lit("-"), F.col("b").cast("string")).alias("label"),
        F.when((F.col("wallet") + F.col("b")) % 2 == 0, F.col("funded")).alias("funded"), "trades",
    )
    fields = T.StructType([changes.schema[c] for c in ("wallet", "label", "funded", "trades")])
    table = KeyedTable(spark, shared_dir(spark), "wallet", fields, parts=8)
    for batch in range(4):
        table.upsert(changes.filter(F.col("b") == batch).drop("b"), batch, ["trades"], ["funded"], ["label"])
    return table.read().withColumn("funded", F.coalesce("funded", F.lit(-1.0)))


@query(
    "profile_update_by_key",
    f"""with recursive {CUSTOMER_MEMBERS}, sized as (select node, component,
        count(*) over (partition by component) as size from members)
    select c_custkey as wallet, coalesce(component, -1) as cluster_id, coalesce(size, 0) as cluster_size, c_name as label
    from customer left join (select * from sized where size >= 2) on node = c_custkey""",
)
def profile_update_by_key(spark, folder):
    """Cluster ids and sizes written back to wallet profiles; unknown wallets change nothing."""
    members, _ = materialize(customer_members(spark, folder))
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).filter("size >= 2")
    changes = members.join(sizes, "component").select(
        F.col("node").alias("wallet"),
        F.col("component").alias("cluster_id"),
        F.col("size").alias("cluster_size"),
    )
    stray = changes.withColumn("wallet", F.col("wallet") + 1_000_000_000)
    profiles = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("wallet"),
        F.lit(-1).cast("bigint").alias("cluster_id"),
        F.lit(0).cast("bigint").alias("cluster_size"),
        F.col("c_name").alias("label"),
    )
    table = KeyedTable(spark, shared_dir(spark), "wallet", profiles.schema, parts=8)
    table.upsert(profiles, 0, ["cluster_id", "cluster_size"], keep=["label"])
    table.update(changes.unionByName(stray), 1, ["cluster_id", "cluster_size"])
    return table.read()


@query(
    "metadata_fallback",
    f"""with {V.ALERTS}, one as (select 'm' || c_custkey as mint, case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1
        then c_name end as name, case when c_custkey % 4 = 0 then 'X' || c_custkey end as symbol from customer),
    two as (select 'm' || c_custkey as mint, c_mktsegment as name, 'Y' || c_nationkey as symbol from customer)
    select alert_id, mint, coalesce(nullif(o.name, ''), t.name) as token_name,
      coalesce(a.token_symbol, o.symbol, t.symbol) as token_symbol
    from alerts a left join one o using (mint) left join two t using (mint)""",
)
def metadata_fallback(spark, folder):
    """Name and symbol from the alert, else the first source, else the second."""
    alerts = V.alerts(spark, folder).select("alert_id", "mint", "token_symbol")
    customers = read_table(spark, folder, "customer")
    key = F.col("c_custkey")
    mint = V.text("m", "c_custkey").alias("mint")
    one = customers.select(
        mint,
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.col("c_name")).alias("token_name"),
        F.when(key % 4 == 0, V.text("X", "c_custkey")).alias("token_symbol"),
    )
    two = customers.select(
        mint,
        F.col("c_mktsegment").alias("token_name"),
        V.text("Y", "c_nationkey").alias("token_symbol"),
    )
    return first_known(alerts, [one, two], "mint", ["token_name", "token_symbol"]).select(
        "alert_id", "mint", "token_name", "token_symbol"
    )


@query(
    "price_source_fallback",
    f"""with {V.PRICES}, pairs_price as (select 'm' || l_partkey as mint, max(l_extendedprice) as p from lineitem
        where l_returnflag = 'R' group by all)
    select mint, coalesce(market_cap_usd, p, -1.0::double) as price,
      case when market_cap_usd is not null then 'first' when p is not null then 'second' else '-' end as source
    from prices left join pairs_price using (mint)""",
)
def price_source_fallback(spark, folder):
    """Price of the first source that knows the token, with the source's name."""
    first = V.prices(spark, folder)
    second = (
        read_table(spark, folder, "lineitem")
        .filter("l_returnflag = 'R'")
        .groupBy(V.text("m", "l_partkey").alias("mint"))
        .agg(F.max("l_extendedprice").alias("price"))
    )
    out = first_source(
        first.select("mint"),
        [("first", first.select("mint", F.col("market_cap_usd").alias("price"))), ("second", second)],
        "mint",
        "price",
    )
    return out.select(
        "mint",
        F.coalesce("price", F.lit(-1.0)).alias("price"),
        F.coalesce("source", F.lit("-")).alias("source"),
    )


# --- text ----------------------------------------------------------------------------------


def _scaled_sql(v: str, prefix: str = "") -> str:
    p = f"'{prefix}' || " if prefix else ""
    return (
        f"case when {v} is null then 'N/A' when {v} >= 1e6 then {p}{fixed_sql(f'{v} / 1e6', 1)} || 'M' "
        f"when {v} >= 1e3 then {p}{fixed_sql(f'{v} / 1e3', 1)} || 'K' else {p}{fixed_sql(v, 2)} end"
    )


@query(
    "format_units",
    f"""with v as (select c_custkey, c_acctbal as b, case when c_acctbal > 0 then c_acctbal * 321 end as u,
        c_acctbal / 1000e0 as g, abs(c_acctbal) / 8e0 as r, abs(c_acctbal) * 37e0 as s from customer)
    select c_custkey, {_scaled_sql('b')} as sol, {_scaled_sql('u', '$')} as usd,
      case when g >= 0 then '+' else '' end || {fixed_sql('g * 100', 0)} || '%' as gain,
      case when r > 1000 then 'ALL BUYS (no sells)' when r > 100 then {fixed_sql('r', 0)} || 'x (almost no sells)'
        when r > 10 then {fixed_sql('r', 0)} || 'x' else {fixed_sql('r', 1)} || 'x' end as ratio,
      case when r * 200 >= 1e6 then '$' || {fixed_sql('r * 200e0 / 1e6', 1)} || 'M'
        when r * 200 >= 1e3 then '$' || {fixed_sql('r * 200e0 / 1e3', 0)} || 'K' else '$' || {fixed_sql('r * 200e0', 0)} end as mcap,
      case when s < 60 then {fixed_sql('s', 0)} || 's' when s < 3600 then {fixed_sql('s / 60', 0)} || 'm'
        when s < 86400 then {fixed_sql('s / 3600', 1)} || 'h' else {fixed_sql('s / 86400', 1)} || 'd' end as duration
    from v""",
)
def format_units(spark, folder):
    """Numbers as report text."""
    balance = F.col("c_acctbal")
    ratio = F.abs(balance) / F.lit(8.0)
    return read_table(spark, folder, "customer").select(
        "c_custkey",
        sol_text(balance).alias("sol"),
        usd_text(F.when(balance > 0, balance * 321)).alias("usd"),
        gain_text(balance / F.lit(1000.0)).alias("gain"),
        ratio_text(ratio).alias("ratio"),
        mcap_text(ratio).alias("mcap"),
        duration_text(F.abs(balance) * F.lit(37.0)).alias("duration"),
    )


@query(
    "parse_report_date",
    """select o_orderkey, case o_orderkey % 6 when 3 then '2001-08-02' when 4 then '2001-08-01' when 5 then '-'
    else strftime(case when o_orderkey % 6 = 2 and day(o_orderdate) <= 12
        then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) else o_orderdate::date end, '%Y-%m-%d') end as day
    from orders""",
)
def parse_report_date(spark, folder):
    """Dates in three formats and two words; a day-first date that also reads month-first does so."""
    orders = read_table(spark, folder, "orders")
    kind, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(kind == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 3, "Today")
        .when(kind == 4, "yesterday")
        .otherwise("soon")
    )
    parsed = report_date(text, F.lit("2001-08-02").cast("date"))
    return orders.select(
        "o_orderkey", F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit("-")).alias("day")
    )


