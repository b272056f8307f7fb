"""Reports over alerts, prices and progress figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.columns import epoch_seconds
from flowlens.operators import metrics as ME
from flowlens.operators import trades as T
from flowlens.plans import backtest as BT
from flowlens.plans import reports as R
from flowlens.sources.tables import read_table
from flowlens.workload import views as V
from flowlens.workload.q_tx import SIMPLE_TRADES, deltas
from flowlens.workload.registry import query

DAY_SECONDS = V.DAY

DAY = V.DAY
_DAY_SQL = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d')"
DAY_OF = _DAY_SQL.format("created_at")

# --- backtest ------------------------------------------------------------------------------

RESULTS = f"""{V.ALERTS}, {V.PRICES},
  gains as (select a.*, p.market_cap_usd as current_mcap_usd, p.symbol as price_symbol,
      (p.market_cap_usd - mcap_sol) / mcap_sol * 100 as gain_pct from alerts a left join prices p using (mint)),
  results as (select *, case when gain_pct > 0 then 'winner' when gain_pct <= 0 then 'loser' else 'dead' end as status,
      market_cap_usd is not null as has_price, coalesce(price_symbol, token_symbol, '-') as symbol,
      round(({V.NOW_ORDERS} - created_at) / 3600e0, 1) as age_hours
    from (select *, current_mcap_usd as market_cap_usd from gains))"""
_FIGURES = """count(*) as alerts, count(gain_pct) as with_price_data,
  count(*) filter (gain_pct > 0)::double / count(gain_pct)::double as win_rate,
  ((sum(round(gain_pct * 1e9)::hugeint))::hugeint::double / 1e9) / count(gain_pct)::double as avg_gain_pct,
  max(gain_pct) as best_gain_pct, min(gain_pct) as worst_gain_pct"""


def results(spark, folder):
    return BT.results(V.alerts(spark, folder), V.prices(spark, folder), V.NOW_ORDERS, sol_usd=1.0)


@query(
    "backtest_results",
    f"""with {RESULTS} select alert_id, mint, symbol, trigger_name, gain_pct, status, has_price, age_hours
    from results order by status = 'dead', gain_pct desc nulls last, alert_id""",
)
def backtest_results(spark, folder):
    """Every alert against its current price: dead last, best gain first."""
    found = results(spark, folder).orderBy(*BT.report_order())
    return found.select(
        "alert_id",
        "mint",
        F.coalesce("shown_symbol", F.lit("-")).alias("symbol"),
        "trigger_name",
        "gain_pct",
        "status",
        "has_price",
        "age_hours",
    )


@query(
    "backtest_by_trigger",
    f"with {RESULTS} select trigger_name, {_FIGURES} from results group by trigger_name",
)
def backtest_by_trigger(spark, folder):
    """Performance of each rule."""
    return BT.by_trigger(results(spark, folder))


@query(
    "backtest_summary",
    f"""with {RESULTS} select {_FIGURES}, count(*) filter (status = 'dead') as dead,
    arg_max(symbol, (gain_pct, -alert_id)) filter (gain_pct is not null) as best_symbol,
    arg_min(symbol, (gain_pct, alert_id)) filter (gain_pct is not null) as worst_symbol from results""",
)
def backtest_summary(spark, folder):
    return BT.summary(results(spark, folder))


@query(
    "backtest_view",
    f"""with {RESULTS} select alert_id, status, gain_pct, age_hours from results where status = 'loser'
    order by gain_pct desc, alert_id limit 100""",
)
def backtest_view(spark, folder):
    """First hundred losers by gain."""
    return BT.view(results(spark, folder), "loser").select(
        "alert_id", "status", "gain_pct", "age_hours"
    )


@query(
    "backtest_view_by_age",
    f"""with {RESULTS} select alert_id, status, age_hours from results order by age_hours, alert_id limit 100""",
)
def backtest_view_by_age(spark, folder):
    return BT.view(results(spark, folder), by="age").select("alert_id", "status", "age_hours")


def _cli_sql(where: str = "", tail: str = "") -> str:
    return f"""with {V.ALERTS}, {V.PRICES}, newest as (select * from alerts where mcap_sol > 0 {where} {tail}),
    g as (select trigger_name, (market_cap_usd - mcap_sol) / mcap_sol * 100 as gain_pct from newest left join prices using (mint))
    select trigger_name, count(*) as alerts, count(*) filter (gain_pct > 0) as wins, count(*) filter (gain_pct <= 0) as losses,
      ((sum(round(gain_pct * 1e9)::hugeint))::hugeint::double / 1e9) / count(gain_pct)::double / 100 as avg_gain
    from g group by all"""


def _cli(spark, folder, **kept):
    return BT.by_trigger_fraction(V.alerts(spark, folder), V.prices(spark, folder), V.NOW_ORDERS, 1.0, **kept)


@query("backtest_cli", _cli_sql())
def backtest_cli(spark, folder):
    """Command-line form over all alerts, gains as fractions."""
    return _cli(spark, folder)


@query("backtest_cli_days", _cli_sql(f"and created_at >= {V.NOW_ORDERS - 365 * DAY_SECONDS}"))
def backtest_cli_days(spark, folder):
    """The alerts of the last year only."""
    return _cli(spark, folder, days=365)


@query("backtest_cli_limited", _cli_sql(tail="order by created_at desc, alert_id desc limit 5000"))
def backtest_cli_limited(spark, folder):
    """The newest five thousand alerts only: the limit is the feature here."""
    return _cli(spark, folder, limit=5000)


# --- alert reports -------------------------------------------------------------------------

BY_DATE = f"""{V.ALERTS}, by_date as (select {DAY_OF} as day, count(*) as alert_count,
  count(distinct mint) as unique_tokens from alerts group by all)"""


@query("alerts_by_date", f"with {BY_DATE} select * from by_date")
def alerts_by_date(spark, folder):
    return R.alerts_by_date(V.alerts(spark, folder))


@query(
    "calendar_heat",
    f"""with {BY_DATE} select day, alert_count, case when alert_count > 50 then 4 when alert_count > 20 then 3
    when alert_count > 10 then 2 when alert_count > 0 then 1 else 0 end as heat from by_date""",
)
def calendar_heat(spark, folder):
    by_date = R.alerts_by_date(V.alerts(spark, folder))
    return by_date.select("day", "alert_count", R.heat_level(F.col("alert_count")).alias("heat"))


@query(
    "calendar_totals",
    f"""with {BY_DATE} select sum(alert_count)::bigint as total_alerts, sum(unique_tokens)::bigint as total_tokens,
    count(*) as active_days from by_date""",
)
def calendar_totals(spark, folder):
    return R.calendar_totals(R.alerts_by_date(V.alerts(spark, folder)))


@query(
    "alerts_daily_span",
    f"""with {V.ALERTS} select {DAY_OF} as day, count(*) as total, count(distinct trigger_name) as triggers,
    min(created_at) as first_at, max(created_at) as last_at, (max(created_at) - min(created_at)) / 3600e0 as span_hours
    from alerts group by all""",
)
def alerts_daily_span(spark, folder):
    return R.alerts_daily_span(V.alerts(spark, folder))


@query(
    "triggers_by_date",
    f"with {V.ALERTS} select {DAY_OF} as day, trigger_name, count(*) as n from alerts group by all",
)
def triggers_by_date(spark, folder):
    return R.triggers_by_date(V.alerts(spark, folder))


@query(
    "alert_gaps",
    f"""with {V.ALERTS}, l as (select created_at, lead(created_at) over (order by created_at, alert_id) as nxt from alerts)
    select created_at as gap_start, nxt as gap_end, (nxt - created_at) / 3600e0 as gap_hours from l
    where nxt - created_at > 3600""",
)
def alert_gaps(spark, folder):
    """Pauses of more than an hour between alerts."""
    return R.alert_gaps(V.alerts(spark, folder))


@query(
    "alerts_top_per_date",
    f"""with {V.ALERTS} select {DAY_OF} as day, alert_id, mint, created_at,
    row_number() over (partition by day order by created_at desc, alert_id desc)::int as "rank" from alerts qualify "rank" <= 5""",
)
def alerts_top_per_date(spark, folder):
    return R.alerts_top_per_date(V.alerts(spark, folder), 5).select(
        "day", "alert_id", "mint", "created_at", "rank"
    )


@query(
    "alerts_page",
    f"""with {V.ALERTS} select alert_id, mint, created_at, (select count(*) from alerts) as total,
    token_image is not null as has_image from alerts order by created_at desc, alert_id desc limit 20 offset 40""",
)
def alerts_page(spark, folder):
    return R.alerts_page(V.alerts(spark, folder), limit=20, offset=40).select(
        "alert_id", "mint", "created_at", "total", "has_image"
    )


_FROM, _TO = 946684800, 978307200  # the year 2000


@query(
    "daily_report",
    f"""with {V.ALERTS}, day_alerts as (select * from alerts where created_at >= {_FROM} and created_at < {_TO})
    select trigger_name, count(*) as n, (select count(*) from day_alerts) as total_alerts,
      (select count(distinct mint) from day_alerts) as unique_tokens,
      (select (sum(round(mcap_sol * 100)::bigint)::bigint::double / 100) / count(mcap_sol)::double from day_alerts) as avg_alert_mcap
    from day_alerts group by all""",
)
def daily_report(spark, folder):
    """Alerts of a period by rule with the period's totals."""
    return R.daily_report(V.alerts(spark, folder), _FROM, _TO)


@query(
    "best_pair",
    f"""with {V.PAIRS} select mint, chain, liquidity_usd, price_usd, pair_id from pairs
    qualify row_number() over (partition by mint order by (chain = 'solana')::int desc, liquidity_usd desc, pair_id, l_suppkey) = 1""",
)
def best_pair(spark, folder):
    return R.best_pair(V.pairs(spark, folder)).select(
        "mint", "chain", "liquidity_usd", "price_usd", "pair_id"
    )


_LIVE_NOW = V.NOW_EVENTS - DAY


@query(
    "live_counts",
    f"""with {V.SWAPS}, {V.ALERTS} select count(*) as swaps_last_hour, count(*) / 3600e0 as tx_per_second,
    {_LIVE_NOW} - max(block_time) as processing_lag,
    (select count(*) from alerts where created_at >= {V.NOW_ORDERS - 30 * DAY}) as alerts_today
    from swaps where block_time > {_LIVE_NOW} - 3600 and block_time <= {_LIVE_NOW}""",
)
def live_counts(spark, folder):
    return R.live_counts(
        V.swaps(spark, folder), V.alerts(spark, folder), _LIVE_NOW, V.NOW_ORDERS - 30 * DAY
    )


# --- figures -------------------------------------------------------------------------------

_BOUNDS = (*ME.LATENCY_BOUNDS, 50.0, 100.0, 500.0)


@query(
    "latency_histogram",
    f"""with b as (select unnest([{", ".join(map(str, _BOUNDS))}, 'inf'::double]) as bound)
    select case when isinf(bound) then '+Inf' else bound::varchar end as le,
      (select count(*) from events where value <= bound) as cumulative,
      (select sum(round(value * 1e9)::bigint)::bigint::double / 1e9 from events) as sum, (select count(*) from events) as count
    from b""",
)
def latency_histogram(spark, folder):
    """Cumulative histogram of event values."""
    return ME.histogram(read_table(spark, folder, "events"), "value", _BOUNDS)


@query(
    "batch_timing",
    f"""with {V.SWAPS} select block_time // 3600 as batch, count(*) as n,
    (max(block_time) - min(block_time)) / count(*)::double as seconds_per_tx from swaps group by all""",
)
def batch_timing(spark, folder):
    """Seconds per trade of hourly batches."""
    trades = V.swaps(spark, folder)
    span = F.max("block_time") - F.min("block_time")
    return trades.groupBy(F.floor(F.col("block_time") / 3600).alias("batch")).agg(
        F.count("*").alias("n"), ME.rate(span, F.count("*")).alias("seconds_per_tx")
    )


@query(
    "pipeline_rates",
    f"""with {SIMPLE_TRADES} select (select count(*) from orders) as processed, count(*) as swaps_found,
    (select count(*)::double / (max(epoch_us(o_orderdate) // 1000000) - min(epoch_us(o_orderdate) // 1000000))::double from orders) as tx_per_second,
    (select count(*)::double / (select count(*) from orders)::double * 100 from orders
      where o_orderkey not in (select l_orderkey from lineitem)) as error_rate_pct,
    count(*)::double / (select count(*) from orders)::double * 100 as detection_rate_pct,
    (sum(tenths)::bigint::double / count(*)::double) / 10 as avg_confidence,
    (select count(*)::double / (select count(*) from lineitem)::double * 100 from (
      select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having n > 1)) as dup_keys_pct from best""",
)
def pipeline_rates(spark, folder):
    """Throughput, errors (transactions without a balance), detection rate, confidence, repeated keys."""
    found = (
        T.infer_trades(deltas(spark, folder, programs=False))
        .agg(F.struct(F.count("*").alias("n"), F.sum("confidence_tenths").alias("tenths")))
        .scalar()
    )
    keys = read_table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").count()
    lines = keys.agg(
        F.struct(F.count_if(F.col("count") > 1).alias("dups"), F.sum("count").alias("n"))
    ).scalar()
    orders = read_table(spark, folder, "orders")
    seconds = epoch_seconds(F.col("o_orderdate"))
    known = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    marked = orders.join(known.withColumn("known", F.lit(True)), "o_orderkey", "left")
    counted = marked.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("known").isNull()).alias("errors"),
        (F.max(seconds) - F.min(seconds)).alias("span"),
    )
    return counted.select(
        "processed",
        ME.rate(F.col("processed"), F.col("span")).alias("tx_per_second"),
        ME.rate(F.col("errors"), F.col("processed"), 100.0).alias("error_rate_pct"),
        found["n"].alias("swaps_found"),
        ME.rate(found["n"], F.col("processed"), 100.0).alias("detection_rate_pct"),
        (ME.rate(found["tenths"], found["n"]) / 10).alias("avg_confidence"),
        ME.rate(lines["dups"], lines["n"], 100.0).alias("dup_keys_pct"),
    )


# Progress per day and mint: backlog = trades, lag = largest number of tenths of the values.
_DAY_PROGRESS = f"""progress as (select base_mint as mint, block_time // {DAY} as day, count(*) as backlog,
  max(quote_amount) // 10000000000 as lag from swaps group by all)"""
_MODE = "case when lag > 30 or backlog > 45 then 'critical' when lag > 20 or backlog > 35 then 'degraded' else 'normal' end"


def progress(spark, folder):
    trades = V.swaps(spark, folder)
    rows = trades.groupBy(
        F.col("base_mint").alias("mint"), F.floor(F.col("block_time") / DAY).alias("day")
    )
    return rows.agg(
        F.count("*").alias("backlog"),
        F.floor(F.max("quote_amount") / 10_000_000_000).alias("lag"),
    )


@query(
    "mode_timeline",
    f"""with {V.SWAPS}, {_DAY_PROGRESS}, m as (select *, {_MODE} as mode from progress)
    select mint, day, mode, coalesce(mode <> lag(mode) over (partition by mint order by day), false) as changed,
      mode = 'normal' as store_swaps, mode <> 'critical' as enrich, mode = 'normal' as parse_full from m""",
)
def mode_timeline(spark, folder):
    """Working mode per day and where it changes."""
    mode = ME.mode(F.col("lag"), F.col("backlog"), (20, 35), (30, 45))
    rows = ME.with_transitions(progress(spark, folder).withColumn("mode", mode), "mint", "day")
    return rows.select(
        "mint",
        "day",
        "mode",
        "changed",
        *[c.alias(n) for n, c in ME.allowed(F.col("mode")).items()],
    )


@query(
    "health_issues",
    f"""with {V.SWAPS}, {_DAY_PROGRESS} select mint, day, array_to_string(list_filter([
      case when lag > 25 then 'High processing lag: ' || lag || 's' end,
      case when backlog > 35 then 'Large stream backlog: ' || backlog end,
      case when backlog < 30 then 'Low throughput: ' || (round(backlog::decimal(38, 9) , 1)::decimal(38, 1))::varchar || ' tx/s' end
    ], lambda x: x is not null), '; ') as issues,
    case when backlog < 25 then 'unhealthy' when lag < 20 then 'healthy' else 'degraded' end as status from progress""",
)
def health_issues(spark, folder):
    lag, backlog = F.col("lag"), F.col("backlog")
    issues = ME.health_issues(lag, backlog, F.lit(61), backlog, (25, 35, 60, 30))
    return progress(spark, folder).select(
        "mint",
        "day",
        F.array_join(issues, "; ").alias("issues"),
        ME.health_status(backlog >= 25, lag, 20).alias("status"),
    )


@query(
    "safe_double",
    """with texts as (select event_id, case when event_id % 13 = 0 then 'many' when event_id % 17 = 0 then ''
      when event_id % 19 = 0 then value::int::varchar || '.' || event_id else (event_id % 1000)::varchar end as text from events)
    select event_id, coalesce(try_cast(text as double), -1.0::double) as number from texts""",
)
def safe_double(spark, folder):
    """Numbers read from texts of which some are none."""
    from flowlens.functions.text import safe_double as read

    key = F.col("event_id")
    text = (
        F.when(key % 13 == 0, "many").when(key % 17 == 0, "")
        .when(key % 19 == 0, F.concat(F.rint("value").cast("int").cast("string"), F.lit("."), key.cast("string")))
        .otherwise((key % 1000).cast("string"))
    )
    events = read_table(spark, folder, "events")
    return events.select("event_id", F.coalesce(read(text), F.lit(-1.0)).alias("number"))
