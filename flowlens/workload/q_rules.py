"""Rules, cool-down and token state over daily and weekly statistics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

import flowlens
from flowlens.functions.text import finite_ratio
from flowlens.operators import rules as RU
from flowlens.operators.metrics import fire_rate as fired_share
from flowlens.operators.state import cooled_down, state_at, state_changes
from flowlens.plans import reports as R
from flowlens.plans.detection import gated_hits, stats_pair
from flowlens.sources.rules import FIELDS, load_rules, parsed_condition, rule_errors
from flowlens.session import materialize, shared_dir
from flowlens.sources.tables import read_table
from flowlens.streaming import jobs as J
from flowlens.streaming.progress import ProgressLog, read_progress, worker_state
from flowlens.workload import views as V
from flowlens.workload.q_stats import MCAPS, PAIR, mcap_quotes
from flowlens.workload.registry import query

DAY = V.DAY
RULES = load_rules(Path(flowlens.__file__).parent / "rules" / "daily.yaml")

# The daily rules as SQL over ``pair``.
RULE_SQL = {
    "concentrated_accumulation": "buy_count_5m >= 5 and unique_buyers_5m <= 4",
    "stealth_accumulation": "buy_volume_sol_5m >= 200 and avg_buy_size_5m < 70 and buy_count_5m >= 3",
    "extreme_ratio": "buy_sell_ratio_5m > 2 and buy_volume_sol_5m >= 100 and buy_count_5m >= 3"
    " and unique_buyers_5m >= 3",
    "whale_concentration": "top_3_buyers_volume_share_5m >= 4e-1 and buy_volume_sol_5m >= 100"
    " and buy_count_5m >= 2",
    "slow_stealth_accumulation": "buy_volume_sol_1h >= 1000 and unique_buyers_1h <= 12"
    " and avg_buy_size_1h < 90",
    "slow_concentration": "top_3_buyers_volume_share_1h >= 1e-1 and buy_count_1h >= 100"
    " and buy_volume_sol_1h >= 2000",
}
HITS = f"""{PAIR}, hits as (select * from (select *, case
  {" ".join(f"when {test} then '{name}'" for name, test in RULE_SQL.items())} end as trigger_name
  from pair) where trigger_name is not null)"""


def number_sql(column: str) -> str:
    return (
        f"case when isinf({column}::double) then 'inf' "
        f"else (round((case when isinf({column}::double) then 0 else {column} end)::decimal(38, 9), 2)"
        f"::decimal(38, 2))::varchar end"
    )


def reason_sql() -> str:
    whens = []
    for rule in RULES:
        parts = [f"'Trigger: {rule.name}'"]
        for c in rule.conditions:
            parts.append(f"' | {c.field}=' || {number_sql(c.field)} || ' ({c.op} {c.value})'")
        whens.append(f"when '{rule.name}' then {' || '.join(parts)}")
    return f"case trigger_name {' '.join(whens)} end"


def pair(spark, folder):
    return stats_pair(V.swaps(spark, folder), V.SHORT, V.LONG)


# Conditions as text, good and bad ones, made from the events.
_CONDITIONS = f"""conditions as (
  select event_id, k, ['{"', '".join(FIELDS)}', 'no_such_field'][1 + k % {len(FIELDS) + 1}] as f,
    ['>=', '<=', '==', '>', '<', '!='][1 + user_id::int % 6] as o,
    case when event_id % 13 = 0 then 'many' else value::varchar end as v
  from (select *, json_extract(props, '$.k')::int as k from events)),
  texts as (select event_id, case when event_id % 17 = 0 then f || ' ' || o || ' ' || v || ' ' || o || ' 1'
    else f || ' ' || o || ' ' || v end as text, f, o, v from conditions)"""


def conditions(spark, folder):
    trades = V.swaps(spark, folder)
    values = read_table(spark, folder, "events").select("event_id", "value")
    rows = trades.join(values, trades.slot == values.event_id)
    fields = F.array(*[F.lit(f) for f in (*FIELDS, "no_such_field")])
    ops = F.array(*[F.lit(o) for o in (">=", "<=", "==", ">", "<", "!=")])
    field = F.element_at(fields, (F.col("k") % (len(FIELDS) + 1) + 1).cast("int"))
    op = F.element_at(ops, (F.col("user_id") % 6 + 1).cast("int"))
    number = F.when(F.col("event_id") % 13 == 0, "many").otherwise(F.col("value").cast("string"))
    text = F.concat_ws(" ", field, op, number)
    return rows.select(
        "event_id",
        F.when(F.col("event_id") % 17 == 0, F.concat_ws(" ", text, op, F.lit("1")))
        .otherwise(text)
        .alias("text"),
    )


@query(
    "rule_parse",
    f"""with {_CONDITIONS}, good as (select *, event_id % 17 <> 0 and v <> 'many' and o <> '!=' as ok from texts)
    select event_id, coalesce(case when ok then f end, '-') as field, coalesce(case when ok then o end, '-') as op,
      coalesce(case when ok then v::double end, -1.0::double) as value from good""",
)
def rule_parse(spark, folder):
    """Conditions taken apart; malformed ones give no parts."""
    parts = parsed_condition(F.col("text"))
    return conditions(spark, folder).select(
        "event_id",
        F.coalesce(parts["field"], F.lit("-")).alias("field"),
        F.coalesce(parts["op"], F.lit("-")).alias("op"),
        F.coalesce(parts["value"], F.lit(-1.0)).alias("value"),
    )


_PROBLEM = """case when o = '!=' then 'invalid operator' when event_id % 17 = 0 then 'invalid format'
  when f = 'no_such_field' then 'unknown field ' || f when v = 'many' then 'invalid value' end"""


@query(
    "rule_validate",
    f"""with {_CONDITIONS}, rules as (
      select event_id as rule_id, 'r' || (event_id // 2 + case when event_id % 10 = 1 then 0 else event_id % 2 * 1000000 end)
        as name, *, event_id % 19 = 0 as bare from texts)
    select min(rule_id) as rule_id, name, 'duplicate name' as problem from rules group by name having count(*) > 1
    union all select rule_id, name, 'no conditions' from rules where bare
    union all select rule_id, name, {_PROBLEM} from rules where not bare and {_PROBLEM} is not null""",
)
def rule_validate(spark, folder):
    """All problems of a table of rules."""
    rows = conditions(spark, folder)
    key = F.col("event_id")
    number = F.floor(key / 2) + F.when(key % 10 == 1, 0).otherwise(key % 2 * 1000000)
    rules = rows.select(
        key.alias("rule_id"),
        F.concat(F.lit("r"), number.cast("string")).alias("name"),
        F.when(key % 19 == 0, F.array().cast("array<string>"))
        .otherwise(F.array("text"))
        .alias("conditions"),
    )
    return rule_errors(rules)


@query(
    "trigger_eval",
    f"""with {PAIR} select mint, win_end, {", ".join(f"({t}) as {n}" for n, t in RULE_SQL.items())} from pair""",
)
def trigger_eval(spark, folder):
    """Every rule on every token window."""
    return RU.evaluate(pair(spark, folder), RULES).select(
        "mint", "win_end", *[r.name for r in RULES]
    )


@query(
    "trigger_first_match",
    f"""with {HITS} select mint, win_end, trigger_name, buy_count_5m, unique_buyers_5m, buy_volume_sol_5m,
    case when isinf(buy_sell_ratio_5m) then 999.0 else buy_sell_ratio_5m end as buy_sell_ratio_5m from hits""",
)
def trigger_first_match(spark, folder):
    """The first rule that fires per token and day."""
    hits = RU.first_match(pair(spark, folder), RULES, with_reason=False)
    return hits.select(
        "mint",
        "win_end",
        "trigger_name",
        "buy_count_5m",
        "unique_buyers_5m",
        "buy_volume_sol_5m",
        finite_ratio(F.col("buy_sell_ratio_5m")).alias("buy_sell_ratio_5m"),
    )


@query(
    "trigger_reason",
    f"with {HITS} select mint, win_end, trigger_name, {reason_sql()} as trigger_reason from hits",
)
def trigger_reason(spark, folder):
    return RU.first_match(pair(spark, folder), RULES).select(
        "mint", "win_end", "trigger_name", "trigger_reason"
    )


# The last cap before each hit; a mint without a recent quote has none.
CAPS_AS_OF = f"""{MCAPS}, caps as (select h.mint, h.win_end, m.mcap as mcap_sol
  from (select mint, win_end from matched) h join mcaps m on m.base_mint = h.mint
    and m.block_time < h.win_end and m.block_time >= h.win_end - 1 - {3 * DAY}
  qualify row_number() over (partition by h.mint, h.win_end order by m.block_time desc, m.slot desc) = 1)"""
MATCHED = HITS.replace("hits as (", "matched as (", 1)
GATED_HITS = f"""{MATCHED}, {CAPS_AS_OF},
  hits as (select m.*, mcap_sol from matched m left join caps using (mint, win_end)
    where mcap_sol is null or mcap_sol = 0 or mcap_sol >= 500)"""


def cap_quotes(trades):
    return mcap_quotes(trades).select(
        F.col("base_mint").alias("mint"), "block_time", "slot", F.col("mcap").alias("mcap_sol")
    )


@query(
    "trigger_mcap_gate",
    f"""with {GATED_HITS} select mint, win_end, trigger_name, coalesce(mcap_sol, 0.0::double) as mcap_sol from hits""",
)
def trigger_mcap_gate(spark, folder):
    """Hits whose market cap, as known at the hit, is large enough or unknown."""
    trades = V.swaps(spark, folder)
    hits = RU.first_match(stats_pair(trades, V.SHORT, V.LONG), RULES)
    passed = gated_hits(hits, cap_quotes(trades), 500, max_age=3 * DAY)
    return passed.select(
        "mint", "win_end", "trigger_name", F.coalesce("mcap_sol", F.lit(0.0)).alias("mcap_sol")
    )


COOLED = f"""cooled as (
    select mint, min(win_end) as win_end from hits group by mint
    union all
    select n.mint, n.win_end from cooled c, lateral (
      select mint, min(win_end) as win_end from hits h
      where h.mint = c.mint and h.win_end >= c.win_end + {3 * DAY} group by mint) n)"""


@query(
    "alert_cooldown",
    f"with recursive {HITS}, {COOLED} select h.mint, h.win_end, h.trigger_name from hits h join cooled using (mint, win_end)",
)
def alert_cooldown(spark, folder):
    """Hits that raise an alert when a token stays silent for three days after one."""
    hits = RU.first_match(pair(spark, folder), RULES, with_reason=False)
    return cooled_down(hits, 3 * DAY).select("mint", "win_end", "trigger_name")


STATES = f"""{HITS}, {COOLED},
  hot as (select mint, win_end as changed_at from cooled),
  acts as (select mint, win_end as t, coalesce((select max(changed_at + {3 * DAY}) from hot h
    where h.mint = s.mint and h.changed_at + {3 * DAY} <= s.win_end), -1) as e from stats s),
  changes as (select mint, changed_at, 'hot' as state from hot
    union all select mint, changed_at + {3 * DAY}, 'cold' from hot
    union all select mint, min(t), 'warm' from acts group by mint, e)"""


def changes(spark, folder):
    stats = pair(spark, folder)
    hits = RU.first_match(stats, RULES, with_reason=False)
    return state_changes(stats.select("mint", "win_end"), hits, 3 * DAY)


@query("token_state", f"with recursive {STATES} select * from changes")
def token_state(spark, folder):
    """State changes of every token."""
    return changes(spark, folder).select("mint", "changed_at", "state")


@query(
    "state_counts",
    f"""with recursive {STATES}, last as (select mint, state from changes where changed_at <= {V.NOW_EVENTS}
      qualify row_number() over (partition by mint
        order by changed_at desc, case state when 'hot' then 2 when 'warm' then 1 else 0 end desc) = 1)
    select state, count(*) as tokens from last group by all""",
)
def state_counts(spark, folder):
    states = state_at(changes(spark, folder), V.NOW_EVENTS)
    return states.groupBy("state").agg(F.count("*").alias("tokens"))


_VIEW_NOW = V.NOW_EVENTS - 10 * DAY
_ALERTS_NOW = V.NOW_ORDERS - 1000 * DAY


@query(
    "live_view",
    f"""with recursive {STATES}, {V.ALERTS}, last as (select mint, changed_at, state from changes where changed_at <= {_VIEW_NOW}
      qualify row_number() over (partition by mint order by changed_at desc,
        case state when 'hot' then 1 else 0 end desc, state desc) = 1),
    entries as (select 'swap' as kind, signature as id, base_mint as mint, block_time as seen_at,
        case when quote_mint = 'WSOL' and quote_amount > 0 then (quote_amount::double / 1e9) / base_amount::double * 1000000.0::double end as cap
        from swaps where block_time between {_VIEW_NOW - 300} and {_VIEW_NOW}
      union all select 'alert', alert_id::varchar, mint, created_at, case when mcap_sol <> 0 then mcap_sol end from alerts
        where created_at > {_ALERTS_NOW - 3600} and created_at <= {_ALERTS_NOW}
      union all select 'hot', mint, mint, changed_at, null from last where state = 'hot')
    select kind, row_number() over (partition by kind order by seen_at desc, id desc)::int as place, id, mint, seen_at,
      coalesce(cap, -1.0::double) as mcap_sol
    from entries qualify place <= 20""",
)
def live_view(spark, folder):
    """Trades of the last five minutes, alerts of the last hour and hot tokens at one time."""
    trades, alerts = V.swaps(spark, folder), V.alerts(spark, folder)
    price = (F.col("quote_amount").cast("double") / 1e9) / F.col("base_amount").cast("double")
    capped = trades.withColumn("mcap_at_swap", F.when(F.col("quote_mint") == "WSOL", price * F.lit(1000000.0)))
    found = R.live_view(capped, alerts, changes(spark, folder), _VIEW_NOW, _ALERTS_NOW)
    return found.withColumn("mcap_sol", F.coalesce("mcap_sol", F.lit(-1.0)))


@query(
    "fire_rate",
    f"""with {HITS} select (select count(*) from pair) as evaluations, count(*) as triggers_fired,
    coalesce(count(*)::double / nullif((select count(*) from pair), 0)::double * 100, 0.0::double) as fire_rate_pct from hits""",
)
def fire_rate(spark, folder):
    """Share of evaluated tokens and windows at which a rule fired."""
    stats, _ = materialize(pair(spark, folder))
    return fired_share(stats, RU.first_match(stats, RULES, with_reason=False))


_SNAP = V.NOW_EVENTS - DAY


@query(
    "live_snapshot",
    f"""with recursive {STATES}, {V.ALERTS}, last as (select mint, state from changes where changed_at <= {_SNAP}
      qualify row_number() over (partition by mint
        order by changed_at desc, case state when 'hot' then 2 when 'warm' then 1 else 0 end desc) = 1),
    done as (select * from swaps where block_time <= {_SNAP}), newest as (select * from done where block_time > {_SNAP} - 3600),
    figures as (select greatest((select count(*) from newest), (select count(*) from done)) as swaps_detected,
      (select count(*) from newest) as swaps_last_hour, (select count(*) from newest) / 3600e0 as tx_per_second,
      (select count(*) from last where state = 'hot') as hot_tokens,
      (select count(*) from alerts where created_at >= {V.NOW_ORDERS - 30 * DAY}) as alerts_today,
      (select count(*) from swaps where block_time > {_SNAP}) as backlog,
      coalesce({_SNAP} - (select max(block_time) from done), 0) as processing_lag)
    select *, case when processing_lag > 30 or backlog > 80000 then 'critical'
      when processing_lag > 5 or backlog > 50000 then 'degraded' else 'normal' end as mode from figures""",
)
def live_snapshot(spark, folder):
    """What a live page shows while a stream over the trades is a day behind its source."""
    trades, path, out = V.swaps(spark, folder), shared_dir(spark), shared_dir(spark)
    source = shared_dir(spark)
    trades.filter(F.col("block_time") <= _SNAP).write.parquet(source)
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        stream = J.event_time(J.file_stream(spark, source, trades.schema, max_files=4))
        J.run_available(stream, J.write_versions(out), mode="append", name="trades", log=log)
    finally:
        spark.streams.removeListener(log)
    # The rest of the source arrives; no batch has read it.
    waiting = trades.filter(F.col("block_time") > _SNAP)
    states = state_at(changes(spark, folder), _SNAP)
    worker = worker_state(read_progress(spark, path))
    return R.live_snapshot(trades, V.alerts(spark, folder), states, worker, waiting, _SNAP, V.NOW_ORDERS - 30 * DAY)
