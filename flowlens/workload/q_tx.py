"""Sources, balance changes and trade inference over transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.constants import PROGRAMS, USDC, WSOL
from flowlens.functions import balances as B
from flowlens.functions import swaps as SW
from flowlens.operators import trades as T
from flowlens.operators.merge import first_per_key, insert_ignore, retained
from flowlens.operators.programs import occurrence_notice, program_labels, unknown_programs
from flowlens.session import materialize, shared_dir
from flowlens.sources import tables as TB
from flowlens.workload import views as V
from flowlens.workload.registry import query

DAY = V.DAY
QUARTER = 90 * DAY


def deltas(spark, folder, mixed=False, suppliers=False, programs=True):
    return T.delta_records(V.tx(spark, folder, mixed, suppliers, programs))


# --- sources and logs ----------------------------------------------------------------------

_KNOWN_SQL = ", ".join(f"'{p}'" for p in V.KNOWN_PROGRAMS)


@query(
    "tx_subscription_filter",
    f"""with {V.PROGRAM_USES} select 't' || o_orderkey as signature from orders
    where o_orderkey % 11 <> 0 and o_orderstatus <> 'P'
      and o_orderkey in (select slot from uses where program_id in ({_KNOWN_SQL}))""",
)
def tx_subscription_filter(spark, folder):
    """Votes and failed transactions out, watched programs in."""
    tx = V.tx(spark, folder).withColumns(
        {
            "is_vote": F.col("slot") % 11 == 0,
            "failed": F.col("o_orderstatus") == "P",
            "account_keys": F.concat("account_keys", "programs_invoked"),
        }
    )
    return T.subscribed(tx, V.KNOWN_PROGRAMS).select("signature")


@query(
    "tx_normalize",
    f"""select o_orderkey as slot,
    case o_orderkey % 5 when 0 then 'id:M' || o_orderkey when 1 then 'id:M' || o_orderkey
      when 2 then 'id:M' || o_orderkey else 'T' || o_orderkey end as signature,
    case when o_orderkey % 4 = 0 then {V.NOW_ORDERS} else epoch_us(o_orderdate) // 1000000 end as block_time,
    'c' || o_custkey as fee_payer from orders""",
)
def tx_normalize(spark, folder):
    """Broken signatures, times and fee payers put right."""
    tx = V.tx(spark, folder)
    key = F.col("slot")
    broken = tx.withColumns(
        {
            "signature": F.when(key % 5 == 0, "")
            .when(key % 5 == 1, " Unknown ")
            .when(key % 5 == 2, "ERROR")
            .otherwise(F.concat(F.lit("  T"), key.cast("string"), F.lit(" "))),
            "block_time": F.when(key % 4 != 0, F.col("block_time")),
            "fee_payer": F.when(key % 3 != 0, F.col("fee_payer")).otherwise(F.lit("")),
            "message_id": F.concat(F.lit("M"), key.cast("string")),
        }
    )
    out = T.normalized(broken, now=V.NOW_ORDERS, message_id="message_id")
    return out.select("slot", "signature", "block_time", "fee_payer")


@query(
    "accounts_concat",
    """select o_orderkey as slot, 'c' || o_custkey
    || case when o_orderkey % 2 = 1 then ',w' || o_orderkey || ',w' || o_custkey else '' end
    || case when o_orderkey % 3 = 0 then ',r' || o_custkey else '' end as accounts from orders""",
)
def accounts_concat(spark, folder):
    orders = TB.read_table(spark, folder, "orders")
    w = F.array(V.text("w", "o_orderkey"), V.text("w", "o_custkey"))
    accounts = B.all_accounts(
        F.array(V.text("c", "o_custkey")),
        F.when(F.col("o_orderkey") % 2 == 1, w),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(V.text("r", "o_custkey"))),
    )
    return orders.select(
        F.col("o_orderkey").alias("slot"), F.array_join(accounts, ",").alias("accounts")
    )


def mint_events(spark, folder):
    trades = V.swaps(spark, folder)
    touched = F.array_compact(F.array("base_mint", F.nullif("quote_mint", F.lit("WSOL"))))
    return trades.select(
        "signature",
        "slot",
        "block_time",
        F.col("user_wallet").alias("fee_payer"),
        touched.alias("mints_touched"),
        F.array("venue").alias("programs_invoked"),
    )


@query(
    "mint_event_log",
    f"""with {V.SWAPS} select strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') as day,
    count(*) as events, sum(case when quote_mint = 'WSOL' then 1 else 2 end)::bigint as mints
    from swaps group by all""",
)
def mint_event_log(spark, folder):
    """Write the mint log by day and read it back."""
    path = shared_dir(spark)
    TB.append_mint_log(mint_events(spark, folder), path)
    log = spark.read.parquet(path)
    return log.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("events"), F.sum(F.size("mints_touched")).alias("mints")
    )


@query(
    "mint_event_read_day",
    f"""with {V.SWAPS} select signature, slot, user_wallet as fee_payer from swaps
    where strftime(make_timestamp(block_time * 1000000), '%Y-%m-%d') = '2024-01-15' and base_mint = 'm3'""",
)
def mint_event_read_day(spark, folder):
    path = shared_dir(spark)
    TB.append_mint_log(mint_events(spark, folder), path)
    return TB.read_mint_day(spark, path, "2024-01-15", "m3").select("signature", "slot", "fee_payer")


TOKEN_DELTAS = """deltas as (
  select signature, o_orderkey, payer, owner, mint, sum(delta)::bigint as delta
  from lines group by all having sum(delta) <> 0)"""


@query(
    "delta_log",
    f"""with {V.LINES}, {TOKEN_DELTAS}, n as (
      select o_orderkey, count(*) as n from deltas group by all)
    select epoch_us(o_orderdate) // 1000000 // {QUARTER} * {QUARTER} as bucket, count(*) as records,
      coalesce(sum(n), 0)::bigint as changes
    from orders left join n using (o_orderkey) group by all""",
)
def delta_log(spark, folder):
    """Write balance changes by time bucket and read them back."""
    path = shared_dir(spark)
    TB.append_delta_log(deltas(spark, folder), path, QUARTER)
    log = spark.read.parquet(path)
    return log.groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(
        F.count("*").alias("records"), F.sum(F.size("token_deltas")).alias("changes")
    )


@query(
    "retention_drop",
    f"""with {V.SWAPS} select block_time // 300 * 300 as bucket, count(*) as records from swaps
    where (block_time // {DAY} + 1) * {DAY} >= {V.NOW_EVENTS - 10 * DAY} group by all""",
)
def retention_drop(spark, folder):
    """Write a log by day, drop the days beyond ten, and read back what is left."""
    path = shared_dir(spark)
    TB.append_delta_log(V.swaps(spark, folder).select("signature", "block_time"), path)
    TB.drop_expired(spark, path, V.NOW_EVENTS, 10 * DAY)
    return spark.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("records"))


@query(
    "delta_read_for_mint",
    f"""with {V.LINES}, {TOKEN_DELTAS} select signature, o_orderkey as slot from deltas
    join orders using (o_orderkey) where mint = 'p42'
      and epoch_us(o_orderdate) // 1000000 between {V.NOW_ORDERS - 1500 * DAY} and {V.NOW_ORDERS}""",
)
def delta_read_for_mint(spark, folder):
    """One mint's records of a time, from the log files that the mint index names."""
    path, index = shared_dir(spark), shared_dir(spark)
    TB.append_delta_log(deltas(spark, folder), path, QUARTER)
    TB.index_delta_log(spark, path, index)
    return TB.read_indexed_deltas(
        spark, path, index, "p42", V.NOW_ORDERS, 1500 * DAY, QUARTER
    ).select("signature", "slot")


@query(
    "retention_keep",
    f"""with {V.SWAPS} select signature, block_time from swaps
    where (block_time // 300 + 1) * 300 >= {V.NOW_EVENTS - 10 * DAY}""",
)
def retention_keep(spark, folder):
    trades = V.swaps(spark, folder)
    return retained(trades, "block_time", V.NOW_EVENTS, 10 * DAY, 300).select(
        "signature", "block_time"
    )


@query(
    "swap_insert_ignore",
    """select l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000000 as shipped, l_partkey, l_suppkey,
      l_extendedprice, l_quantity from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')
    qualify row_number() over (partition by l_orderkey, l_linenumber
      order by l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1""",
)
def swap_insert_ignore(spark, folder):
    """New rows, first per key, whose key the target does not hold yet."""
    rows = TB.read_table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        V.epoch_seconds(F.col("l_shipdate")).alias("shipped"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
    )
    stored = TB.read_table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    held = rows.join(stored.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    order = [
        F.asc(c) for c in ("shipped", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    ]
    keys = ["l_orderkey", "l_linenumber"]
    target = first_per_key(held, keys, order)
    return insert_ignore(target, rows, keys, order)


# --- balance changes -----------------------------------------------------------------------


@query(
    "token_deltas",
    f"with {V.LINES}, {TOKEN_DELTAS} select signature, owner, mint, delta from deltas",
)
def token_deltas(spark, folder):
    out = deltas(spark, folder, programs=False).select("signature", F.explode("token_deltas").alias("d"))
    return out.select("signature", "d.owner", "d.mint", F.col("d.delta").cast("bigint").alias("delta"))


@query(
    "sol_deltas",
    f"""with {V.LINES}, suppliers as (select distinct signature, l_suppkey as s from lines)
    select signature, account, delta from (
      select signature, payer as account, sum(sol)::bigint as delta from lines group by all
      union all
      select signature, 's' || s, case s % 5 when 0 then 0 when 1 then 5000000 - 2039280 else 10 * s end
      from suppliers)
    where delta <> 0""",
)
def sol_deltas(spark, folder):
    out = deltas(spark, folder, suppliers=True, programs=False).select("signature", F.explode("sol_deltas").alias("d"))
    return out.select("signature", "d.account", F.col("d.delta").cast("bigint").alias("delta"))


MIXED_DELTAS = f"{V.MIXED_LINES}, {TOKEN_DELTAS}"
MERGED = f"""raw_sol as (
    select signature, payer as account, sum(sol)::bigint as delta from lines group by all
    having sum(sol) <> 0),
  merged as (select signature, account, sum(delta)::bigint as delta from (
    select * from raw_sol union all
    select signature, owner, delta from deltas where mint = '{WSOL}') group by all)"""


@query("wsol_merge", f"with {MIXED_DELTAS}, {MERGED} select * from merged")
def wsol_merge(spark, folder):
    merged = B.merge_wsol(F.col("token_deltas"), F.col("sol_deltas"))
    out = deltas(spark, folder, mixed=True, programs=False).select("signature", F.explode(merged).alias("d"))
    return out.select("signature", "d.account", F.col("d.delta").cast("bigint").alias("delta"))


@query(
    "candidate_users",
    f"""with {MIXED_DELTAS} select signature, owner as user_wallet from deltas
    union select 't' || o_orderkey, 'c' || o_custkey from orders""",
)
def candidate_users(spark, folder):
    users = B.candidate_users(F.col("token_deltas"), F.col("fee_payer"))
    return deltas(spark, folder, mixed=True, programs=False).select(
        "signature", F.explode(users).alias("user_wallet")
    )


@query(
    "mints_touched",
    f"with {MIXED_DELTAS} select distinct signature, mint from deltas where mint <> '{WSOL}'",
)
def mints_touched(spark, folder):
    return deltas(spark, folder, mixed=True, programs=False).select(
        "signature", F.explode("mints_touched").alias("mint")
    )


@query(
    "program_ids",
    """select distinct 't' || l_orderkey as signature, unnest([p_brand, p_type]) as program_id
    from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey""",
)
def program_ids(spark, folder):
    ids = B.program_ids(F.col("inner_programs"), F.col("programs_invoked"), F.array(F.lit("")))
    return V.tx(spark, folder).select("signature", F.explode(ids).alias("program_id"))


@query(
    "delta_record",
    f"""with {MIXED_DELTAS}, {MERGED}, t as (select signature, count(*) as token_changes,
      count(distinct mint) filter (mint <> '{WSOL}') as mints from deltas group by all)
    select 't' || o_orderkey as signature, o_orderkey as slot, epoch_us(o_orderdate) // 1000000 as block_time,
      coalesce(token_changes, 0) as token_changes, (r.signature is not null)::int as sol_changes,
      coalesce(mints, 0) as mints, 5000::bigint as tx_fee
    from orders left join t on t.signature = 't' || o_orderkey
      left join raw_sol r on r.signature = 't' || o_orderkey""",
)
def delta_record(spark, folder):
    return deltas(spark, folder, mixed=True, programs=False).select(
        "signature",
        "slot",
        "block_time",
        F.size("token_deltas").cast("bigint").alias("token_changes"),
        F.size("sol_deltas").alias("sol_changes"),
        F.size("mints_touched").cast("bigint").alias("mints"),
        "tx_fee",
    )


# --- trades --------------------------------------------------------------------------------

# All trades any user of a transaction may have made, with confidence in tenths.
_QUOTES = f"('{WSOL}', '{USDC}')"
CANDIDATES = f"""people as (
    select signature, o_orderkey, payer, owner as u from deltas
    union select 't' || o_orderkey, o_orderkey, 'c' || o_custkey, 'c' || o_custkey from orders
      where o_orderkey in (select o_orderkey from deltas)),
  own as (select signature, owner as u, mint, delta from deltas where mint <> '{WSOL}'),
  legs as (
    select signature, u, mint, delta, mint in {_QUOTES} as quote from own
    union all select signature, account, '{WSOL}', delta, true from merged),
  sides as (select 'buy' as side, 1 as sign union all select 'sell', -1),
  sums as (
    select l.signature, l.u, side, count(*) filter (not quote) as n_base, count(*) filter (quote) as n_quote,
      arg_min(mint, (-abs(delta), mint)) filter (not quote) as base_mint,
      max(abs(delta)) filter (not quote) as base_amount,
      arg_min(mint, (-abs(delta), mint)) filter (quote) as quote_mint,
      max(abs(delta)) filter (quote) as quote_amount
    from legs l, sides where delta * sign * case when quote then -1 else 1 end > 0
    group by all having n_base > 0 and n_quote > 0),
  owned as (select signature, u, count(*) as n from own group by all),
  candidates as (
    select p.signature, p.o_orderkey as slot, p.u as user_wallet, side, base_mint, base_amount, quote_mint,
      quote_amount, p.u = p.payer as is_payer,
      10 - case when n_base > 1 then 2 else 0 end - case when n_quote > 1 then 1 else 0 end
        - case when abs(r.delta) = 2039280 then 1 else 0 end - case when n > 3 then 1 else 0 end as tenths
    from people p join sums s on s.signature = p.signature and s.u = p.u
      join owned o on o.signature = p.signature and o.u = p.u
      left join raw_sol r on r.signature = p.signature and r.account = p.u)"""
MIXED_TRADES = f"{MIXED_DELTAS}, {MERGED}, {CANDIDATES}"
BEST = """best as (select * from candidates where tenths >= 7
  qualify row_number() over (partition by signature
    order by tenths desc, is_payer desc, side, user_wallet) = 1)"""


def trade_columns(frame, prefix=""):
    return [
        F.col(f"{prefix}user_wallet").alias("user_wallet"),
        F.col(f"{prefix}side").alias("side"),
        F.col(f"{prefix}base_mint").alias("base_mint"),
        F.col(f"{prefix}base_amount").cast("bigint").alias("base_amount"),
        F.col(f"{prefix}quote_mint").alias("quote_mint"),
        F.col(f"{prefix}quote_amount").cast("bigint").alias("quote_amount"),
    ]


@query(
    "swap_candidates",
    f"""with {MIXED_TRADES} select signature, user_wallet, side, base_mint, base_amount, quote_mint,
    quote_amount from candidates""",
)
def swap_candidates(spark, folder):
    """Every trade each user may have made."""
    out = T.trades_considered(deltas(spark, folder, mixed=True, programs=False)).select(
        "signature", F.explode("trades").alias("t")
    )
    return out.select("signature", *trade_columns(out, "t."))


@query(
    "swap_confidence",
    f"""with {MIXED_TRADES} select side, tenths::bigint as tenths, count(*) as n from candidates group by all""",
)
def swap_confidence(spark, folder):
    out = T.trades_considered(deltas(spark, folder, mixed=True, programs=False)).select(F.explode("trades").alias("t"))
    return (
        out.select("t.side", (-F.col("t.minus_tenths")).cast("bigint").alias("tenths"))
        .groupBy("side", "tenths")
        .agg(F.count("*").alias("n"))
    )


SIMPLE_TRADES = f"{V.LINES}, {TOKEN_DELTAS}, {MERGED}, {CANDIDATES}, {BEST}"


@query(
    "swap_inference",
    f"""with {SIMPLE_TRADES} select signature, slot, user_wallet, side, base_mint, base_amount,
    quote_mint, quote_amount, tenths / 10.0::double as confidence from best""",
)
def swap_inference(spark, folder):
    """The trade of each transaction, confidence at least 0.7."""
    out = T.infer_trades(deltas(spark, folder, programs=False))
    return out.select("signature", "slot", *trade_columns(out), "confidence")


@query(
    "swap_inference_mixed",
    f"""with {MIXED_TRADES}, {BEST} select signature, slot, user_wallet, side, base_mint, base_amount,
    quote_mint, quote_amount, tenths / 10.0::double as confidence,
    case when quote_mint = '{WSOL}' then quote_amount else 0 end as quote_lamports from best""",
)
def swap_inference_mixed(spark, folder):
    """As ``swap_inference`` with several owners, wrapped SOL and dollar legs."""
    out = T.infer_trades(deltas(spark, folder, mixed=True, programs=False))
    return out.select(
        "signature",
        "slot",
        *trade_columns(out),
        "confidence",
        F.col("quote_lamports").cast("bigint").alias("quote_lamports"),
    )


# Brands 1 to 9 stand for the nine trading programs.
_PROGRAM_SQL = " ".join(f"when 'Brand#{i}' then '{v}'" for i, (_, v) in enumerate(PROGRAMS.values(), 1))


def real_programs(column):
    table = []
    for i, program in enumerate(PROGRAMS, 1):
        table += [F.lit(f"Brand#{i}"), F.lit(program)]
    known = F.create_map(*table)
    return F.transform(column, lambda p: F.coalesce(F.try_element_at(known, p), p))


@query(
    "venue",
    f"""with {V.PROGRAM_USES}, named as (
      select signature, case program_id {_PROGRAM_SQL} end as venue from uses)
    select 't' || o_orderkey as signature, coalesce(min(venue), 'unknown') as venue,
      greatest(1, count(venue))::bigint as route_depth
    from orders left join named on signature = 't' || o_orderkey group by all""",
)
def venue(spark, folder):
    programs = real_programs(F.col("programs_invoked"))
    return V.tx(spark, folder).select(
        "signature",
        SW.venue(programs).alias("venue"),
        SW.route_depth(programs).cast("bigint").alias("route_depth"),
    )


@query(
    "mcap_at_swap",
    f"""with {SIMPLE_TRADES}, supply as (
      select 'p' || p_partkey as mint, case when p_type <> 'SMALL' then p_size::bigint * 1000000000 end as supply,
        p_size % 10 as decimals from part)
    select signature, base_mint,
      case when quote_mint = '{WSOL}' then ((quote_amount::double / 1e9) / base_amount::double) * supply::double end
        as mcap_at_swap,
      case when quote_mint = '{WSOL}' and supply is not null then ((quote_amount::double / 1e9) / base_amount::double)
        * pow(10.0::double, decimals) end as price_sol
    from best left join supply on mint = base_mint""",
)
def mcap_at_swap(spark, folder):
    supply = (
        TB.read_table(spark, folder, "part")
        .select(
            V.text("p", "p_partkey").alias("base_mint"),
            F.when(
                F.col("p_type") != "SMALL", F.col("p_size").cast("bigint") * F.lit(10**9)
            ).alias("supply"),
            (F.col("p_size") % 10).alias("decimals"),
        )
    )
    out = T.with_mcap(T.infer_trades(deltas(spark, folder, programs=False)), supply)
    return out.select("signature", "base_mint", "mcap_at_swap", "price_sol")


BACKFILL = f"""hot_mints as (select 'p' || p_partkey as mint from part where p_size >= 45)"""


SUPPLY = """supply as (
  select 'p' || p_partkey as mint, case when p_type <> 'SMALL' then p_size::bigint * 1000000000 end as supply from part)"""
BACKFILLED = f"""select signature, slot, venue, user_wallet, side, base_mint as mint, base_amount, quote_mint, quote_amount,
    case when quote_mint = '{WSOL}' then ((quote_amount::double / 1e9) / base_amount::double) * supply::double end as mcap_at_swap
    from (select *, 'unknown' as venue from best) left join supply on mint = base_mint
    where base_mint in (select mint from hot_mints)"""


def part_supply(spark, folder):
    return TB.read_table(spark, folder, "part").select(
        V.text("p", "p_partkey").alias("base_mint"),
        F.when(F.col("p_type") != "SMALL", F.col("p_size").cast("bigint") * F.lit(10**9)).alias("supply"),
        (F.col("p_size") % 10).alias("decimals"),
    )


def hot_parts(spark, folder):
    hot = TB.read_table(spark, folder, "part").filter("p_size >= 45")
    return hot.select(V.text("p", "p_partkey").alias("mint"))


def backfill_columns(found):
    return found.select(
        "signature",
        "slot",
        "venue",
        "user_wallet",
        "side",
        F.col("base_mint").alias("mint"),
        F.col("base_amount").cast("bigint").alias("base_amount"),
        "quote_mint",
        F.col("quote_amount").cast("bigint").alias("quote_amount"),
        "mcap_at_swap",
    )


@query(
    "hot_backfill",
    f"""with {MIXED_TRADES}, {BEST}, {BACKFILL}, {SUPPLY} {BACKFILLED} and slot % 3 <> 0""",
)
def hot_backfill(spark, folder):
    """Trades of newly hot mints found again in stored balance changes, but for those stored already."""
    changes, _ = materialize(deltas(spark, folder, mixed=True))  # read three times below
    stored = T.infer_trades(changes.filter(F.col("slot") % 3 == 0)).select("signature", "base_mint")
    return backfill_columns(T.backfill_missing(changes, hot_parts(spark, folder), part_supply(spark, folder), stored))


# --- programs ------------------------------------------------------------------------------

_UNKNOWN = f"program_id not in ({_KNOWN_SQL})"
_TX_USES = f"""{V.PROGRAM_USES}, tx_uses as (
  select uses.* from uses join orders on o_orderkey = slot)"""


@query(
    "unknown_programs",
    f"""with {_TX_USES}, c as (
      select program_id, count(*) as occurrences, min(slot) as first_slot from tx_uses
      where {_UNKNOWN} group by all),
    b as (select u.program_id, string_agg(distinct k.program_id, ',' order by k.program_id) as co_occurring
      from tx_uses u join tx_uses k on k.signature = u.signature
      where u.{_UNKNOWN} and k.program_id in ({_KNOWN_SQL}) group by all)
    select c.*, coalesce(co_occurring, '') as co_occurring from c left join b using (program_id)""",
)
def unknown_program_counts(spark, folder):
    out = unknown_programs(V.tx(spark, folder), V.KNOWN_PROGRAMS)
    return out.withColumn("co_occurring", F.array_join("co_occurring", ","))


@query(
    "unknown_program_notice",
    f"""with {_TX_USES} select program_id, slot, signature from tx_uses where {_UNKNOWN}
    qualify row_number() over (partition by program_id order by slot, signature) = 100""",
)
def unknown_program_notice(spark, folder):
    out = occurrence_notice(V.tx(spark, folder), V.KNOWN_PROGRAMS, 100)
    return out.select("program_id", "slot", "signature")


@query(
    "program_label",
    f"""with {_TX_USES} select case when p_id in ({_KNOWN_SQL}) then 'known ' || p_id
      else (p_id || '-rest')[1:8] end as label, count(*) as n
    from (select program_id as p_id from tx_uses) group by all""",
)
def program_label(spark, folder):
    """Configured name of a program, else the first eight characters of its id."""
    uses = V.tx(spark, folder).select(F.explode("programs_invoked").alias("p"))
    known = F.col("p").isin(*V.KNOWN_PROGRAMS)
    ids = uses.select(
        F.when(known, F.col("p")).otherwise(F.concat("p", F.lit("-rest"))).alias("program_id")
    )
    brands = TB.read_table(spark, folder, "part").select("p_brand").distinct()
    names = brands.filter(F.col("p_brand").isin(*V.KNOWN_PROGRAMS)).select(
        F.col("p_brand").alias("program_id"), F.concat(F.lit("known "), "p_brand").alias("name")
    )
    return program_labels(ids, names).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "profile_lookup",
    """select c_custkey, c_name, c_mktsegment from customer where c_custkey = 42""",
)
def profile_lookup(spark, folder):
    """One profile by key; the key reaches the file scan."""
    return (
        TB.read_table(spark, folder, "customer")
        .filter("c_custkey = 42")
        .select("c_custkey", "c_name", "c_mktsegment")
    )


