"""The driver's tables seen as transactions, trades, alerts, prices and funding edges.

Each view has a Spark form and a SQL form (a CTE body). They follow FIXTURES.md part B.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.constants import USDC, WSOL
from flowlens.functions.columns import epoch_seconds
from flowlens.operators.lookups import PLANNED_SHARE, lookup_join, planned_bytes, shuffled
from flowlens.sources.tables import read_table

DAY = 86_400
NOW_EVENTS = 1_706_659_200  # 2024-01-31
NOW_ORDERS = 996_710_400  # 2001-08-02
KNOWN_PROGRAMS = tuple(f"Brand#{i}" for i in range(1, 6))
SHORT, LONG = DAY, 7 * DAY


def text(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# --- trades --------------------------------------------------------------------------------

SWAPS = """swaps as (
  select 'e' || event_id as signature, event_id as slot,
    epoch_us(ts) // 1000000 as block_time, event_type as venue, 'u' || user_id as user_wallet,
    case when event_type in ('error', 'view') then 'sell' else 'buy' end as side,
    'm' || (k % 10) as base_mint, ((k + 1) * 1000)::bigint as base_amount,
    case when k % 7 = 0 then 'USDC' else 'WSOL' end as quote_mint,
    round(value * 1e9)::bigint as quote_amount, user_id, k
  from (select *, json_extract(props, '$.k')::int as k from events))"""


def swaps(spark: SparkSession, folder: str) -> DataFrame:
    return swaps_of(read_table(spark, folder, "events"))


def swaps_of(events: DataFrame) -> DataFrame:
    """Trades from an ``events`` table or stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.withColumn("k", k).select(
        text("e", "event_id").alias("signature"),
        F.col("event_id").alias("slot"),
        epoch_seconds(F.col("ts")).alias("block_time"),
        F.col("event_type").alias("venue"),
        text("u", "user_id").alias("user_wallet"),
        F.when(F.col("event_type").isin("error", "view"), "sell").otherwise("buy").alias("side"),
        F.concat(F.lit("m"), (F.col("k") % 10).cast("string")).alias("base_mint"),
        ((F.col("k") + 1) * 1000).cast("bigint").alias("base_amount"),
        F.when(F.col("k") % 7 == 0, "USDC").otherwise("WSOL").alias("quote_mint"),
        F.round(F.col("value") * 1e9).cast("bigint").alias("quote_amount"),
        "user_id",
        "k",
    )


# --- transactions --------------------------------------------------------------------------

# One row per line of an order, with the parties and amounts of the transaction view.
LINES = """lines as (
  select o_orderkey, 't' || o_orderkey as signature, 'c' || o_custkey as payer,
    'c' || o_custkey as owner, 'p' || l_partkey as mint,
    case when l_returnflag = 'R' then -1 else 1 end * l_quantity::bigint * 1000 as delta,
    case when l_returnflag = 'R' then 1 else -1 end * round(l_extendedprice * 100)::bigint as sol,
    l_suppkey, l_partkey, l_linenumber
  from orders join lineitem on l_orderkey = o_orderkey)"""

# The same with other owners and quote tokens mixed in.
MIXED_LINES = f"""lines as (
  select o_orderkey, 't' || o_orderkey as signature, 'c' || o_custkey as payer,
    case when l_linenumber % 3 = 0 then 's' || l_suppkey else 'c' || o_custkey end as owner,
    case when l_partkey % 10 = 0 then '{WSOL}' when l_partkey % 10 = 1 then '{USDC}'
      else 'p' || l_partkey end as mint,
    case when l_returnflag = 'R' then -1 else 1 end * l_quantity::bigint * 1000 as delta,
    case when l_returnflag = 'R' then 1 else -1 end * round(l_extendedprice * 100)::bigint as sol,
    l_suppkey, l_partkey, l_linenumber
  from orders join lineitem on l_orderkey = o_orderkey)"""


def tx(
    spark: SparkSession, folder: str, mixed: bool = False, suppliers: bool = False, programs: bool = True
) -> DataFrame:
    """Each order with its lines as one transaction.

    ``mixed`` adds suppliers as owners and quote tokens as mints; ``suppliers`` adds the supplier
    accounts, some of them new. Without ``programs`` no program is listed, for what looks at none: Spark does not
    drop the lookup by itself. Grouping is by order, whose lines are few by nature.
    """
    orders = read_table(spark, folder, "orders")
    lines = read_table(spark, folder, "lineitem")
    parts = read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"
    )
    returned = F.col("l_returnflag") == "R"
    units = F.col("l_quantity").cast("bigint") * 1000
    zero = F.lit(0).cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    mint = text("p", "l_partkey")
    other_owner = F.lit(False)
    if mixed:
        mint = (
            F.when(F.col("l_partkey") % 10 == 0, WSOL)
            .when(F.col("l_partkey") % 10 == 1, USDC)
            .otherwise(mint)
        )
        other_owner = F.col("l_linenumber") % 3 == 0
    balance = F.struct(
        F.when(other_owner, text("s", "l_suppkey")).alias("owner"),
        mint.alias("mint"),
        F.when(returned, units).otherwise(zero).alias("pre"),
        F.when(returned, zero).otherwise(units).alias("post"),
    )
    invoked = {"programs": "p_brand", "types": "p_type"} if programs else {}
    lines = lookup_join(lines, parts, ["l_partkey"], "left") if programs else lines
    grouped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(balance).alias("b"),
        F.sum(F.when(returned, cents).otherwise(-cents)).alias("sol"),
        *[F.array_sort(F.collect_set(c)).alias(name) for name, c in invoked.items()],
        F.array_sort(F.collect_set("l_suppkey")).alias("supp"),
    )
    # Orders are flat and narrow beside their collected lines, which are not sorted once more where orders can be hashed.
    joined = shuffled(orders, planned_bytes(orders) * PLANNED_SHARE).join(grouped, "o_orderkey", "left")
    payer = text("c", "o_custkey")

    def balances(side: str):
        return F.transform(
            F.coalesce("b", F.array()),
            lambda b: F.struct(
                F.coalesce(b["owner"], payer).alias("owner"),
                b["mint"].alias("mint"),
                b[side].cast("decimal(20,0)").alias("amount"),
            ),
        )

    keys, pre, post = F.array(payer), F.array(F.lit(10**12)), None
    post = F.array(F.lit(10**12) + F.coalesce("sol", F.lit(0)) - 5000)
    if suppliers:
        supp = F.coalesce("supp", F.array().cast("array<bigint>"))
        keys = F.concat(keys, F.transform(supp, lambda s: F.concat(F.lit("s"), s.cast("string"))))
        pre = F.concat(
            pre, F.transform(supp, lambda s: F.when(s % 5 < 2, zero).otherwise(F.lit(1000)))
        )
        post = F.concat(
            post,
            F.transform(
                supp,
                lambda s: F.when(s % 5 == 0, F.lit(2039280))
                .when(s % 5 == 1, F.lit(5_000_000))
                .otherwise(1000 + 10 * s)
                .cast("bigint"),
            ),
        )
    nothing = F.array().cast("array<string>")
    return joined.select(
        text("t", "o_orderkey").alias("signature"),
        F.col("o_orderkey").alias("slot"),
        epoch_seconds(F.col("o_orderdate")).alias("block_time"),
        payer.alias("fee_payer"),
        keys.alias("account_keys"),
        balances("pre").alias("pre_token_balances"),
        balances("post").alias("post_token_balances"),
        pre.cast("array<bigint>").alias("pre_balances"),
        post.cast("array<bigint>").alias("post_balances"),
        F.lit(5000).cast("bigint").alias("fee"),
        (F.coalesce("programs", nothing) if programs else nothing).alias("programs_invoked"),
        F.lit(False).alias("is_vote"),
        F.lit(False).alias("failed"),
        (F.coalesce("types", nothing) if programs else nothing).alias("inner_programs"),
        "o_orderstatus",
    )


PROGRAM_USES = """uses as (
  select distinct 't' || l_orderkey as signature, l_orderkey as slot, p_brand as program_id
  from lineitem join part on p_partkey = l_partkey)"""


# --- alerts and prices ---------------------------------------------------------------------

ALERTS = """alerts as (
  select o_orderkey as alert_id, 'm' || o_custkey as mint, o_orderpriority as trigger_name,
    o_totalprice as mcap_sol,
    case when o_orderstatus <> 'P' then 'S' || (o_custkey % 50) end as token_symbol,
    epoch_us(o_orderdate) // 1000000 + (o_orderkey % 1440) * 60 as created_at,
    case when o_orderkey % 3 = 0 then 'i' || o_orderkey end as token_image
  from orders)"""

PRICES = """prices as (
  select 'm' || c_custkey as mint, case when c_acctbal > 0 then c_acctbal * 50 end as market_cap_usd,
    c_name as symbol, c_mktsegment as source
  from customer)"""


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("alert_id"),
        text("m", "o_custkey").alias("mint"),
        F.col("o_orderpriority").alias("trigger_name"),
        F.col("o_totalprice").alias("mcap_sol"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")),
        ).alias("token_symbol"),
        (epoch_seconds(F.col("o_orderdate")) + F.col("o_orderkey") % 1440 * 60).alias("created_at"),
        F.when(F.col("o_orderkey") % 3 == 0, text("i", "o_orderkey")).alias("token_image"),
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select(
        text("m", "c_custkey").alias("mint"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 50).alias("market_cap_usd"),
        F.col("c_name").alias("symbol"),
        F.col("c_mktsegment").alias("source"),
    )


# --- funding -------------------------------------------------------------------------------

CUSTOMER_EDGES = """edges as (
  select c_custkey as wallet, c_custkey // 7 as funder from customer
  where c_custkey % 3 <> 0 and c_custkey // 7 in (select c_custkey from customer))"""

# Component of every node by walking outwards from the least node.
def components_sql(nodes: str, edges: str) -> str:
    return f"""node_links as (select wallet as a, funder as b from {edges}
    union select funder, wallet from {edges}),
  reach as (select node as a, node as root from {nodes}
    union select l.b, r.root from reach r join node_links l on l.a = r.a where r.root < l.b),
  members as (select a as node, min(root) as component from reach group by a)"""


def customer_edges(spark: SparkSession, folder: str) -> DataFrame:
    keys = read_table(spark, folder, "customer").select("c_custkey")
    funder = F.floor(F.col("c_custkey") / 7).cast("bigint")
    edges = keys.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("wallet"), funder.alias("funder"))
    known = keys.select(F.col("c_custkey").alias("funder")).hint("merge")
    return edges.join(known, "funder", "left_semi").select(
        "wallet", "funder"
    )


TRANSFERS = """transfers as (
  select 'c' || o_custkey as wallet, 's' || l_suppkey as funder,
    epoch_us(l_shipdate) // 1000000 as block_time, l_orderkey as slot, l_linenumber as idx
  from lineitem join orders on o_orderkey = l_orderkey)"""


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        text("c", "o_custkey").alias("wallet"),
        text("s", "l_suppkey").alias("funder"),
        epoch_seconds(F.col("l_shipdate")).alias("block_time"),
        F.col("l_orderkey").alias("slot"),
        F.col("l_linenumber").alias("idx"),
    )


# Transfers between the users of the trades.
USER_TRANSFERS = """user_transfers as (
  select user_wallet as wallet,
    'u' || (case when k % 2 = 0 then user_id // 7 else (user_id + k) // 11 end) as funder,
    block_time, slot from swaps)"""

USER_EDGES = """users as (select distinct user_wallet as node, user_id from swaps),
  user_edges as (select 'u' || user_id as wallet, 'u' || (user_id // 7) as funder from users
    where user_id % 3 <> 0 and 'u' || (user_id // 7) in (select node from users))"""


def user_transfers(trades: DataFrame) -> DataFrame:
    user, k = F.col("user_id"), F.col("k")
    other = F.when(k % 2 == 0, F.floor(user / 7)).otherwise(F.floor((user + k) / 11))
    return trades.select(
        F.col("user_wallet").alias("wallet"),
        F.concat(F.lit("u"), other.cast("bigint").cast("string")).alias("funder"),
        "block_time",
        "slot",
    )


def users(trades: DataFrame) -> DataFrame:
    return trades.select(F.col("user_wallet").alias("node"), "user_id").distinct()


def user_edges(trades: DataFrame) -> DataFrame:
    known = users(trades)
    funder = F.concat(F.lit("u"), F.floor(F.col("user_id") / 7).cast("bigint").cast("string"))
    edges = known.filter("user_id % 3 <> 0").select(F.col("node").alias("wallet"), funder.alias("funder"))
    return edges.join(known.select(F.col("node").alias("funder")), "funder", "left_semi").select(
        "wallet", "funder"
    )


# --- markets -------------------------------------------------------------------------------

PAIRS = """pairs as (
  select 'm' || l_partkey as mint, case when l_linestatus = 'F' and l_partkey % 10 <> 0 then 'solana' else 'other' end as chain,
    l_extendedprice as liquidity_usd, l_quantity as price_usd,
    l_orderkey * 10000 + l_linenumber as pair_id, l_suppkey
  from lineitem)"""


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem")
    main = (F.col("l_linestatus") == "F") & (F.col("l_partkey") % 10 != 0)
    return lines.select(
        text("m", "l_partkey").alias("mint"),
        F.when(main, "solana").otherwise("other").alias("chain"),
        F.col("l_extendedprice").alias("liquidity_usd"),
        F.col("l_quantity").alias("price_usd"),
        (F.col("l_orderkey") * 10000 + F.col("l_linenumber")).alias("pair_id"),
        "l_suppkey",
    )
