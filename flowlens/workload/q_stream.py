"""Streams over the tables, run to completion; their results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import rules as RU
from flowlens.operators import stats as S
from flowlens.operators import trades as T
from flowlens.plans.detection import stats_pair
from flowlens.session import materialize, shared_dir
from flowlens.sources.rules import read_rules, write_rules
from flowlens.streaming import gates as GT
from flowlens.streaming import jobs as J
from flowlens.workload import views as V
from flowlens.workload.q_rules import RULE_SQL, RULES, STATES
from flowlens.workload.q_stats import PAIR, mcap_quotes
from flowlens.workload.q_tx import (
    BACKFILL,
    BACKFILLED,
    BEST,
    MIXED_TRADES,
    SIMPLE_TRADES,
    SUPPLY,
    backfill_columns,
    deltas,
    hot_parts,
    part_supply,
)
from flowlens.workload.registry import ORACLE, query

DAY = V.DAY


# Rows of a micro-batch. Each micro-batch has a cost of its own, so their number follows the rows and not a setting.
BATCH_ROWS = 1_000_000


def staged(df, order, files=None, rows=BATCH_ROWS):
    """``df`` as a folder that grew in time order: one range-partitioned write, whose files then get
    modification times in the order of their ranges, so that a file stream reads them in time order.

    A file of about ``rows`` rows, at least six, where ``files`` does not say how many."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if not files:
        df, _ = materialize(df)
        files = max(6, -(-df.count() // rows))
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")]
    found.sort(key=lambda f: f.getPath().getName())
    first = min((f.getModificationTime() for f in found), default=0)
    for i, file in enumerate(found):
        system.setTimes(file.getPath(), first + 1000 * i, -1)
    return path


def trade_stream(spark, folder):
    """The trades as a stream of several micro-batches in time order."""
    trades = V.swaps(spark, folder)
    return J.file_stream(spark, staged(trades, "block_time"), trades.schema, max_files=1)


@query(
    "tx_source",
    f"""with {SIMPLE_TRADES} select signature, slot, user_wallet, side, base_mint,
    base_amount, quote_amount from best""",
)
def tx_source(spark, folder):
    """Transactions from a file stream, some delivered twice, turned into trades, stored once."""
    tx = V.tx(spark, folder).drop("inner_programs", "o_orderstatus")
    again = tx.filter(F.col("slot") % 5 == 0).withColumn("block_time", F.col("block_time") + 60)
    path = staged(tx.unionByName(again), "block_time")
    stream = J.file_stream(spark, path, tx.schema, max_files=1)
    # Signatures are kept for a day; repeats come within minutes.
    unique = J.deduplicated(J.event_time(stream, late="1 day"), ["signature"]).drop("ts")
    trades = T.infer_trades(T.delta_records(T.normalized(unique)))
    out = shared_dir(spark)
    # Six years of orders stand for the source: stored by 90 days, a batch spans about a year of them.
    store = J.insert_once(out, ["signature", "base_mint"], ["slot"], epoch="block_time", period=90 * DAY, reach=1)
    J.run_available(trades, store, mode="append", partitions=J.state_partitions(spark))
    return J.read_stored(spark, out, trades.schema, "block_time").select(
        "signature",
        "slot",
        "user_wallet",
        "side",
        "base_mint",
        F.col("base_amount").cast("bigint").alias("base_amount"),
        F.col("quote_amount").cast("bigint").alias("quote_amount"),
    )


@query(
    "stream_backfill",
    f"""with {MIXED_TRADES}, {BEST}, {BACKFILL}, {SUPPLY} {BACKFILLED}""",
)
def stream_backfill(spark, folder):
    """Mints turn hot one batch after another; each batch fetches their trades, none twice."""
    hot = hot_parts(spark, folder)
    stream = J.file_stream(spark, staged(hot.unionByName(hot), "mint", 3), hot.schema, max_files=1)
    out = shared_dir(spark)
    changes, _ = materialize(deltas(spark, folder, mixed=True))
    J.run_available(stream, J.backfill_hot(out, lambda: changes, part_supply(spark, folder), period=90 * DAY), mode="append")
    return backfill_columns(spark.read.parquet(out))


def _counters_sql(size: int, slide: int) -> str:
    starts = f"range(block_time // {slide} * {slide} - {size - slide}, block_time // {slide} * {slide} + 1, {slide})"
    return f"""with {V.SWAPS} select base_mint as mint, s as win_start, s + {size} as win_end,
    count(*) filter (side = 'buy') as buy_count, count(*) filter (side = 'sell') as sell_count,
    sum(quote_amount)::bigint as volume_lamports
    from (select *, unnest({starts}) as s from swaps) group by all"""


def counters(spark, folder, size, slide=None):
    stream = J.event_time(trade_stream(spark, folder))
    out = shared_dir(spark)
    store = J.write_versions(out, ["mint", "win_start"], every=4)
    J.run_available(J.bucket_counters(stream, size, slide), store, partitions=J.state_partitions(spark))
    latest = J.read_latest(spark, out, ["mint", "win_start"])
    return latest.select(
        "mint",
        "win_start",
        "win_end",
        "buy_count",
        "sell_count",
        F.col("volume_lamports").cast("bigint").alias("volume_lamports"),
    )


@query("stream_bucket_counters", _counters_sql(3600, 3600))
def stream_bucket_counters(spark, folder):
    """Hourly counters kept up to date by a stream."""
    return counters(spark, folder, "1 hour")


@query("stream_rolling", _counters_sql(6 * 3600, 3600))
def stream_rolling(spark, folder):
    """Six-hour counters, one per hour, kept up to date by a stream."""
    return counters(spark, folder, "6 hours", "1 hour")


@query(
    "stream_restart",
    f"""with {V.SWAPS} select signature, slot, base_mint, user_wallet, quote_amount from swaps""",
)
def stream_restart(spark, folder):
    """A stream that is stopped half way and started again: every trade once."""
    trades = V.swaps(spark, folder).drop("user_id", "k")
    middle = V.NOW_EVENTS - 15 * DAY
    source, out = shared_dir(spark), shared_dir(spark)
    trades.filter(F.col("block_time") < middle).write.parquet(source)

    def run(checkpoint=None):
        stream = J.file_stream(spark, source, trades.schema, max_files=1)
        return J.run_available(
            stream, J.insert_once(out, ["signature", "base_mint"], ["slot"], epoch="block_time"), checkpoint, "append"
        )

    checkpoint = run()
    # The second half arrives together with a repeat of some records of the first.
    trades.filter(F.col("block_time") >= middle - DAY).write.mode("append").parquet(source)
    run(checkpoint)
    return J.read_stored(spark, out, trades.schema, "block_time").select(
        "signature", "slot", "base_mint", "user_wallet", "quote_amount"
    )


_MIDDLE = V.NOW_EVENTS - 15 * DAY
_EARLY = [r.name for r in RULES[:3]]
_RELOADED = " ".join(
    f"when {test}" + ("" if name in _EARLY else f" and win_end >= {_MIDDLE}") + f" then '{name}'"
    for name, test in RULE_SQL.items()
)


@query(
    "rules_reload",
    f"""with {PAIR} select mint, win_end, trigger_name from (
      select mint, win_end, case {_RELOADED} end as trigger_name from pair) where trigger_name is not null""",
)
def rules_reload(spark, folder):
    """Rules read anew from their file for every micro-batch; the file changes half way."""
    stats, _ = materialize(stats_pair(V.swaps(spark, folder), V.SHORT, V.LONG))
    source, out, file = shared_dir(spark), shared_dir(spark), shared_dir(spark)

    def run(rules, part, checkpoint=None):
        write_rules(spark, rules, file)
        stats.filter(part).write.mode("append").parquet(source)
        stream = J.file_stream(spark, source, stats.schema, max_files=2)
        return J.run_available(stream, J.match_rules(out, lambda: read_rules(spark, file)), checkpoint, "append")

    checkpoint = run(RULES[:3], F.col("win_end") < _MIDDLE)
    run(RULES, F.col("win_end") >= _MIDDLE, checkpoint)
    return spark.read.parquet(out).select("mint", "win_end", "trigger_name")


@query("stream_token_state", f"with recursive {STATES} select * from changes")
def stream_token_state(spark, folder):
    """State changes by a stateful stream: those of ``token_state``.

    A clock row beyond the last hot period moves the watermark, so that the open periods end too.
    """
    stats, _ = materialize(stats_pair(V.swaps(spark, folder), V.SHORT, V.LONG))
    fired = RU.first_match(stats, RULES, with_reason=False).select(
        "mint", "win_end", F.lit(True).alias("hit")
    )
    grid = stats.select("mint", "win_end").join(fired, ["mint", "win_end"], "left")
    rows = grid.withColumn("hit", F.coalesce("hit", F.lit(False)))
    clock = rows.agg((F.max("win_end") + 30 * DAY).alias("win_end")).filter("win_end is not null").select(
        F.lit(J.CLOCK).alias("mint"), "win_end", F.lit(False).alias("hit")
    )
    rows = rows.unionByName(clock)
    stream = J.file_stream(spark, staged(rows, "win_end"), rows.schema, max_files=1)
    out = shared_dir(spark)
    J.run_available(
        J.token_state(stream, 3 * DAY), J.write_versions(out), mode="append", partitions=J.state_partitions(spark)
    )
    return spark.read.parquet(out).select("mint", "changed_at", "state")


# --- keys that recur -----------------------------------------------------------------------


def run_to_the_end(spark, rows, time, make):
    """``make`` of ``rows`` as a stream of micro-batches in time order, with a tick that lets everything settle."""
    end = rows.agg((F.max(time) + 100 * DAY).alias(time)).filter(F.col(time).isNotNull())
    rows = GT.with_clock(rows, end, time)
    # Rows wait in Python for the watermark, so a micro-batch is smaller than elsewhere.
    stream = J.file_stream(spark, staged(rows, time, rows=BATCH_ROWS // 4), rows.schema, max_files=1)
    out = shared_dir(spark)
    J.run_available(make(stream), J.write_versions(out), mode="append", partitions=J.state_partitions(spark))
    return spark.read.parquet(out).drop("batch")


@query("stream_dedup_ttl", ORACLE["dedup_ttl"])
def stream_dedup_ttl(spark, folder):
    """``dedup_ttl`` by a stateful stream: keys recur, each is closed for 600 s by every pass."""
    trades = V.swaps(spark, folder).select("venue", "block_time", "slot")
    return run_to_the_end(
        spark, trades, "block_time", lambda rows: GT.first_sight(rows, ["venue"], "block_time", 600, carry=["slot"])
    )


@query("stream_mcap_asof", ORACLE["mcap_asof"])
def stream_mcap_asof(spark, folder):
    """``mcap_asof`` by a stateful stream: the last value of each mint is kept for six hours."""
    trades = V.swaps(spark, folder)
    rows = trades.select("base_mint", "block_time", "slot", "side", "quote_mint", "quote_amount", "base_amount")

    def make(stream):
        sells = stream.filter(f"side = 'sell' or {GT.CLOCK}").select("base_mint", "block_time", "slot", GT.CLOCK)
        return GT.latest_before(sells, mcap_quotes(stream), "base_mint", "mcap", 21_600)

    found = run_to_the_end(spark, rows, "block_time", make)
    return found.select("slot", "base_mint", "mcap", F.coalesce("mcap_time", F.lit(0)).alias("mcap_time"))


# --- first seen, refreshed by each trade -----------------------------------------------------

_REFRESHED = f"""with {V.SWAPS}, gaps as (select user_wallet, block_time,
      block_time - lag(block_time) over (partition by user_wallet order by block_time) as gap from swaps)
    select distinct user_wallet, block_time as first_seen from gaps where gap is null or gap >= {7 * DAY}"""


@query("wallet_first_seen_refreshed", _REFRESHED)
def wallet_first_seen_refreshed(spark, folder):
    """First sight of each wallet, forgotten when it has not traded for seven days."""
    return S.wallet_first_seen_refreshed(V.swaps(spark, folder), 7 * DAY)


@query("stream_first_seen_refreshed", _REFRESHED)
def stream_first_seen_refreshed(spark, folder):
    """The same as sessions of a stream, told when they have ended."""
    trades = V.swaps(spark, folder).select("user_wallet", "block_time")

    found = run_to_the_end(
        spark, trades, "block_time",
        lambda rows: S.wallet_first_seen_refreshed(J.event_time(rows), 7 * DAY, stamped=True),
    )
    # Not in the stream: the filter would be pushed below the watermark, and the tick would be lost.
    return found.filter("user_wallet is not null")
