"""Steps that grew too fast on larger tables: what they join, shuffle and write."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowlens.operators import trades as T
from flowlens.session import materialize, shared_dir
from flowlens.sources import tables as TB
from flowlens.streaming import jobs as J
from flowlens.workload import q_tx
from flowlens.workload import views as V

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rates_look_up_no_programs(spark):
    assert "p_partkey" not in plan(entry.queries()["pipeline_rates"](spark, FOLDER))


def test_orders_are_hashed_not_sorted_for_their_lines(spark):
    found = plan(V.tx(spark, FOLDER, programs=False))
    assert "ShuffledHashJoin" in found and "SortMergeJoin" not in found


def test_large_index_part_is_dealt_to_several_tasks(spark):
    path, index = shared_dir(spark), shared_dir(spark)
    rows = spark.range(400, numPartitions=4).selectExpr(
        "array('m') as mints_touched", "id * 86400 as block_time", "id as slot", "cast(id as string) as signature"
    )
    TB.append_delta_log(rows, path)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "500", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        TB.index_delta_log(spark, path, index)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    posted = spark.read.parquet(index)
    assert posted.select("part").distinct().count() == 1 and len(posted.inputFiles()) > 1
    assert TB.read_indexed_deltas(spark, path, index, "m", 400 * 86400, 10 * 86400).count() == 10


def test_backfill_shuffles_no_records(spark, monkeypatch):
    changes, _ = materialize(q_tx.deltas(spark, FOLDER, mixed=True))
    hot = q_tx.hot_parts(spark, FOLDER)
    found = T.backfill(changes, hot)
    assert "Exchange hashpartitioning" not in plan(found)
    monkeypatch.setattr(T, "BROADCAST_BYTES", -1)
    by_shuffle = T.backfill(changes, hot)
    assert "Exchange hashpartitioning" in plan(by_shuffle)
    assert sorted(map(str, found.collect())) == sorted(map(str, by_shuffle.collect())) != []


def test_stored_periods_are_not_a_file_per_task(spark):
    schema = "k long, block_time long"
    path, out = shared_dir(spark), shared_dir(spark)
    spark.range(400).selectExpr("id as k", "(id % 3) * 86400 as block_time").coalesce(1).write.parquet(path)
    sink = J.insert_once(out, ["k"], ["block_time"], epoch="block_time")
    J.run_available(J.file_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1), sink, mode="append")
    stored = spark.read.parquet(out)
    assert stored.count() == 400 and len(stored.inputFiles()) == 3


@pytest.mark.parametrize("pre,post,want", [
    ([], [("a", "x", 5)], {("a", "x"): 5}),
    ([("a", "x", 5)], [("a", "x", 5)], {}),
    ([("a", "x", 5), ("a", "x", 2), ("b", "x", 0)], [("a", "x", 9), ("b", "y", 1)], {("a", "x"): 2, ("b", "y"): 1}),
])
def test_changes_with_and_without_repeated_keys(spark, pre, post, want):
    from flowlens.functions.balances import token_deltas

    kind = "array<struct<owner:string,mint:string,amount:long>>"
    row = spark.createDataFrame([(pre, post)], f"pre {kind}, post {kind}")
    got = row.select(F.explode(token_deltas(F.col("pre"), F.col("post"))).alias("e")).select("e.*").collect()
    assert {(r.owner, r.mint): int(r.delta) for r in got} == want and len(got) == len(want)
