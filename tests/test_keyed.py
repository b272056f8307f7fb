"""Keyed tables, clusters by batches and the log index: right rows, and files that stay untouched."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.clusters import ClusterStore
from flowlens.operators.keyed import KeyedTable
from flowlens.session import shared_dir
from flowlens.sources import tables as TB

SCHEMA = T.StructType().add("k", "long").add("label", "string").add("note", "string").add("n", "long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_touches_only_its_parts(spark):
    table = KeyedTable(spark, shared_dir(spark), "k", SCHEMA, parts=16)
    assert table.read().count() == 0
    start = [(k, f"l{k}", None if k % 2 else "old", k) for k in range(200)]
    table.upsert(spark.createDataFrame(start, SCHEMA), 0, ["n"], ["note"], ["label"])
    assert rows(table.read()) == sorted(start, key=str)
    before = {part: name for part, _, name in table.folders()}
    changes = [(7, "x", "new", 70), (8, "x", None, 80), (1000, "y", None, 1)]
    frame = spark.createDataFrame(changes, SCHEMA)
    for _ in range(2):  # a replay gives the same
        table.upsert(frame, 1, ["n"], ["note"], ["label"])
        want = {r[0]: r for r in start} | {7: (7, "l7", "new", 70), 8: (8, "l8", "old", 80), 1000: changes[2]}
        assert rows(table.read()) == sorted(want.values(), key=str)
    touched = table.parts_of(frame)
    assert 0 < len(touched) <= 3
    after = table.newest()
    assert {p for p in after if after[p] != before.get(p)} == touched and set(table._names("part=*/version=1")) == {after[p] for p in touched}
    table.update(spark.createDataFrame([(7, None, None, 5), (-1, None, None, 9)], SCHEMA).select("k", "n"), 2, ["n"])
    assert [r.n for r in table.read().filter("k = 7").collect()] == [5] and table.read().count() == 201
    extra = len(table.folders()) - len(table.newest())
    assert extra > 0 and table.vacuum(1) == extra
    assert len(table.folders()) == len(table.newest()) and table.read().count() == 201


def test_uncommitted_versions_are_not_read(spark):
    table = KeyedTable(spark, shared_dir(spark), "k", SCHEMA, parts=4)
    table.upsert(spark.createDataFrame([(1, "a", "b", 1)], SCHEMA), 0, ["n"], ["note"], ["label"])
    path = next(iter(table.newest().values())).replace("version=0", "version=1")
    spark.createDataFrame([(1, "half", "done", 2)], SCHEMA).write.parquet(path)
    assert rows(table.read()) == [(1, "a", "b", 1)]


def test_clusters_equal_union_find(spark):
    rng = random.Random(3)
    store, parent = ClusterStore(spark, shared_dir(spark), T.StringType(), parts=8), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for version in range(4):
        links = [(f"w{rng.randrange(60):02}", f"w{rng.randrange(60):02}") for _ in range(12)]
        nodes = [f"z{version}", f"w{version:02}"]
        for a, b in links:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        for x in nodes:
            root(x)
        frame = spark.createDataFrame([*links, (None, "w99")], "wallet string, funder string")
        old = dict(map(tuple, store.read().collect()))
        for _ in range(1 + version % 2):  # the second and last batch come twice
            changed = store.add(frame, version, spark.createDataFrame([(x,) for x in nodes], "node string"))
        want = {x: root(x) for x in parent}
        assert dict(map(tuple, store.read().collect())) == want
        assert sorted(map(tuple, store.members.read().collect())) == sorted(want.items())
        assert dict(map(tuple, changed.collect())) == {x: c for x, c in want.items() if old.get(x) != c}


def test_index_opens_only_files_of_the_mint(spark):
    path, index = shared_dir(spark), shared_dir(spark)
    schema = "signature string, block_time long, mints_touched array<string>"
    days = [(f"s{d}-{k}", d * 86_400 + k, ["hot", "rare"] if d == 3 and k < 2 else ["hot", "hot"]) for d in range(8) for k in range(5)]
    for part in (days[:20], days[20:]):  # the second append is indexed by itself
        TB.append_delta_log(spark.createDataFrame(part, schema), path)
        TB.index_delta_log(spark, path, index)
    TB.index_delta_log(spark, path, index)
    postings = spark.read.parquet(index)
    assert postings.count() == postings.select("mint", "file").distinct().count()
    assert postings.filter("mint = 'hot'").agg(F.sum("records")).first()[0] == len(days)
    now = 8 * 86_400
    found = TB.read_indexed_deltas(spark, path, index, "rare", now, 7 * 86_400)
    assert sorted(r.signature for r in found.collect()) == ["s3-0", "s3-1"]
    holding = {r[0] for r in postings.filter("mint = 'rare'").select("file").collect()}
    assert len(found.inputFiles()) == len(holding) < len(spark.read.parquet(path).inputFiles())
    assert rows(TB.read_indexed_deltas(spark, path, index, "hot", now, 3 * 86_400).select("signature")) == rows(
        TB.read_recent_deltas(spark, path, now, 3 * 86_400, "hot").select("signature")
    )
    assert TB.read_indexed_deltas(spark, path, index, "none", now, 7 * 86_400).count() == 0
