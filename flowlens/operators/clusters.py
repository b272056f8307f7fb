"""Wallet clusters kept up to date by new links: only components that a link joins are relabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.graph import components
from flowlens.operators.keyed import KeyedTable
from flowlens.operators.lookups import lookup_join
from flowlens.session import materialize


class ClusterStore:
    """Two keyed tables of (node, component): ``labels`` by node, ``members`` by component (its least node).

    A batch of links is lifted to links between the labels of their ends; the components of that small graph
    say which labels give way to which. Only the parts of the touched labels are read and written. Joins with stored
    parts are by sort and merge: as compressed files they look small enough for Spark to broadcast them.
    """

    def __init__(self, spark: SparkSession, path: str, node: T.DataType, parts: int = 64) -> None:
        self.schema = T.StructType([T.StructField("node", node), T.StructField("component", node)])
        self.labels = KeyedTable(spark, f"{path}/labels", "node", self.schema, parts)
        self.members = KeyedTable(spark, f"{path}/members", "component", self.schema, parts)

    def read(self) -> DataFrame:
        return self.labels.read()

    def add(self, links: DataFrame, version: int, nodes: DataFrame | None = None, a: str = "wallet", b: str = "funder") -> DataFrame:
        """Add ``links`` and lone ``nodes``; the (node, component) rows that are new or have changed.

        ``version`` counts up from batch to batch; the same version may be added again. A missing end links nothing.
        """
        kind = self.schema["node"].dataType
        pairs, _ = materialize(
            links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).distinct()
        )
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        if nodes is not None:
            ends = ends.unionByName(nodes.select(F.col("node").cast(kind).alias("node")))
        ends, _ = materialize(ends.filter("node is not null").distinct())
        known = self.labels.read(self.labels.parts_of(ends), version)
        found = ends.join(known.hint("merge"), "node", "left")
        labelled, _ = materialize(
            found.select("node", F.coalesce("component", "node").alias("label"), F.col("component").isNull().alias("new"))
        )
        one = labelled.select(F.col("node").alias("a"), F.col("label").alias("la"))
        two = labelled.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        lifted = lookup_join(lookup_join(pairs, one, ["a"], "inner"), two, ["b"], "inner").select("la", "lb")
        labels = labelled.select(F.col("label").alias("node")).distinct()
        merged, _ = materialize(components(labels, lifted, "la", "lb").toDF("label", "component"))
        moved, _ = materialize(merged.filter("label <> component"))
        old = moved.select(F.col("label").alias("component"))
        left_behind = self.members.read(self.members.parts_of(old), version).withColumnRenamed("component", "label")
        relabelled = lookup_join(left_behind, moved, ["label"], "inner").select("node", "component")
        fresh = lookup_join(labelled.filter("new").select("node", "label"), merged, ["label"], "inner").select("node", "component")
        changes, _ = materialize(relabelled.unionByName(fresh))
        self.labels.upsert(changes, version, overwrite=["component"])
        touched = self.members.parts_of(old) | self.members.parts_of(changes)
        stay = self.members.read(touched, version).join(changes.select("node").hint("merge"), "node", "left_anti")
        self.members.replace(stay.select("node", "component").unionByName(changes), touched, version)
        return changes
