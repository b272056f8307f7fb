"""Tables by key on immutable files of which a change rewrites only the parts it touches.

Rows lie in ``parts`` hash parts of their key. A version of a part is a folder (``part=3/version=17``) that is
written once; a change writes new versions of the parts that hold changed keys and then a mark that
commits it. Readers take the newest committed version of every part: they never see half a change, and a
replay of a version reads what was before it and overwrites its own folders. So what a batch reads and writes
grows with the parts it touches and not with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.merge import update_by_key, upsert
from flowlens.session import drop_path, materialize


class KeyedTable:
    """A table of ``schema`` dealt by the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, parts: int = 64) -> None:
        self.spark, self.path, self.key, self.schema, self.parts = spark, path.rstrip("/"), key, schema, parts

    # --- files -----------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        target, system = self._fs(f"{self.path}/{pattern}")
        return [s.getPath().toString() for s in system.globStatus(target) or []]

    def committed(self) -> list[int]:
        return sorted(int(n.rsplit("=", 1)[1]) for n in self._names("_commits/version=*"))

    def folders(self) -> list[tuple[int, int, str]]:
        """(part, version, folder) of every version written, committed or not: one row per folder."""
        found = []
        for name in self._names("part=*/version=*"):
            part, version = name.rsplit("/", 2)[-2:]
            found.append((int(part.split("=")[1]), int(version.split("=")[1]), name))
        return found

    def newest(self, before: int | None = None) -> dict[int, str]:
        """Folder of each part's newest committed version (before ``before``)."""
        good = {v for v in self.committed() if before is None or v < before}
        return {part: name for part, version, name in sorted(self.folders()) if version in good}

    # --- reading and writing -----------------------------------------------------------------

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def parts_of(self, rows: DataFrame) -> set[int]:
        """Parts that the keys of ``rows`` lie in: at most ``parts`` numbers."""
        return {r[0] for r in rows.select(self.part()).distinct().collect()}

    def read(self, parts: set[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of the given parts (all by default)."""
        newest = self.newest(before)
        folders = [newest[p] for p in sorted(newest) if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def replace(self, rows: DataFrame, touched: set[int], version: int) -> None:
        """Write ``rows`` as the whole content of the parts ``touched``. A part left without rows gets an empty file."""
        if touched:
            dealt = rows.select(*self.schema.names, self.part().alias("part")).repartition("part")
            dealt = dealt.withColumn("version", F.lit(version).cast("long"))
            writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("part", "version").parquet(self.path)
            written = {p for p, v, _ in self.folders() if v == version}
            for part in touched - written:
                empty = self.spark.createDataFrame([], self.schema).coalesce(1)
                empty.write.mode("overwrite").parquet(f"{self.path}/part={part}/version={version}")
        target, system = self._fs(f"{self.path}/_commits/version={version}")
        system.create(target, True).close()

    def upsert(
        self, changes: DataFrame, version: int, overwrite: Sequence[str] = (), fill: Sequence[str] = (), keep: Sequence[str] = ()
    ) -> None:
        """Merge ``changes`` (one row per key) as ``merge.upsert`` does."""
        changes, _ = materialize(changes)
        touched = self.parts_of(changes)
        self.replace(upsert(self.read(touched, version), changes, self.key, overwrite, fill, keep), touched, version)

    def update(self, changes: DataFrame, version: int, columns: Sequence[str]) -> None:
        """Replace ``columns`` where ``changes`` has the key; unknown keys do nothing."""
        changes, _ = materialize(changes)
        touched = self.parts_of(changes) & set(self.newest(version))
        self.replace(update_by_key(self.read(touched, version), changes, self.key, columns), touched, version)

    def vacuum(self, versions: int = 2) -> int:
        """Drop committed versions of a part but the newest ``versions``; the number of folders dropped."""
        good, dropped = set(self.committed()), 0
        by_part: dict[int, list[tuple[int, str]]] = {}
        for part, version, name in self.folders():
            if version in good:
                by_part.setdefault(part, []).append((version, name))
        for found in by_part.values():
            for _, name in sorted(found)[:-versions]:
                drop_path(self.spark, name)
                dropped += 1
        return dropped


def upsert_sink(table: KeyedTable, overwrite: Sequence[str] = (), fill: Sequence[str] = (), keep: Sequence[str] = ()):
    """Sink of a stream: each micro-batch (one row per key) is a version of the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id, overwrite, fill, keep)
        table.vacuum()

    return write
