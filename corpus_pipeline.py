"""Corpus pipeline: language, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of ``docs`` as they came, whatever other columns there are.

**Edge cases**, besides those of the operators: an empty table stays empty; of rows that share an id and a
text one stays; documents without an id pass the near-duplicate stage, for it can't name them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, language, mixing
from flowlens.llm.common import aside, crc_mod, drop_tables, stored, stored_at, table, tables_so_far
from flowlens.llm.neardup import BROADCAST_IDS, near_duplicates
from flowlens.llm.tokens import token_index, write_tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose language the classifier finds ambiguous."""
    model = language.fit(docs.filter(crc_mod("doc_id", 5) != 0))
    plain, back = aside(docs, ("text",))
    return language.identified(plain, model).filter(~F.col("lang_ambiguous")).select(back)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least document id of each group of near-duplicates (5 words, similarity 0.8)."""
    mark = tables_so_far()
    groups = near_duplicates(docs, width=5, num=80, den=100)
    # A document that stands in several rows is told by its id: rows of an id that goes, go.
    gone, gone_at = stored_at(groups.filter(~F.col("kept")).select("doc_id").distinct())
    repeated, repeated_at = stored_at(
        groups.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    )
    drop_tables(spark, mark, [gone_at, repeated_at])
    plain, back = aside(docs, ("doc_id", "text"))
    few = gone.count() <= BROADCAST_IDS
    left = plain.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return left.select(back)
    # Of rows with one id and text one stays, the same at every run.
    left = left.withColumn("same", F.xxhash64("text"))
    alone = left.join(repeated, "doc_id", "left_anti")
    order = Window.partitionBy("doc_id", "same").orderBy(F.xxhash64(*[c for c in left.columns if c != "doc_id"]))
    one = left.join(repeated, "doc_id", "left_semi").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return alone.unionByName(one.drop("place")).select(back)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    plain, back = aside(docs, ("text",))
    found = decontaminate.with_leaks(plain, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to their sources' targets, in training order; one taken twice stands twice."""
    plain, back = aside(docs, ("doc_id", "source", "text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return mixing.ordered(mixing.curriculum(plain, mixing.size_of()), parts).select(back)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write packed ids and read them back: doc_id, start, n_tokens, ids_crc32."""
    return token_index(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_languages),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

# Language, groups and tokens can't be said in SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
