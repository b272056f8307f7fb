"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import align, chat, decontaminate, language, licences, mixing, spelling, topk, toxicity
from flowlens.llm.common import crc_mod, table
from flowlens.llm.lm import scored
from flowlens.llm.neardup import near_duplicates
from flowlens.llm.substrings import deduplicated
from flowlens.llm.tokens import token_index, write_tokens

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_token_ids")
def op1_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Packed ids of all documents, read back from the blocks."""
    blocks = write_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(blocks)


@query("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Deleted-interpolation scores of all documents; remainder 2 is held out of the counts."""
    return scored(table(spark, folder, "documents"), crc_mod("doc_id", 7) != 2)


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingles overlap by 85 % or more."""
    return near_duplicates(table(spark, folder, "documents"), width=3, num=85, den=100)


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; remainder 0 is held out of training."""
    docs, held = table(spark, folder, "documents"), crc_mod("doc_id", 5) == 0
    model = language.fit(docs.filter(~held))
    found = language.identified(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left after removing every repeated window of 35 words."""
    found = deduplicated(table(spark, folder, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


@query("op6_licence_scan", licences.SQL)
def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document by the digest of its whole text, and the notices among its lines."""
    found = licences.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("licence_digest").alias("digest"), F.col("licence").alias("license"),
        F.array_join("licence_notices", ",").alias("notices"),
    )


@query("op7_mixing", mixing.SQL)
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document, in the order of their first position."""
    docs = table(spark, folder, "documents")
    mixed = mixing.curriculum(docs.select("doc_id", "source", "text"), mixing.size_of()).drop("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.element_at("mix_positions", 1)
    return (
        mixed.withColumn("position", F.when(F.size("mix_positions") > 0, place))
        .repartitionByRange(parts, "position", "doc_id").sortWithinPartitions("position", "doc_id")
        .select(
            "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
            F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
        )
    )


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item and the words matched."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.words")


@query("op9_top_k", topk.SQL)
def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Five best inner products of every fiftieth vector among all others."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; remainder 1 is held out of training."""
    docs, held = table(spark, folder, "documents"), crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held)
    found = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), "predicted", "toxic_window"
    )


@query("op11_chat", chat.SQL)
def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations folded from their event log, rendered, and read back from the rendered text."""
    return chat.formatted(table(spark, folder, "conversations"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of two tokenizers' tokens over every document."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.aligned(table(spark, folder, "documents"), *paths)


@query("op13_spelling")
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words of all documents, their near words, forms and roots."""
    return spelling.spelling_groups(table(spark, folder, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
