"""The pipeline stage by stage, each against plain Python on its own input."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from helpers import corpus, frame, words
from pyspark.sql import functions as F
from test_neardup import family, plain
from tokenizers import Tokenizer

ITEM = "the little train leaves the town at nine and comes to the sea when the sun is high"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus() + family(20, 8, 6, 500)
    rows += [(900, rows[1][1] + " " + ITEM + " end", "x", "s1", 0, 0.0, 1, "v"), (901, "!! 12", "x", "s2", 0, 0.0, 1, "v")]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(docs):
    return sorted(map(tuple, docs.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("kept", F.lit("a")).withColumn("target", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "token_ids"]

    known = stages["language"](spark, docs, folder)
    assert known.columns == docs.columns
    # The corpus' labels don't follow its texts, so only texts without letters are sure to go.
    letters = [r for r in rows_of(docs) if any(c.isalpha() for c in r[1] or "")]
    assert set(map(str, rows_of(known))) <= set(map(str, letters))

    docs = docs.filter(F.col("text").rlike("\\p{L}"))
    one = stages["near_duplicates"](spark, docs, folder)
    assert one.columns == docs.columns
    source = rows_of(docs)
    label = {i: c for i, _, c in plain(source, 5, 80, 100)}
    want = {(r[0], r[1]) for r in source if r[0] is None or label[r[0]] == r[0]}
    got = [(r[0], r[1]) for r in rows_of(one)]
    assert len(got) == len(set(got)) and set(got) == want

    clean = stages["decontamination"](spark, one, folder)
    assert clean.columns == docs.columns
    assert rows_of(clean) == [r for r in rows_of(one) if r[0] != 900]

    taken = stages["mixing"](spark, clean, folder)
    assert taken.columns == docs.columns
    times = collections.Counter(map(str, rows_of(taken)))
    assert set(times) <= set(map(str, rows_of(clean))) and max(times.values()) <= 2
    total = sum(len(words(r[1])) for r in rows_of(clean))
    most = max(len(words(r[1])) for r in rows_of(clean))
    assert abs(sum(len(words(r[1])) for r in rows_of(taken)) - 1.5 * total) <= 5 * most

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = sorted(map(tuple, stages["token_ids"](spark, taken, folder).select("doc_id", "n_tokens", "ids_crc32").collect()), key=str)
    ids = [(r[0], [*coder.encode(r[1], add_special_tokens=False).ids, 2]) for r in rows_of(taken)]
    assert out == sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=str)


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
