import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm import tokens
from flowlens.llm.tokens import Encoder, bits_for, pack, token_index, unpack, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_pack_reads_any_part(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype(np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    for first, count in ((0, 1000), (1, 998), (17, 1), (999, 1), (5, 0)):
        assert unpack(data, bits, first, count).tolist() == ids[first : first + count].tolist()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


CODER = Encoder(PATH)
ALPHABET = "ab Z'stre019.,!?-\n\t\r\x0b\x85\xa0 　 éßñ中😀́_"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=4))
def test_ids_are_those_of_whole_texts(texts):
    flat, counts = CODER.encode(pa.array(texts))
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


def test_special_token_text():
    texts = ["a <|endoftext|> b", "plain"]
    flat, counts = CODER.encode(pa.array(texts))
    assert flat.tolist() == [i for t in texts for i in PLAIN.encode(t, add_special_tokens=False).ids]


def test_round_trip(spark):
    docs = frame(spark)
    blocks = write_tokens(docs, PATH, block_ids=500, shards=3)
    got = {}
    for r in token_index(blocks).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    start, want = 0, {}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in rows:
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_empty(spark):
    assert token_index(write_tokens(frame(spark, []), PATH)).count() == 0


def test_batches_are_encoded_a_little_at_a_time(monkeypatch):
    texts = [f"text {i} " * 4000 for i in range(60)]
    taken = []

    class Watched(Encoder):
        def encode(self, texts):
            taken.append(texts.nbytes)
            return super().encode(texts)

    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(tokens, "encoder", Watched)
    monkeypatch.setattr(tokens, "TaskContext", type("Tasks", (), {"get": staticmethod(Task)}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    blocks = [r for b in tokens._writer(PATH, 2, 50_000)(iter([batch])) for r in b.to_pylist()]
    got = [unpack(r["payload"], r["bits"], d["offset"], d["n"]).tolist() for r in blocks for d in r["docs"]]
    assert got == [[*PLAIN.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert max(taken) < 600_000
