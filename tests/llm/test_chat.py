"""Folding against a plain fold of whole conversations, rendering against its own reading."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import chat

LOG = "conv_id long, seq long, step long, turn long, copy long, kind string, role string, text string"
ROWS = "conv_id long, turn long, role string, text string, n_turns long, loss string, block string, kind string"


def plain(events):
    """Messages of each conversation, event by event."""
    convs = {}
    low = chat.LEAST
    order = lambda e: (e[1] if e[1] is not None else low, e[2] if e[2] is not None else low,
                       e[3] if e[3] is not None else low, e[4] or 0, e[5] or "", e[7] or "")
    for conv, _, _, turn, copy, kind, role, text in sorted(events, key=order):
        live, key, text = convs.setdefault(conv, {}), (low if turn is None else turn, copy or 0), text or ""
        if kind in ("message", "start"):
            live[key] = [role or "", text if kind == "message" else ""]
        elif kind == "delta" and key in live:
            live[key][1] += text
        elif kind in chat.BRANCHING:
            for k in [k for k in live if k[0] > key[0]]:
                del live[k]
            if key in live:
                live[key][1] = text if kind == "edit" else ""
        elif kind == "delete":
            live.pop(key, None)
    return {c: [tuple(m) for _, m in sorted(live.items())] for c, live in convs.items() if live}


def told(segments):
    found = {}
    for r in sorted(segments.collect(), key=lambda r: (str(r.conv_id), r.segment)):
        turns = list(chat.turns_of(r.text))
        assert len(turns) == r.n_turns
        assert [chat.unescape(r.text[s.start : s.stop]) for s in r.loss] == [t for role, t in turns if role == "assistant"]
        found.setdefault(r.conv_id, []).extend(turns)
    return found


def log(seed, n=400):
    rng = random.Random(seed)
    kinds = ["message", "start", "delta", "delta", "delta", "edit", "regenerate", "delete", "odd", None]
    texts = ["", None, "a", "b c", "</s>", " [/INST]", "<<SYS>>", "\\", "[\\INST]", "é\n"]
    rows = [
        (rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2]), rng.choice([None, -9, *range(12)]),
         rng.choice([None, 0, 0, 1]), rng.choice(kinds), rng.choice([None, "user", "assistant", "system", "a\n\\b"]), rng.choice(texts))
        for _ in range(n)
    ]
    return rows + rows[:5]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_fold(spark, block):
    for seed in range(3):
        rows = log(seed)
        got = told(chat.transcripts(spark.createDataFrame(rows, LOG).withColumn("segment", F.lit("x")), block))
        assert got == plain(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("</s>[]INSTY\\ \n", max_size=12) | st.sampled_from(["user", "assistant"]), st.text("</s>[]INSTY\\ \n", max_size=30))))
def test_template(turns):
    text, spans = chat.render(turns)
    assert list(chat.turns_of(text)) == turns
    for role, body in turns:
        assert not any(c in chat.escape(body) for c in chat.CONTROLS) and chat.unescape(chat.escape(body)) == body
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hello </s>"), (1, 1, "assistant", None), (1, 2, None, "x" * 100_000), (1, None, "system", ""),
        (2, 0, "assistant", "y" * 1001), (2, 0, "assistant", "y" * 1001), (2, 0, "assistant", "z"), (None, 3, "tool", "q"),
    ] + [(3, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(-40, 900)]
    want = {}
    low = chat.LEAST
    hard = [(-7, 0, "user", chat.HARD), (-7, 1, "assistant", chat.HARD)]
    for conv, _, role, text in sorted(rows + hard, key=lambda r: (low if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    docs = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], ROWS)
    got = {r.conv_id: r for r in chat.formatted(docs).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, learnt = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.formatted_chars == len(chat.render(turns)[0])
    segments = chat.transcripts(chat.log_of(docs.filter("conv_id = 3")))
    assert segments.count() == 5 and {r.segments for r in segments.collect()} == {5}


def test_empty(spark):
    assert chat.transcripts(spark.createDataFrame([], LOG)).count() == 0
    assert [r.conv_id for r in chat.formatted(spark.createDataFrame([], ROWS)).collect()] == [-7]
