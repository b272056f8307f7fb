"""Chat transcripts from event logs, rendered with a loss mask.

**Log.** One row per event: ``conv_id, seq, step, turn, copy, kind, role, text``. Events of a
conversation happen in the order of (seq, step). A message is named by (turn, copy); ``copy`` tells apart
messages that share a turn. Kinds:

* ``message`` puts a whole message; ``start`` opens an empty one, ``delta`` appends to it;
* ``edit`` replaces a message's text, ``regenerate`` empties it for new deltas. Both branch the
  conversation: messages of later turns that were opened before the event are discarded;
* ``delete`` removes one message. Events of a message that is not there, and unknown kinds, change no
  text (an edit or regeneration branches all the same).

**Fold.** A conversation's log is dealt by blocks of ``BLOCK_TURNS`` turns and sorted by sequence, so that one
long conversation is many groups. What earlier turns do to a block is one event, the last branching
before it: a running maximum over one row per block, added to the block's own log. A task holds one block's messages.

**Output.** One row per (conversation, segment): ``text``, its ``n_turns`` and ``loss``, the spans (code points)
of the assistant's texts. ``segments`` is the number of the conversation's blocks; blocks without a live message have
no row. Segments in order make up the conversation, and ``turns_of`` reads the turns back from the text.

**Edge cases.** Null texts are empty, null roles the empty role; null conversations are one
conversation, null turns come first and null sequences happen first. Repeated rows are repeated events: a message put twice stands once,
a delta twice is appended twice. Events that agree in (seq, step) happen in the order of (turn, copy, kind, text). Very long
texts stay whole; an empty log gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import stored, task

BLOCK_TURNS = 256
BRANCHING = ("edit", "regenerate")
LOG = ("conv_id", "seq", "step", "turn", "copy", "kind", "role", "text")
# Null sequences and turns sort first.
LEAST = -(1 << 62)

SEGMENT_SCHEMA = (
    "conv_id long, segment long, segments long, n_turns long, text string, loss array<struct<start:bigint,stop:bigint>>"
)


# --- template ----------------------------------------------------------------------------------


# The marks of the instruction format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

# A control string inside a text gets a backslash after its first character; one that has some gets one more.
_CONTROLS = [re.compile(r"(\[)(\\*)(/?INST\])"), re.compile(r"(<)(\\*)(/?s>|</?SYS>>)")]
_MARKED = [re.compile(r"(\[)\\(\\*)(/?INST\])"), re.compile(r"(<)\\(\\*)(/?s>|</?SYS>>)")]

_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]"
    r"|<s><<SYS>>(?P<role>.*?)\n(?P<other>.*?)<</SYS>>"
    r"| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    for pattern in _CONTROLS:
        text = pattern.sub(r"\1\\\2\3", text)
    return text


def unescape(text: str) -> str:
    for pattern in _MARKED:
        text = pattern.sub(r"\1\2\3", text)
    return text


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, spans under the loss mask) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "user":
            piece = f"<s>[INST] {body} [/INST]"
        elif role == "assistant":
            piece = f" {body} </s>"
            spans.append((at + 1, at + 1 + len(body)))
        else:
            piece = f"<s><<SYS>>{_role_out(role)}\n{body}<</SYS>>"
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a rendered text."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        if found["user"] is not None:
            yield "user", unescape(found["user"])
        elif found["assistant"] is not None:
            yield "assistant", unescape(found["assistant"])
        else:
            yield _role_in(found["role"]), unescape(found["other"])
        at = found.end()


# --- fold --------------------------------------------------------------------------------------


@dataclass
class _Message:
    role: str
    parts: list[str]


class Fold:
    """Messages of one block while its events go by."""

    def __init__(self) -> None:
        self.live: dict[tuple[int, int], _Message] = {}

    def branch(self, turn: int) -> None:
        for key in [k for k in self.live if k[0] > turn]:
            del self.live[key]

    def event(self, kind: str, turn: int, copy: int, role: str, text: str) -> None:
        key = (turn, copy)
        if kind == "branch":
            self.live.clear()
        elif kind == "message":
            self.live[key] = _Message(role, [text])
        elif kind == "start":
            self.live[key] = _Message(role, [])
        elif kind == "delta":
            if key in self.live:
                self.live[key].parts.append(text)
        elif kind in BRANCHING:
            self.branch(turn)
            if key in self.live:
                self.live[key].parts = [text] if kind == "edit" else []
        elif kind == "delete":
            self.live.pop(key, None)

    def turns(self) -> list[tuple[str, str]]:
        return [(m.role, "".join(m.parts)) for _, m in sorted(self.live.items())]


_OUT = pa.schema(
    [
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("segments", pa.int64()), ("n_turns", pa.int64()),
        ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by (conversation, block, sequence); one is held at a time."""
    names = ("conv_id", "block", "blocks", "kind", "turn", "copy", "role", "text")
    now, blocks, fold = None, 0, Fold()

    def row() -> Iterator[pa.RecordBatch]:
        turns = fold.turns()
        if turns:
            text, spans = render(turns)
            loss = [{"start": a, "stop": b} for a, b in spans]
            values = (now[0], now[1], blocks, len(turns), text, loss)
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, values, strict=True))], schema=_OUT)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        for conv, block, known, kind, turn, copy, role, text in zip(*columns, strict=True):
            if (conv, block) != now:
                if now is not None:
                    yield from row()
                now, blocks, fold = (conv, block), 0, Fold()
            blocks = known or blocks
            fold.event(kind, turn, copy, role, text)
    if now is not None:
        yield from row()


def transcripts(log: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Fold the log and render it: one row per (conversation, segment), see the module."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(LEAST))
    events = log.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        ((turn - F.pmod(turn, F.lit(block_turns))) / block_turns).cast("long").alias("block"),
        F.coalesce(F.col("seq").cast("long"), F.lit(LEAST)).alias("seq"),
        F.coalesce(F.col("step").cast("long"), F.lit(LEAST)).alias("step"),
        turn.alias("turn"),
        F.coalesce(F.col("copy").cast("long"), F.lit(0)).alias("copy"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # One row per block: its last branching. The window runs over these rows, never over events.
    when = F.when(F.col("kind").isin(*BRANCHING), F.struct("seq", "step"))
    per_block = events.groupBy("conv_id", "block").agg(F.max(when).alias("last"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        "conv_id", "block", F.count("*").over(whole).alias("blocks"), F.max("last").over(earlier).alias("last")
    )
    own = events.withColumn("blocks", F.lit(None).cast("long"))
    text = F.lit("")
    added = carried.select(
        "conv_id", "block", F.coalesce("last.seq", F.lit(LEAST)).alias("seq"), F.coalesce("last.step", F.lit(LEAST)).alias("step"),
        F.lit(LEAST).alias("turn"), F.lit(-1).cast("long").alias("copy"), F.lit("branch").alias("kind"), text.alias("role"), text.alias("text"),
        "blocks",
    )
    order = ["conv_id", "block", "seq", "step", "turn", "copy", "kind", "text"]
    dealt = own.unionByName(added).repartition("conv_id", "block").sortWithinPartitions(*order)
    slim = dealt.select("conv_id", "block", "blocks", "kind", "turn", "copy", "role", "text")
    return slim.mapInArrow(task(_fold), SEGMENT_SCHEMA)


# --- reading back ------------------------------------------------------------------------------

DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        for role, body in turns_of(text):
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
        for span in spans:
            learnt = unescape(text[span["start"] : span["stop"]])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.chars += len(text)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations come sorted by segment; only the running hashes are held."""
    schema = pa.schema(
        [(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in
         ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
    )
    now, digest, some = None, _Digest(), False
    done: list[tuple] = []

    def close() -> None:
        done.append((now, digest.n_turns, digest.turns.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.chars))

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "text", "loss")]
        for conv, text, loss in zip(*columns, strict=True):
            if some and conv != now:
                close()
                digest = _Digest()
            now, some = conv, True
            digest.add(text, loss)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done.clear()
    if some:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered text: turns, loss text and their SHA-256.

    A conversation of one segment is read where it lies. One of many is streamed in order by one task
    with only the hashes in memory, for SHA-256 of a whole can't be put together from parts.
    """
    slim = segments.select("conv_id", "segment", "segments", "text", "loss")
    alone = slim.filter("segments = 1").select("conv_id", "text", "loss").mapInArrow(task(_digests), DIGEST_SCHEMA)
    many = slim.filter("segments > 1").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return alone.unionByName(many.select("conv_id", "text", "loss").mapInArrow(task(_digests), DIGEST_SCHEMA))


# --- a log from finished conversations ----------------------------------------------------------

DELTA_CHARS = 400


def log_of(conversations: DataFrame) -> DataFrame:
    """The log that a chat service would have written of ``conversations`` (conv_id, turn, role, text).

    An assistant's text is streamed in deltas of ``DELTA_CHARS`` characters; one in four was drafted and
    regenerated before. One in four of the other messages was sent in other words and then edited. Rows that share
    a conversation and a turn are messages of their own, ordered by role and text.
    """
    text, draft = F.coalesce("text", F.lit("")), F.lit("(draft) ")
    tied = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select(
        "conv_id", "turn", F.col("turn").alias("seq"), (F.row_number().over(tied) - 1).cast("long").alias("copy"),
        "role", text.alias("text"), F.pmod(F.crc32(text.cast("binary")), F.lit(4)).alias("way"),
    )

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    n = F.ceil(F.char_length("text") / DELTA_CHARS)
    deltas = F.transform(
        F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: event("delta", F.substring(F.col("text"), (i * DELTA_CHARS + 1).cast("int"), F.lit(DELTA_CHARS))),
    )
    start, nothing = event("start", F.lit("")), F.array().cast("array<struct<kind:string,text:string>>")
    drafted = F.array(event("delta", draft), event("regenerate", F.lit("")))
    streamed = F.concat(F.array(start), F.when(F.col("way") == 0, drafted).otherwise(nothing), deltas)
    edited = F.array(event("message", draft), event("edit", F.col("text")))
    said = F.when(F.col("way") == 1, edited).otherwise(F.array(event("message", F.col("text"))))
    events = F.when(F.col("role") == "assistant", streamed).otherwise(said)
    return rows.select("conv_id", "turn", "seq", "copy", "role", F.posexplode(events).alias("step", "event")).select(
        "conv_id", "seq", "step", "turn", "copy", F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text")
    )


# --- the query ---------------------------------------------------------------------------------

HARD = "</s>[INST] ok [/INST]"


def formatted(conversations: DataFrame) -> DataFrame:
    """All conversations, and one whose texts look like the template, rendered and read back."""
    spark = conversations.sparkSession
    own = spark.createDataFrame(
        [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string"
    )
    rows = conversations.select(*[F.col(n).cast(t).alias(n) for n, t in own.dtypes]).unionByName(own)
    return digests(stored(transcripts(log_of(rows))))


SQL = r"""
with every as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped as (
    select *, regexp_replace(regexp_replace(text, '\[(\\*)(/?INST\])', '[\\\1\2', 'g'),
                             '<(\\*)(/?s>|</?SYS>>)', '<\\\1\2', 'g') as body
    from every
)
select conv_id,
       count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(body) + case role when 'user' then length('<s>[INST] ' || ' [/INST]')
                                         when 'assistant' then length(' ' || ' </s>')
                                         else length('<s><<SYS>>' || role || chr(10) || '<</SYS>>') end) as bigint) as formatted_chars
from escaped
group by conv_id
"""
