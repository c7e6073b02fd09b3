"""Chat formatting from event logs: fold deltas, edits and regenerations into final messages, then render them.

Events are rows (conv_id, seq, kind, msg, role, text), applied in the order of seq (ties: start, edit, regenerate, delta; then
by the message's place, then by text):
- `start` opens message msg with a role and maybe first text; the message that starts later stands later in the conversation
  (ties: by msg). A message that starts again goes on as the first: only the text is taken, as if a delta brought it.
- `delta` appends text, `edit` replaces the text.
- `regenerate` drops the message's text, and every message that started after it and is still there; later deltas write it anew.
- A message that was dropped is gone: all further events of it do nothing, its regenerations included.
- Events of other kinds do nothing, nor do those of a message before its start.

Render. One piece per message: `### role: text</turn>` and a newline. Inside role and text a backslash goes before each
backslash, before `###` and before `</turn>`, inside a role also before each colon, so that pieces, one after the other, can be
read back. The loss mask covers the text of assistant messages: (loss_start, loss_end) in code points of the piece.

Memory: the events of a message are read as a sorted stream with only its text at hand; regenerations are read as a sorted stream
with two numbers for each that can still drop something. The order of a conversation is found by window functions that hold one
row, and its digest by reading sorted pieces as a stream with one hash state. So a conversation or a message may hold a third of
all rows. Those passes are one task for a conversation, since each step depends on the one before; folding texts, rendering and
reading back are spread by message.

Defined cases: null text and null role count as empty; a null conv_id is a conversation of its own; null seq sorts first; equal
rows of the log are applied as often as they stand there; an empty log gives an empty result."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

OPEN, CLOSE = "### ", "</turn>"
KINDS = ["start", "edit", "regenerate", "delta"]

_PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(CLOSE, "\\" + CLOSE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of a message, and where its text begins and ends in it."""
    head, body = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: ", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of all pieces of an output; raises ValueError where it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = _PIECE.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


_MESSAGE = "text string, role string, seq long, rank int, again array<struct<seq:bigint,rank:int>>"


def _messages(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Events sorted by message and time -> a row for each message that starts: its text after its last edit or regeneration, its
    role, when it began, and when it was regenerated."""
    key, began, role, parts, again = None, None, "", [], []

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done) if done else [[]] * len(schema), schema)], schema=schema)

    def told() -> tuple:
        return (*key, "".join(parts), role, began[0], began[1], [{"seq": a, "rank": b} for a, b in again])

    for batch in batches:
        done = []
        for conv, msg, seq, rank, r, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "msg", "seq", "rank", "role", "text"))):
            if key is None or conv != key[0] or msg != key[1]:
                if began is not None:
                    done.append(told())
                key, began, parts, again = (conv, msg), None, [], []
            if began is None:
                if rank != 1:
                    continue
                began, role = (seq, rank), r
            if rank in (2, 3):
                parts = []
            if rank == 3:
                if not again or again[-1] != (seq, rank):
                    again.append((seq, rank))
            else:
                parts.append(text)
        yield out(done)
    if began is not None:
        yield out([told()])


def _effective(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Regenerations of conversations, sorted by time -> those of messages that were still there.

    A regeneration at time t of the message at place p drops what stands behind p and began before t. Kept are the places and
    times of those that count; one that drops no more than a later one is forgotten, so both grow, and whether a message is gone
    is seen at the first one after its begin."""
    least = -(1 << 63)
    key, places, times = None, [], []
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (conv, place, seq, rank, seq0, rank0) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "seq", "rank", "seq0", "rank0")))):
            if conv != key or not i and key is None:
                key, places, times = conv, [], []
            began = (least if seq0 is None else seq0, rank0)
            j = bisect_right(times, began)
            if j < len(times) and places[j] < place:
                continue
            keep[i] = True
            while places and places[-1] >= place:
                places.pop()
                times.pop()
            places.append(place)
            times.append((least if seq is None else seq, rank))
        yield pa.RecordBatch.from_arrays([batch.column(f.name).filter(pa.array(keep)) for f in schema], schema=schema)


def fold(events: DataFrame) -> DataFrame:
    """events -> (conv_id, turn, role, text): the final messages, numbered by start from 0."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    log = events.select("conv_id", "msg", F.col("seq").cast("long").alias("seq"), rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("rank > 0")
    kinds = log.select("conv_id", "msg").schema
    schema = f"conv_id {kinds['conv_id'].dataType.simpleString()}, msg {kinds['msg'].dataType.simpleString()}, {_MESSAGE}"
    own = log.repartition("conv_id", "msg").sortWithinPartitions("conv_id", "msg", "seq", "rank", "text")
    own = own.mapInArrow(partial(_messages, schema=_arrow(events.sparkSession, schema)), schema)
    order = Window.partitionBy("conv_id").orderBy("seq", "rank", "msg")
    placed = own.withColumn("place", F.row_number().over(order).cast("long"))
    again = placed.where(F.size("again") > 0).select("conv_id", "place", F.col("seq").alias("seq0"), F.col("rank").alias("rank0"), F.explode("again").alias("t"))
    again = again.select("conv_id", "place", "seq0", "rank0", "t.seq", "t.rank").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "rank", "place")
    schema = f"conv_id {kinds['conv_id'].dataType.simpleString()}, place long, seq long, rank int"
    counts = again.mapInArrow(partial(_effective, schema=_arrow(events.sparkSession, schema)), schema)
    counts = counts.groupBy(F.col("conv_id").alias("_c"), F.col("place").alias("_p")).agg(F.max(F.struct("seq", "rank")).alias("regenerated"))
    messages = placed.join(counts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p")), "left")
    # a message goes if one before it was regenerated after it began; the latest time of what came before suffices
    order = Window.partitionBy("conv_id").orderBy("place")
    messages = messages.withColumn("cut", F.max("regenerated").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    messages = messages.where(F.col("cut").isNull() | (F.col("cut") < F.struct("seq", "rank")))
    return messages.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("turn"), "role", "text")


def _arrow(spark, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [render(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
        piece, start, end = zip(*made) if made else ((), (), ())
        loss = pa.array([r == "assistant" for r in b.column("role").to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(piece, pa.string()), loss, pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["conv_id", "turn", "piece", "loss", "loss_start", "loss_end"])


def format_chat(events: DataFrame) -> DataFrame:
    """events -> (conv_id, turn, piece, loss, loss_start, loss_end); a conversation's output is its pieces by turn."""
    kind = dict(events.dtypes)["conv_id"]
    return fold(events).select("conv_id", "turn", "role", "text").mapInArrow(_rendered, f"conv_id {kind}, turn long, piece string, loss boolean, loss_start long, loss_end long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, read back and reduced to what the digests take."""
    for b in batches:
        pieces = b.column("piece").to_pylist()
        turns = [[f"{role}\n{text}\n" for role, text in read_back(p)] for p in pieces]
        spans = zip(pieces, *(b.column(c).to_pylist() for c in ("loss", "loss_start", "loss_end")))
        masked = [unescape(p[s:e]) if on else "" for p, on, s, e in spans]
        more = [pa.array([len(t) for t in turns], pa.int64()), pa.array(["".join(t) for t in turns], pa.string()), pa.array(masked, pa.string()), pa.array([len(p) for p in pieces], pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), *more], ["conv_id", "turn", "n", "turns", "masked", "chars"])


_RESULT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole conversations; one hash state at a time, however long a conversation is."""
    key, state = None, None

    def told() -> list:
        return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done) if done else [[]] * len(_RESULT), _RESULT)], schema=_RESULT)

    for b in batches:
        done = []
        for conv, n, turns, masked, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n", "turns", "masked", "chars"))):
            if state is None or conv != key:
                if state is not None:
                    done.append(told())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n
            state[1].update(turns.encode())
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += chars
        yield out(done)
    if state is not None:
        yield out([told()])


def digests(pieces: DataFrame) -> DataFrame:
    """What is read back from the output of each conversation (conv_id: an integer)."""
    read = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "piece", "loss", "loss_start", "loss_end").mapInArrow(_read, "conv_id long, turn long, n long, turns string, masked string, chars long")
    read = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return read.mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log that ends in them. Rows are messages in the order of turn,
    role and text (null first), each in one of four ways, by a hash of the row: streamed in two deltas; opened with a draft that an
    edit replaces; streamed as a draft and regenerated; or followed by a message that a regeneration takes away again, before it
    is streamed anew, and whose own late regeneration and delta do nothing. Equal rows are messages of their own."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def way(*events: tuple) -> Column:
        made = [F.struct(F.lit(kind).alias("kind"), F.lit(step).alias("step"), F.lit(other).alias("other"), part.alias("part")) for step, (kind, part, other) in enumerate(events)]
        return F.array(*made)

    none, draft = F.lit(""), F.concat(second, F.lit("?"))
    ways = [
        way(("start", none, False), ("delta", first, False), ("delta", second, False)),
        way(("start", draft, False), ("edit", first, False), ("delta", second, False)),
        way(("start", none, False), ("delta", draft, False), ("regenerate", none, False), ("delta", first, False), ("delta", second, False)),
        way(("start", draft, False), ("start", draft, True), ("regenerate", none, False), ("delta", first, False), ("regenerate", none, True), ("delta", draft, True), ("delta", second, False)),
    ]
    kind = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(len(ways)))
    parts = F.when(kind == 0, ways[0]).when(kind == 1, ways[1]).when(kind == 2, ways[2]).otherwise(ways[3])
    rows = rows.select("conv_id", "n", "role", F.explode(parts).alias("p"))
    msg = F.when(F.col("p.other"), -F.col("n")).otherwise(F.col("n"))
    return rows.select("conv_id", (F.col("n") * 8 + F.col("p.step")).alias("seq"), F.col("p.kind").alias("kind"), msg.alias("msg"), "role", F.col("p.part").alias("text"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation's formatted output, and of the extra conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_chat(conversation_events(rows.unionByName(extra))))
