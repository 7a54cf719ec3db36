"""Formatting of conversations in Spark, turn by turn, and reading the output back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.chat_template import END, SEPARATOR, START, TEMPLATE, Turn, compile_template, spans, unescape
from edgeloom.llm.common import small_batches

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _turns(batches) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, seq, piece, loss): the pieces of each conversation in order, with their loss spans.

    A piece holds one turn, the first also what the template has before the loop and the last also
    what it has after; a conversation's formatted text is its pieces joined. loss lists the ranges of
    the piece that stand inside ``{% generation %}``. Rows of a conversation are dealt by id and
    sorted by turn (nulls first; ties by role, then text), then formatted in one pass that holds two
    turns at most, so the longest conversation needs no more memory than its longest turn. Null roles
    and texts are empty, rows with a null id are one conversation with a null id, repeated rows are
    turns of their own, and an empty table gives no rows.
    """
    small_batches(conversations.sparkSession)
    compile_template(template)

    def run(batches):
        compiled, held, size = compile_template(template), [[], [], [], []], 0
        current, before, index = None, None, 0

        def close(turn: tuple[int | None, str, str], first: bool, last: bool):
            out = []
            if first:
                compiled.before(None, out)
            compiled.turn(Turn(turn[1] or "", turn[2] or "", first, last, index), out)
            if last:
                compiled.after(None, out)
            text = "".join(p for p, _ in out)
            for column, x in zip(held, (turn[0], index - 1, text, [{"start": a, "stop": b} for a, b in spans(out)]), strict=True):
                column.append(x)
            return len(text)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int64(), pa.int64(), pa.string(), _SPANS), strict=True)], names=["id", "seq", "piece", "loss"])
            for column in held:
                column.clear()
            return batch

        for row in _turns(batches):
            if before is not None:
                size += close(before, index == 1, row[0] != current)
            index = index + 1 if before is not None and row[0] == current else 1
            current, before = row[0], row
            if len(held[0]) >= 1000 or size > 4 << 20:
                yield flush()
                size = 0
        if before is not None:
            close(before, index == 1, True)
        if held[0]:
            yield flush()

    rows = conversations.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return dealt.mapInArrow(run, "id long, seq long, piece string, loss array<struct<start: long, stop: long>>").withColumnRenamed("id", id_col)


def parse_turns(piece: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a piece of the standard template holds, unescaped."""
    out = []
    for part in piece.split(START)[1:]:
        role, rest = part.split(SEPARATOR, 1)
        out.append((unescape(role), unescape(rest.split(END, 1)[0])))
    return out


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what format_conversations wrote with the standard template, one row per conversation.

    (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all taken from the pieces
    and their loss spans alone, in one pass over pieces as they stand: a conversation's pieces follow
    each other in one partition, and only running digests are held.
    """

    def run(batches):
        current, state = None, None

        def row():
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def emit(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for key, seq, piece, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq == 0:
                    if state is not None:
                        done.append(row())
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(piece[span["start"] : span["stop"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece)
            if done:
                yield emit(done)
        if state is not None:
            yield emit([row()])

    out = formatted.select(id_col, "seq", "piece", "loss").mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)
