"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only the reply is trainable.  A conversation that does not end
with a reply gives one more row with nothing trainable, so that the output
always holds the whole conversation and can be read back.

The template is ``<s>[INST] text [/INST]`` for a user, `` text </s>`` for an
assistant and ``<s>[ROLE] role`` newline ``text [/ROLE]`` for any other role.
A control string inside a text gets a backslash after its first character
(``[INST]`` becomes ``[\\INST]``, ``[\\INST]`` becomes ``[\\\\INST]``), so no
text can close a turn, and taking one backslash away restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow, map_arrow, n_parts

_PLAIN = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE\]))")
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[ROLE\] (?P<role>[^\n]*)\n(?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.S)

BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    body = escape(text)
    head, tail = ("<s>[INST] ", " [/INST]") if role == "user" else (" ", " </s>") if role == "assistant" else (f"<s>[ROLE] {_role_out(role)}\n", " [/ROLE]")
    return head + body + tail, len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            out.append(("assistant", unescape(m["assistant"])))
        else:
            out.append((_role_in(m["role"]), unescape(m["other"])))
        at = m.end()
    return out


EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"


def expand(conversations: DataFrame, keep: str = "conv_id") -> DataFrame:
    """Examples of all conversations: ``conv_id, example, text, loss_start, loss_end``.

    Code points ``loss_start`` to ``loss_end`` of ``text`` are trainable.  Rows of a
    conversation stay together and in order within a partition.  Turns are
    ordered by turn, then role and text (null turns first); null text or role:
    empty; a null ``conv_id`` is one conversation; repeated rows are turns of
    their own; other columns are ignored; an empty table gives no rows.  The
    stream holds one conversation's text at a time.
    """
    cols = [F.col(keep).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))]
    turns = conversations.select(*cols).repartition(n_parts(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(EXAMPLES)
        rows: list[tuple] = []
        held = 0
        current: object = run
        text, n, open_tail = "", 0, False

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for conv, role, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != current or current is run:
                    if open_tail:
                        rows.append((current, n, text, len(text), len(text)))
                        held += len(text)
                    current, text, n, open_tail = conv, "", 0, False
                piece, a, z = format_turn(role, body)
                a, z = len(text) + a, len(text) + z
                text += piece
                open_tail = role != "assistant"
                if not open_tail:
                    rows.append((conv, n, text, a, z))
                    n += 1
                    held += len(text)
                if held > BATCH_CHARS:
                    yield out()
                    rows.clear()
                    held = 0
        if open_tail:
            rows.append((current, n, text, len(text), len(text)))
        yield out()

    return map_arrow(turns, run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from nothing but the rows of ``expand``."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(ddl)
        current: object = run
        loss, chars, formatted, examples, last = hashlib.sha256(), 0, 0, 0, ""

        def row() -> tuple:
            turns = read_turns(last)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            return current, len(turns), digest.hexdigest(), chars, loss.hexdigest(), formatted, examples

        for batch in batches:
            rows = []
            for conv, text, a, z in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
                if conv != current or current is run:
                    if current is not run:
                        rows.append(row())
                    current, loss, chars, formatted, examples = conv, hashlib.sha256(), 0, 0, 0
                part = unescape(text[a:z])
                loss.update(part.encode())
                chars += len(part)
                formatted += len(text)
                examples += z > a
                last = text
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        if current is not run:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), schema.types, strict=True)], schema=schema)

    return map_arrow(examples, run, ddl)
