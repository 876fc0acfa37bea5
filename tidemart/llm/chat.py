"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, then the reply, whose text alone is under the loss mask. Turns after
the last reply come in a closing example without loss, so the output holds
the whole conversation. Conversations are dealt by id and read in turn order;
a task streams through them and holds the formatted text of one at a time
(which one example has to hold anyway).

Template, a turn:  <|turn:ROLE|> newline TEXT <|end|> newline
In roles and texts a backslash, < and > are written as two backslashes, \\l
and \\g, so no text can contain a control string, and reading reverses it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, prepare

BATCH_CHARS = 4 << 20
_TURN = re.compile(r"<\|turn:([^<>]*)\|>\n([^<>]*)<\|end\|>\n")
_ESCAPED = re.compile(r"\\([\\lg])")
_PLAIN = {"\\": "\\", "l": "<", "g": ">"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def head(role: str) -> str:
    return f"<|turn:{escape(role)}|>\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not in the template at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             assistant: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): a row per assistant
    turn, its example's whole text and the code points under the loss mask;
    one more, with an empty mask, where turns follow the last reply.

    Null texts and roles are empty ones; rows of one id and turn all stay, in
    the order of role and text; a null id is a conversation of its own. An
    empty table gives an empty result."""
    prepare(turns.sparkSession)
    schema = T.StructType([T.StructField("conv_id", turns.schema[conv_id].dataType), T.StructField("example", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    dealt = (turns.select(col(conv_id).alias("c"), col(turn).alias("n"), F.coalesce(col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(col(text).cast("string"), F.lit("")).alias("t"))
             .repartition("c").sortWithinPartitions("c", "n", "r", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, now, so_far, number, open_turns = 0, None, "", 0, False

        def put():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=schema.names)

        types = None
        for b in batches:
            if types is None:
                types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for c, r, t in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if now is None or now[0] != c:
                    if open_turns:
                        rows.append((now[0], number, so_far, len(so_far), len(so_far)))
                        size += len(so_far)
                    now, so_far, number, open_turns = (c,), "", 0, False
                h, body = head(r), escape(t)
                start = len(so_far) + len(h)
                so_far += h + body + "<|end|>\n"
                open_turns = r != assistant
                if not open_turns:
                    rows.append((c, number, so_far, start, start + len(body)))
                    size += len(so_far)
                    number += 1
                if size >= BATCH_CHARS:
                    yield put()
                    rows, size = [], 0
        if open_turns:
            rows.append((now[0], number, so_far, len(so_far), len(so_far)))
        if rows:
            yield put()

    return dealt.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the rows of `examples`: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The rows must come as `examples` yields them, a conversation's together
    and in order; stored rows must be sorted so again. Null texts are empty
    ones; a conversation without an assistant turn has no loss; all rows
    without an id are one conversation; no rows give no result."""
    schema = T.StructType([formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, loss, chars, total, kind = None, "", hashlib.sha256(), 0, 0, None
        rows: list[tuple] = []

        def close():
            turns = read_turns(last)
            rows.append((now[0], len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), chars, loss.hexdigest(), total))

        def put():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=kind)] + [pa.array([r[k] for r in rows]) for k in range(1, 6)], names=schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for c, text, start, end in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if now is None or now[0] != c:
                    if now is not None:
                        close()
                    now, loss, chars, total = (c,), hashlib.sha256(), 0, 0
                last, total = text, total + len(text)
                under = unescape(text[start:end])
                loss.update(under.encode())
                chars += len(under)
            if len(rows) >= 1000:
                yield put()
                rows.clear()
        if now is not None:
            close()
        if rows:
            yield put()

    return formatted.select("conv_id", "example", "text", "loss_start", "loss_end").mapInArrow(run, schema)
