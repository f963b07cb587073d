"""Chat formatting with compiled templates, and reading the formatted text back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import runs_of
from linework.llm.template import compile_template

END = "</turn>\n"
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | role }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: A long conversation comes in parts of about this many characters, each of whole turns.
PART_CHARS = 1_000_000
#: What stands with a backslash before it inside a text, and inside a role (the backslash itself first).
CONTROL = ("###", "</turn>")
ROLE_CONTROL = (*CONTROL, ":", "\n")


def _escape(text: str, control: tuple[str, ...]) -> str:
    text = text.replace("\\", "\\\\")
    for c in control:
        text = text.replace(c, "\\" + c)
    return text


def _unescape(text: str, control: tuple[str, ...]) -> str:
    """The inverse of _escape: no control string stands bare in what that gives, so the backslashes that
    stand before one are its own, and the rest are pairs."""
    for c in control:
        text = text.replace("\\" + c, c)
    return text.replace("\\\\", "\\")


def escape(text: str | None) -> str:
    """Control strings and backslashes with a backslash before them."""
    return _escape(text or "", CONTROL)


def escape_role(role: str | None) -> str:
    return _escape(role or "", ROLE_CONTROL)


def unescape(text: str) -> str:
    return _unescape(text, CONTROL)


def _bare(text: str, mark: str, at: int) -> int:
    """Where mark next stands from at on without a backslash of its own; -1 if nowhere."""
    start = at
    while (found := text.find(mark, at)) >= 0:
        n = found
        while n > start and text[n - 1] == "\\":
            n -= 1
        if (found - n) % 2 == 0:
            break
        at = found + 1
    return found


def turns(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text; a ValueError if it isn't one."""
    at = 0
    while at < len(text):
        role = _bare(text, ":\n", at + 4) if text.startswith("### ", at) else -1
        end = _bare(text, END, role + 2) if role >= 0 else -1
        if end < 0:
            raise ValueError(f"no turn at {at}: {text[at : at + 40]!r}")
        yield _unescape(text[at + 4 : role], ROLE_CONTROL), unescape(text[role + 2 : end])
        at = end + len(END)


def _rows(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple]:
    """Rows of batches, decoded about 4 MB of the column text at a time."""
    for batch in batches:
        for at, stop in runs_of(batch.column(text), most=256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, stop - at).columns), strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 200 + sum(len(x) for x in row if isinstance(x, str))
        if chars >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _formatter(template: str, id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        render = compile_template(template, {"escape": escape, "role": escape_role})
        for conv, rows in groupby(_rows(batches, 2), key=lambda r: r[0]):
            part, text, loss, at = 0, [], [], 0
            for piece, learned in render({"messages": ({"role": r[1] or "", "text": r[2] or ""} for r in rows)}):
                text.append(piece)
                if learned:
                    loss.append({"start": at, "stop": at + len(piece)})
                at += len(piece)
                if piece == END and at >= PART_CHARS:
                    yield conv, part, "".join(text), loss
                    part, text, loss, at = part + 1, [], [], 0
            if text or not part:
                yield conv, part, "".join(text), loss

    return lambda batches: _in_batches(parts(batches), schema)


def format_conversations(rows: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, text, loss) per conversation, its rows by turn; loss holds the spans of generations.

    Rows go to a conversation's task sorted and are rendered as they come, so a conversation of any
    length takes the memory of one part or of its longest turn; parts of PART_CHARS are cut at turn ends.  Null roles and
    texts are empty; a null id is a conversation; rows with the same turn sort by role and text and
    each count; an empty table gives none; other columns are ignored, so their names can't clash.
    """
    slim = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = dealt.schema["conv_id"].dataType
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("part", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss", spans)])
    from pyspark.sql.pandas.types import to_arrow_type

    return dealt.mapInArrow(_formatter(template, to_arrow_type(kind)), schema)


def _digester(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, parts in groupby(_rows(batches, 2), key=lambda r: r[0]):
            n, learned, chars, every, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for _, _, text, spans in parts:
                chars += len(text)
                for role, said in turns(text):
                    n += 1
                    every.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    under = unescape(text[s["start"] : s["stop"]])
                    learned += len(under)
                    loss.update(under.encode())
            yield conv, n, every.hexdigest(), learned, loss.hexdigest(), chars

    return lambda batches: _in_batches(read(batches), schema)


def read_back(formatted: DataFrame, arranged: bool = False) -> DataFrame:
    """Digests of conversations from their formatted text: n_turns, turns_sha256 (role, \\n, text, \\n
    a turn), loss_chars and loss_sha256 (the unescaped text under the loss spans), formatted_chars.

    arranged: the rows come straight from format_conversations(), whose order holds; rows from
    elsewhere are dealt and sorted again.  A conversation's digest runs over its text in order, so
    one task reads it, part by part.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if not arranged:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = formatted.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    return formatted.select("conv_id", "part", "text", "loss").mapInArrow(_digester(to_arrow_type(kind)), schema)


#: The contract's rows in DuckDB.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:|\n)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::bigint AS formatted_chars
FROM c GROUP BY 1
"""
