"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it as
context, and only that reply under the loss mask (a span of code points). Turns
after the last reply make one more example without a mask, so nothing is lost.

The template writes an assistant's text as `<s>text</s>` and any other turn as
`[INST]role\\ntext[/INST]`. In texts and roles a backslash becomes `\\b`, the first
character of a control string `\\l` or `\\k`, and in roles a line end `\\n`; so no
control string is left in them, and each escape is undone in one pass.

Rows are dealt by conversation, sorted on disk where needed, and read as a stream.
A task holds the text of one conversation and a few megabytes of examples.

Defined cases: a null text or role is empty; a row with a null conv_id belongs to no
other and is a conversation of one turn; a very long text is held whole; turns
with equal numbers, null ones first, are ordered by role and text; repeated rows are
turns of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template and how they are written inside a text, in this order.
ESCAPES = (("\\", "\\b"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\kINST]"), ("[/INST]", "\\k/INST]"))
_CODES = {"\\b": "\\", "\\l": "<", "\\k": "[", "\\n": "\n"}
_CODE = re.compile(r"\\[blkn]")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.DOTALL)
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"
BATCH_CHARS = 1 << 20


def escape(text: str) -> str:
    for plain, coded in ESCAPES:
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _CODES[m[0]], text)


def render(role: str, text: str) -> str:
    if role == "assistant":
        return f"<s>{escape(text)}</s>"
    head = escape(role).replace("\n", "\\n")
    return f"[INST]{head}\n{escape(text)}[/INST]"


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text as (role, text)."""
    return [("assistant", unescape(m[1])) if m[2] is None else (unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(text)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, rows) of each conversation; rows without a conv_id are one each."""
    for conv, group in groupby(rows, lambda r: r[0]):
        yield from ((conv, iter([r])) for r in group) if conv is None else [(conv, group)]


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end; a conversation's examples follow one another in one partition."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        out, size = [], 0
        for conv, turns in _conversations(_rows(batches)):
            text, n, open_turns = "", 0, False
            for _, role, said in turns:
                piece = render(role, said)
                text, open_turns = text + piece, role != "assistant"
                if not open_turns:
                    out.append((conv, n, text, len(text) - len(piece) + 3, len(text) - 4))
                    n, size = n + 1, size + len(text)
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if open_turns:
                out.append((conv, n, text, 0, 0))
                size += len(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    none = F.lit("")
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    turns = turns.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.drop("turn").mapInArrow(expand, EXAMPLES)


def read_back(formatted: DataFrame) -> DataFrame:
    """A digest of each conversation from its formatted examples alone."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        for conv, group in _conversations(_rows(batches)):
            loss, loss_chars, chars, last = hashlib.sha256(), 0, 0, ""
            for _, _, text, start, end in group:
                said = unescape(text[start:end])
                loss.update(said.encode())
                loss_chars, chars, last = loss_chars + len(said), chars + len(text), text
            turns = parse(last)  # the last example holds every turn
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            found.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(found) == 4096:
                yield batch()
                found.clear()
        if found:
            yield batch()

    return formatted.mapInArrow(digest, out)


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


_SQL_ESCAPED = "text"
for _plain, _coded in ESCAPES:
    _SQL_ESCAPED = f"replace({_SQL_ESCAPED}, '{_plain}', '{_coded}')"

ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
r AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length({_SQL_ESCAPED.replace("text", "role")}) END + length({_SQL_ESCAPED}) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS turns FROM c),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = turns), 0)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
