r"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn, each as ``<turn>`` role newline text ``</turn>`` newline. The
grammar is deterministic: a backslash takes the next character literally, a role ends at the first bare
newline, a text at the first bare ``</turn>``, and a bare ``<turn>`` inside either is an error. Every turn
is rendered raw first and parsed again; where the recovered turn differs from the source, conflicting
content is escaped (at the next level: backslashes and control strings, then every character that could begin one)
and the round trip is repeated until it is identical. A turn's rendering that parses alone parses in any
concatenation, as a match depends on nothing behind it.

The loss mask covers the texts of assistant turns: spans of the formatted output, read back unescaped.

Conversations are dealt by conv_id and sorted by turn within partitions; a task streams its rows and
holds one turn and two running digests, so a conversation of any length needs constant memory.

Defined results. Null roles and texts are empty. Turns are ordered by turn (null first), then role, then
text, so ties and repeated rows have one order. Null conv_ids form one conversation. Texts of any length are read whole. Further columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, ESCAPE = "<turn>", "</turn>", "\\"
LOSS_ROLE = "assistant"

_TURN = re.compile(r"<turn>((?:[^\\\n<]++|\\.|<(?!/?turn>))*+)\n((?:[^\\<]++|\\.|<(?!/?turn>))*+)</turn>\n", re.S)
_CONFLICT = (None, re.compile(r"\\|</?turn>"), re.compile(r"[\\<>\n]"))
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if ESCAPE in text else text


def escape(text: str, level: int) -> str:
    return _CONFLICT[level].sub(lambda m: ESCAPE + m[0], text) if level else text


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text as formatted) of each turn; ValueError outside the grammar."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)))
        at = found.end()
    return out


def render_turn(role: str, text: str) -> str:
    """The turn's rendering at the lowest level of escaping whose parse is the turn itself."""
    for level in range(len(_CONFLICT)):
        role_level = len(_CONFLICT) - 1 if level and "\n" in role else level
        formatted = f"{OPEN}{escape(role, role_level)}\n{escape(text, level)}{CLOSE}\n"
        try:
            turns = parse(formatted)
        except ValueError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return formatted
    raise ValueError("a turn that no level of escaping recovers")


def format_conversation(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it under the loss mask."""
    formatted = "".join(render_turn(role or "", text or "") for role, text in turns)
    return formatted, [(a, b) for role, _, a, b in parse(formatted) if role == LOSS_ROLE]


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """Running figures of one conversation, all of them read back from its formatted turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, start, end in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == LOSS_ROLE:
                masked = unescape(formatted[start:end])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now, done = [c.split()[0] for c in SCHEMA.split(", ")], None, []

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv, role, text in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2)), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(render_turn(role.as_py() or "", text.as_py() or ""))
        if done:
            yield out()
            done = []
    if now is not None:
        done = [now.row()]
        yield out()


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row per conversation, read back from its formatted form."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_digests, SCHEMA)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_digests(given.unionByName(hard))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text) + len(regexp_extract_all(text, '\\|</?turn>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
