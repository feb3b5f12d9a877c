"""Operator 8, chat formatting with a compiled template and generation markers.

The template writes a conversation turn by turn; what stands between
``generation`` marks is the loss mask. Control strings inside roles and texts
are escaped, so that the output can be read back to the very turns.

Defined cases: turns stand in the order of turn, then role, then text, NULLs
first; NULL text and role are empty; rows without conv_id are one conversation;
repeated rows are turns of their own; an empty table gives an empty result;
extra columns are ignored.

Rows are dealt by conv_id and sorted in their partitions; tasks read them as a
stream and hold one turn at a time (:func:`read_back`), so a conversation with a
third of all rows needs no more memory than another. :func:`format_conversations`
returns each conversation as one string and thus holds it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .templates import Piece, compile_template

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = """
{%- for m in messages -%}
{{ '<s>' + (m.role | escape) + '[INST]' }}
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
{{ '[/INST]' + '</s>' }}
{%- endfor -%}
"""
_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)


def escape(text: str | None) -> str:
    r"""Doubles backslashes and puts ``\-`` behind the first character of control strings."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\-{m[0][1:]}", text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\-])", lambda m: "\\" if m[1] == "\\" else "", text)


def renderer(template: str = TEMPLATE):
    """A function from messages to (text, generated) pieces."""
    write = compile_template(template, {"escape": escape, "trim": lambda s: (s or "").strip()})
    return lambda messages: write(messages=messages)


def read_back(pieces: Iterable[Piece]) -> dict:
    """Figures of one formatted conversation, from its pieces, turn by turn."""
    turns, turn_digest, loss_chars, loss_digest, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
    pending, masked = "", []

    def put(digest, text: str) -> None:
        digest.update(text.encode("utf-8", "surrogatepass"))

    def settle(marked: list[str]) -> None:
        nonlocal loss_chars
        text = unescape("".join(marked))
        loss_chars += len(text)
        put(loss_digest, text)

    for text, generated in pieces:
        chars += len(text)
        pending += text
        if generated:
            masked.append(text)
            continue
        settle(masked)
        masked = []
        end = 0
        for match in _TURN.finditer(pending):
            turns += 1
            put(turn_digest, f"{unescape(match[1])}\n{unescape(match[2])}\n")
            end = match.end()
        pending = pending[end:]
    settle(masked)
    if pending:
        raise ValueError("the formatted conversation does not end with a turn")
    return {
        "n_turns": turns, "turns_sha256": turn_digest.hexdigest(), "loss_chars": loss_chars,
        "loss_sha256": loss_digest.hexdigest(), "formatted_chars": chars,
    }


def joined(pieces: Iterable[Piece]) -> tuple[str, list[dict]]:
    """The formatted text and the spans of its loss mask, in code points."""
    out, spans, at = [], [], 0
    for text, generated in pieces:
        if generated and text:
            if spans and spans[-1]["upto"] == at:
                spans[-1]["upto"] += len(text)
            else:
                spans.append({"from": at, "upto": at + len(text)})
        out.append(text)
        at += len(text)
    return "".join(out), spans


def _by_conversation(batches: Iterator[pa.RecordBatch]):
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    for conv_id, turns in groupby(rows, key=lambda row: row[0]):
        yield conv_id, ({"role": role or "", "text": text or ""} for _, role, text in turns)


def _dealt(conversations: DataFrame) -> DataFrame:
    return (
        conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (from, upto in code points) per conversation."""
    kind = pa.list_(pa.struct([("from", pa.int64()), ("upto", pa.int64())]))

    def written(batches):
        render = renderer(template)
        for conv_id, messages in _by_conversation(batches):
            text, spans = joined(render(messages))
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv_id], pa.int64()), pa.array([text], pa.string()), pa.array([spans], kind)], names=["conv_id", "formatted", "loss_spans"]
            )

    return _dealt(conversations).mapInArrow(written, "conv_id long, formatted string, loss_spans array<struct<from:long,upto:long>>")


_FIGURES = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def conversation_figures(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from each formatted conversation."""

    def read(batches):
        render, rows = renderer(template), []
        for conv_id, messages in _by_conversation(batches):
            rows.append({"conv_id": conv_id, **read_back(render(messages))})
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, _FIGURES)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, _FIGURES)

    return _dealt(conversations).mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return conversation_figures(rows.unionByName(probe))
