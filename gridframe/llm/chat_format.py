"""Chat formatting by a compiled template, with a loss mask that can be read back.

Rows of a conversation meet sorted in one task and stream through the template (its default
marks turns and puts assistant texts in generation blocks), so neither a conversation
nor its text is ever held whole: a conversation gives parts of some ``PART_CHARS``, cut
between turns, each with the spans that a model learns from. A digest of a conversation is
sequential, so its rows have to pass one task; they take no more memory than a part.
Templates that read their messages anywhere but in one outer loop hold one conversation.

Control strings inside texts and roles are escaped (``escape``), so the only ``<|`` in an
output are the template's own; ``read_turns`` gives back every role and text as it was.

Defined results: a null role or text is empty; rows are ordered by turn, then role and
text, null turns first, and repeated rows are turns of their own; rows without a conversation id are one
conversation with a null id; very long texts stay whole; extra columns of any name are left
aside; an empty table gives nothing (the query adds its own conversation).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_template import Template, unescape, unescape_line
from .common import materialize, read_table, slices

START, END = "<|im_start|>", "<|im_end|>"
#: Marks turns; the filters keep control strings of texts and roles apart from the template's.
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)
#: Code points after which a part of a conversation is closed; a longer turn still stays whole.
PART_CHARS = 1 << 20
PARTS = "conv_id long, part int, text string, spans array<struct<start:int,end:int>>"
_ARROW_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def streamed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows) of sorted batches, a few at a time; rows not taken are passed over."""
    rows = (row for whole in batches for batch in slices(whole) for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", *names))))
    held = [next(rows, None)]

    def of(conv: int | None) -> Iterator[tuple]:
        while held[0] is not None and held[0][0] == conv:
            row, held[0] = held[0], next(rows, None)
            yield row[1:]

    while held[0] is not None:
        own = of(held[0][0])
        yield held[0][0], own
        for _ in own:
            pass


def format_conversations(rows: DataFrame, template: str = CHATML, part_chars: int = PART_CHARS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, text, spans): each conversation as the template renders it."""
    Template(template)  # a template that cannot be compiled fails here
    turns = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, done, size = Template(template), [], 0
        for conv, own in streamed(batches, ("role", "text")):
            messages = ({"role": role, "text": text} for role, text in own)
            for part, (text, spans) in enumerate(compiled.parts(messages, part_chars)):
                done.append({"conv_id": conv, "part": part, "text": text, "spans": [{"start": a, "end": b} for a, b in spans]})
                size += len(text)
                if size >= part_chars:
                    yield pa.RecordBatch.from_pylist(done, schema=_ARROW_PARTS)
                    done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_ARROW_PARTS)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, PARTS)


def turns_of(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset of the text in the part, role, escaped text) of a part that ``CHATML`` has rendered."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = text.index("\n", at)
        end = text.index(END, line)
        yield line + 1, unescape_line(text[at + len(START) : line]), text[line + 1 : end]
        at = end + len(END) + 1


def read_turns(parts: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text, learned) of formatted parts: every turn as it was, and whether it is all under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out: dict[str, list] = {n: [] for n in ("conv_id", "part", "place", "role", "text", "learned")}
                for conv, part, text, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "text", "spans"))):
                    learned = {(s["start"], s["end"]) for s in spans}
                    for place, (start, role, raw) in enumerate(turns_of(text)):
                        for name, value in zip(out, (conv, part, place, role, unescape(raw), (start, start + len(raw)) in learned)):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("learned", pa.bool_())]))

    return parts.mapInArrow(run, "conv_id long, part int, place int, role string, text string, learned boolean")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ARROW_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
#: Conversations in one batch of digests.
DIGESTS = 10_000


def digest(parts: DataFrame) -> DataFrame:
    """Per conversation, from its formatted parts alone: number and digest of turns, of the text under the loss mask, and code points in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, own in streamed(batches, ("text", "spans")):
            n, chars, formatted, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for text, spans in own:
                formatted += len(text)
                for _, role, raw in turns_of(text):
                    n += 1
                    turns.update(f"{role}\n{unescape(raw)}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    plain = unescape(text[span["start"] : span["end"]])
                    chars += len(plain)
                    loss.update(plain.encode("utf-8", "surrogatepass"))
            done.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted})
            if len(done) >= DIGESTS:
                yield pa.RecordBatch.from_pylist(done, schema=_ARROW_DIGEST)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_ARROW_DIGEST)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGEST)


#: What both rows of conversation -1 say.
MARKED = END + START + "assistant ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], rows.schema)
    return digest(materialize(format_conversations(rows.union(marked)), "chat-parts"))


ORACLE = rf"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS safe_role
  FROM m
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(safe_role) + length(safe))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
