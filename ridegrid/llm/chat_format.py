"""Operator 2: chat formatting with compiled templates (``templates.py``).

Conversations are dealt by id and sorted by turn; each one streams through the
compiled template turn by turn, and what the template writes is read back at
once: a reader splits it at the control strings, undoes the escapes and
digests roles, texts and the text under the loss mask.  Neither needs more
than one turn in memory, however long the conversation.  (The digest of a
conversation is one sequential hash, so one conversation is one task's work.)

Escaping: a backslash is doubled, and one is set behind the first character
of every control string inside a text or role, so control strings in the
output are always the template's own.

Defined results: null text and role count as empty.  Rows without conv_id form
one conversation.  A null turn comes first; equal turns follow role, then
text; rows that repeat are repeated.  Only the named columns are read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridegrid.llm.templates import Template

CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' + '[ROLE]' }}{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)

_CONTROL = regex.compile(r"\\|" + "|".join(map(regex.escape, CONTROLS)))
_TURN = regex.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*)\[/INST\]|(.*))</s>", regex.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return regex.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


class Reader:
    """Reads formatted output back, piece by piece."""

    def __init__(self, keep: bool = False):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.open: list[str] = []
        self.keep, self.parts, self.spans = keep, [], []

    def write(self, text: str, marked: bool) -> None:
        if marked and text:
            plain = unescape(text)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
            if self.keep:
                self.spans.append({"begin": self.chars, "end": self.chars + len(text)})
        self.chars += len(text)
        if self.keep:
            self.parts.append(text)
        self.open.append(text)
        if "</s>" in text:
            self._read()

    def _read(self) -> None:
        held = "".join(self.open)
        cut = held.rfind("</s>") + 4
        self.open = [held[cut:]]
        for turn in held[:cut].split("</s>")[:-1]:
            found = _TURN.fullmatch(turn + "</s>")
            if not found:
                raise ValueError("formatted text does not read back")
            body = found[3] if found[2] is None else found[2]
            self.turns.update(f"{unescape(found[1])}\n{unescape(body)}\n".encode())
            self.n_turns += 1


def format_conversations(
    conversations: DataFrame, template: str = TEMPLATE, texts: bool = False, conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    With ``texts`` also ``formatted`` and ``loss_spans`` (begin, end in code points);
    such a conversation must fit into one row.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    if texts:
        schema += ", formatted string, loss_spans array<struct<begin:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, escape)
        stream = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        done: list[dict] = []
        held = 0
        for conv, turns in groupby(stream, key=lambda row: row[0]):
            reader = Reader(texts)
            compiled.stream({"messages": ({"role": role, "text": text} for _, role, text in turns)}, reader.write)
            row = {
                "conv_id": conv, "n_turns": reader.n_turns, "turns_sha256": reader.turns.hexdigest(),
                "loss_chars": reader.loss_chars, "loss_sha256": reader.loss.hexdigest(), "formatted_chars": reader.chars,
            }
            if texts:
                row |= {"formatted": "".join(reader.parts), "loss_spans": reader.spans}
                held += reader.chars
            done.append(row)
            if len(done) == 1000 or held > 4_000_000:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done, held = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
             "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    if texts:
        kinds |= {"formatted": pa.string(), "loss_spans": pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))}
    arrow = pa.schema(list(kinds.items()))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def probe(conversations: DataFrame) -> DataFrame:
    """Conversation -7: a user, then an assistant turn, both made of control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    turns = [F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role"), text.alias("text")) for i, role in enumerate(("user", "assistant"))]
    return (
        conversations.sparkSession.range(1).select(F.explode(F.array(*turns)).alias("t"))
        .select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", "t.text")
    )
