"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio, document or another kind
of file. A visitor walks the turns of a conversation in order and flattens
the parts: text stays text, every other part becomes a numbered placeholder such as
``<|image:1|>``; its reference, place and expanded token count are recorded.

The template marks turns as ``<|im_start|>role\\n content <|im_end|>\\n`` (without the
spaces). Control strings inside texts are escaped reversibly: a ``<`` followed by
one or more ``|`` gets one more ``|``, so no text can hold ``<|`` followed by a letter.
Adjacent text parts are joined before escaping. The loss mask covers the texts of assistant turns
as spans of code points in the formatted text.

Turns are ordered by turn number, then role, then content, so ties and repeated rows have a
fixed order. One conversation is one output row and is put together in one task; tasks hold
one conversation at a time beside the rows of a batch.

Defined results: null text is empty; a null role is the empty role; a part without a
kind is text; unknown kinds become ``file`` placeholders of no tokens; missing sizes count as
none; rows with a null conversation id form one conversation; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.tables import arrow
from casegrain.llm.words import column

START, END = "<|im_start|>", "<|im_end|>"
PATCH = 28            # pixels of an image that one token covers, each way
AUDIO_RATE = 25       # tokens a second
PAGE_TOKENS = 512     # tokens a document page

PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
ATTACHMENT = "struct<index:int,turn:int,kind:string,ref:string,offset:int,tokens:long>"
FORMATTED = (f"conv_id long, n_turns long, formatted string, loss_spans array<struct<start:int,stop:int>>, "
             f"attachments array<{ATTACHMENT}>, attachment_tokens long")
READ = "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long, attachment_tokens long"

FORMATTED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ("attachments", pa.list_(pa.struct([
        ("index", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
        ("offset", pa.int32()), ("tokens", pa.int64())]))),
    ("attachment_tokens", pa.int64())])
READ_ARROW = pa.schema([
    ("conv_id", pa.int64()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
    ("loss_text", pa.string()), ("formatted_chars", pa.int64()), ("attachment_tokens", pa.int64())])

_MARK = re.compile(r"<(\|+)")
_ESCAPED = re.compile(r"<\|(\|+)")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<|\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Flattener:
    """Visits the parts of one conversation in order."""

    def __init__(self):
        self.out: list[str] = []
        self.at = 0
        self.text: list[str] = []
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def turn(self, number: int, role: str, parts: list[dict]) -> None:
        self.write(f"{START}{escape_role(role)}\n")
        for p in parts:
            getattr(self, f"visit_{p['kind'] or 'text'}", self.visit_file)(number, role, p)
        self._close_text(role)
        self.write(f"{END}\n")

    def _close_text(self, role: str) -> None:
        s = escape("".join(self.text))
        if s and role == "assistant":
            self.spans.append({"start": self.at, "stop": self.at + len(s)})
        self.write(s)
        self.text.clear()

    def _attach(self, number: int, role: str, kind: str, part: dict, tokens: int) -> None:
        self._close_text(role)
        index = len(self.attachments) + 1
        self.attachments.append({"index": index, "turn": number, "kind": kind, "ref": part["ref"],
                                 "offset": self.at, "tokens": tokens})
        self.write(f"<|{kind}:{index}|>")

    def visit_text(self, number: int, role: str, part: dict) -> None:
        self.text.append(part["text"] or "")

    def visit_image(self, number: int, role: str, part: dict) -> None:
        side = lambda n: math.ceil(max(0, n or 0) / PATCH)
        self._attach(number, role, "image", part, side(part["width"]) * side(part["height"]))

    def visit_audio(self, number: int, role: str, part: dict) -> None:
        self._attach(number, role, "audio", part, math.ceil(max(0.0, part["seconds"] or 0.0) * AUDIO_RATE))

    def visit_document(self, number: int, role: str, part: dict) -> None:
        self._attach(number, role, "document", part, max(0, part["pages"] or 0) * PAGE_TOKENS)

    def visit_file(self, number: int, role: str, part: dict) -> None:
        self._attach(number, role, "file", part, 0)


def text_parts(text: Column) -> Column:
    """The content of a plain text row: one text part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null("string").alias("ref"),
                            null("int").alias("width"), null("int").alias("height"),
                            null("double").alias("seconds"), null("int").alias("pages"))).cast(f"array<{PART}>")


def format_chats(turns: DataFrame) -> DataFrame:
    """Format ``turns`` (conv_id, turn, role, parts): one row of ``FORMATTED`` per conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    chats = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(row)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = Flattener()
                rows = column(batch, "turns")[i].as_py()
                for k, r in enumerate(rows):
                    f.turn(k, r["role"], r["parts"])
                yield pa.RecordBatch.from_pylist([{
                    "conv_id": column(batch, "conv_id")[i].as_py(), "n_turns": len(rows),
                    "formatted": "".join(f.out), "loss_spans": f.spans, "attachments": f.attachments,
                    "attachment_tokens": sum(a["tokens"] for a in f.attachments)}], FORMATTED_ARROW)
    return arrow(chats, run, FORMATTED)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns and the text under the loss mask, taken from the formatted text alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                s = column(batch, "formatted")[i].as_py()
                spans = column(batch, "loss_spans")[i].as_py()
                rows.append({"conv_id": column(batch, "conv_id")[i].as_py(),
                             "turns": [{"role": unescape_role(r), "text": unescape(t)} for r, t in _TURN.findall(s)],
                             "loss_text": "".join(unescape(s[x["start"]:x["stop"]]) for x in spans),
                             "formatted_chars": len(s),
                             "attachment_tokens": column(batch, "attachment_tokens")[i].as_py()})
            yield pa.RecordBatch.from_pylist(rows, READ_ARROW)
    return arrow(formatted.select("conv_id", "formatted", "loss_spans", "attachment_tokens"), run, READ)
