"""Conversations as training text, by any template, with the spans of all turns found from the outside.

A template is a function from messages ({"role", "text"}) to text, about which nothing else is known. A conversation is
rendered turn by turn, each time one turn longer, and two outputs after each other are compared: what the longer one has
more is the turn's piece. Where the content stands in it is found by rendering the last turn with two probes, whose
outputs begin to differ where the content begins. If the longer output doesn't go on from the shorter one, the template
has rewritten history.

Turns come in order of (conv_id, turn) and are rendered as they come. Of a template that says so (`by_turn`), each turn's
piece depends on that turn alone; a task then holds `window` turns at a time however long a conversation is, and goes on
with the newer half as context. Of any other template nothing is known, so all turns of the conversation stay its context.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import slices

Template = Callable[[list[dict[str, str]]], str]
#: Turns that are rendered together at most, if the template is `by_turn`.
WINDOW = 64
PROBES = "a", "b"
PIECE = "conv_id long, nth long, role string, piece string, content_start int, content_end int, trained boolean, rewritten int, context_free boolean, tail string"

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: What a text may not hold as it is: the sign that escapes, and what makes a mark.
_CONTROL = re.compile(r"\\|#|(?<=<)/(?=turn>)")
_ROLE = re.compile(r"\\|#|(?<=<)/(?=turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*): ((?:[^\\<]++|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escaped(text: str, control: re.Pattern[str] = _CONTROL) -> str:
    """The text with a backslash before each control character, so that no mark can stand in it."""
    return control.sub(lambda m: f"\\{m[0]}", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(messages: list[dict[str, str]]) -> str:
    """The library's own template: `### role: text</turn>` and a line end for each turn."""
    return "".join(f"{OPEN}{escaped(m['role'], _ROLE)}{MIDDLE}{escaped(m['text'])}{CLOSE}" for m in messages)


#: What a turn adds depends on the turn alone.
marked.by_turn = True


def parsed(output: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the text) of each turn in what `marked` gives; a ValueError for anything else."""
    out, at = [], 0
    while at < len(output):
        found = _TURN.match(output, at)
        if not found:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescaped(found[1]), unescaped(found[2]), found.start(2), found.end(2)))
        at = found.end()
    return out


def common_prefix(a: str, b: str) -> int:
    """How many characters both begin with, by halving."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Conversation:
    """Renders one conversation as its turns come."""

    def __init__(self, template: Template, trained: frozenset[str], window: int) -> None:
        self.template, self.trained, self.window = template, trained, max(2, window)
        self.by_turn = getattr(template, "by_turn", False)
        self.check_at = self.window
        self.messages: list[dict[str, str]] = []
        self.pieces: list[str] = []
        try:
            self.output = template([])
        except Exception:  # the template wants a message; then all before the first turn is its piece
            self.output = ""

    def add(self, role: str, text: str) -> dict:
        """The next turn's piece and where its content is in the piece."""
        same = len(self.messages) < self.check_at or self._slide()
        self.messages.append({"role": role, "text": text})
        shorter, longer = self.output, self.template(self.messages)
        shared = common_prefix(shorter, longer)
        rest = shorter[shared:]
        rewritten = 0
        if rest and not (longer.endswith(rest) and len(longer) >= shared + len(rest)):
            rewritten, rest = len(rest), ""
        piece = longer[shared : len(longer) - len(rest)]
        start = end = None
        if role in self.trained:
            a, b = (self.template([*self.messages[:-1], {"role": role, "text": p}]) for p in PROBES)
            before = common_prefix(a, b)
            start, end = before - shared, len(longer) - (len(a) - before - 1) - shared
            if not 0 <= start <= end <= len(piece):  # the content is rewritten, or not in its own piece
                start = end = None
        if not self.messages[1:]:  # what stands before the first turn belongs to it
            piece, start, end = longer[: shared] + piece, None if start is None else start + shared, None if end is None else end + shared
        self.output = longer
        self.pieces.append(piece)
        return {"piece": piece, "content_start": start, "content_end": end, "trained": role in self.trained, "rewritten": rewritten, "context_free": same, "tail": rest}

    def _slide(self) -> bool:
        """Do the newer turns give the same pieces without the older ones? Goes on with them alone if the template is `by_turn`, else with all."""
        half = self.window // 2
        messages, pieces = self.messages[-half:], self.pieces[-half:]
        first, output = self.template(messages[:1]), self.template(messages)
        # The first turn in a window also has what the template begins with.
        same = output[len(first) :].startswith("".join(pieces[1:]))
        if self.by_turn and same:
            self.messages, self.pieces, self.output = messages, pieces, output
        else:
            self.pieces = pieces
            self.check_at += self.window - half
        return same


def _turns(conversations: DataFrame) -> DataFrame:
    """The rows of each conversation together, in order: by turn, then role, then text; null comes first."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(conversations: DataFrame, template: Template = marked, trained: tuple[str, ...] = ("assistant",), window: int = WINDOW) -> DataFrame:
    """A row for each turn of conversations (conv_id, turn, role, text): conv_id, nth from 1, role, and

    - piece: what the turn adds to the output; the pieces in order, and the last turn's tail, are the whole output
    - content_start, content_end: where its content is in the piece, escaped as the template does (code points), for the
      roles that are trained on; null if the template doesn't show it there
    - rewritten: how many code points of what stood before the template has taken back with this turn; then the pieces
      before it don't hold any more, and `stable` leaves the conversation out
    - context_free: false at a turn before which the newer half of the window gives other pieces without the older turns;
      the piece itself is right all the same, since the template has seen them

    Null text and null role count as empty; a null conv_id is one conversation; turns that are equal come by role, then
    text; repeated rows are turns of their own. Other columns don't matter. An empty table gives no rows.
    """
    roles = frozenset(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chat, nth = object(), None, 0
        for b in slices(batches):
            made = []
            for conv_id, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if conv_id != key or chat is None:
                    key, chat, nth = conv_id, _Conversation(template, roles, window), 0
                nth += 1
                made.append({"conv_id": conv_id, "nth": nth, "role": role, **chat.add(role, text)})
            if made:
                yield pa.RecordBatch.from_pylist(made, _ARROW)

    return _turns(conversations).mapInArrow(run, PIECE)


_ARROW = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("content_start", pa.int32()), ("content_end", pa.int32()), ("trained", pa.bool_()), ("rewritten", pa.int32()), ("context_free", pa.bool_()), ("tail", pa.string())])


def stable(pieces: DataFrame, context_free: bool = True) -> DataFrame:
    """The rows of conversations whose history is never rewritten, whose trained content is found, and, unless context_free is false, whose pieces don't depend on turns outside the window."""
    bad = pieces.filter((F.col("rewritten") > 0) | (~F.col("context_free") & F.lit(context_free)) | (F.col("trained") & F.col("content_start").isNull())).select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("no")).distinct()
    return pieces.join(bad, (F.coalesce(pieces["conv_id"], F.lit(0)) == F.col("c")) & (pieces["conv_id"].isNull() == F.col("no")), "left_anti")


def report(pieces: DataFrame) -> DataFrame:
    """What `marked` output says, read back from the pieces: one row for each conversation.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 (all text under
    the mask, without escapes), formatted_chars, mask_agrees (each trained span is the text that the marks enclose, and
    nothing else is). A conversation's pieces are read one after another, none is held.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, mask_agrees boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = object(), None
        for b in slices(batches, "piece"):
            done = []
            for r in b.to_pylist():
                if now is None or r["conv_id"] != key:
                    if now is not None:
                        done.append(now.row())
                    key, now = r["conv_id"], _Digest(r["conv_id"])
                now.add(r)
            if done:
                yield _rows(done)
        if now is not None:
            yield _rows([now.row()])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return pieces.mapInArrow(run, schema)


class _Digest:
    """Sums and hashes of one conversation's output."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss, self.agrees = conv_id, hashlib.sha256(), hashlib.sha256(), True
        self.n = self.loss_chars = self.chars = self.tail = 0

    def add(self, r: dict) -> None:
        span = (r["content_start"], r["content_end"])
        turns = parsed(r["piece"])
        for role, text, start, end in turns:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.agrees &= not r["trained"] or (start, end) == span
        self.n += len(turns)
        self.agrees &= len(turns) == 1
        if span[0] is not None:
            said = unescaped(r["piece"][span[0] : span[1]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(r["piece"])
        self.tail = len(r["tail"])

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars + self.tail, self.agrees
