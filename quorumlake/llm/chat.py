"""Chat formatting (operator 6): a finite-state machine over roles and a declarative template.

The rows of a conversation, in the order of turn, drive a machine of few states. It tells whether the order of roles is
the template's (column ok, and the first offence in error) and emits text segments with a loss flag each: a header, the
text, a footer. A conversation is never held as a whole, however many turns it has: segments leave as they are made.

Control strings inside texts are escaped reversibly: every "<", any number of "!", "|" gets one "!" more, so that "<|"
never stands in an escaped text; in roles, a backslash and a newline are written with a backslash too.

Defined results: null text or role counts as empty; a role that the template does not name is formatted as it is, without
loss, and is an error; rows of equal turn go by role and text, repeated rows are turns of their own; a null conv_id is a
conversation of its own; an empty table gives no rows.
"""

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fit_partitions, small_batches


@dataclass(frozen=True)
class Template:
    """Segments of a turn as (text, loss), {role} and {text} being filled in, and the machine's moves from state to state."""

    turn: tuple = (("<|im_start|>{role}\n", False), ("{text}", None), ("<|im_end|>\n", False))
    loss_roles: frozenset = frozenset({"assistant"})
    start: str = "start"
    moves: tuple = (
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"),
    )
    final: frozenset = frozenset({"assistant"})


CHATML = Template()
_UP, _DOWN = re.compile(r"<(!*)\|"), re.compile(r"<!(!*)\|")


def escape(text: str) -> str:
    return _UP.sub(r"<!\1|", text)


def unescape(text: str) -> str:
    return _DOWN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


SEGMENTS = "conv_id long, segment long, turn_no long, text string, loss boolean, state string, error string"


class Machine:
    """Where a conversation stands."""

    def __init__(self, template: Template):
        self.template, self.moves = template, {(a, role): b for a, role, b in template.moves}
        self.state, self.turns, self.segments, self.error = template.start, 0, 0, None

    def turn(self, role: str, text: str) -> list[tuple]:
        after = self.moves.get((self.state, role))
        if after is None and self.error is None:
            self.error = f"turn {self.turns}: {role!r} after {self.state}"
        self.state = after or role
        out = []
        for form, loss in self.template.turn:
            filled = form.replace("{role}", escape_role(role)) if "{role}" in form else escape(text) if form == "{text}" else form
            out.append((self.segments, self.turns, filled, bool(role in self.template.loss_roles if loss is None else loss), self.state, self.error))
            self.segments += 1
        self.turns += 1
        return out


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments as in SEGMENTS of turns (conv_id, turn, role, text), those of a conversation in order within one partition.

    state and error are the machine's after the turn; a conversation is well formed if its last row has no error and a
    final state.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(fit_partitions(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches):
        machine, now = None, object()
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if machine is None or conv != now:
                    machine, now = Machine(template), conv
                out += [(conv, *x) for x in machine.turn(role, text)]
            if out:
                yield _rows(out, ["conv_id", "segment", "turn_no", "text", "loss", "state", "error"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()])

    return dealt.select("conv_id", "role", "text").mapInArrow(segments, SEGMENTS)


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, ok boolean, error string"


class _Reader:
    """Parses the formatted text of a conversation, fed segment by segment, back into turns, and takes digests."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.buffer, self.state, self.error = "", "start", None

    def feed(self, text: str, loss: bool, state: str, error: str | None) -> None:
        self.chars += len(text)
        self.state, self.error = state, error
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.buffer += text
        if self.buffer.endswith("<|im_end|>\n"):
            head, body = self.buffer.removesuffix("<|im_end|>\n").removeprefix("<|im_start|>").split("\n", 1)
            self.all.update(f"{unescape_role(head)}\n{unescape(body)}\n".encode())
            self.turns, self.buffer = self.turns + 1, ""

    def row(self, template: Template) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {self.conv}: text after the last turn")
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.error is None and self.state in template.final, self.error


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """DIGESTS of each conversation, from its segments alone, in whatever order they come."""
    small_batches(segments.sparkSession)
    segments = segments.repartition(fit_partitions(segments), "conv_id").sortWithinPartitions("conv_id", "segment")

    def digests(batches):
        reader, types = None, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        for batch in batches:
            out = []
            columns = [batch.column(x).to_pylist() for x in ("conv_id", "segment", "text", "loss", "state", "error")]
            for conv, segment, text, loss, state, error in zip(*columns, strict=True):
                if segment == 0:
                    if reader:
                        out.append(reader.row(template))
                    reader = _Reader(conv)
                reader.feed(text, loss, state, error)
            if out:
                yield _rows(out, names, types)
        if reader:
            yield _rows([reader.row(template)], names, types)

    return segments.mapInArrow(digests, DIGESTS)
