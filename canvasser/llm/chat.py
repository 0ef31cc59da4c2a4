"""Chat formatting: messages of typed content parts become one marked text with a loss mask.

A message holds parts of a kind (text, image, audio, document). A visitor with one method for
each kind flattens them in order: text is escaped, any other part becomes a placeholder, and its
reference, place and expanded token count are recorded as an attachment. The template marks turns::

    <turn user>
    What is on <image 1>?
    </turn>

Control strings inside texts are escaped by a backslash in front of them, and backslashes that
stand directly before a control string are doubled; everything else stays as it is. So a control
string is real if an even number of backslashes precedes it, and reading back gives the very text.

``format_turns`` works message by message where the rows are. ``in_order`` then deals turns by
conversation, sorts them and adds the place of each in the text of its conversation: a
conversation is the concatenation of its turns. Conversations are never held whole: ``digest``
reads them back turn by turn with running hashes, so memory is bounded by a batch of turns
whatever the length of a conversation.

Defined results: a null text is empty, a null role is the empty role, null parts are left out. A
part of any other kind is a placeholder ``<other n>`` of no tokens. Sizes that are missing or not
positive count as the least size there is (one tile, one frame, one page). Turns go by turn number
(null last), then role, then formatted text, so repeated rows are all kept, side by side. Rows without a
conversation id are one conversation of id null. Empty tables give empty results. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm.common import spans

TRAINED = "assistant"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,place:int,tokens:long>"
TURN = f"conv_id long, turn long, role string, formatted string, loss_from int, loss_to int, attachments array<{ATTACHMENT}>, expanded_tokens long"
_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int64())])
_TURN = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
    ("attachments", pa.list_(_ATTACHMENT)), ("expanded_tokens", pa.int64()),
])
KINDS = ("image", "audio", "document", "other")
CONTROLS = ("<turn ", "</turn>", *(f"<{k} " for k in KINDS))


@dataclass(frozen=True)
class Sizes:
    """What a placeholder expands to: tokens of an image tile, an audio second, a document page."""

    tile: int = 28  # edge of an image tile in pixels; a tile is one token
    per_second: float = 25.0
    per_page: int = 256


class Escapes:
    """Reversible escaping of control strings.

    The first character of every control string occurs nowhere else in any of them, nor is it a
    backslash, so control strings never overlap.
    """

    def __init__(self, controls: tuple[str, ...] = CONTROLS):
        heads = {c[:1] for c in controls}
        if not all(controls) or "\\" in "".join(controls) or any(h in c[1:] for c in controls for h in heads):
            raise ValueError("control strings must not overlap or hold a backslash")
        named = "|".join(map(re.escape, sorted(controls, key=len, reverse=True)))
        self._before = re.compile(rf"(\\*)({named})")
        self._tail = re.compile(r"\\+\Z")

    def escape(self, text: str, closed: bool = False) -> str:
        """The text with its control strings escaped; ``closed`` if a real one follows at once."""
        text = self._before.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
        return self._tail.sub(lambda m: m[0] * 2, text) if closed else text

    def unescape(self, text: str, closed: bool = False) -> str:
        """The text that ``escape`` was given."""
        if closed:
            text = self._tail.sub(lambda m: m[0][: len(m[0]) // 2], text)
        return self._before.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)

    def real(self, text: str) -> Iterator[tuple[int, str]]:
        """Place and string of each control string that is not escaped."""
        for m in self._before.finditer(text):
            if len(m[1]) % 2 == 0:
                yield m.start(2), m[2]


_ROLE = str.maketrans({"\\": "\\\\", "<": "\\<", ">": "\\>", "\n": "\\n"})
_HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n")
_FOOT = "\n</turn>\n"


def escape_role(role: str) -> str:
    return role.translate(_ROLE)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Flattener:
    """Visits the parts of one message in order; ``body`` and ``attachments`` hold what came out."""

    sizes: Sizes = field(default_factory=Sizes)
    escapes: Escapes = field(default_factory=Escapes)
    attachments: list[dict] = field(default_factory=list)
    _done: list[str] = field(default_factory=list)
    _open: list[str] = field(default_factory=list)  # text since the last placeholder, escaped as one

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, "visit_" + (part.get("kind") or ""), self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self._open.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (-(-max(_number(part, k), 1) // self.sizes.tile) for k in ("width", "height"))
        self._attach("image", part, int(across) * int(down))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round(_number(part, "seconds") * self.sizes.per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(max(_number(part, "pages"), 1)) * self.sizes.per_page)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._done += [self.escapes.escape("".join(self._open), closed=True)]
        self._open.clear()
        place = len(self.attachments) + 1
        self._done.append(f"<{kind} {place}>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "place": place, "tokens": tokens})

    @property
    def body(self) -> str:
        return "".join(self._done) + self.escapes.escape("".join(self._open))


def _number(part: dict, name: str) -> float:
    """The size of this name; 0 where there is none."""
    value = part.get(name)
    return float(value) if value is not None and 0 < value < float("inf") else 0.0


def flatten(parts: list, sizes: Sizes, escapes: Escapes) -> tuple[str, list[dict]]:
    """Escaped text with placeholders, and the attachments, of the parts of one message."""
    visitor = Flattener(sizes, escapes)
    for part in parts:
        visitor.visit(part)
    return visitor.body, visitor.attachments


def read_turn(formatted: str, escapes: Escapes) -> tuple[str, list]:
    """Role and parts of one formatted turn: texts as strings, placeholders as (kind, place)."""
    head = _HEAD.match(formatted)
    if not head or not formatted.endswith(_FOOT):
        raise ValueError("not a formatted turn")
    return unescape_role(head[1]), read_body(formatted[head.end() : -len(_FOOT)], escapes)


def read_body(body: str, escapes: Escapes) -> list:
    parts, at = [], 0
    for place, control in escapes.real(body):
        kind = control[1:].strip()
        if kind not in KINDS:
            raise ValueError(f"{control!r} inside a turn")
        end = body.index(">", place)
        parts += [escapes.unescape(body[at:place], closed=True), (kind, int(body[place + len(control) : end]))]
        at = end + 1
    return [p for p in [*parts, escapes.unescape(body[at:])] if p != ""]


def text_parts(messages: DataFrame, text: str = "text", into: str = "parts") -> DataFrame:
    """Messages of plain text as messages of one text part."""
    empty = ["cast(null AS string) AS ref", "cast(null AS int) AS width", "cast(null AS int) AS height", "cast(null AS double) AS seconds", "cast(null AS int) AS pages"]
    one = F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), *map(F.expr, empty))
    return messages.withColumn(into, F.array(one).cast(f"array<{PART}>"))


def format_turns(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    trained: str = TRAINED, sizes: Sizes = Sizes(), controls: tuple[str, ...] = (),
) -> DataFrame:
    """Every message as one turn of the template (columns ``TURN``).

    ``loss_from`` and ``loss_to`` bound the code points of ``formatted`` that are trained on: the
    body of messages of the role ``trained``; elsewhere both are 0. ``controls`` are further
    strings to escape, such as the special tokens of a tokenizer.
    """
    names = (*CONTROLS, *controls)
    Escapes(names)  # fail early
    rows = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes = Escapes(names)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                who = row["role"] or ""
                body, attachments = flatten(row["parts"] or [], sizes, escapes)
                head = f"<turn {escape_role(who)}>\n"
                begin, end = (len(head), len(head) + len(body)) if who == trained else (0, 0)
                tokens = sum(a["tokens"] for a in attachments)
                out.append((row["conv_id"], row["turn"], who, head + body + _FOOT, begin, end, attachments, tokens))
            yield _batch(out, _TURN)

    return rows.mapInArrow(run, TURN)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sorted_turns(turns: DataFrame) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "formatted"]
    return turns.repartition("conv_id").sortWithinPartitions(*order)


def in_order(turns: DataFrame) -> DataFrame:
    """The turns with ``at``, the place (code points) of each in the text of its conversation.

    A conversation's text is the concatenation of ``formatted`` in the order of ``at``. One pass
    over sorted rows that holds a number per conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, begun = None, 0, False
        for batch in batches:
            places = []
            for conv_id, text in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist()):
                if not begun or conv_id != conv:
                    conv, at, begun = conv_id, 0, True
                places.append(at)
                at += len(text)
            yield batch.append_column("at", pa.array(places, pa.int64()))

    return _sorted_turns(turns).mapInArrow(run, TURN + ", at long")


class _Running:
    """Figures of one conversation while its turns go by."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.size, self.loss = conv_id, 0, 0, 0
        self.turns, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int, end: int, escapes: Escapes) -> None:
        role, parts = read_turn(formatted, escapes)
        text = "".join(p if isinstance(p, str) else f"<{p[0]} {p[1]}>" for p in parts)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.n += 1
        self.size += len(formatted)
        if end > begin:
            learned = "".join(p for p in read_body(formatted[begin:end], escapes) if isinstance(p, str))
            self.trained.update(learned.encode("utf-8", "surrogatepass"))
            self.loss += len(learned)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.trained.hexdigest(), self.size


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest(turns: DataFrame, controls: tuple[str, ...] = ()) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    All of it is read back from the formatted text and its loss mask.
    """
    names = (*CONTROLS, *controls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes, state = Escapes(names), None
        for batch in batches:
            for a, b in spans(pc.binary_length(batch["formatted"]).to_pylist(), 4_000_000):
                part, done = batch.slice(a, b - a), []
                for conv_id, text, begin, end in zip(*(part[c].to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                    if state is None or state.conv_id != conv_id:
                        if state is not None:
                            done.append(state.row())
                        state = _Running(conv_id)
                    state.add(text, begin, end, escapes)
                yield _batch(done, _DIGEST)
        if state is not None:
            yield _batch([state.row()], _DIGEST)

    rows = _sorted_turns(turns).select("conv_id", "formatted", "loss_from", "loss_to")
    return rows.mapInArrow(run, DIGEST)
