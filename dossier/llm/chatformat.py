"""Chat formatting whose output is parsed back and compared with its source."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN = "<s>"
TEMPLATE = {
    "system": ("[SYS]", "[/SYS]"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("[REPLY]", "</s>"),
}
NAMED = ("[ROLE]", "[AS]", "[/AS]")
CONTROL = [BEGIN, *[m for pair in TEMPLATE.values() for m in pair], *NAMED]

MARK = re.compile("|".join(re.escape(m) for m in CONTROL))
_INNER = "|".join(re.escape(m[1:]) for m in CONTROL)
ESCAPABLE = re.compile(rf"([<\[])(\\*)(?={_INNER})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_INNER})")
OPENERS = {pair[0]: (role, pair[1]) for role, pair in TEMPLATE.items()}


class GrammarError(ValueError):
    """A rendered text that the grammar does not allow."""


def escape(text: str) -> str:
    """Every control string, escaped or not, gets one more backslash after its first character."""
    return ESCAPABLE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


class Parser:
    """Deterministic parser of ``<s> turn*``, fed piece by piece.

    A turn is an opener, its text without control strings, and its closer; a
    role outside the template stands between ``[ROLE]`` and ``[AS]``. Pieces must
    not cut a control string. Yields (role, text, start of the text's escaped form, its length).
    """

    def __init__(self):
        self.at = 0
        self.state = "begin"
        self.role = self.closer = None
        self.text: list[str] = []
        self.start = 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        last = 0
        for mark in MARK.finditer(piece):
            between = piece[last : mark.start()]
            yield from self._step(between, mark.group(), self.at + mark.start())
            last = mark.end()
        if last < len(piece):
            if self.state in ("begin", "turn"):
                raise GrammarError("text outside a turn")
            self.text.append(piece[last:])
        self.at += len(piece)

    def _step(self, between: str, mark: str, place: int) -> Iterator[tuple[str, str, int, int]]:
        after = place + len(mark)
        if self.state == "begin":
            if mark != BEGIN or between:
                raise GrammarError("no begin")
            self.state = "turn"
        elif self.state == "turn":
            if between:
                raise GrammarError("text outside a turn")
            if mark in OPENERS:
                self.role, self.closer = OPENERS[mark]
                self.state = "text"
            elif mark == NAMED[0]:
                self.state = "role"
            else:
                raise GrammarError(f"{mark} opens no turn")
            self.start, self.text = after, []
        elif self.state == "role":
            if mark != NAMED[1]:
                raise GrammarError(f"{mark} in a role")
            self.role = unescape("".join([*self.text, between]))
            self.state, self.closer = "text", NAMED[2]
            self.start, self.text = after, []
        else:
            if mark != self.closer:
                raise GrammarError(f"{mark} in a text")
            raw = "".join([*self.text, between])
            yield self.role, unescape(raw), self.start, len(raw)
            self.state, self.text = "turn", []

    def close(self) -> None:
        if self.state not in ("begin", "turn"):
            raise GrammarError("unfinished turn")


def _render(role: str, text: str, times: int) -> tuple[str, int, int]:
    """A turn with its contents escaped ``times`` times, and where its text lies."""
    for _ in range(times):
        text = escape(text)
    if role in TEMPLATE:
        opener, closer = TEMPLATE[role]
    else:
        for _ in range(times):
            role = escape(role)
        opener, closer = f"{NAMED[0]}{role}{NAMED[1]}", NAMED[2]
    return f"{opener}{text}{closer}", len(opener), len(text)


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn as text that parses back to itself, and the place and length of its text.

    The plain form is parsed first; content is escaped until the parser gives
    back the source. Once is enough for any content, as an escaped text holds no
    control string and unescaping undoes exactly one escape.
    """
    role, text = role or "", text or ""
    for times in range(2):
        rendered = _render(role, text, times)
        parser = Parser()
        try:
            turns = [*parser.feed(BEGIN), *parser.feed(rendered[0])]
            parser.close()
        except GrammarError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return rendered
    raise GrammarError("no escape gives the turn back")


def format_turns(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: its rendered text, and the place of its loss inside it.

    The formatted conversation is ``<s>`` and the ``rendered`` texts in the order
    of (turn, role, text), nulls first; equal rows are turns of their own. Loss
    covers the text of assistant turns: ``loss_start`` and ``loss_length`` in
    code points of ``rendered``, null for others. Each row is rendered and
    parsed back by itself, whatever the size of its conversation. A null text or
    role counts as empty; rows with a null conversation form one; an empty table
    gives no rows; other columns are not read.
    """
    chosen = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        from dossier.llm.chatformat import render_turn

        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            loss = [r == "assistant" for r in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array([o[1] if x else None for o, x in zip(out, loss, strict=True)], pa.int64()),
                    pa.array([o[2] if x else None for o, x in zip(out, loss, strict=True)], pa.int64()),
                ],
                [*batch.schema.names, "rendered", "loss_start", "loss_length"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, rendered string, loss_start long, loss_length long"
    return chosen.mapInArrow(run, schema)


class _Reader:
    """Reads one conversation's output back: its turns, and the text under its loss mask."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.parser = Parser()
        self.turns = self.chars = self.loss_chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.add(BEGIN, None, None)

    def add(self, rendered: str, loss_start: int | None, loss_length: int | None) -> None:
        for role, text, _, _ in self.parser.feed(rendered):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(rendered)
        if loss_start is not None:
            under = unescape(rendered[loss_start : loss_start + loss_length])
            self.loss_chars += len(under)
            self.loss_hash.update(under.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        self.parser.close()
        return (self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars)


def _digests(rows: Iterable[tuple]) -> Iterator[tuple]:
    reader = None
    for conv_id, rendered, start, length in rows:
        if reader is None or reader.conv_id != conv_id:
            if reader is not None:
                yield reader.row()
            reader = _Reader(conv_id)
        reader.add(rendered, start, length)
    if reader is not None:
        yield reader.row()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_turns``.

    The whole output is parsed again turn after turn and hashed as it goes by:
    rows are sorted inside the partitions of their conversations and streamed,
    so a task holds one turn, never a conversation. The digest of a conversation
    runs over all its turns in order and is the only step bound to one task.
    """
    kind = formatted.schema["conv_id"].dataType

    def run(batches):
        import pyarrow as pa

        from dossier.llm.chatformat import _digests

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        held = []

        def table():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names
            )

        for row in _digests(rows()):
            held.append(row)
            if len(held) == 10_000:
                yield table()
                held.clear()
        if held:
            yield table()

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(kind)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "rendered", "loss_start", "loss_length").mapInArrow(
        run,
        f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
