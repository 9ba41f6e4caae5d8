"""Chat formatting by incremental rendering of a black-box template.

A template is any object with ``render(turns) -> str``.  Prefixes of a conversation that grow by one
turn are rendered, and consecutive outputs compared: what is new is the turn's span, and an output
that does not begin with the one before shows a template that rewrites history.  Where the text lies
in the span of a turn that the model learns from is found by rendering that turn with two probe texts.

By default the prefixes are rendered whole, every one of them, so a change anywhere before is found at
the turn that makes it.  A template's class may declare how many turns before a turn can change how it
is rendered (``memory``); only what the class itself declares counts, as a subclass may render in another
way.  Then only those turns are rendered again, and a long conversation takes time in proportion to its
length.  The declaration is held against whole prefixes: against each of the first ``WHOLE`` turns, then after
twice as many each time, and at the end, at any length, so a task holds such a conversation, as it does one whose
template declares nothing.  A template that inherits ``render`` from ``Turnwise`` and says itself how one turn is
rendered has nothing to hold: its whole is its turns one by one, so its conversations are streamed at any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

#: So many turns are each held against the whole.
WHOLE = 32
Turn = tuple[str, str]


class HistoryRewritten(ValueError):
    """The template's output for a longer conversation does not begin with that for a shorter one."""


class Turnwise:
    """A template whose whole is what its turns are one by one."""

    def turn(self, role: str, text: str) -> str:
        raise NotImplementedError

    def render(self, turns: Sequence[Turn]) -> str:
        return "".join(self.turn(role, text) for role, text in turns)


class MarkedTurns(Turnwise):
    """User turns stand between [INST] and [/INST], all others between <s> and </s> with their role.

    Within roles and texts a backslash is doubled, and one is put into every control string, after
    its first character; so no control string is left, and dropping the backslashes undoes it.
    """

    #: How many turns before a turn can change how it is rendered; holds for this class alone.
    memory: int | None = 0
    CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[:]")
    _control = re.compile("|".join(map(re.escape, CONTROLS)))
    _turn = re.compile(r"\[INST\](.*?)\[/INST\]|<s>(.*?)\[:\](.*?)</s>", re.DOTALL)
    _escaped = re.compile(r"\\(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def turn(self, role: str, text: str) -> str:
        return f"[INST]{self.escape(text)}[/INST]" if role == "user" else f"<s>{self.escape(role)}[:]{self.escape(text)}</s>"

    def parse(self, text: str) -> list[Turn]:
        """The turns that were rendered to ``text``."""
        out, at = [], 0
        for m in self._turn.finditer(text):
            if m.start() != at:
                break
            out.append(("user", self.unescape(m[1])) if m[2] is None else (self.unescape(m[2]), self.unescape(m[3])))
            at = m.end()
        if at != len(text):
            raise ValueError(f"not a rendered conversation at character {at}")
        return out


class Incremental:
    """Takes a conversation turn by turn: (formatted, loss start and stop in it, or None).

    ``close`` ends it; it and ``add`` raise HistoryRewritten where the template changes what was
    rendered before.  With ``kept_chars`` a declared memory is trusted beyond so many characters.
    """

    def __init__(self, template, learned: frozenset[str] = frozenset(("assistant",)), kept_chars: int | None = None):
        self.template, self.learned, self.kept_chars = template, learned, kept_chars
        self.memory: int | None = vars(type(template)).get("memory")
        self.turns: list[Turn] = []
        self.pieces: list[str] = []
        self.before = ""
        turnwise = type(template).render is Turnwise.render and "turn" in vars(type(template)) and self.memory == 0
        self.chars, self.seen, self.checked, self.whole = 0, 0, 0, not turnwise

    def add(self, role: str, text: str) -> tuple[str, int | None, int | None]:
        if self.memory is None:
            recent, before = self.turns, self.before
        else:
            recent = self.turns[max(0, len(self.turns) - max(1, self.memory)) :]
            before = self.template.render(recent) if recent else ""
        now = self.template.render([*recent, (role, text)])
        if not now.startswith(before):
            raise HistoryRewritten(f"turn {self.seen} changes what was rendered before it")
        start = stop = None
        if role in self.learned:
            one, two = (self.template.render([*recent, (role, probe)]) for probe in "ab")
            head = next((i for i in range(len(before), min(len(one), len(two))) if one[i] != two[i]), None)
            if head is None or one[head + 1 :] != two[head + 1 :]:
                raise ValueError("the template does not show a turn's text once")
            start, stop = head - len(before), len(now) - (len(one) - head - 1) - len(before)
        self.turns.append((role, text))
        self.seen, self.chars = self.seen + 1, self.chars + len(text)
        piece = now[len(before) :]
        if self.memory is None:
            self.before = now
            return piece, start, stop
        over = self.kept_chars is not None and self.chars > self.kept_chars
        if self.whole:
            self.pieces.append(piece)
            if self.seen <= WHOLE or self.seen >= 2 * self.checked or over:
                self.close()
        if over:
            self.whole, self.pieces = False, []
        if not self.whole:
            del self.turns[: len(self.turns) - max(1, self.memory)]
        return piece, start, stop

    def close(self) -> None:
        """Holds the turns, rendered at once, against their pieces; without a declared memory that is done already."""
        if self.memory is not None and self.whole and self.checked != self.seen and self.template.render(self.turns) != "".join(self.pieces):
            raise HistoryRewritten(f"after turn {self.seen - 1} the whole is rendered differently from its turns one by one")
        self.checked = self.seen


SCHEMA = "conv_id long, place long, role string, formatted string, start long, stop long, loss_start long, loss_stop long"


def _formatted(template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state, place, offset = Incremental(template), 0, 0
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if current != (conv,):
                    state.close()
                    current, state, place, offset = (conv,), Incremental(template), 0, 0
                role, text = role or "", text or ""
                piece, a, b = state.add(role, text)
                values = (conv, place, role, piece, offset, offset + len(piece), None if a is None else offset + a, None if b is None else offset + b)
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                place, offset = place + 1, offset + len(piece)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["conv_id", "place", "role", "formatted", "start", "stop", "loss_start", "loss_stop"])
        state.close()

    return run


def format_turns(conversations: DataFrame, template=None) -> DataFrame:
    """One row per turn, each conversation's together and in order: conv_id, place, role, formatted
    (the turn's part of the rendered conversation), start and stop (in characters of the whole),
    loss_start and loss_stop (of the text that is learned; null for other turns).

    ``conversations`` has conv_id, turn, role, text.  Turns sort by turn, then role, then text (null
    first), so ties and repeated rows have one order.  Null roles and texts are empty; a null conv_id
    is an id like any other.  Conversations stream through sorted partitions; none is gathered.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(ordered, _formatted(template or MarkedTurns()), SCHEMA)


def _read_back(template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def out(done: list[dict]) -> pa.RecordBatch:
            values = [(s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"]) for s in done]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*values, strict=True), kinds, strict=True)], names)

        for batch in batches:
            done = []
            for conv, place, piece, start, a, b in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "formatted", "start", "loss_start", "loss_stop")], strict=True):
                if place == 0:
                    if state:
                        done.append(state)
                    state = {"conv": conv, "turns": 0, "all": sha256(), "chars": 0, "loss": sha256(), "size": 0}
                for role, text in template.parse(piece):
                    state["all"].update(f"{role}\n{text}\n".encode())
                    state["turns"] += 1
                if a is not None:
                    text = template.unescape(piece[a - start : b - start])
                    state["loss"].update(text.encode())
                    state["chars"] += len(text)
                state["size"] += len(piece)
            if done:
                yield out(done)
        if state:
            yield out([state])

    return run


def conversation_digests(turns: DataFrame, template=None) -> DataFrame:
    """Read ``format_turns``' output back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  It must get that output as it is, with its order."""
    return mapped(turns, _read_back(template or MarkedTurns()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
