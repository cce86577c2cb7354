"""Chat formatting in budgeted windows.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``, or ``<|im_past|>role...`` where a window repeats it;
control strings inside roles and texts are escaped reversibly. Prefix sums of the tokens of the turns so formatted
cut a conversation into turn-aligned windows within a budget. Each window opens with the conversation's system turn
and repeats a limited history; only texts of assistant turns that are new in the window are targets, so each is
trained on once.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks
from veridoc.llm.token_counts import count_texts

OPEN, PAST, CLOSE = "<|im_start|>", "<|im_past|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_(start|past)\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\([\\|n])")


def escape(text: str, line: bool = False) -> str:
    """No control string begins inside the result; line: no line end either."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def formatted_turn(role: str, text: str, mark: str = OPEN) -> str:
    return f"{mark}{escape(role, True)}\n{escape(text)}{CLOSE}"


def parse(formatted: str) -> list[tuple[bool, str, str]]:
    """(whether the turn is repeated, role, text) of each turn of a formatted window."""
    return [(mark == "past", unescape(r), unescape(t)) for mark, r, t in _TURN.findall(formatted)]


class Windows:
    """Takes one conversation's turns (role, text, tokens when formatted) in order and gives its windows as they
    fill up. past: tokens by which a repeated turn differs from a new one."""

    def __init__(self, budget: int, history: int, past: int = 0):
        self.budget, self.history, self.past = budget, history, past
        self.system: tuple | None = None
        self.recent: list[tuple] = []
        self.shown: list[tuple] = []
        self.fresh: list[tuple] = []
        self.used = 0

    def add(self, turn: tuple) -> tuple | None:
        """Adds a turn; returns a window if the turn opens another one."""
        done = None
        if self.fresh and self.used + turn[2] > self.budget:
            done = self.close()
            self.fresh, self.used = [], turn[2]
            lead = [self.system] if self.system and self.used + self.system[2] + self.past <= self.budget else []
            self.used += sum(t[2] + self.past for t in lead)
            kept, told = [], 0
            for old in reversed(self.recent):
                cost = old[2] + self.past
                if self.used + cost > self.budget or told + cost > self.history:
                    break
                kept.append(old)
                told += cost
                self.used += cost
            self.shown = lead + kept[::-1]
        else:
            self.used += turn[2]
        self.fresh.append(turn)
        if turn[0] == "system" and self.system is None and not self.recent:
            self.system = turn
        else:
            self.recent.append(turn)
            while len(self.recent) > 1 and sum(t[2] + self.past for t in self.recent[1:]) >= self.history:
                self.recent.pop(0)
        return done

    def close(self) -> tuple:
        """(formatted, starts and ends of the target spans, repeated turns)."""
        parts, spans, at = [formatted_turn(role, text, PAST) for role, text, _ in self.shown], [], 0
        at = sum(map(len, parts))
        for role, text, _ in self.fresh:
            turn = formatted_turn(role, text)
            if role == "assistant" and text:
                spans.append((at + len(OPEN) + len(escape(role, True)) + 1, at + len(turn) - len(CLOSE)))
            parts.append(turn)
            at += len(turn)
        return "".join(parts), [s for s, _ in spans], [e for _, e in spans], len(self.shown)


WINDOW = "window int, formatted string, starts array<int>, ends array<int>, repeated int"


def format_windows(turns: DataFrame, tokenizer: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, WINDOW's columns) of conversations given as (conv_id, turn, role, text).

    A window of two turns or more has at most ``budget`` tokens, marks and escapes included. A turn that is longer
    has a window of its own and is never cut; the system turn leads each later window in which it fits beside a
    new turn. starts and ends are code-point spans of the targets, repeated the number of leading turns that an
    earlier window has, too; the text marks them as well. Null texts and roles count as empty; a null conv_id is a
    conversation of its own; turns with equal numbers follow each other by role and text, and repeated rows stay.
    Tokens are counted where the rows are read; then a conversation streams through one task, window by window,
    and is never held whole. Extra columns are left out; an empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = ["conv_id", "turn", "role", "text", "n"]

    def counted(batches):
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            sizes = [n for lo, hi in blocks(texts, 1 << 20) for n in count_texts([formatted_turn(r, t) for r, t in zip(roles[lo:hi], texts[lo:hi], strict=True)], tokenizer)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], named)

    kind = rows.schema["conv_id"].dataType.simpleString()
    sized = rows.mapInArrow(counted, f"conv_id {kind}, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, n long")
    sized = sized.repartition("conv_id").sortWithinPartitions(*named).select("conv_id", "role", "text", "n")
    kinds = pa.schema([("window", pa.int32()), ("formatted", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("repeated", pa.int32())])

    def run(batches):
        # a mark is several pre-tokens, of which one differs; a turn ends in a newline, so tokens add up
        past = count_texts([PAST], tokenizer)[0] - count_texts([OPEN], tokenizer)[0]
        current, state, number, kind = None, None, 0, None
        out: list[tuple] = []

        def batch():
            nonlocal out
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate([kind, *kinds.types])]
            out = []
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *kinds.names])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, role, text, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or conv != current:
                    if state:
                        out.append((current, number, *state.close()))
                    current, state, number = conv, Windows(budget, history, past), 0
                if done := state.add((role, text, n)):
                    out.append((conv, number, *done))
                    number += 1
                if len(out) >= 500:
                    yield batch()
        if state:
            out.append((current, number, *state.close()))
        if out:
            yield batch()

    return sized.mapInArrow(run, f"conv_id {kind}, {WINDOW}")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def window_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what its formatted windows say when they are read back: turns and targets once each.

    Takes rows of format_windows in any order, from any table; they are ordered by conv_id and window, and turns
    marked as repeated are passed over. An empty table gives no rows."""
    rows = windows.select("conv_id", "window", "formatted", "starts", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        current, state, kind = None, None, None
        out: list[tuple] = []

        def finish():
            out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def batch():
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *[f.split()[0] for f in DIGEST.split(", ")]])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, _, formatted, starts, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or conv != current:
                    if state:
                        finish()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for past, role, text in parse(formatted):
                    if not past:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                for s, e in zip(starts, ends, strict=True):
                    target = unescape(formatted[s:e])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(formatted)
                state[5] += 1
            if len(out) > 1000:
                yield batch()
        if state:
            finish()
        if out:
            yield batch()

    return rows.mapInArrow(run, f"conv_id {windows.schema['conv_id'].dataType.simpleString()}, {DIGEST}")
