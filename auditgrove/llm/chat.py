"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' token counts choose the longest span of new turns that fits
the budget together with the system turn (if the conversation starts with one, every window does) and the repeated history: the last turns before the span, up
to ``history`` tokens. A turn longer than the budget has a window of its own and is never cut. Loss falls on the
assistant turns of the span; system turn and history repeat text, so they are masked.

A turn is written ``<|turn|>role`` newline ``text<|end|>`` newline. In texts and roles a backslash is doubled, then every control
string is broken by a backslash behind its first character, so no text can end a turn; a newline in a role is written behind
a backslash. Reading drops each backslash and takes the next character as it is.

Windows are rows of text and loss spans (code points). Conversations are streamed in order of turn, so a task holds one window
and its history, however long the conversation.

Defined results: null text or role is empty; equal turn numbers are ordered by role, then text; repeated rows are turns
each; a null conv_id is a conversation of its own; an empty table has no windows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.llm.shared import alias_free, bound_batches, emit

BUDGET, HISTORY = 1024, 256
CONTROL = re.compile(re.escape("<|") + "|" + "|".join(re.escape(c) for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")))
HEAD, TAIL = "<|turn|>", "<|end|>\n"
#: Characters of a text whose words are counted at a time.
COUNTED = 1 << 16
ESCAPED = re.compile(r"\\(.)", re.S)
WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int64()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
WINDOWS_DDL = "conv_id long, window long, n_repeated long, text string, loss_starts array<long>, loss_ends array<long>"
REPORT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text."""
    head = "<|turn|>" + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def turn_tokens(role: str, text: str) -> int:
    """Tokens of a turn: its words and the four marks around them. A long text is counted piece by piece."""
    n, inside = 4, False
    for at in range(0, len(text), COUNTED):
        part = text[at : at + COUNTED]
        n += len(part.split()) - (inside and not part[0].isspace())
        inside = not part[-1].isspace()
    return n


class Formatter:
    """Windows of one conversation, fed turn by turn."""

    def __init__(self, conv_id, budget: int, history: int, count):
        self.conv_id, self.budget, self.history, self.count = conv_id, budget, history, count
        self.system, self.first, self.number = None, True, 0
        self.total = 0  # prefix sum before the next turn
        self.past: deque = deque()  # repeated history: (prefix sum before, prefix sum after, turn)
        self.span: list = []

    def add(self, role: str, text: str):
        """Take a turn; gives the window that it closes, if any."""
        cost, done = self.count(role, text), None
        fixed = self.system[0] if self.system else 0
        head = self.span[0][0] - self.past[0][0] if self.span and self.past else 0
        if self.span and fixed + head + self.total + cost - self.span[0][0] > self.budget:
            done = self.close()
        self.span.append((self.total, self.total + cost, (role, text)))
        self.total += cost
        if self.first and role == "system":
            self.system = (cost, (role, text))
        self.first = False
        if done is not None:  # history that leaves no room for the new turn is given up, oldest first
            while self.past and fixed + self.total - self.past[0][0] > self.budget:
                self.past.popleft()
        return done

    def close(self) -> dict:
        repeated = ([self.system[1]] if self.system and self.number else []) + [t for _, _, t in self.past]
        parts, at, starts, ends = [], 0, [], []
        for i, (role, text) in enumerate(repeated + [t for _, _, t in self.span]):
            piece, lo, hi = format_turn(role, text)
            if i >= len(repeated) and role == "assistant":
                starts.append(at + lo)
                ends.append(at + hi)
            parts.append(piece)
            at += len(piece)
        row = {"conv_id": self.conv_id, "window": self.number, "n_repeated": len(repeated), "text": "".join(parts), "loss_starts": starts, "loss_ends": ends}
        self.past.extend(self.span[1:] if self.system and not self.number else self.span)
        while self.past and self.total - self.past[0][0] > self.history:
            self.past.popleft()
        self.span, self.number = [], self.number + 1
        return row


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=turn_tokens) -> DataFrame:
    """Windows of all conversations: conv_id, window, n_repeated (turns repeated at its head), text, loss spans."""
    bound_batches(turns.sparkSession)
    source = alias_free(turns, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        rows.append(now.close())
                    now = Formatter(conv_id, budget, history, count)
                if (done := now.add(role, text)) is not None:
                    rows.append(done)
            if rows:
                yield emit({f.name: [r[f.name] for r in rows] for f in WINDOWS}, WINDOWS)
                rows = []
        if now is not None:
            yield emit({k: [v] for k, v in now.close().items()}, WINDOWS)

    return dealt.mapInArrow(run, WINDOWS_DDL)


def parse_window(text: str, starts: list[int], ends: list[int]) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns (role, text) of a window and the texts under its loss mask, all unescaped."""
    turns, at = [], 0
    while at < len(text):
        line = at + len(HEAD)
        while True:  # the role ends at the first newline that no backslash escapes
            line = text.find("\n", line)
            escapes = 0
            while line > 0 and text[line - 1 - escapes] == "\\":
                escapes += 1
            if escapes % 2 == 0:
                break
            line += 1
        end = text.find(TAIL, line + 1) if line >= 0 else -1  # no escaped text holds the mark
        if end < 0 or not text.startswith(HEAD, at):
            raise ValueError("a window is not a run of whole turns")
        turns.append((unescape(text[at + len(HEAD) : line]), unescape(text[line + 1 : end])))
        at = end + len(TAIL)
    return turns, [unescape(text[s:e]) for s, e in zip(starts, ends)]


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: what they hold and what the loss mask covers."""
    bound_batches(windows.sparkSession)
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        now, rows = None, []

        def done():
            rows.append(now | {"turns_sha256": now["turns_sha256"].hexdigest(), "loss_sha256": now["loss_sha256"].hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        done()
                    now = dict.fromkeys(REPORT.names, 0) | {"conv_id": row["conv_id"], "turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()}
                turns, loss = parse_window(row["text"], row["loss_starts"], row["loss_ends"])
                for role, text in turns[row["n_repeated"] :]:
                    now["turns_sha256"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    now["n_turns"] += 1
                for text in loss:
                    now["loss_sha256"].update(text.encode("utf-8", "surrogatepass"))
                    now["loss_chars"] += len(text)
                now["formatted_chars"] += len(row["text"])
                now["n_windows"] += 1
            if rows:
                yield emit({f.name: [r[f.name] for r in rows] for f in REPORT}, REPORT)
                rows = []
        if now is not None:
            done()
            yield emit({f.name: [r[f.name] for r in rows] for f in REPORT}, REPORT)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return dealt.mapInArrow(run, ddl)
