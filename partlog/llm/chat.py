"""Chat formatting in budgeted windows.

``format_conversations`` turns conversations (rows by turn) into training windows.  Running
sums of the turns' tokens choose spans that begin and end at turns.  Every window repeats
the leading system turns; every window but the first also repeats the last turns before it,
as far as they fit into a history budget and leave room for the next turn.  Repeated turns and all but the assistants' texts
stay outside the loss mask, so each assistant text is learned once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts a backslash becomes
two, and ``<|`` becomes ``<\\|``, so that no text can look like a control string; a newline
in a role becomes ``\\n``.  ``read_windows`` undoes this.

Rows are sorted by (conversation, turn, role, text) inside tasks, and tasks walk through
them with one window in memory, so a conversation of any length needs bounded memory.

Defined results: a null text or role is an empty one; rows without a conversation id form
one conversation of their own; several rows with one turn number, repeated rows too, are
turns of their own, ordered by role and text; a turn that is longer than the budget, or than
what the system turns leave of it, makes a window of its own and is never cut; system turns
that are longer than the budget are not repeated; further columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes

WINDOW_TOKENS = 2048
HISTORY_TOKENS = 256
START, END = "<|im_start|>", "<|im_end|>"

WINDOWS = (
    "conv_id bigint, window int, text string, n_tokens bigint, n_turns int,"
    " n_repeated int, loss_start array<int>, loss_end array<int>"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint,"
    " loss_sha256 string, formatted_chars bigint, n_windows bigint"
)

_TOKEN = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str, role: bool = False) -> str:
    if "\\" not in text:
        return text
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def count_tokens(text: str) -> int:
    """Words and punctuation marks, an estimate that needs no vocabulary."""
    return sum(1 for _ in _TOKEN.finditer(text))


class _Conversation:
    """The window being filled, and what later ones repeat of it."""

    def __init__(self, conv_id, window_tokens: int, history_tokens: int):
        self.conv_id, self.budget, self.history_budget = conv_id, window_tokens, history_tokens
        self.system: list[tuple[str, str, int]] = []
        self.history: list[tuple[str, str, int]] = []
        self.fresh: list[tuple[str, str, int]] = []
        self.number, self.used = 0, 0

    def add(self, role: str, text: str) -> list[tuple]:
        turn = (role, text, count_tokens(text) + count_tokens(role) + 2)
        done = []
        if self.fresh and self.used + turn[2] > self.budget:
            done.append(self.close())
        if not self.fresh:  # history gives way to a turn that needs its room
            while self.history and self.used + turn[2] > self.budget:
                self.used -= self.history.pop(0)[2]
        self.fresh.append(turn)
        self.used += turn[2]
        return done

    def close(self) -> tuple:
        window = self._window([*(self.system if self.number else []), *self.history])
        kept = [*self.history, *self.fresh]
        if not self.number:
            self.system = list(takewhile(lambda t: t[0] == "system", self.fresh))
            kept = kept[len(self.system) :]
            if sum(t[2] for t in self.system) > self.budget:
                self.system = []  # nothing would fit beside it
        sums, total = [], 0
        for turn in reversed(kept):
            total += turn[2]
            sums.append(total)
        fits = sum(1 for s in sums if s <= self.history_budget)
        self.history = kept[len(kept) - fits :]
        self.fresh, self.number = [], self.number + 1
        self.used = sum(t[2] for t in self.system) + sum(t[2] for t in self.history)
        return window

    def _window(self, repeated: list[tuple[str, str, int]]) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        turns = [*repeated, *self.fresh]
        for k, (role, text, _) in enumerate(turns):
            head, body = f"{START}{escape(role, role=True)}\n", escape(text)
            if role == "assistant" and k >= len(repeated):
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, f"{END}\n"]
            at += len(head) + len(body) + len(END) + 1
        tokens = sum(t[2] for t in turns)
        return (
            self.conv_id,
            self.number,
            "".join(parts),
            tokens,
            len(turns),
            len(repeated),
            starts,
            ends,
        )


def format_conversations(
    conversations: DataFrame,
    window_tokens: int = WINDOW_TOKENS,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """Windows of each conversation, see the module; columns as in ``WINDOWS``."""
    batch_bytes(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Conversation | None = None
        names = [c.split()[0] for c in WINDOWS.split(", ")]
        for batch in batches:
            out = []
            ids = [i if i is None else int(i) for i in batch["conv_id"]]
            for conv_id, role, text in zip(ids, batch["role"], batch["text"]):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(conv_id, window_tokens, history_tokens)
                out += now.add(role, text)
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([now.close()], columns=names)

    return (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .withColumn("conv_id", F.col("conv_id").cast("string"))
        .mapInPandas(windows, WINDOWS)
    )


def read_windows(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(unescape(m[1], role=True), unescape(m[2])) for m in _TURN.finditer(text)]


def digest_windows(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: columns as in ``DIGESTS``."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        now, state = None, None

        def row():
            turns, loss, n, chars, formatted, count = state
            return (now[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count)

        for batch in batches:
            out = []
            ids = [i if i is None else int(i) for i in batch["conv_id"]]
            for conv_id, text, repeated, starts, ends in zip(
                ids, batch["text"], batch["n_repeated"], batch["loss_start"], batch["loss_end"]
            ):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        out.append(row())
                    now = (conv_id,)
                    state = [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                for role, said in read_windows(text)[repeated:]:
                    state[0].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    state[2] += 1
                for a, b in zip(starts, ends):
                    said = unescape(text[a:b])
                    state[1].update(said.encode("utf-8", "surrogatepass"))
                    state[3] += len(said)
                state[4] += len(text)
                state[5] += 1
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([row()], columns=names)

    return (
        windows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "window")
        .withColumn("conv_id", F.col("conv_id").cast("string"))
        .mapInPandas(digests, DIGESTS)
    )
