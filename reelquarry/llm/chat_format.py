"""Conversations as training texts: windows of whole turns under a token budget, with a loss mask.

Prefix sums of the turns' tokens choose the spans: a window takes new turns while the sum since its first new turn fits.
Every window begins with the system turn, then repeats as many whole turns before its new ones as a second, smaller budget
lets it. Repeated turns are under no loss, so each assistant text is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare, to_batch

#: Tokens of a window, and of the turns before its new ones that it repeats.
BUDGET, HISTORY = 512, 128
#: Tokens that a turn's marks are counted as.
MARK_TOKENS = 6
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"

OPEN, CLOSE = "<s>[{}]\n", "</s>\n"
#: Strings that templates of chat models give a meaning. Fixed values.
CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<bos>", "<eos>", "<pad>", "<unk>",
)
#: A control string with any number of backslashes after its first character.
_CONTROL = re.compile("|".join(rf"({re.escape(c[0])})(\\*+)({re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(r"<s>\[([^\]\n]*)\]\n(.*?)</s>\n", re.S)


def _spread(found: re.Match, change: Callable[[str], str]) -> str:
    first, slashes, rest = (x for x in found.groups() if x is not None)
    return first + change(slashes) + rest


def escape(text: str) -> str:
    """Put one more backslash after the first character of each control string, so that none is left as it was."""
    if "<" not in text and "[" not in text:  # where all control strings begin
        return text
    return _CONTROL.sub(lambda m: _spread(m, lambda s: s + "\\"), text)


def unescape(text: str) -> str:
    """Take one backslash away where escape() put it."""
    if "\\" not in text:
        return text
    return _CONTROL.sub(lambda m: _spread(m, lambda s: s[1:]), text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted text."""
    return [(unquote(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def word_tokens(text: str) -> int:
    """Words and single signs: a count of tokens without a vocabulary."""
    return len(re.findall(r"\w+|[^\w\s]", text))


@cache
def _piece_model(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_tokens(path: str) -> Callable[[str], int]:
    """A counter of a SentencePiece model's tokens; the file is read here and sent along with the function."""
    with open(path, "rb") as file:
        model = file.read()
    return lambda text: len(_piece_model(model).encode(text))


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int
    total: int  #: prefix sum with this turn


@dataclass
class _Conversation:
    """Takes turns one by one and gives windows. It holds a window's turns and those that the next may repeat."""

    conv_id: int | None
    budget: int
    history: int
    system: _Turn | None = None
    before: deque[_Turn] = field(default_factory=deque)
    new: list[_Turn] = field(default_factory=list)
    total: int = 0
    began: int = 0  #: prefix sum before the first new turn
    windows: int = 0
    turns: int = 0

    def room(self) -> int:
        repeated = sum(t.tokens for t in self.before) + (self.system.tokens if self.system and self.windows else 0)
        return self.budget - repeated

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        turn = _Turn(role, text, tokens, self.total + tokens)
        window = self.close() if self.new and turn.total - self.began > self.room() else None
        if not self.turns and role == SYSTEM_ROLE:
            self.system = turn
        self.new.append(turn)
        self.total = turn.total
        self.turns += 1
        return window

    def close(self) -> tuple | None:
        if not self.new:
            return None
        repeated = [self.system] if self.system and self.windows else []
        repeated += self.before
        parts, spans, at = [], [], 0
        for k, turn in enumerate(repeated + self.new):
            opened, text = OPEN.format(quote(turn.role, safe="")), escape(turn.text)
            parts += [opened, text, CLOSE]
            if turn.role == TARGET_ROLE and k >= len(repeated):
                spans.append([at + len(opened), at + len(opened) + len(text)])
            at += len(opened) + len(text) + len(CLOSE)
        tokens = sum(t.tokens for t in repeated + self.new)
        out = (self.conv_id, self.windows, len(repeated), len(self.new), "".join(parts), spans, tokens, tokens > self.budget)
        # what the next window repeats: whole turns from the last back, but the system turn has its own place
        self.before.extend(t for t in self.new if t is not self.system)
        while self.before and sum(t.tokens for t in self.before) > self.history:
            self.before.popleft()
        self.new, self.began = [], self.total
        self.windows += 1
        return out


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("formatted", pa.string()),
     ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())]
)


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    count: Callable[[str], int] = word_tokens,
) -> DataFrame:
    """(conv_id, window, n_repeated, n_new, formatted, loss_spans, n_tokens, over_budget) for each window.

    Rows are taken by turn, then role, then text; repeated rows are turns of their own. The first turn, if its role is
    system, leads every window. loss_spans are [start, end) code points of `formatted` that hold the texts of new assistant
    turns. A turn that alone exceeds the budget gets a window, with over_budget true. Null roles and texts count as empty,
    null turns come first, and rows with a null conv_id are one conversation. Memory is bounded by a window and the
    history, not by a conversation. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    prepare(turns.sparkSession)
    if not 0 <= history < budget:
        raise ValueError("the history must be less than the budget")
    rows = turns.select(
        column(conv_col).cast("long").alias("conv_id"),
        column(turn_col).cast("long").alias("turn"),
        F.coalesce(column(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            out = []
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now and (window := now.close()):
                        out.append(window)
                    now = _Conversation(conv_id, budget, history)
                if window := now.add(role, text, count(text) + MARK_TOKENS):
                    out.append(window)
            if out:
                yield to_batch(out, _SCHEMA)
        if now and (window := now.close()):
            yield to_batch([window], _SCHEMA)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(
        run, "conv_id long, window long, n_repeated long, n_new long, formatted string, loss_spans array<array<long>>, n_tokens long, over_budget boolean"
    )


def read_back(windows: DataFrame, together: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) from formatted windows alone.

    Turns that a window repeats are skipped. The digests are of role, newline, text, newline per turn, and of the texts under
    the loss mask; formatted_chars counts the code points of all windows of a conversation. together: each conversation's
    windows are in one partition already, in order, as format_conversations() leaves them; else they are shuffled.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
         ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6])
        for batch in batches:
            out = []
            for conv_id, _, repeated, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv_id:
                    if now:
                        out.append(done(now))
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in turns_of(formatted)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for start, end in spans:
                    text = unescape(formatted[start:end])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(formatted)
                now[6] += 1
            if out:
                yield to_batch(out, schema)
        if now:
            yield to_batch([done(now)], schema)

    rows = windows.select("conv_id", "window", "n_repeated", "formatted", "loss_spans")
    if not together:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    )
