"""Chat formatting with a grammar round trip.

The template marks each turn with a header and an end of its role:

    system     [SYS] text [/SYS]          user   [INST] text [/INST]
    assistant  [OUT] text </s>            other  [ROLE "name"] text [/ROLE]

A turn is rendered as it is and read back by a deterministic parser that knows the template only. If the parser does not
return exactly this one turn with this text, the text conflicts with the template: the turn is rendered once more with a
plus in its header and the text escaped by steps (first control strings, then the escape character too) until reading it
back gives the source. This search goes on where the rows lie; a row then moves with the step that it needs.

The rows of a conversation meet in order, and its whole rendering, turn after turn, goes through one parser, which takes it
up piece by piece and returns turns as they end. Each is compared with its source; where one differs, its turn and all after
it are rendered by the next step until they agree. Only what was read back is digested. A digest is sequential, so a
conversation is digested in one task, as a stream: one that holds a third of all rows needs no more memory than its longest
turn, and its task does no more than format, read and hash.

Defined results: null texts and null roles count as empty; turns of equal number are ordered by role, then text, and
repeated rows stay repeated; a null conv_id is a conversation of its own; an empty table gives an empty result; what the
query puts in beside the table stays apart from a conversation of the same number.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: role -> name in the header and end of the turn
ROLES = {"system": ("SYS", "[/SYS]"), "user": ("INST", "[/INST]"), "assistant": ("OUT", "</s>")}
OTHER = ("ROLE", "[/ROLE]")
_BY_NAME = {v[0]: (k, v[1]) for k, v in ROLES.items()}
_HEADER = re.compile(r'\[(SYS|INST|OUT|ROLE ("(?:[^"\\]|\\.)*"))(\+?)\] ')
_CONTROL = re.compile(r"\[(?=/?(?:SYS|INST|OUT|ROLE))|<(?=/s>)")
STEPS = 3
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


class NotTheGrammar(ValueError):
    pass


def escape(text: str, step: int) -> str:
    """Step 1 breaks control strings up; step 2 guards backslashes first, which makes it reversible for any text."""
    if step >= 2:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: "\\" + m[0], text) if step else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Reader:
    """A parser of formatted text that comes in pieces. One pass from left to right, no way back."""

    def __init__(self) -> None:
        self.rest, self.read = "", 0  # what no turn has ended in yet, and how much was read before it

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that end within what has come so far."""
        text = self.rest + piece if self.rest else piece
        at = 0
        while at < len(text):
            if not (head := _HEADER.match(text, at)):
                break
            if head[2]:
                role, end = json.loads(head[2]), OTHER[1]
            else:
                role, end = _BY_NAME[head[1]]
            stop = text.find(" " + end, head.end())
            if stop < 0:
                break
            body = text[head.end() : stop]
            if _CONTROL.search(body if not head[3] else _ESCAPED.sub("\0", body)):
                raise NotTheGrammar(f"a control string within the turn at {self.read + at}")
            yield role, unescape(body) if head[3] else body
            at = stop + 1 + len(end)
        self.rest, self.read = text[at:], self.read + at

    def end(self) -> None:
        if self.rest:
            raise NotTheGrammar(f"the turn at {self.read} is none, or has no end")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    reader = Reader()
    turns = list(reader.feed(text))
    reader.end()
    return turns


def write_turn(role: str, text: str, step: int) -> str:
    name, end = ROLES.get(role, OTHER)
    if name == OTHER[0]:
        name = f"{name} {json.dumps(role)}"
    return f"[{name}{'+' if step else ''}] {escape(text, step)} {end}"


def step_of(role: str, text: str, least: int = 0) -> int:
    """The first step at which a turn reads back as itself."""
    for step in range(least, STEPS):
        try:
            if parse(write_turn(role, text, step)) == [(role, text)]:
                return step
        except NotTheGrammar:
            pass
    raise NotTheGrammar(f"a turn of role {role!r} cannot be written")


def rendered(turns: Iterable[tuple[str, str, int]]) -> Iterator[tuple[str, tuple[str, str]]]:
    """The pieces of a whole conversation's rendering, each with the turn that one parser of them all reads back in its place.

    turns: (role, text, step). From a turn that does not read back as its source on, texts are escaped by a step more.
    """
    reader, more = Reader(), 0
    for role, text, step in turns:
        while True:
            now, out = Reader(), write_turn(role, text, min(step + more, STEPS - 1))
            now.rest, now.read = reader.rest, reader.read
            try:
                back = list(now.feed(out))
            except NotTheGrammar:
                back = []
            if back == [(role, text)] and not now.rest:
                break
            if step + more >= STEPS - 1:
                raise NotTheGrammar(f"a turn of role {role!r} cannot be written")
            more += 1
        reader = now
        yield out, back[0]
    reader.end()


def render(turns: Iterable[tuple[str, str]]) -> str:
    return "".join(out for out, _ in rendered((r, t, step_of(r, t)) for r, t in turns))


class Digest:
    """What the query returns of a conversation, taken up turn by turn from what the parser read back."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, out: str, back: tuple[str, str]) -> None:
        role, text = back
        self.turns += 1
        self.chars += len(out)
        self.sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == "assistant":  # the loss mask covers the assistant's text without header and end
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, key) -> tuple:
        return key, self.turns, self.sha.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _as_strings(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Keys as strings: among nulls, pandas would make fractions of whole numbers."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in kinds), *(c for c in df.columns if c not in kinds))


def _typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in df.columns))


def ordered(chats: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rows with the step that each needs, those of a conversation together in one task, in order; keys as strings."""
    rows = chats.select(*kinds, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(step=[step_of(r, t) for r, t in zip(b["role"], b["text"], strict=True)])

    stepped = _typed(_as_strings(rows, kinds).mapInPandas(searched, "conv_id string, turn string, role string, text string, step int"), kinds)
    return _as_strings(stepped.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), kinds)


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Sorted batches as conversations: (conv_id, its rows (turn, role, text, step))."""

    def rows():
        for b in batches:
            ids, turns = (b[c].astype(object).where(b[c].notna(), None) for c in ("conv_id", "turn"))
            yield from zip(ids, turns, b["role"], b["text"], b["step"].astype(int), strict=True)

    for key, own in groupby(rows(), key=lambda r: r[0]):
        yield key, (r[1:] for r in own)


def _frames(rows: Iterator[tuple], names: Sequence[str], most: int = 2000, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pd.DataFrame(held, columns=list(names), dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=list(names), dtype=object)


def format_turns(chats: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, and loss_start and loss_end, the code points of formatted under the loss mask."""
    kinds = dict(chats.select("conv_id", "turn").dtypes)

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for key, own in _conversations(batches):
            numbers: deque = deque()
            for out, (role, _) in rendered((role, text, step) for turn, role, text, step in own if numbers.append(turn) is None):
                span = (_HEADER.match(out).end(), len(out) - len(" </s>")) if role == "assistant" else (None, None)
                yield key, numbers.popleft(), out, *span

    names = ("conv_id", "turn", "formatted", "loss_start", "loss_end")
    made = ordered(chats, kinds).mapInPandas(lambda it: _frames(turns(it), names), "conv_id string, turn string, formatted string, loss_start long, loss_end long")
    return _typed(made, kinds)


COLUMNS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digests(chats: DataFrame) -> DataFrame:
    """One row per conversation: its rendering, read back and digested as it streams by."""
    kinds = dict(chats.select("conv_id", "turn").dtypes)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for key, own in _conversations(batches):
            now = Digest()
            for out, back in rendered(r[1:] for r in own):
                now.add(out, back)
            yield now.row(key)

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    made = ordered(chats, kinds).mapInPandas(lambda it: _frames(digests(it), names), f"conv_id string, {COLUMNS}")
    return _typed(made, {"conv_id": kinds["conv_id"]})


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat_digests(chats).unionByName(chat_digests(probe))


QUERIES = {"op5_chat": op5_chat}
SQL: dict[str, str] = {}
