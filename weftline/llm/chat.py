"""Chat formatting with a grammar round trip.

Grammar, with ROLE one of the header words and L the escape level of the turn (0, 1 or 2):

    conversation = turn*
    turn         = "<s>[" ROLE "|" L "] " text " [/" ROLE "]</s>"

The roles user, assistant and system have header words of their own; any other role (null counts as empty) stands
percent-encoded after "as:". Level 0 holds the text verbatim. A text that does not come back from the parser is
escaped: at level 1 a backslash goes before each backslash and each control string, at level 2 everything but letters and
digits is percent-encoded. The parser is deterministic: one regular expression for each level's turn, matched from where
the last turn ended.

A formatted conversation is one text. It is read back as such: cut into pieces of a fixed length that know nothing of turns,
from which an incremental parser gets the turns; each is compared with a digest of its source.

Null texts count as empty. Turns are in order of turn (nulls first), role and text; repeated rows are turns of their own.
A null conv_id is a conversation. An empty table gives an empty result. Very long texts are turns like others. Other columns
are not carried, whatever their names.
"""

from __future__ import annotations

import collections
import hashlib
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batch

#: Fixed values of the template: header words of the roles, and the strings that a text could be confused with.
HEADERS = {"user": "INST", "assistant": "ANS", "system": "SYS"}
CONTROL = re.compile(r"\\|</?s>|\[/?(?:INST|ANS|SYS|as:)")
_ROLES = {v: k for k, v in HEADERS.items()}
_HEAD = re.compile(r"<s>\[(INST|ANS|SYS|as:[A-Za-z0-9%]*)\|([012])\] ")
#: What a head may begin with, and the longest that is waited for.
_PARTIAL = re.compile(r"<(?:s(?:>(?:\[(?:I|IN|INS|A|AN|S|SY|a|as|(?:INST|ANS|SYS|as:[A-Za-z0-9%]*)(?:\|(?:[012]\]?)?)?)?)?)?)?")
_LONGEST_HEAD = 1 << 20
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: Characters of a conversation that the parser is given at a time.
PIECE = 1 << 14


def escape(text: str, level: int) -> str:
    if level == 1:
        return CONTROL.sub(lambda m: "\\" + m[0], text)
    return _percent(text) if level == 2 else text


def _percent(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "%" + format(ord(c), "X") + "%" for c in text)


def _unpercent(text: str) -> str:
    return re.sub(r"%([0-9A-F]+)%", lambda m: chr(int(m[1], 16)), text)


class Parser:
    """Reads a conversation from pieces of any length; holds no more than the turn that has not ended yet."""

    def __init__(self) -> None:
        self.text, self.seen = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that end with this piece; ValueError where no turn can start."""
        self.text += piece
        at = 0
        while at < len(self.text):
            m = _HEAD.match(self.text, at)
            if not m:
                if len(self.text) - at > _LONGEST_HEAD or not _PARTIAL.fullmatch(self.text, at):
                    raise ValueError(f"no turn starts with {self.text[at : at + 40]!r}")
                break
            close = f" [/{m[1]}]</s>"
            # Can't occur inside: level 0 has no control string, and level 1 a backslash between blank and bracket.
            e = self.text.find(close, max(m.end(), self.seen))
            if e < 0:
                self.seen = max(m.end(), len(self.text) - len(close))
                break
            body = self.text[m.end() : e]
            body = _UNESCAPE.sub(r"\1", body) if m[2] == "1" else _unpercent(body) if m[2] == "2" else body
            yield _ROLES.get(m[1]) or _unpercent(m[1].removeprefix("as:")), body
            at = e + len(close)
            self.seen = 0
        self.text = self.text[at:]
        self.seen = max(0, self.seen - at)

    def close(self) -> None:
        if self.text:
            raise ValueError(f"the turn {self.text[:40]!r} has no end")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; ValueError if it is not in the grammar."""
    parser = Parser()
    out = list(parser.feed(text))
    parser.close()
    return out


def source_digest(role: str | None, text: str | None) -> bytes:
    return hashlib.blake2b(f"{role or ''}\n{text or ''}".encode("utf-8", "surrogatepass"), digest_size=12).digest()


def render_turn(role: str | None, text: str | None) -> str:
    """The turn at the lowest level from which the parser gets it back, and whose text holds no control string that could reach beyond it."""
    role, text = role or "", text or ""
    head = HEADERS.get(role) or "as:" + _percent(role)
    for level in (0, 1, 2):
        out = f"<s>[{head}|{level}] {escape(text, level)} [/{head}]</s>"
        try:
            if (level or not CONTROL.search(text)) and parse(out) == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError("a turn can't be written")


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: conv_id, turn, role, text, formatted, source. A conversation is the formatted strings of its rows, joined.

    Rendering and its round trip need one turn at a time; then conversations are dealt out by their ids and sorted, so that a
    reader gets the text in order however long a conversation is. ``source`` is a digest of the turn's role and text.
    """
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()), ("source", pa.binary())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([render_turn(*x) for x in turns], pa.string()), pa.array([source_digest(*x) for x in turns], pa.binary())], schema=out)

    src = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = src.mapInArrow(render, "conv_id long, turn long, role string, text string, formatted string, source binary")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, by the parser alone: turns, digests of the turns and of the text under the loss mask.

    A conversation is read as one text, in pieces of PIECE characters whatever its rows are; only the piece, the turn that has
    not ended, digests and counts are held. ValueError if the turns found are not those of the source.
    """
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    class Conversation:
        def __init__(self, conv_id: int | None) -> None:
            self.id, self.parser, self.rest, self.size, self.sources = conv_id, Parser(), [], 0, collections.deque()
            self.n = self.chars = self.loss_chars = 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted: str, source: bytes) -> None:
            self.chars += len(formatted)
            self.rest.append(formatted)
            self.size += len(formatted)
            self.sources.append(source)
            if self.size >= PIECE:
                text = "".join(self.rest)
                whole = len(text) // PIECE * PIECE
                for i in range(0, whole, PIECE):
                    self.read(text[i : i + PIECE])
                self.rest, self.size = [text[whole:]], len(text) - whole

        def read(self, piece: str) -> None:
            for role, text in self.parser.feed(piece):
                if not self.sources or source_digest(role, text) != self.sources.popleft():
                    raise ValueError(f"turn {self.n} of conversation {self.id} is not what was formatted")
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    self.loss_chars += len(text)
                    self.loss.update(text.encode())

        def row(self) -> tuple:
            self.read("".join(self.rest))
            self.parser.close()
            if self.sources:
                raise ValueError(f"conversation {self.id} has lost its last {len(self.sources)} turns")
            return self.id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            rows = []
            for c, f, source in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if now is None or c != now.id:
                    if now is not None:
                        rows.append(now.row())
                    now = Conversation(c)
                now.add(f, source)
            if rows:
                yield batch(out, *zip(*rows, strict=True))
        if now is not None:
            yield batch(out, *([x] for x in now.row()))

    return formatted.select("conv_id", "formatted", "source").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
