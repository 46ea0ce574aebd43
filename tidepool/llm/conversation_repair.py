"""Conversation structure repair by secondary-sorted streaming.

A repaired conversation has role initials ``(s?(ua)+)?``. The cheapest edits
reach it: keep a row (0), give it the role user or assistant (2), delete it (3),
insert an empty user or assistant row (2); a truncated row that stays costs 1
more, blank rows and duplicates have to go. Of equally cheap edit strings
(initials D, I, K, R in order) the ASCII-least counts.

Rows are repartitioned by conversation and sorted by turn, last row first, and
``mapInPandas`` carries the dynamic program across Arrow batches: four numbers,
the cost of the rest from each state of the pattern. Going backwards, a row's
best edit is known for each state when the row is met, so one byte a row (two
bits a state) is all that has to be remembered; once the first row is reached,
the edits are read off forwards, which also gives the least string. Bytes and
rows of a conversation lie on a stack that spills compressed chunks to a file
of the task beyond ``spill_bytes``, so a conversation of any length takes a
bounded share of memory (its edit string apart, which is a value of the result).

A conversation is streamed by one task, as its digest runs over all its rows in
order. What does not need the order happens before and is dealt by conversation
and content: which rows repeat an earlier one (a grouping and a join).

Null and odd rows: null roles and texts are one space (so a null text is blank),
null turns come first and count for no gap, and rows without conv_id are one
conversation. Rows of one turn are ordered by role and text (bytes), so repeated
rows stand together and all but the first are duplicates. Gaps beyond 64 bits
are given as the largest long. An empty table gives an empty result. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one conversation's rows in memory before they spill.
SPILL_BYTES = 8 << 20
#: Rows of a batch that is handed back.
OUT_ROWS = 2_000

WHITE = " \t\n\x0b\f\r"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id long, position long, edit string, role string, text string"

LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. Where an inserted or re-roled row leads.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Cost of the rest after the last row: insert what is missing.
_END = (0, 4, 2, 0)
_D, _I, _K, _R = range(4)  # in the order of their letters
LETTERS = "DIKR"
_NEVER = 1 << 40


def damage(rows: DataFrame) -> DataFrame:
    """Plants faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (it
    stays with ``dropped`` set, so that its conversation is known), 1 empties the
    text, 2 removes its ``.!?``, 3 repeats the row, 4 sets the role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("fault", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns(
        {
            "text": text,
            "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role")),
            "dropped": F.col("fault") == 0,
            "copy": F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))),
        }
    )
    return rows.drop("fault", "copy")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows with their faults, by conversation, last turn first."""
    white = F.lit(WHITE)
    trimmed = F.rtrim(F.col("text"), white)
    rows = rows.select(
        F.col("conv_id").isNotNull().alias("has_conv"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        "role",
        "text",
        "dropped",
        (trimmed == "").alias("blank"),
        F.substring(trimmed, -1, 1).isin(".", "!", "?").alias("ended"),
        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"),
    )
    when = F.struct("has_turn", "turn")
    first = rows.where("NOT dropped").groupBy("has_conv", "conv", "content").agg(F.min(when).alias("first"))
    rows = rows.join(first, ["has_conv", "conv", "content"], "left").withColumn("repeated", F.coalesce(when > F.col("first"), F.lit(False)))
    rows = rows.drop("content", "first").repartition("has_conv", "conv")
    return rows.sortWithinPartitions("has_conv", "conv", *[F.desc(c) for c in ("has_turn", "turn", "role", "text")])


class _Stack:
    """What was pushed last comes first; beyond ``limit`` bytes in a file."""

    def __init__(self, limit: int):
        self.limit, self.held, self.size, self.file, self.chunks = limit, [], 0, None, []

    def push(self, choice: int, role: str, text: str | None) -> None:
        self.held.append((choice, role, text))
        self.size += 200 + len(role) + (len(text) if text else 0)
        if self.size > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            raw = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(self.held))
            self.chunks.append((self.file.seek(0, 2), self.file.write(raw)))
            self.held, self.size = [], 0

    def popped(self) -> Iterator[tuple[int, str, str | None]]:
        yield from reversed(self.held)
        self.held = []
        for start, size in reversed(self.chunks):
            self.file.seek(start)
            yield from reversed(pickle.loads(zstandard.ZstdDecompressor().decompress(self.file.read(size))))
        if self.file:
            self.file.close()


def _step(initial: str, stays: bool, extra: int, rest: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Best edits of one row for the four states, packed two bits each, and the
    cost from each state on. ``rest``: cost from each state after the row."""
    keep = _KEEP.get(initial, {})
    options = []
    for q in range(4):
        kept = rest[keep[q]] + extra if stays and q in keep else _NEVER
        changed = rest[_NEXT[q]] + extra + 2 if stays else _NEVER
        options.append([rest[q] + 3, _NEVER, kept, changed])
    least = [min(o) for o in options]
    # From user on an inserted row leads to assistant and back; going round costs more than it gives.
    from_u, from_a = min(least[2], least[3] + 2), min(least[3], least[2] + 2)
    for q, ahead in enumerate((from_u, from_u, from_a, from_u)):
        options[q][_I] = ahead + 2
    value = tuple(min(o) for o in options)
    return sum(o.index(v) << 2 * q for q, (o, v) in enumerate(zip(options, value))), value


class _Conversation:
    """One conversation, its rows met last to first."""

    _known: dict = {}

    def __init__(self, conv_id: int | None, spill_bytes: int):
        self.conv_id, self.stack = conv_id, _Stack(spill_bytes)
        self.cost, self.rest = 0, _END  # cost of the rest: the common part, and what each state adds
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.first = None
        self.later = self.pending = None

    def meet(self, has_turn, turn, role, text, blank, ended, repeated) -> None:
        """The row waits until the one before it is known: an equal one makes it a duplicate."""
        if self.pending:
            same = self.pending[:4] == (has_turn, turn, role, text)
            self._take(*self.pending, same)
        self.pending = (has_turn, turn, role, text, blank, ended, repeated)

    def _take(self, has_turn, turn, role, text, blank, ended, repeated, same) -> None:
        initial = role[:1]
        if self.later is not None:
            self.illegal += initial + self.later not in LEGAL
        self.later = initial
        if has_turn and turn != self.first:
            self.last = turn if self.last is None else self.last
            self.first = turn
            self.turns += 1
        doubled = not blank and (repeated or same)
        cut = not blank and not doubled and not ended
        self.blank += blank
        self.duplicate += doubled
        self.truncated += cut
        stays = not blank and not doubled
        key = (initial, stays, cut, self.rest)
        if key not in self._known:
            choice, value = _step(initial if initial in _KEEP else "", stays, int(cut), self.rest)
            self._known[key] = choice, min(value), tuple(v - min(value) for v in value)
        choice, least, self.rest = self._known[key]
        self.cost += least
        self.stack.push(choice, role, text if stays else None)

    def edits(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(letter, role, text) first to last; a deleted row has no role and text."""
        if self.pending:
            self._take(*self.pending, False)
            self.pending = None
        self.cost += self.rest[0]
        q = 0
        for choice, role, text in self.stack.popped():
            while (edit := choice >> 2 * q & 3) == _I:
                q = _NEXT[q]
                yield "I", _ROLE[q], ""
            if edit == _D:
                yield "D", None, None
                continue
            q = _KEEP[role[:1]][q] if edit == _K else _NEXT[q]
            yield LETTERS[edit], role if edit == _K else _ROLE[q], text
        while q in (1, 2):
            q = _NEXT[q]
            yield "I", _ROLE[q], ""

    def summary(self) -> tuple:
        audit, digest, sep = [], hashlib.sha256(), ""
        for letter, role, text in self.edits():
            audit.append(letter)
            if role is not None:
                digest.update(f"{sep}{role}:{text}".encode())
                sep = "\n"
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(audit), digest.hexdigest()

    def rows(self) -> Iterator[tuple]:
        position = 0
        for letter, role, text in self.edits():
            if role is not None:
                yield self.conv_id, position, letter, role, text
                position += 1


def _conversations(batches: Iterator[pd.DataFrame], spill_bytes: int) -> Iterator[_Conversation]:
    """Finished conversations of a sorted partition, whatever batches they span."""
    key, now = None, None
    names = ["has_conv", "conv", "has_turn", "turn", "role", "text", "dropped", "blank", "ended", "repeated"]
    for pdf in batches:
        for has_conv, conv, has_turn, turn, role, text, dropped, blank, ended, repeated in zip(*(pdf[n].tolist() for n in names)):
            if (has_conv, conv) != key:
                if now is not None:
                    yield now
                key, now = (has_conv, conv), _Conversation(conv if has_conv else None, spill_bytes)
            if not dropped:
                now.meet(has_turn, turn, role, text, blank, ended, repeated)
    if now is not None:
        yield now


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in schema.split(", ")]
    held: list[tuple] = []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(held, columns=names, dtype=object)
        return out.astype({n: "Int64" for n, kind in (f.split() for f in schema.split(", ")) if kind == "long"})

    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield frame()
            held = []
    if held:
        yield frame()


def summaries(rows: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row a conversation (see ``SUMMARY``): its faults, the cheapest edits and
    the digest of the repaired rows. ``rows``: conv_id, turn, role, text, dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((c.summary() for c in _conversations(batches, spill_bytes)), SUMMARY)

    return _sorted(rows).mapInPandas(run, SUMMARY)


def repaired(rows: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The rows of the repaired conversations (see ``ROWS``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((row for c in _conversations(batches, spill_bytes) for row in c.rows()), ROWS)

    return _sorted(rows).mapInPandas(run, ROWS)
