"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, told as letters.

A conversation is right when its role initials read ``(s?(ua)+)?``. Rows are kept (K, 0), given the role user or assistant
(R, 2), deleted (D, 3; blank and repeated rows must be), and rows without text of either role are inserted anywhere (I, 2); a row
that ends amid a sentence costs 1 more unless it is deleted. Of the cheapest edits those with the ASCII-least letters are
taken.

The decision is one integer minimum over a DAG of (row, automaton state). An edge's weight is a plain integer: its cost in
the high digits, its letter as the first of a fixed number of low octal digits. A node's value is the least sum to the
end; going on over an edge moves the low digits of the value behind it one place down, and what isn't used stays zero, so
a text that ends first is less. As letters begin at one and are ordered as in ASCII, comparing integers compares
costs and then letters. Automaton states have one insertion each, and more than two insertions between rows never pay,
so ``3 * rows + 2`` digits hold every candidate. The letters decide the rest: which role a state gives a row is unique.

On Spark: rows are dealt and sorted by conversation twice. The first time only flags and digests move, and a task
keeps one byte a row and the distinct digests of one conversation (``reports``); the second time the conversation's letters come before its
rows, which stream by (``repaired_turns``, ``repaired_digests``), so no conversation's texts are ever held together.
The integers of a conversation of n rows have 9 n bits, so the decision takes time in n * n / 64: a second or so for 20,000 rows.

Defined results: a null role or text is one space; rows are taken by turn, null turns first, rows of one turn by role and
then by the SHA-256 of role and text; a role is legal by its first character alone; white space is the space and \\t to \\r; a null
conversation id is a conversation of its own; equal rows after the first are duplicates; other columns are not read; an empty table gives
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import quoted

#: White space, sentence ends, costs and letters of the edits.
WHITE = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = (".", "!", "?")
RENAME_COST, DELETE_COST, INSERT_COST, CUT_COST = 2, 3, 2, 1
LETTERS = "DIKR"
DELETE, INSERT, KEEP, RENAME = 1, 2, 3, 4
LEGAL_PAIRS = {"su", "ua", "au"}

#: Automaton states: nothing yet, after a system, user or assistant row; which state a kept role leads to, and the one
#: role that an inserted or renamed row can have.
START, SYSTEM, USER, ASSISTANT = range(4)
GOES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GIVEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: A row as one byte: its initial (0 to 3), must it go (4), is it cut (8).
INITIALS = "sua"
MUST_GO, CUT = 4, 8
#: Characters of results in one batch of rows.
BATCH_CHARS = 4 << 20


def cheapest(rows: bytes | bytearray) -> tuple[int, str]:
    """(cost, letters) of the best edits of a conversation's rows."""
    digits = 3 * len(rows) + 2
    width = 3 * digits
    low = (1 << width) - 1
    first = width - 3

    def weight(letter: int, cost: int) -> int:
        return (cost << width) + (letter << first)

    delete, insert = weight(DELETE, DELETE_COST), weight(INSERT, INSERT_COST)
    keep = (weight(KEEP, 0), weight(KEEP, CUT_COST))
    rename = (weight(RENAME, RENAME_COST), weight(RENAME, RENAME_COST + CUT_COST))

    def moved(value: int) -> int:
        """A value with its letters one place down."""
        letters = value & low
        return value - letters + (letters >> 3)

    to_assistant = insert + moved(0)
    values = [0, insert + moved(to_assistant), to_assistant, 0]
    for row in reversed(rows):
        behind = [moved(v) for v in values]
        values = [delete + v for v in behind]
        if not row & MUST_GO:
            cut = row >> 3
            initial = INITIALS[row & 3 : (row & 3) + 1]
            for state in range(4):
                best = min(values[state], rename[cut] + behind[GIVEN[state]])
                if initial in GOES[state]:
                    best = min(best, keep[cut] + behind[GOES[state][initial]])
                values[state] = best
        user, assistant = values[USER], values[ASSISTANT]
        values[USER] = min(user, insert + moved(assistant))
        values[ASSISTANT] = min(assistant, insert + moved(user))
        into_user = insert + moved(values[USER])
        values[START], values[SYSTEM] = min(values[START], into_user), min(values[SYSTEM], into_user)
    letters = f"{values[START] & low:0{digits}o}".rstrip("0")
    return values[START] >> width, letters.translate(str.maketrans("1234", LETTERS))


def ordered_rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, own): rows without nulls, and the digest that tells equal rows and orders rows of a turn."""
    role, text = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(F.col(quoted(conv_col)).alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("own", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def fault_flags(text: Column) -> Column:
    """MUST_GO of a blank text, CUT of one whose last character that isn't white is no sentence end, else 0."""
    last = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return F.when(last == "", MUST_GO).when(last.isin(*SENTENCE_ENDS), 0).otherwise(CUT)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Conversation:
    """What is told of a conversation whose rows come one by one."""

    def __init__(self):
        self.rows, self.seen, self.last = bytearray(), set(), ""
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, flags: int, own: bytes) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        initial = role[:1]
        if self.rows and self.last + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.last = initial
        if flags & MUST_GO:
            self.blank += 1
        elif own in self.seen:
            self.duplicate += 1
            flags = MUST_GO
        elif flags & CUT:
            self.truncated += 1
        self.seen.add(own)
        self.rows.append(flags | (INITIALS.index(initial) if initial and initial in INITIALS else 3))

    def told(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, letters = cheapest(self.rows)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, letters


def opened(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    """The type of the first column, and all batches."""
    first = next(batches, None)
    return (pa.null(), iter(())) if first is None else (first.column(0).type, chain([first], batches))


def batches_of(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_CHARS."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _reports(rows: DataFrame) -> DataFrame:
    flagged = rows.select("conv", "turn", "role", "own", fault_flags(F.col("text")).alias("flags"))
    dealt = flagged.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "own")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, current = None, None
        for batch in batches:
            for key, turn, role, own, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or key != conv:
                    if current is not None:
                        yield (conv, *current.told())
                    conv, current = key, Conversation()
                current.add(turn, role, flags, own)
        if current is not None:
            yield (conv, *current.told())

    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, batches = opened(batches)
        yield from batches_of(told(batches), [arrow, *[pa.int64()] * len(COUNTS), pa.string()], schema.names, lambda r: len(r[-1]))

    return dealt.mapInArrow(run, schema)


def reports(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    return _reports(ordered_rows(turns, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv", conv_col)


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, role, text, edit) of repaired rows; (conv, None, None, None) after a conversation's last.

    Batches have (conv, audit, role, text); a conversation's audit comes before its rows.
    """
    conv, audit, at, state, begun = None, "", 0, START, False
    for batch in batches:
        for key, letters, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if letters is not None:
                if begun:
                    for edit in audit[at:]:
                        state = GIVEN[state]
                        yield conv, NAMES[state], "", edit
                    yield conv, None, None, None
                conv, audit, at, state, begun = key, letters, 0, START, True
                continue
            while audit[at] == "I":
                state, at = GIVEN[state], at + 1
                yield conv, NAMES[state], "", "I"
            edit, at = audit[at], at + 1
            if edit == "K":
                state = GOES[state][role[:1]]
                yield conv, role, text, edit
            elif edit == "R":
                state = GIVEN[state]
                yield conv, NAMES[state], text, edit
    if begun:
        for edit in audit[at:]:
            state = GIVEN[state]
            yield conv, NAMES[state], "", edit
        yield conv, None, None, None


def _led_by_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, audit, role, text): each conversation's audit, then its rows in order."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("own", "binary"))]
    heads = audits.select("conv", "audit", F.lit(0).alias("place"), *nothing)
    both = heads.unionByName(rows.select("conv", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("place"), "turn", "role", "text", "own"))
    dealt = both.repartition("conv").sortWithinPartitions("conv", "place", F.asc_nulls_first("turn"), "role", "own")
    return dealt.select("conv", "audit", "role", "text")


def repaired_turns(turns: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation id, place from 1, role, text, edit) of the repaired rows; ``found`` are the reports of the same rows."""
    led = _led_by_audits(ordered_rows(turns, conv_col, turn_col, role_col, text_col), found.select(F.col(quoted(conv_col)).alias("conv"), "audit"))
    schema = T.StructType([T.StructField(conv_col, led.schema["conv"].dataType), T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", "edit"))])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for conv, role, text, edit in replayed(batches):
            place = place + 1 if edit else 0
            if edit:
                yield conv, place, role, text, edit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, batches = opened(batches)
        yield from batches_of(placed(batches), [arrow, pa.int64(), *[pa.string()] * 3], schema.names, lambda r: len(r[3]))

    return led.mapInArrow(run, schema)


def repaired_digests(turns: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation id, repaired_sha256): SHA-256 of the repaired rows as role:text, joined by newlines."""
    led = _led_by_audits(ordered_rows(turns, conv_col, turn_col, role_col, text_col), found.select(F.col(quoted(conv_col)).alias("conv"), "audit"))
    schema = T.StructType([T.StructField(conv_col, led.schema["conv"].dataType), T.StructField("repaired_sha256", T.StringType())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, between = hashlib.sha256(), b""
        for conv, role, text, edit in replayed(batches):
            if edit:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            else:
                yield conv, digest.hexdigest()
                digest, between = hashlib.sha256(), b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, batches = opened(batches)
        yield from batches_of(digests(batches), [arrow, pa.string()], schema.names, lambda r: 64)

    return led.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by a hash of conversation and turn: a twentieth each of the rows is
    dropped, emptied, rid of its sentence ends, repeated, or given the role user."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(hit == 1, "").when(hit == 2, F.translate(text, "".join(SENTENCE_ENDS), "")).otherwise(text)
    times = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = turns.where(hit != 0).select("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return made.drop("copy")
