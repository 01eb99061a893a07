"""Chat transcripts: roles by a hidden Markov model over lines, and canonical turn rendering.

A transcript is a text in which speakers' turns follow one another, mostly but not always with a marker ("User:",
"### Assistant", "<|system|>", "Q:"). Its lines are observed as a marker class together with line features (blank, a
question, long, a list item or code). The hidden state of a line is a role and whether the line begins a turn. Viterbi
finds the best states; each begun turn is rendered in one canonical form without its marker.

The model's probabilities are smoothed counts over transcripts whose states are known (``fit``): at most
``STATES * SYMBOLS`` rows reach the driver, whatever the size of the table.

Long conversations are written in parts that end between turns (``written_transcripts``). The chain goes on over the parts
(``parse_conversations``): each part is told by the best score from every state before it to every state at its end, these
small tables are combined in order, and with the states at its ends fixed each part is parsed by itself, as if the
conversation were parsed in one piece. Nothing tells the model that a part begins with a turn: a part's first lines may go
on in the turn before. Such a piece is rendered with a plus sign before its role and isn't counted as a turn;
``read_parts`` joins it to its beginning.

The canonical form can be read back (``read_rendered``): a text's own ``<|`` gets a backslash.

Defined results: null and empty transcripts have no turns and render as ""; blank lines at a turn's ends go; a marker
without text is a turn with an empty text; of equally likely paths the first state in ``STATES`` is taken; rows are parsed alone, so
repeated rows need no rule; an empty table gives an empty result; columns with an output's name are replaced, others
kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import quoted, rank_in_groups

ROLES = ("system", "user", "assistant")
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
#: Names that speakers' markers use, by role.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "model", "gpt", "response"),
}
_ROLE_OF = {n: r for r, ns in NAMES.items() for n in ns}
MARKER = re.compile(r"^\s*(?:\*\*|#{1,4}\s*|<\|(?:im_start\|>)?|\[|>+\s*)?([A-Za-z]{1,12})(?:\*\*\s*:|\s*:\s*\*\*|\|>|\]|\s*:|\s*>)\s*|^\s*#{1,4}\s+([A-Za-z]{1,12})\s*$")
LIST_OR_CODE = re.compile(r"^\s*(?:[-*+•]\s|\d{1,3}[.)]\s|```|    |\t)")
LONG = 160
#: Log-probability of what can't be.
NEVER = -1e9
SYMBOLS = 4 * 2 * 2 * 2 + 1


def marker_of(line: str) -> tuple[str | None, str]:
    """(role, rest of the line) if it starts with a speaker's marker, else (None, line)."""
    found = MARKER.match(line)
    role = found and _ROLE_OF.get((found[1] or found[2]).lower())
    return (role, line[found.end() :]) if role else (None, line)


def symbol(line: str) -> int:
    """The observed class of a line."""
    if not line.strip():
        return SYMBOLS - 1
    role, rest = marker_of(line)
    at = ROLES.index(role) + 1 if role else 0
    return ((at * 2 + rest.rstrip().endswith("?")) * 2 + (len(rest) >= LONG)) * 2 + bool(LIST_OR_CODE.match(rest))


class LineModel:
    """Log-probabilities of first states, of state after state, and of symbols by state."""

    def __init__(self, first: list[int], follows: dict[tuple[int, int], int], emits: dict[tuple[int, int], int]):
        n = len(STATES)
        self.first = [math.log((first[s] + 1e-3) / (sum(first) + n * 1e-3)) for s in range(n)]
        after = [sum(follows.get((s, t), 0) for t in range(n)) for s in range(n)]
        self.step = [[math.log((follows.get((s, t), 0) + 0.1) / (after[s] + 0.1 * n)) for t in range(n)] for s in range(n)]
        for s, (role, _) in enumerate(STATES):
            for t, (other, begins) in enumerate(STATES):
                if not begins and other != role:
                    self.step[s][t] = NEVER  # a turn goes on in its own role
        for s, (_, begins) in enumerate(STATES):
            if not begins:
                self.first[s] = NEVER
        seen = [sum(emits.get((s, y), 0) for y in range(SYMBOLS)) for s in range(n)]
        self.emit = [[math.log((emits.get((s, y), 0) + 0.1) / (seen[s] + 0.1 * SYMBOLS)) for y in range(SYMBOLS)] for s in range(n)]

    def entered(self, before: int | None) -> list[float]:
        """Scores of a first line's states: of the whole conversation, or of a part that follows on a state."""
        return self.first if before is None else self.step[before]

    def forward(self, symbols: list[int], start: list[float]) -> tuple[list[float], list[list[int]]]:
        """Scores of the last line's states, and of each line but the first the best state before each state."""
        n = range(len(STATES))
        score = [start[s] + self.emit[s][symbols[0]] for s in n]
        back = []
        for y in symbols[1:]:
            best = [max(n, key=lambda s, t=t: score[s] + self.step[s][t]) for t in n]
            score = [score[best[t]] + self.step[best[t]][t] + self.emit[t][y] for t in n]
            back.append(best)
        return score, back

    def viterbi(self, symbols: list[int], before: int | None = None, end: int | None = None) -> list[int]:
        """The likeliest states of a sequence of lines, with the state before it and its last one given or free."""
        if not symbols:
            return []
        score, back = self.forward(symbols, self.entered(before))
        path = [max(range(len(STATES)), key=lambda s: score[s]) if end is None else end]
        for best in reversed(back):
            path.append(best[path[-1]])
        return path[::-1]

    def through(self, symbols: list[int], first: bool) -> list[float]:
        """The best score from each state before a part (rows; a first part has one row) to each state at its end."""
        return [x for before in ([None] if first else range(len(STATES))) for x in self.forward(symbols, self.entered(before))[0]]

    def turns(self, transcript: str, before: int | None = None, end: int | None = None) -> list[tuple[str, str]]:
        """(role, text) of each turn; a first piece that goes on in the turn before has a plus sign before its role."""
        if not transcript:
            return []
        lines = transcript.split("\n")
        out: list[tuple[str, list[str]]] = []
        for line, s in zip(lines, self.viterbi([symbol(x) for x in lines], before, end), strict=True):
            role, begins = STATES[s]
            if begins:
                out.append((role, [marker_of(line)[1]]))
            elif out:
                out[-1][1].append(line)
            else:
                out.append((f"+{role}", [line]))
        return [(role, "\n".join(own).strip()) for role, own in out]


def rendered(turns: list[tuple[str, str]]) -> str:
    """The canonical form of turns."""
    return "".join(f"<|{role}|>\n{_OWN.sub(_MARKED, text)}\n<|end|>\n" for role, text in turns)


_OWN, _MARKED = re.compile(r"<(\\*)\|"), r"<\1\\|"
_BACK, _PLAIN = re.compile(r"<(\\*)\\\|"), r"<\1|"
_TURN = re.compile(r"<\|(\+?\w+)\|>\n(.*?)\n<\|end\|>\n", re.S)


def read_rendered(text: str) -> list[tuple[str, str]]:
    """The turns of a canonical form."""
    return [(role, _BACK.sub(_PLAIN, own)) for role, own in _TURN.findall(text)]


def read_parts(parts: list[str]) -> list[tuple[str, str]]:
    """The turns of a conversation's rendered parts, pieces joined by a line end (blank lines at a cut are lost)."""
    out: list[tuple[str, str]] = []
    for role, text in (turn for part in parts for turn in read_rendered(part)):
        if role.startswith("+"):
            before, held = out.pop()
            out.append((before, "\n".join(filter(None, (held, text)))))
        else:
            out.append((role, text))
    return out


def fit(transcripts: DataFrame, text_col: str = "text", roles_col: str = "line_roles") -> LineModel:
    """Count states and symbols in transcripts whose lines' roles are known.

    ``roles_col`` is an array with one entry a line: the role where a turn begins, null where it goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int, int], int] = {}
            for text, roles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last, role = None, None
                for line, begun in zip((text or "").split("\n") if text else [], roles or [], strict=False):
                    role = begun or role
                    if role not in ROLES:
                        continue
                    s = STATES.index((role, bool(begun)))
                    keys = [("first", s, 0)] if last is None else [("follows", last, s)]
                    for key in [*keys, ("emits", s, symbol(line))]:
                        counts[key] = counts.get(key, 0) + 1
                    last = s
            rows = [(k, a, b, n) for (k, a, b), n in counts.items()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["kind", "a", "b", "n"])

    counted = transcripts.select(text_col, roles_col).mapInArrow(run, "kind string, a int, b int, n long")
    rows = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    first = [0] * len(STATES)
    for r in rows:
        if r.kind == "first":
            first[r.a] = r.n
    return LineModel(first, {(r.a, r.b): r.n for r in rows if r.kind == "follows"}, {(r.a, r.b): r.n for r in rows if r.kind == "emits"})


OUTPUTS = {"n_turns": (pa.int64(), T.LongType()), "roles": (pa.list_(pa.string()), T.ArrayType(T.StringType())), "rendered": (pa.string(), T.StringType())}


def parse_transcripts(df: DataFrame, model: LineModel, text_col: str = "text", keep: tuple[str, ...] | None = None, ends: tuple[str, str] | None = None) -> DataFrame:
    """Add n_turns, roles (array) and rendered, the canonical form, of every whole transcript.

    ``ends`` names two columns with the states before a transcript and at its end, null where they are free.
    """
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in OUTPUTS]
    fixed = [F.col(quoted(c)).cast("int") for c in ends or ()] or [F.lit(None).cast("int")] * 2
    given = [F.col(quoted(text_col)).cast("string").alias("given"), fixed[0].alias("before"), fixed[1].alias("end")]
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), *given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, end = (c.to_pylist() for c in batch.columns[-3:])
            found = [model.turns(t or "", b, e) for t, b, e in zip(texts, before, end, strict=True)]
            begun = [[r for r, _ in t if not r.startswith("+")] for t in found]
            made = [[len(r) for r in begun], begun, [rendered(t) for t in found]]
            arrays = [pa.array(x, kind) for x, (kind, _) in zip(made, OUTPUTS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *arrays], names=[*(f.name for f in kept), *OUTPUTS])

    return source.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, (_, k) in OUTPUTS.items())]))


def part_ends(parts: DataFrame, model: LineModel) -> DataFrame:
    """(conv_id, part, before, end) of the parts of conversations that have several: states on the best path of the whole.

    What meets in one task is a conversation's parts at 36 numbers each, not its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [model.through([symbol(x) for x in (t or "").split("\n")], p == 0) for t, p in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.float64()))], names=["conv_id", "part", "through"])

    n = len(STATES)

    def best_path(rows):
        rows = rows.sort_values("part")
        score, back = None, []
        for table in rows["through"]:
            table = np.asarray(table).reshape(-1, n)
            total = table if score is None else score[:, None] + table
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        ends = [int(score.argmax())]
        for best in reversed(back[1:]):
            ends.append(int(best[ends[-1]]))
        ends.reverse()
        return rows[["conv_id", "part"]].assign(before=pd.array([None, *ends[:-1]], dtype="Int32"), end=pd.array(ends, dtype="Int32"))

    kind = dict(parts.dtypes)["conv_id"]
    several = parts.where("part > 0").select(F.col("conv_id").alias("c")).distinct()
    long = parts.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", F.col("part").cast("long"), "text")
    tables = long.mapInArrow(run, f"conv_id {kind}, part long, through array<double>")
    return tables.groupBy("conv_id").applyInPandas(best_path, f"conv_id {kind}, part long, before int, end int")


def parse_conversations(parts: DataFrame, model: LineModel) -> DataFrame:
    """(conv_id, part, n_turns, roles, rendered) of written conversations, each decoded as one chain over its parts."""
    ends = part_ends(parts, model).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before", "end")
    placed = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return parse_transcripts(placed, model, keep=("conv_id", "part"), ends=("before", "end"))


#: Turns of one conversation that are written in one part; any number gives the same turns.
TURNS_TOGETHER = 256
#: Marker styles of written transcripts: before and after the role's name, and the names used.
STYLES = (("", ": ", ("System", "User", "Assistant")), ("### ", "\n", ("System", "Human", "Assistant")), ("<|", "|> ", ("system", "user", "assistant")), ("", ": ", ("Context", "Q", "A")), ("[", "] ", ("SYSTEM", "CUSTOMER", "AGENT")))


def written_transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, part, text, line_roles) from a (conv_id, turn, role, text) table: conversations as plain transcripts.

    Each conversation has one marker style by a hash of its id; every fourth turn or so (by a hash) has no marker. Rows
    equal in every column count once. A row with a null turn comes first; an unknown or null role is written as it
    is known to nobody, without marker. A conversation's turns are dealt into parts by their rank.
    """
    names = F.array(*(F.array(*(F.lit(n) for n in s[2])) for s in STYLES))
    before, after = F.array(*(F.lit(s[0]) for s in STYLES)), F.array(*(F.lit(s[1]) for s in STYLES))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    role_at = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role")).cast("int") - 1
    marked = F.coalesce(F.pmod(F.xxhash64("conv_id", "turn", F.lit(3)), F.lit(4)) != 0, F.lit(True)) & F.coalesce(role_at >= 0, F.lit(False))
    marker = F.when(marked, F.concat(F.get(before, style), F.get(F.get(names, style), role_at), F.get(after, style))).otherwise(F.lit(""))
    written = F.concat(marker, F.coalesce("text", F.lit("")))
    begins = F.when(role_at >= 0, F.col("role"))
    lines = F.concat(F.array(begins), F.array_repeat(F.lit(None).cast("string"), F.size(F.split("written", "\n", -1)) - 1))
    rows = turns.select("conv_id", "turn", "role", "text").distinct().withColumn("written", written).withColumn("lines", lines)
    rows = rank_in_groups(rows.withColumn("nth", F.coalesce(F.col("turn").cast("long"), F.lit(-1))), ["conv_id"], ["nth", "role", "text"], "at")
    part = F.floor((F.col("at") - 1) / TURNS_TOGETHER).alias("part")
    whole = rows.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("at", "written", "lines"))).alias("all"))
    return whole.select("conv_id", "part", F.array_join(F.transform("all", lambda x: x["written"]), "\n").alias("text"), F.flatten(F.transform("all", lambda x: x["lines"])).alias("line_roles"))
