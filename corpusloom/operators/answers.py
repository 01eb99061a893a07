"""A log of provider answers: validated, rendered and cleaned."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BLOCKS, MOST_ROWS, MOST_COLUMNS, MOST_CHARS = 64, 128, 12, 4000


def _once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def _text(value: object, sources: int, refs: object) -> str:
    _need(isinstance(value, str) and 0 < len(value.strip()) and len(value) <= MOST_CHARS, "a text is missing or too long")
    _need(isinstance(refs, list) and all(type(r) is int and 1 <= r <= sources for r in refs), "a source that isn't there")
    return value.strip() + "".join(f" [{r}]" for r in sorted(set(refs)))


def rendered_answer(raw: str | None, sources: int) -> tuple[str, str, str | None]:
    """(status, text, reason): answered, abstained or invalid."""
    try:
        answer = json.loads(raw or "", object_pairs_hook=_once)
        _need(isinstance(answer, dict) and set(answer) <= {"status", "blocks"}, "other keys than status and blocks")
        _need(answer.get("status") in ("answered", "abstained"), "an unknown status")
        blocks = answer.get("blocks")
        _need(isinstance(blocks, list) and len(blocks) <= MOST_BLOCKS, "blocks are no list, or too many")
        if answer["status"] == "abstained":
            _need(not blocks, "an abstention with blocks")
            return "abstained", "", None
        _need(bool(blocks), "an answer without blocks")
        out = []
        for b in blocks:
            _need(isinstance(b, dict), "a block is no object")
            kind = b.get("type")
            if kind == "paragraph":
                out.append(_text(b.get("text"), sources, b.get("sources", [])))
            elif kind == "list":
                items = b.get("items")
                _need(isinstance(items, list) and 0 < len(items) <= MOST_ROWS, "a list without items, or with too many")
                out.append("\n".join("- " + _text(i.get("text") if isinstance(i, dict) else None, sources, i.get("sources", [])) for i in items))
            elif kind == "table":
                columns, rows = b.get("columns"), b.get("rows")
                _need(isinstance(columns, list) and 0 < len(columns) <= MOST_COLUMNS and isinstance(rows, list) and 0 < len(rows) <= MOST_ROWS, "a table's size")
                _need(all(isinstance(r, list) and len(r) == len(columns) for r in rows), "a row of another length")
                cells = lambda r: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ")[:MOST_CHARS] for c in r) + " |"
                out.append("\n".join([cells(columns), "|" + " --- |" * len(columns), *map(cells, rows)]))
            else:
                raise ValueError("an unknown kind of block")
        return "answered", "\n\n".join(out), None
    except (ValueError, TypeError, AttributeError, RecursionError) as e:
        return "invalid", "", str(e)


def answer_log_audit(log: DataFrame) -> DataFrame:
    """(answer_id, status, text, reason) of a log with (answer_id, raw, source_count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [rendered_answer(r, n or 0) for r, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], names=["answer_id", "status", "text", "reason"])

    return log.select(F.col("answer_id").cast("long"), "raw", F.col("source_count").cast("int")).mapInArrow(run, "answer_id long, status string, text string, reason string")


def clean_answer_log(log: DataFrame, abstains: str, text_col: str = "text") -> DataFrame:
    """Add public_text (hidden blocks, wrappers and [n] markers removed) and abstained (by a pattern)."""
    t = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?s)<think>.*?(?:</think>|$)", "")
    t = F.regexp_replace(t, r"(?s)^\s*```[a-zA-Z]*\n(.*?)\n?```\s*$", "$1")
    public = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*\[\d{1,6}\]", ""), r"[ \t]+\n", "\n"))
    return log.withColumn("public_text", public).withColumn("abstained", F.coalesce(F.col("public_text").rlike(abstains), F.lit(False)))


def session_messages(answers: DataFrame) -> DataFrame:
    """Two rows (conv_id, turn, role, text) per answered question, to append to a conversations table."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    rows = answers.select("conv_id", "next_turn", F.posexplode(pair).alias("at", "m"))
    return rows.select("conv_id", (F.col("next_turn") + F.col("at")).alias("turn"), "m.role", "m.text")
