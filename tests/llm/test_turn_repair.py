"""Conversation repair against a search over edit sequences, and whole tables against a plain walk."""

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from corpusloom.llm import turn_repair as tr
from corpusloom.llm.queries import op13_turn_repair

RIGHT = re.compile(r"(s?(ua)+)?\Z")


def searched(rows):
    """(cost, letters, turns) of the best edits of [(role, text, must go, cut)], by best-first search over edits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, initials, turns = heapq.heappop(heap)
        if i == len(rows) and RIGHT.match(initials):
            return cost, letters, list(turns)
        state = (i, initials[-1:])
        # of one state a costlier way never wins; ways of equal cost may
        if (state, cost, letters) in done or len(letters) > 3 * len(rows) + 2:
            continue
        done.add((state, cost, letters))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, letters + "I", i, initials + role[0], (*turns, (role, ""))))
        if i < len(rows):
            role, text, must, cut = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, initials, turns))
            if not must:
                heapq.heappush(heap, (cost + cut, letters + "K", i + 1, initials + (role[:1] or "-"), (*turns, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + cut, letters + "R", i + 1, initials + other[0], (*turns, (other, text))))
        # wrong beginnings lead nowhere
        heap = [h for h in heap if re.match(r"(s?(ua)*u?)?\Z", h[3])]
        heapq.heapify(heap)
    raise AssertionError


def test_cheapest_against_search():
    rng = random.Random(6)
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "assistant", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        coded = bytes(("sua".index(r[0]) if r[:1] in ("s", "u", "a") else 3) | 4 * must | 8 * (cut and not must) for r, _, must, cut in rows)
        assert tr.cheapest(coded) == searched([(r, t, m, c and not m) for r, t, m, c in rows])[:2]


def test_known_edits():
    assert tr.cheapest(b"") == (0, "")
    assert tr.cheapest(bytes([0, 1, 2])) == (0, "KKK")
    assert tr.cheapest(bytes([1])) == (2, "KI")
    assert tr.cheapest(bytes([0])) == (3, "D")
    assert tr.cheapest(bytes([2, 2])) == (2, "RK")
    assert tr.cheapest(bytes([1, 2] * 1000 + [1])) == (2, "K" * 2001 + "I")


def walked(turns):
    """What the query gives, by plain Python."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for c, turn, role, text in turns:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            rows += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        numbers = {r[0] for r in rows if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        judged, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for i, (_, role, text) in enumerate(rows):
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "truncated" if solid[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, letters, kept = searched(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, letters, digest)
    return out


def test_rows_against_a_walk(spark, tmp_path):
    rng = random.Random(12)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Fine.", "Is it?  \n", "cut short", "é!", "", " \t\x0b", None, "\x1c.", "..", "no end\x85"]
    turns = [(c, t, rng.choices(roles, [5, 5, 2, 1, 1, 1])[0], rng.choice(texts)) for c in range(80) for t in range(rng.randint(1, 5))]
    turns += [(500, None, "user", "a."), (500, None, "assistant", "b."), (500, 9, "user", "c"), (500, 4, "assistant", "d."), (500, 4, "assistant", "d.")]
    turns += [(None, 1, "user", "q?"), (None, None, None, None), (600, -5, "user", "x" * 300_000), (600, 5, "assistant", "y."), (601, 0, "user:", "b."), (601, 1, "user", ":b.")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("clash")).repartition(3)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in op13_turn_repair(spark, str(tmp_path)).collect()}
    assert found == walked(turns)


def test_repaired_turns_are_right(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = tr.damaged(turns)
    found = tr.reports(rows)
    repaired = tr.repaired_turns(rows, found).collect()
    digests = {r.conv_id: r.repaired_sha256 for r in tr.repaired_digests(rows, found).collect()}
    by_conv = {}
    for r in sorted(repaired, key=lambda r: (r.conv_id, r.place)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for r in found.collect():
        own = by_conv.get(r.conv_id, [])
        assert RIGHT.match("".join(x.role[0] for x in own)) and [x.place for x in own] == list(range(1, len(own) + 1))
        assert "".join(x.edit for x in own) == r.audit.replace("D", "")
        assert digests[r.conv_id] == hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest()


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([("a", 1, "user", "x.", 3)], "c string, `t.n` int, role string, text string, conv int")
    assert [tuple(r) for r in tr.reports(df, "c", "t.n").collect()] == [("a", 0, 0, 0, 0, 0, 2, "KI")]
    assert [tuple(r) for r in tr.repaired_turns(df, tr.reports(df, "c", "t.n"), "c", "t.n").collect()] == [("a", 1, "user", "x.", "K"), ("a", 2, "assistant", "", "I")]
    none = df.limit(0)
    assert tr.reports(none, "c", "t.n").count() == 0 and tr.repaired_digests(none, tr.reports(none, "c", "t.n"), "c", "t.n").count() == 0


def test_batches_keep_conversations_whole(spark, monkeypatch):
    monkeypatch.setattr(tr, "BATCH_CHARS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(5) for t in range(40 + c)], "conv_id long, turn long, role string, text string")
        found = tr.reports(turns)
        assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {c: (2, "K" * (40 + c) + "I") if c % 2 else (0, "K" * (40 + c)) for c in range(5)}
        whole = {c: "\n".join([f"{'user' if t % 2 == 0 else 'assistant'}:{t}." for t in range(40 + c)] + ["assistant:"] * (c % 2)) for c in range(5)}
        assert {r.conv_id: r.repaired_sha256 for r in tr.repaired_digests(turns, found).collect()} == {c: hashlib.sha256(w.encode()).hexdigest() for c, w in whole.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
