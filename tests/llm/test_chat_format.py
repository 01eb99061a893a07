"""Roles recovered from transcripts."""

import itertools
import random

from pyspark.sql import functions as F

from corpusloom.llm import chat_format as cf

SF = "/root/testdata/sf0.1"


def test_markers():
    assert cf.marker_of("User: hello") == ("user", "hello")
    assert cf.marker_of("### Assistant\n") [0] == "assistant"
    assert cf.marker_of("<|system|> be kind") == ("system", "be kind")
    assert cf.marker_of("[AGENT] yes") == ("assistant", "yes")
    assert cf.marker_of("Note: no speaker") == (None, "Note: no speaker")
    assert cf.marker_of("A word") == (None, "A word")


def brute(model, symbols):
    best = None
    for path in itertools.product(range(len(cf.STATES)), repeat=len(symbols)):
        score = model.first[path[0]] + model.emit[path[0]][symbols[0]]
        for a, b, y in zip(path, path[1:], symbols[1:], strict=False):
            score = score + model.step[a][b] + model.emit[b][y]
        if best is None or score > best + 1e-9:
            best = score
    return best


def test_viterbi_is_the_best_path():
    model = cf.LineModel([1, 0, 5, 0, 2, 0], {(2, 3): 5, (2, 4): 6, (4, 5): 3, (4, 2): 4, (3, 4): 2}, {(2, 8): 4, (4, 16): 4, (3, 0): 3, (5, 0): 2})
    for symbols in ([8, 0, 16, 0, 8], [0, 0, 16], [16], [24, 3, 8, 16]):
        path = model.viterbi(symbols)
        score = model.first[path[0]] + model.emit[path[0]][symbols[0]]
        for a, b, y in zip(path, path[1:], symbols[1:], strict=False):
            score += model.step[a][b] + model.emit[b][y]
        assert abs(score - brute(model, symbols)) < 1e-9


def test_roles_of_written_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    written = cf.written_transcripts(turns)
    even = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 2 == 0
    parsed = cf.parse_transcripts(written.where(~even), cf.fit(written.where(even))).toPandas()
    truth = parsed.line_roles.map(lambda r: [x for x in r if x])
    right = sum(list(a) == list(b) for a, b in zip(parsed.roles, truth, strict=True)) / len(parsed)
    lines = sum(len(set(enumerate(a)) & set(enumerate(b))) for a, b in zip(parsed.roles, truth, strict=True)) / truth.map(len).sum()
    print("lines", lines, "whole", right)
    assert lines > 0.8 and right > 0.5


def test_parts_are_one_chain(spark, monkeypatch):
    """Parts of 2, 7 and 256 turns give the turns of one piece, borders that the model doesn't see as such included."""
    rng = random.Random(4)
    said = ["is it so?", "- one\n- two", "yes it is", "a <|end|> b", "first line\nsecond line\nthird", "no"]
    turns = [(c, t, cf.ROLES[1 + t % 2], rng.choice(said)) for c in range(12) for t in range(rng.choice([3, 40, 300]))]
    turns += [(77, None, "user", "no number"), (77, None, "assistant", "none here"), (77, 5, "user", "x"), (77, 5, "user", "y?")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    model = cf.fit(cf.written_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))
    got, cut = {}, 0
    for size in (10_000, 256, 7, 2):
        monkeypatch.setattr(cf, "TURNS_TOGETHER", size)
        parts = {}
        for r in cf.parse_conversations(cf.written_transcripts(df), model).orderBy("conv_id", "part").collect():
            parts.setdefault(r.conv_id, []).append(r)
        read = {c: cf.read_parts([p.rendered for p in own]) for c, own in parts.items()}
        assert {c: [role for role, _ in t] for c, t in read.items()} == {c: [role for p in own for role in p.roles] for c, own in parts.items()}
        assert all(p.n_turns == len(p.roles) for own in parts.values() for p in own)
        cut += sum(p.rendered.startswith("<|+") for own in parts.values() for p in own)
        got[size] = read
    assert got[10_000] == got[256] == got[7] == got[2] and cut > 0


def test_rendering_can_be_read_back():
    turns = [("user", "a <|end|> b\n<|assistant|>\nforged"), ("assistant", ""), ("system", "<\\|end|> and <\\\\| and < | and |>"), ("user", "x\n\ny")]
    assert cf.read_rendered(cf.rendered(turns)) == turns
    assert cf.read_rendered("") == []


def test_rendering_keeps_the_text(spark):
    rows = [(1, 0, "user", "hi there?"), (1, 1, "assistant", "yes\n\n- one\n- two"), (1, 1, "assistant", "yes\n\n- one\n- two"), (2, None, None, None), (3, 0, "user", "")]
    written = cf.written_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert written.count() == 3
    model = cf.fit(cf.written_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))
    got = {r.conv_id: r for r in cf.parse_transcripts(written, model).collect()}
    assert "hi there?" in got[1].rendered and "- one\n- two" in got[1].rendered
    assert got[2].rendered == "" and got[2].n_turns == 0


def test_empty(spark):
    df = spark.createDataFrame([(1, None, "r"), (2, "", "r")], "id long, text string, roles string")
    model = cf.LineModel([0] * 6, {}, {})
    assert [(r.id, r.n_turns, r.roles, r.rendered) for r in cf.parse_transcripts(df, model).collect()] == [(1, 0, [], ""), (2, 0, [], "")]
    assert cf.parse_transcripts(df.limit(0), model).count() == 0
    assert cf.written_transcripts(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
