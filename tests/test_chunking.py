"""Chunking: windows, structure, tables, families."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as ck
from corpusloom.operators import structure as st

H = lambda t, level=1: {"text": t, "level": level, "page_number": 1}
P = lambda text, headings=(), tables=(), n=1: {"page_number": n, "text": text, "headings": list(headings), "tables": [{"rows": r, "page_number": n} for r in tables]}


def test_fixed_windows(spark):
    rows = ck.chunk_fixed(spark.createDataFrame([(1, "0123456789a")], "doc_id long, text string"), 6, 2).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content) for r in rows] == [(0, "012345"), (1, "456789"), (2, "89a")]


@pytest.mark.parametrize("size,overlap", [(1, 0), (5, 2), (7, 6)])
def test_fixed_against_a_loop(spark, size, overlap):
    texts = ["", " ", "a", "ab   \n  cd", "x" * 23, "ab cd " * 9, None]
    got = {}
    for r in ck.chunk_fixed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, overlap).orderBy("chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for i, t in enumerate(texts):
        expected = []
        for at in range(0, len(t or ""), size - overlap):
            if t[at : at + size].strip():
                expected.append(t[at : at + size])
            if at + size >= len(t):
                break
        assert got.get(i, []) == expected
    with pytest.raises(ValueError):
        ck.chunk_fixed(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 3, 3)


def made(spark, pages, strategy, *sizes):
    df = spark.createDataFrame([("d", pages)], f"doc_id string, pages {st.PAGES}")
    return [r.asDict(True) for r in st.build_chunks(df, strategy, *sizes).orderBy("chunk_type", "chunk_index").collect()]


def contents(spark, pages, size):
    return [c["content"] for c in made(spark, pages, "structure", size)]


def test_headings_begin_every_piece(spark):
    out = contents(spark, [P("A\nfirst text here\nB\nsecond text", [H("A"), H("B")])], 500)
    assert out == ["A\n\nfirst text here", "B\n\nsecond text"]
    page = P("Head\n" + "One sentence here. " * 20, [H("Head")])
    many = made(spark, [page], "structure", 60)
    assert all(c["content"].startswith("Head\n\n") and len(c["content"]) <= 60 for c in many) and len(many) > 5
    assert [c["chunk_id"] for c in many] == [c["chunk_id"] for c in made(spark, [page], "structure", 60)]


def test_paragraphs_and_pages(spark):
    assert contents(spark, [P("one\n\ntwo")], 200) == ["one\n\ntwo"]
    out = made(spark, [P("Top\n", [H("Top")], n=3), P("goes on", n=4)], "structure", 200)
    assert [(c["page_number"], c["content"]) for c in out] == [(3, "Top"), (4, "Top\n\ngoes on")]
    deep = made(spark, [P("A\nB\nC\nx", [H("A", 1), H("B", 2), H("C", 2)])], "structure", 200)
    assert deep[-1]["heading_path"] == ["A", "C"]
    assert contents(spark, [P("   ")], 200) == []


def test_paths_pop_and_carry(spark):
    pages = [P("A\nB\nC", [H("A", 1), H("B", 3), H("C", 2)]), P("below C", n=2), P("D\nd", [H("D", 4)], n=3), P("E\ne", [H("E", 2)], n=4), P("end", n=5)]
    got = {(c["page_number"], c["content"]): c["heading_path"] for c in made(spark, pages, "structure", 200)}
    assert got == {(1, "A"): ["A"], (1, "B"): ["A", "B"], (1, "C"): ["A", "C"], (2, "C\n\nbelow C"): ["A", "C"], (3, "D\n\nd"): ["A", "C", "D"], (4, "E\n\ne"): ["A", "E"], (5, "E\n\nend"): ["A", "E"]}


def test_headings_that_are_not_in_the_text(spark):
    lost = [H("Lost", 1), H("Gone", 2)]
    assert [(c["heading"], c["content"]) for c in made(spark, [P("body", lost)], "structure", 100)] == [("Gone", "Gone\n\nbody")]
    assert contents(spark, [P("", lost)], 100) == ["Lost", "Gone"]
    # found out of order: the second heading stands before the first
    assert contents(spark, [P("B\nfirst\nA\nsecond", [H("A"), H("B")])], 100) == ["B\n\nfirst", "A\n\nsecond"]


def test_cuts(spark):
    assert contents(spark, [P("aaa bbb ccc")], 7) == ["aaa bbb", "ccc"]
    assert contents(spark, [P("abcdefghij")], 4) == ["abcd", "efgh", "ij"]
    assert contents(spark, [P("One. Two! Three? Four")], 9) == ["One. Two!", "Three?", "Four"]
    assert contents(spark, [P("é" * 5 + " 😀😀 x")], 5) == ["é" * 5, "😀😀 x"]
    assert contents(spark, [P("Long heading\nbody text", [H("Long heading")])], 10) == ["Long heading", "body text"]
    assert all(len(c) <= 50 for c in contents(spark, [P("word " * 20_000 + "x" * 5000)], 50))


def test_tables_repeat_their_header(spark):
    rows = [["k", "v"]] + [[f"key{i}", "value " * 3] for i in range(12)]
    out = made(spark, [P("x", tables=[rows])], "tables", 180)
    assert len(out) > 2 and {c["table_part_count"] for c in out} == {len(out)}
    assert all("| k | v |\n| --- | --- |" in c["content"] for c in out)
    assert [c["row_start"] for c in out[1:]] == [c["row_end"] + 1 for c in out[:-1]]
    assert out[0]["row_start"] == 1 and out[-1]["row_end"] == 12
    odd = made(spark, [P("", tables=[[["a|b", None]], []])], "tables", 180)
    assert [(c["content"], c["row_start"], c["row_end"]) for c in odd] == [("Table 1: Full text\n| a\\|b |  |\n| --- | --- |", 0, 0)]


def test_each_table_takes_the_heading_above_it(spark):
    text = "One\n| a | b |\nTwo\n| c | d |"
    out = made(spark, [P(text, [H("One"), H("Two")], [[["a", "b"]], [["c", "d"]]])], "tables", 300)
    assert [c["heading"] for c in out] == ["One", "Two"]
    out = made(spark, [P("Top\nx", [H("Top")]), P("", tables=[[["a"]]], n=2)], "tables", 300)
    assert [(c["heading"], c["page_number"]) for c in out] == [("Top", 2)]


def test_families_and_combined(spark):
    out = made(spark, [P("H\n" + "word " * 200, [H("H")])], "parent_child", 500, 300, 80)
    parents, children = [[c for c in out if c["chunk_type"] == t] for t in ("parent", "child")]
    assert len(parents) > 2 and {c["parent_chunk_id"] for c in children} == {p["chunk_id"] for p in parents}
    assert [i for p in parents for i in p["child_chunk_ids"]] == [c["chunk_id"] for c in children]
    page = P("H\ntext before\n| a | b |\n| --- | --- |\n| 1 | 2 |", [H("H")], [[["a", "b"], ["1", "2"]]])
    out = {c["chunk_type"]: c for c in made(spark, [page], "combined", 300, 300, 80)}
    assert sorted(out) == ["child", "parent", "table"] and "| 1 | 2 |" not in out["child"]["content"]
    assert out["parent"]["child_chunk_ids"] == [out["child"]["chunk_id"], out["table"]["chunk_id"]]
    alone = made(spark, [P("", tables=[[["a"], ["1"]], [["b"]]])], "combined", 300, 300, 80)
    assert [c["chunk_type"] for c in alone] == ["parent", "table", "table"] and alone[0]["child_count"] == 2
    # a table told to lie on a page without text gets a parent of its own behind the others
    far = P("H\nx", [H("H")], [[["a"]]])
    far["tables"][0]["page_number"] = 9
    out = made(spark, [far], "combined", 300, 300, 80)
    assert [(c["chunk_type"], c["chunk_index"], c["page_number"]) for c in out] == [("child", 0, 1), ("parent", 0, 1), ("parent", 1, 9), ("table", 0, 9)]


def test_lines_that_repeat_a_table_go(spark):
    text = "a  b\n|a | b|\n|:---|---:|\n| x\\|y | |\nx|y\n| other | row |"
    df = spark.createDataFrame([("d", 1, text, [], [([["a", "b"], ["x|y", None]], 1)])], f"doc_id string, page_number int, text string, headings array<struct<text:string,level:int>>, tables {st.TABLES}")
    assert st.without_table_rows(df).head().text == "| other | row |"


def test_markdown_to_chunks_in_spark(spark):
    md = "# Top\nintro\n\n ## Part \n| a | b |\n|---|:---:|\n| 1 | 2\\|3 |\n|---|---|\n| 4 |\n\nend\n| not | a table |\n####### seven"
    docs = spark.createDataFrame([("d1", md), ("d2", None), ("d3", "|\n| --- |\r\n| x |")], "doc_id string, text string")
    pages = st.parse_markdown_pages(docs)
    got = {r.doc_id: r.pages[0] for r in pages.collect()}
    p = got["d1"]
    assert [(h.text, h.level) for h in p.headings] == [("Top", 1), ("Part", 2)] and [t.rows for t in p.tables] == [[["a", "b"], ["1", "2|3"], ["4"]]]
    assert p.text.startswith("Top\nintro\n\nPart\n| a | b |") and p.text.endswith("| not | a table |\n####### seven")
    assert got["d2"].text == "" and got["d2"].headings == [] and [t.rows for t in got["d3"].tables] == [[[""], ["x"]]]
    for strategy in ("structure", "tables", "parent_child", "combined"):
        assert st.build_chunks(pages, strategy).where("error is not null").count() == 0
        assert st.build_chunks(pages.limit(0), strategy).count() == 0
    broken = spark.createDataFrame([("d", [(1, "Head x", [("Head", None, 1), ("x", 2, 1)], None)]), ("e", [(None, "x", None, None)]), ("f", [(1, "fine", None, None)])], f"doc_id string, pages {st.PAGES}")
    assert {r.doc_id: (r.content, r.error) for r in st.build_chunks(broken, "structure").collect()} == {"d": (None, "heading without text or level"), "e": (None, "page without number"), "f": ("fine", None)}
    exploded = ck.explode_pages(pages.where("doc_id = 'd1'")).collect()
    assert [(r.doc_id, r.parent_doc_id) for r in exploded] == [("d1-p001", "d1")]


def test_headings_from_words(spark):
    rows = [("d", 1, "Big", 20.0, 1.0, 0.0), ("d", 1, "title", 20.0, 1.001, 5.0), ("d", 1, "mid", 12.0, 2.0, 0.0)] + [("d", 1, "body", 10.0, 3.0 + i, 0.0) for i in range(5)] + [("d", 1, "1.2 numbered", 10.0, 30.0, 0.0)]
    got = ck.headings_from_words(spark.createDataFrame(rows, "doc_id string, page_number int, text string, size double, top double, x0 double"))
    assert sorted((r.text, r.level) for r in got.collect()) == [("1.2 numbered", 3), ("Big title", 1), ("mid", 2)]


def test_clean_tables(spark):
    df = spark.createDataFrame([([["a", None], [None, " "]],), ([[None]],)], "rows array<array<string>>")
    assert [r.rows for r in ck.clean_extracted_tables(df).collect()] == [[["a", ""]]]
    assert ck.with_document_chunk_count(spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")).agg(F.max("document_chunk_count").alias("m")).first().m == 2


def test_pages_without_bars_are_not_looked_at_by_line(spark, monkeypatch):
    rows = [("a", " x\r\ny z\n\n", []), ("b", None, []), ("c", "a  b\nc", [([["a", "b"]], 1)]), ("d", "x\n | --- |\n", []), ("e", "| u |\nu", [([["u"]], 1)])]
    df = spark.createDataFrame([(d, 1, t, [], x) for d, t, x in rows], f"doc_id string, page_number int, text string, headings array<struct<text:string,level:int>>, tables {st.TABLES}")
    assert {r.doc_id: r.text for r in st.without_table_rows(df).collect()} == {"a": "x\ny\nz", "b": "", "c": "c", "d": "x", "e": ""}
    # a line is split into cells once, and tightened only on pages with tables
    calls, cells = [], st.cells_of
    monkeypatch.setattr(st, "cells_of", lambda line: calls.append(1) or cells(line))
    plan = st.without_table_rows(df).select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and plan.count("(?<!\\\\)\\|") == 1
