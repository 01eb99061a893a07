"""Complete catalogues: damaged, older, smaller and conflicting tables refuse."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import complete_catalog as cc

RULES = cc.CatalogRules("name", "code", r"7\d{3}[A-Z]*", ("a.org", "b.a.org"), ("N", "S"))
HEADER = "| no | Code | Name of it |\n| --- | --- | --- |\n"
COLUMNS = "chunk_id string, content string, doc_id string, chunk_type string, source_url string, source_file string, raw_file string, version string, content_hash string, admission_year string, academic_year string, campus string, table_index int, table_part int, table_part_count int, row_start int, row_end int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def family(place="N", year=2026, doc="d", table=None, rows=("| I | GROUP | GROUP |", "| 1 | 7001 | Alpha |", "| 2 | 7002 | **Beta** |"), tag=""):
    table = (0 if place == "N" else 1) if table is None else table
    return [
        {"chunk_id": f"{doc}-{place}-{year}-{i}{tag}", "content": HEADER + row, "doc_id": doc, "chunk_type": "table", "source_url": f"https://b.a.org/{doc}", "admission_year": str(year), "campus": place, "table_index": table, "table_part": i, "table_part_count": len(rows), "row_start": i, "row_end": i}
        for i, row in enumerate(rows, 1)
    ]


def damage(name):
    north, south = family(), family("S")
    if name == "missing_part":
        north.pop(1)
    elif name == "duplicate_part":
        north[1]["table_part"] = 1
    elif name == "other_type":
        north[1]["chunk_type"] = "text"
    elif name == "row_gap":
        north[1]["row_start"] = 8
    elif name == "wrong_row_count":
        north[1]["row_end"] = 3
    elif name == "missing_code":
        north[1]["content"] = HEADER + "| 1 | none yet | Alpha |"
    elif name == "wrong_header":
        north[1]["content"] = north[1]["content"].replace("Code", "Number")
    elif name == "wrong_year":
        north[1]["admission_year"] = "2025"
    elif name == "wrong_place":
        north[1]["campus"] = "S"
    elif name == "wrong_version":
        north[1]["version"] = "other"
    elif name == "duplicate_id":
        north[1]["chunk_id"] = north[0]["chunk_id"]
    elif name == "duplicate_code":
        north[2]["content"] = HEADER + "| 2 | 7001 | Beta |"
    elif name == "unsafe_name":
        north[1]["content"] = HEADER + "| 1 | 7001 | <b>Alpha</b> |"
    elif name == "ragged_row":
        north[1]["content"] = HEADER + "| 1 | 7001 | Alpha | more |"
    return north + south


DAMAGES = ["missing_part", "duplicate_part", "other_type", "row_gap", "wrong_row_count", "missing_code", "wrong_header", "wrong_year", "wrong_place", "wrong_version", "duplicate_id", "duplicate_code", "unsafe_name", "ragged_row"]


def answered(spark, cases, places=(), asked=()):
    """Answered case names; each case is a corpus of its own, told by a prefix of its documents and by its hosts' place names."""
    out = {}
    parts = [{**p, "doc_id": f"{case}/{p['doc_id']}", "campus": f"{case}/{p['campus']}"} for case, own in cases.items() for p in own]
    df = spark.createDataFrame([tuple(p.get(n) for n in NAMES) for p in parts], COLUMNS).repartition(3)
    requests = spark.createDataFrame([(case, [f"{case}/{p}" for p in places or ("N", "S")], list(asked)) for case in cases], "query_id string, places array<string>, asked_years array<int>")
    for r in cc.complete_catalog(requests, df, RULES).collect():
        out.setdefault(r.query_id, []).append(r)
    return {k: sorted(v, key=lambda r: (r.place, r.entry)) for k, v in out.items()}


def test_damage_refuses_everything(spark):
    cases = {name: damage(name) for name in DAMAGES} | {"whole": damage("none")}
    # a damaged wider table isn't replaced by a smaller or older one
    large, small = family(), family(table=2, tag="-small")
    large[0]["table_part_count"] = 20
    large[-1]["row_end"] = 20
    cases["larger_is_damaged"] = large + small + family("S") + family(year=2025, table=5) + family("S", year=2025, table=6)
    cases["newest_is_damaged"] = damage("missing_part") + family(year=2025, table=5) + family("S", year=2025, table=6)
    cases["tie"] = family() + family(table=2, tag="-b") + family("S")
    other = family(doc="other")
    other[1]["content"] = HEADER + "| 1 | 7001 | Gamma |"
    cases["conflict"] = family() + family("S") + other + family("S", doc="other")
    cases["agreement"] = family() + family("S") + family(doc="other", tag="x") + family("S", doc="other", tag="x")
    cases["two_documents_cover_one_place_each"] = family() + family("S", doc="other")
    cases["other_host"] = [{**p, "source_url": "https://evil.org/x"} for p in damage("none")]
    cases["no_year"] = [{**p, "admission_year": None} for p in damage("none")]
    cases["older_has_more"] = family() + family("S") + family(year=2025, doc="old", rows=[f"| {i} | 70{i:02d} | P{i} |" for i in range(1, 9)]) + family("S", year=2025, doc="old")
    cases["longer_document"] = family() + family("S") + family(doc="long", rows=["| 1 | 7001 | Alpha |", "| 2 | 7002 | Beta |", "| 3 | 7003AB | Gamma |"]) + family("S", doc="long")
    got = answered(spark, cases)
    assert set(got) == {"whole", "agreement", "older_has_more", "longer_document"}
    assert [(r.place[-1], r.entry, r.code, r.name, r.section.label) for r in got["whole"]] == [(p, i, f"700{i}", n, "GROUP") for p in "NS" for i, n in ((1, "Alpha"), (2, "Beta"))]
    assert {r.year for r in got["older_has_more"]} == {2026} and [r.code for r in got["longer_document"]] == ["7001", "7002", "7003AB", "7001", "7002"]


def test_requests(spark):
    cases = {"x": family() + family("S", year=2025)}
    assert answered(spark, cases) == {}
    assert [r.year for r in answered(spark, cases, ("N",))["x"]] == [2026, 2026]
    assert [r.year for r in answered(spark, cases, ("S",), (2025,))["x"]] == [2025, 2025]
    assert answered(spark, cases, ("S",), (2026,)) == {} and answered(spark, cases, ("N",), (2025, 2026)) == {}


def test_proofs_name_their_fault(spark):
    faults = {"missing_part": "parts", "duplicate_part": "parts", "other_type": "type", "row_gap": "rows", "wrong_row_count": "rows", "missing_code": "broken", "wrong_header": "physical", "wrong_year": "identity", "wrong_version": "identity", "duplicate_id": "ids", "duplicate_code": "codes", "unsafe_name": "broken", "ragged_row": "broken", "whole": None}
    parts = [{**p, "doc_id": name} for name in faults for p in damage(name) if p["table_index"] == 0]
    df = spark.createDataFrame([tuple(p.get(n) for n in NAMES) for p in parts], COLUMNS)
    assert {r.doc_id: r.fault for r in cc.proved_tables(df, RULES)[0].collect()} == faults


def test_sections_and_rendering(spark):
    rows = ["|  | First | First |", "| 1 | 7001 | Alpha |", "|  | Below | Below |", "| 2 | 7002 | Beta |", "| II | Second | Second |", "| 3 | 7003 | Gamma |", "| 4 | 7004 | Delta |"]
    df = spark.createDataFrame([tuple(p.get(n) for n in NAMES) for p in family(rows=rows)], COLUMNS)
    requests = spark.createDataFrame([(1, ["N"], [])], "query_id long, places array<string>, asked_years array<int>")
    entries = cc.complete_catalog(requests, df, RULES).cache()
    assert [(r.section and r.section.label, r.subsection and r.subsection.label) for r in entries.orderBy("entry").collect()] == [("First", None), ("First", "Below"), ("Second", None), ("Second", None)]
    sources = df.select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.col("table_part").alias("marker"))
    text = "### Programmes of 2026, N\n\n#### First [1]\n\n- Programme **Alpha**, code **7001** [2].\n\n##### Below [3]\n\n- Programme **Beta**, code **7002** [4].\n\n#### Second [5]\n\n- Programme **Gamma**, code **7003** [6].\n- Programme **Delta**, code **7004** [7]."
    assert [r.text for r in cc.render_catalog(entries, sources).collect()] == [text]
    assert cc.render_catalog(entries, sources.where("marker > 1")).count() == 0
    assert cc.render_catalog(entries, sources.union(sources.where("marker = 1"))).count() == 0
    assert cc.complete_catalog(requests, df.limit(0), RULES).count() == 0 and cc.complete_catalog(requests.limit(0), df, RULES).count() == 0


@pytest.mark.parametrize("line,kind", [("| 1 | 7001 | Alpha |", "entry"), ("| IV | A | A |", "section"), ("| x | 7001 | Alpha |", "broken"), ("| I | A | B |", "broken")])
def test_kinds_of_lines(spark, line, kind):
    df = spark.createDataFrame([tuple(p.get(n) for n in NAMES) for p in family(rows=[line])], COLUMNS)
    assert [r.kind for r in cc.table_rows(df, RULES).orderBy("at").collect()] == ["header", kind]


def test_place_by_place(spark):
    from corpusloom.operators import catalog_tables as ct

    line = "| n | v |\n| --- | --- |\n| {} | x |"
    part = lambda doc, table, year, place, k, n, row, **more: {"doc_id": doc, "table_index": table, "table_part": k, "table_part_count": n, "row_start": row, "row_end": row, "content": line.format(row), "title": "t", "source_url": "https://a.org/x", "admission_year": year, "campus": place} | more
    rows = [part("whole", 0, "2024", "A", 1, 1, 1), part("small", 0, "2024", "B", 1, 1, 1), part("small", 1, "2024", "B", 1, 3, 1, row_end=9), part("old", 0, "2023", "C", 1, 1, 1), part("tie", 0, "2024", "D", 1, 1, 1), part("tie", 1, "2024", "D", 1, 1, 1)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id string, table_index int, table_part int, table_part_count int, row_start int, row_end int, content string, title string, source_url string, admission_year string, campus string")
    assert [r.campus for r in ct.complete_catalog(df, ["a.org"]).collect()] == ["A"]


def test_proof_keeps_no_lines_and_counts_nothing_distinct(spark, monkeypatch):
    rows = [("d", i, p, f"{i}-{p}") for i in range(20) for p in (1, 2)]
    parts = spark.createDataFrame(rows, "doc_id string, table_index long, table_part int, chunk_id string").repartition(4, "table_index")
    text = "| no | Code | Name |\n| --- | --- | --- |\n| {p} | 700{p} | x |"
    content = F.replace(F.lit(text), F.lit("{p}"), F.col("table_part").cast("string"))
    none = [F.lit(None).cast("string").alias(c) for c in ("source_file", "raw_file", "version", "content_hash", "academic_year")]
    parts = parts.select("*", content.alias("content"), F.lit("table").alias("chunk_type"), F.lit("https://a.org/x").alias("source_url"), *none, F.lit("2024").alias("admission_year"), F.lit("N").alias("campus"), F.lit(2).alias("table_part_count"), F.col("table_part").alias("row_start"), F.col("table_part").alias("row_end"))
    monkeypatch.setattr(cc, "checkpointed", None)
    tables, entries = cc.proved_tables(parts, RULES)
    assert [(r.declared, r.entries, r.fault) for r in tables.collect()] == [(2, 2, None)] * 20 and entries.count() == 40
    # several distinct counts would multiply the rows before they are shuffled
    assert "Expand" not in tables._jdf.queryExecution().executedPlan().toString()


def test_a_proof_reads_each_text_once_in_batches(spark):
    df = spark.createDataFrame([tuple(p.get(n) for n in NAMES) for p in damage("none")], COLUMNS)
    tables = cc.proved_tables(df, RULES)[0].select("doc_id", "table_index", "declared", "entries", "fault")
    plan = tables._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [facts(content") == 1 and "lambdafunction" not in plan
    assert sorted((r.table_index, r.entries, r.fault) for r in tables.collect()) == [(0, 2, None), (1, 2, None)]


def test_only_parts_of_whole_documents_are_kept_and_read(spark, monkeypatch):
    kept, real = [], cc.checkpointed
    monkeypatch.setattr(cc, "checkpointed", lambda df: kept.append(real(df)) or kept[-1])
    cases = {f"older{y}": family(year=y, table=y) + family("S", year=y, table=y + 100) for y in range(2000, 2020)}
    parts = [p for own in cases.values() for p in own] + family() + family("S") + family(doc="half") + [p | {"table_part_count": 9} for p in family(doc="damaged") + family("S", doc="damaged")]
    df = spark.createDataFrame([tuple(p.get(n) for n in NAMES) for p in parts], COLUMNS)
    requests = spark.createDataFrame([(1, ["N", "S"], [])], "query_id long, places array<string>, asked_years array<int>")
    found = cc.complete_catalog(requests, df, RULES)
    assert [r.code for r in found.orderBy("place", "entry").collect()] == ["7001", "7002", "7001", "7002"]
    texts = [k for k in kept if "content" in k.columns]
    assert len(texts) == 1 and texts[0].count() == 6 and {r.doc_id for r in texts[0].collect()} == {"d"}


def test_rendering_digests_nothing_again(spark):
    df = spark.createDataFrame([tuple(p.get(n) for n in NAMES) for p in family()], COLUMNS)
    requests = spark.createDataFrame([(1, ["N"], [])], "query_id long, places array<string>, asked_years array<int>")
    entries = cc.complete_catalog(requests, df, RULES)
    marked = df.select(F.lit(1).cast("long").alias("query_id"), "chunk_id", F.col("table_part").alias("marker"))
    text = cc.render_catalog(entries, marked)
    assert "sha2" not in text._jdf.queryExecution().optimizedPlan().toString() and text.count() == 1


def test_remembered_lines_stand_under_their_own_header():
    read = cc.line_reader(RULES)
    wide = "| no | Code | Name of it | more |"
    lines = ["above | it", HEADER.strip(), "| I | A | A |", "| 1 | 7001 | A |", wide, "| I | A | A |", "| 1 | 7001 | A | x |", "| no | **Còde** | __Nâme__ |", "|| I | A | A ||"]
    for _ in range(2):
        assert [(at, x[3], len(x[1])) for at, x in read("\r\n".join(lines))] == [(1, "header", 3), (3, "section", 3), (4, "entry", 3), (5, "header", 4), (6, "broken", 4), (7, "entry", 4), (8, "header", 3), (9, "section", 3)]
