"""Scope rules, packing, rendering and citations."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scope as sc
from corpusloom.operators import context as cx
from corpusloom.operators import rerank

V = sc.Vocabulary(
    places={"N": r"\bnorth\b", "S": r"\bsouth\b"},
    intents={"cutoff": "cutoff", "tuition": "tuition"},
    default_intent="admissions",
    sections={"cutoff": "cutoff", "tuition": "tuition"},
    off_topic="curriculum",
    strict_intents=("cutoff", "tuition"),
    place_required=("cutoff",),
)
FIELDS = ("chunk_id", "content", "doc_id", "heading", "section", "title", "campus", "campus_code", "campuses", "admission_year", "academic_year", "year", "source_url", "source_file", "raw_file", "version", "content_hash")


def assessed(spark, query, **chunk):
    row = {f: chunk.get(f) for f in FIELDS} | {"heading_path": chunk.get("heading_path", []), "query": query, "query_id": 1, "score": 1.0}
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", heading_path array<string>, query string, query_id long, score double"
    return sc.assess(sc.with_scope(spark.createDataFrame([row], schema), V), V)


def year_cases():
    """A question for one intake year: the chunk's own year decides, an academic year by its first half."""
    for asked in (2041, 2044):
        for known in (None, asked - 1, asked, asked + 1):
            chunk = {} if known is None else {"admission_year": str(known)}
            ambiguities, factors = (["year_missing"], {"year_unknown"}) if known is None else ([], {"year_match"} if known == asked else set())
            yield f"admission {asked}", chunk, known in (None, asked), ambiguities, factors
        for first in (asked - 1, asked):
            yield f"admission {asked}", {"academic_year": f"{first}-{first + 1}"}, first == asked, [], {"academic_start"} if first == asked else set()


def range_cases():
    """A question for an academic year: the same range confirms it, its first year alone leaves it open."""
    asked = "tuition 2051-2052"
    for first in (2050, 2051, 2052):
        yield asked, {"academic_year": f"{first}-{first + 1}"}, first == 2051, [], {"academic_range"} if first == 2051 else set()
        yield asked, {"admission_year": str(first)}, first == 2051, ["academic_range_unconfirmed"] if first == 2051 else [], {"year_match"} if first == 2051 else set()


def place_cases():
    for asked, known in (("south", "South"), ("south", "North"), ("north", None)):
        match = bool(known) and known.lower() == asked
        yield f"cutoff {asked}", {"campus": known} if known else {}, match, [] if known else ["campus_missing"], {"campus_match"} if match else set() if known else {"campus_unknown"}
    yield "the cutoff, please", {}, True, ["campus_unspecified"], set()


CASES = [
    *year_cases(),
    *range_cases(),
    *place_cases(),
    ("how high is tuition", {"heading": "Fees and tuition"}, True, [], {"section_match"}),
    ("how high is tuition", {"heading": "The curriculum"}, True, [], {"curriculum_section"}),
    ("say more of QX7", {"content": "QX7 is a programme"}, True, [], {"exact_entity_code"}),
    ("say more of QX7", {"content": "QX71 is another"}, True, [], set()),
]


@pytest.mark.parametrize("query,chunk,eligible,ambiguities,factors", CASES)
def test_assess(spark, query, chunk, eligible, ambiguities, factors):
    r = assessed(spark, query, **chunk).first()
    assert (r.eligible, r.ambiguities, {f.name for f in r.factors}) == (eligible, ambiguities, factors)


def test_places_and_guard(spark):
    assert assessed(spark, "q", campus="north south", heading="South site").first().s_places == ["S"]
    assert assessed(spark, "q", campus="moon", heading="South site").first().s_places == []
    assert assessed(spark, "q", title="North").first().s_places == ["N"]
    a = assessed(spark, "q 2031", doc_id="d", admission_year="2031", version="1").select("doc_id", *sc.PROVENANCE, "s_years", "s_places", "eligible", "q_years", "q_places")
    for change, ok in (({}, True), ({"version": "2"}, False), ({"doc_id": "e"}, False), ({"source_url": "u"}, False), ({"admission_year": "2030"}, False)):
        b = assessed(spark, "q 2031", **({"doc_id": "d", "admission_year": "2031", "version": "1"} | change)).select("doc_id", *sc.PROVENANCE, "s_years", "s_places", "eligible")
        pair = a.select(*(F.col(c).alias(c if c.startswith("q_") else f"a_{c}") for c in a.columns)).crossJoin(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)))
        assert pair.select(sc.same_scope("a_", "b_").alias("ok")).first().ok is ok


def test_domain_rerank(spark):
    rows = assessed(spark, "cutoff north 2031", campus="North", admission_year="2031", chunk_id="a", content="cutoff").unionByName(assessed(spark, "cutoff north 2031", campus="North", chunk_id="b", content="cutoff")).unionByName(assessed(spark, "cutoff north 2031", campus="South", chunk_id="c", content="cutoff"))
    assert [r.chunk_id for r in rerank.domain_rerank(rows, 5).orderBy("rank").collect()] == ["a", "b"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, pos int, chunk_id string, content string, expansion_type string, doc_id string, score double, title string, place int, tokens array<string>")


def test_pack_skips_and_goes_on(spark):
    rows = [(1, 0, "a", "x" * 10, "exact", "d", 1.0, "t", 0, []), (1, 1, "b", "y" * 24, "exact", "d", 1.0, "t", 1, []), (1, 2, "c", "z" * 5, "exact", "d", 1.0, "t", 2, [])]
    assert [r.chunk_id for r in cx.pack_context(hits(spark, rows), 20, ("doc_id",)).orderBy("place").collect()] == ["a", "c"]


def test_pack_order_and_duplicates(spark):
    rows = [(1, 0, "n", "near", "neighbor", "d", 1.0, "t", 0, []), (1, 1, "e", "exact one", "exact", "d", 1.0, "t", 1, []), (1, 2, "p", "parent", "parent", "d", 1.0, "t", 2, []), (1, 3, "e2", "Exact  one", "exact", "d", 1.0, "t", 3, []), (1, 4, "e3", "exact one", "exact", "other", 1.0, "t", 4, []), (1, 5, "blank", "  ", "exact", "d", 1.0, "t", 5, [])]
    assert [r.chunk_id for r in cx.pack_context(hits(spark, rows), 100, ("doc_id",)).orderBy("place").collect()] == ["e", "e3", "p", "n"]


def test_render_trim_and_groups(spark):
    rows = [(1, 0, "a", "body", "exact", "d", 0.5, 'q"<&', 0, ["x", "y"]), (1, 1, "b", "body", "exact", "d", 0.7, "t", 1, ["y", "z"])]
    df = hits(spark, rows)
    text = cx.render_context(df).first().context
    assert text.startswith('<document index="1" title="q&quot;&lt;&amp;" score="0.5000">\nbody\n</document>\n\n<document index="2"')
    assert cx.trim_context_tail(df, len(text)).count() == 2 and cx.trim_context_tail(df, len(text) - 1).count() == 1
    g = cx.group_evidence(df, ("doc_id",)).collect()
    assert [(r.score, r.pos, r.chunk_id, r.tokens) for r in g] == [(0.7, 0, "a", ["x", "y", "z"])]
    assert cx.citation_id_collisions(df.withColumn("chunk_id", F.lit("same")).withColumn("doc_id", F.col("pos").cast("string")), ("doc_id",)).first().identities == 2


def test_citations_excerpts_and_lists(spark):
    answers = spark.createDataFrame([(5, 1, "So [2] and [1][2], not [9].")], "answer_id long, query_id long, text string")
    sources = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id long, place int, chunk_id string")
    assert sorted((r.marker, r.chunk_id) for r in cx.citations_for_answers(answers, sources).collect()) == [(1, "a"), (2, "b")]
    h = spark.createDataFrame([(1, "a", 0, "Nothing here. The red fox runs fast! " + "long " * 100), (1, "b", 1, "fox")], "query_id long, chunk_id string, pos int, content string")
    claims = spark.createDataFrame([(1, 1, "a red fox runs"), (2, 1, "zebra")], "claim_id long, query_id long, claim string")
    assert [(r.claim_id, r.chunk_id, r.excerpt) for r in cx.best_excerpt(h, claims).collect()] == [(1, "a", "The red fox runs fast!")]
    assert cx.best_excerpt(h, spark.createDataFrame([(1, 1, "a RED fox")], "claim_id long, query_id long, claim string")).count() == 0
    long = spark.createDataFrame([(1, "c", 0, "| --- | --- |\n" + "x " * 300 + "The AB1 fee is 40 here " + "y " * 300)], "query_id long, chunk_id string, pos int, content string")
    cut = cx.best_excerpt(long, spark.createDataFrame([(1, 1, "AB1 fee 40 [2]"), (2, 1, "AB2 fee")], "claim_id long, query_id long, claim string")).collect()
    assert [r.claim_id for r in cut] == [1] and "AB1 fee is 40" in cut[0].excerpt and cut[0].excerpt[0] == cut[0].excerpt[-1] == "…" and len(cut[0].excerpt) <= 362
    said = spark.createDataFrame([(5, 1, "which fox?", "It runs [2].\n\nNothing on zebras [1].")], "answer_id long, query_id long, query string, text string")
    shown = spark.createDataFrame([(1, "a", "A cat. Zebras rest here.", 0.25, "", "src"), (1, "b", "No. The fox runs. Yes.", 0.1234567, None, None)], "query_id long, chunk_id string, content string, score double, title string, source string")
    shown = shown.withColumns({c: F.lit(None).cast("string") for c in ("source_url", "source_type", "doc_id", "section", "published_at", "retrieved_at")} | {"page_number": F.lit(3)})
    cited = cx.citation_details(spark.createDataFrame([(5, 1, "a"), (5, 2, "b")], "answer_id long, marker int, chunk_id string"), said, shown).orderBy("marker").collect()
    assert [(r.title, r.source, r.source_url, r.page, r.section, r.snippet, r.score) for r in cited] == [("src", "src", "", 3, None, "Zebras rest here.", 0.25), ("Chunk b", "Chunk b", "", 3, None, "The fox runs.", 0.123457)]
    lists = spark.createDataFrame([(1, "3 methods:\n1. one\n2. two"), (1, "3. three"), (2, "2 methods:\n1. one"), (3, "1 methods\n1. a"), (3, "1. b")], "query_id long, content string")
    got = cx.numbered_methods(lists, r"(\d+) methods", r"^(\d+)\. (.*)$").collect()
    assert sorted((r.query_id, r.number, r.text) for r in got) == [(1, 1, "one"), (1, 2, "two"), (1, 3, "three")]
    lists = [(1, "2 methods\n1. way one\n2. way two\n3. way three"), (2, "2 methods\n1. way one\n2. other"), (3, "1 methods\n1. way <b>"), (4, "2 methods\n1. Way  one.\n1. way ONE\n2. way two;"), (5, "11 methods\n" + "\n".join(f"{i}. way {i}" for i in range(1, 12)))]
    lists = spark.createDataFrame(lists, "query_id long, content string")
    got = cx.numbered_methods(lists, r"(\d+) methods", r"^(\d+)\. (.*)$", "way").collect()
    assert sorted((r.query_id, r.number, r.text) for r in got) == [(4, 1, "Way one"), (4, 2, "way two")]
    scoped = [(1, "1 methods\n1. way", "2024", ["N"], []), (2, "1 methods\n1. way", "2024", ["N"], ["N"]), (3, "1 methods", "2024", ["N"], ["N"]), (3, "1. way", "2024", ["S"], ["N"]), (4, "1 methods", "2024", ["N", "S"], []), (4, "1. way", "2023", [], []), (5, "1 methods\n1. way", "2024", ["N", "S"], [])]
    scoped = spark.createDataFrame(scoped, "query_id long, content string, year string, places array<string>, asked_places array<string>")
    assert sorted(r.query_id for r in cx.numbered_methods(scoped, r"(\d+) methods", r"^(\d+)\. (.*)$").collect()) == [2, 5]
    order = cx.citation_order(spark.createDataFrame([(1, 0.5, 0.1, 1.0, 0), (1, 0.9, 0.1, 0.1, 1)], "query_id long, coverage double, overlap double, score double, pos int"))
    assert [r.pos for r in order.orderBy("rank").collect()] == [1, 0]
