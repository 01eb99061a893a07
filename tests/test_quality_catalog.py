"""Audits, index agreement, split tables, golden sets, answers and files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, catalog_tables, evaluation, html_pages, quality
from corpusloom.runtime import rank_in_groups
from corpusloom.sources import corpus


def test_index_diff(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, payload string")
    has = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("d", "4")], "id string, payload string")
    got = sorted((r.finding, r.key) for r in quality.index_diff(want, has).collect())
    assert got == [("duplicate", "d"), ("missing", "c"), ("payload_mismatch", "b"), ("unexpected", "d")]
    assert quality.index_diff(want, want).count() == 0


def test_fingerprints_follow_every_change(spark):
    df = spark.createDataFrame([(i, f"body {i}") for i in range(200)], "doc_id long, body string")
    one = quality.corpus_fingerprint(df).first()
    assert one == quality.corpus_fingerprint(df.repartition(9).orderBy(F.rand(3))).first() and one.documents == 200
    assert one.fingerprint != quality.corpus_fingerprint(df.withColumn("body", F.when(F.col("doc_id") == 7, "edited").otherwise(F.col("body")))).first().fingerprint
    assert quality.corpus_fingerprint(df.limit(0)).first().documents == 0
    assert quality.build_fingerprint({"a": 1, "b": 2}) == quality.build_fingerprint({"b": 2, "a": 1})


def test_stale_reasons_and_preflight(spark):
    m = spark.createDataFrame([("r1", None, "c0")], "revision string, build_fingerprint string, corpus_fingerprint string")
    want = {"revision": "r1", "build_fingerprint": "b", "corpus_fingerprint": "c"}
    assert quality.stale_reasons(m, want).first().reasons == ["build_fingerprint_missing", "corpus_fingerprint_changed"]
    assert quality.stale_reasons(m.limit(0), want).first().reasons == ["manifest_missing"]
    checks = spark.createDataFrame([("ids", "error", True), ("corpus", "stale", False)], "check string, severity string, ok boolean")
    assert quality.preflight_status(checks).first() == ("ready_for_rebuild", ["corpus"])


def test_rank_in_groups(spark):
    rows = [("hot", i) for i in range(500)] + [("b", 3), ("b", 1), (None, 2)]
    got = rank_in_groups(spark.createDataFrame(rows, "g string, v long").repartition(6), ["g"], ["v"]).collect()
    assert sorted((str(r.g), r.v, r["rank"]) for r in got) == sorted([("hot", i, i + 1) for i in range(500)] + [("b", 1, 1), ("b", 3, 2), ("None", 2, 1)])


def test_recrawl_and_evidence(spark):
    s = "source_url string, http_status int, attachments array<string>"
    old = spark.createDataFrame([("u1", 200, ["a"]), ("u2", 200, ["b"]), ("u3", 404, None)], s)
    new = spark.createDataFrame([("u2", 200, None)], s)
    got = quality.merge_partial_recrawl(old, new, new)
    assert sorted((r.source_url, r.attachments) for r in got.collect()) == [("u1", ["a"]), ("u2", ["b"])]
    ev = spark.createDataFrame([("c1", "d", "t", 1, "u", "The *quote*"), ("c2", "d", "t", 1, "u", "x"), ("c1", "d", "z", 1, "u", "quote"), ("c1", "d", "t", 1, "u", "absent")], "chunk_id string, doc_id string, title string, page int, source_url string, quote string")
    ch = spark.createDataFrame([("c1", "d", "t", 1, "u", "here is the  quote")], "chunk_id string, doc_id string, title string, page_number int, source_url string, content string")
    assert sorted(r.status for r in quality.evidence_membership(ev, ch).collect()) == ["field_differs", "no_chunk", "ok", "quote_missing"]


def parts(spark, change=None):
    rows = []
    for k in (1, 2, 3):
        r = {"chunk_id": f"p{k}", "content": f"Title\n| name | code |\n| --- | --- |\n| n{k} | {k} |", "doc_id": "d", "chunk_type": "table", "title": "T", "source_url": "https://ok.example/x", "admission_year": "2031", "campus": "N", "table_index": 0, "table_part": k, "table_part_count": 3, "row_start": k, "row_end": k}
        rows.append(r)
    rows = change(rows) if change else rows
    schema = "chunk_id string, content string, doc_id string, chunk_type string, title string, source_url string, admission_year string, campus string, table_index int, table_part int, table_part_count int, row_start int, row_end int"
    return spark.createDataFrame(rows, schema)


DAMAGE = {
    "missing part": lambda r: r[:2],
    "first part missing": lambda r: r[1:],
    "part twice": lambda r: [*r, r[0]],
    "other count": lambda r: [r[0] | {"table_part_count": 4}, *r[1:]],
    "gap in rows": lambda r: [r[0], r[1] | {"row_start": 3, "row_end": 3}, r[2]],
    "rows overlap": lambda r: [r[0], r[1] | {"row_start": 1, "row_end": 1}, r[2]],
    "other title": lambda r: [r[0] | {"title": "X"}, *r[1:]],
    "other year": lambda r: [r[0] | {"admission_year": "2030"}, *r[1:]],
    "other place": lambda r: [r[0] | {"campus": "S"}, *r[1:]],
    "other address": lambda r: [r[0] | {"source_url": "https://ok.example/y"}, *r[1:]],
    "other header": lambda r: [r[0] | {"content": r[0]["content"].replace("code", "id")}, *r[1:]],
    "fewer physical rows": lambda r: [r[0] | {"content": r[0]["content"].rsplit("\n", 1)[0]}, *r[1:]],
    "more physical rows": lambda r: [r[0] | {"content": r[0]["content"] + "\n| z | 9 |"}, *r[1:]],
}


def test_complete_table(spark):
    assert catalog_tables.table_family_check(parts(spark)).first().complete
    rows = catalog_tables.complete_catalog(parts(spark), ["ok.example"]).orderBy("row").collect()
    assert [r.cells for r in rows] == [["n1", "1"], ["n2", "2"], ["n3", "3"]]
    assert catalog_tables.complete_catalog(parts(spark), ["other.example"]).count() == 0


@pytest.mark.parametrize("name", sorted(DAMAGE))
def test_damaged_table(spark, name):
    assert not any(r.complete for r in catalog_tables.table_family_check(parts(spark, DAMAGE[name])).collect() if r.rows)


def test_sections_names_and_rendering(spark):
    rows = spark.createDataFrame([("d", 0, 1, ["loose", ""]), ("d", 0, 2, ["a", "1"]), ("d", 0, 3, ["I. First", ""]), ("d", 0, 4, ["sub", ""]), ("d", 0, 5, ["b", "2"]), ("d", 0, 6, ["II. Second", ""]), ("d", 0, 7, ["c", "3"])], "doc_id string, table_index int, row int, cells array<string>").withColumn("labels", F.array(F.lit("name"), F.lit("code")))
    got = catalog_tables.carry_sections(rows).orderBy("row")
    assert [(r.cells[0], r.section, r.subsection) for r in got.collect()] == [("a", "loose", None), ("b", "I. First", "sub"), ("c", "II. Second", None)]
    names = spark.createDataFrame([(1, "  B ")], "query_id long, name string")
    found = catalog_tables.named_entry_lookup(got, names, [0])
    assert catalog_tables.render_catalog(found).first().text == "1. name: b; code: 2"


def order_of(df):
    return [r.chunk_id for r in df.orderBy("query_id", "place").collect()]


def test_seed_cover(spark):
    s = "query_id long, chunk_id string, rank int, items array<string>, overview boolean"
    rows = [(1, "a", 1, ["x"], False), (1, "b", 2, ["y", "z"], False), (1, "c", 3, ["x", "y"], True), (1, "d", 4, [], True)]
    cover = lambda rows, k: order_of(catalog_tables.seed_cover(spark.createDataFrame(rows, s), k))
    assert cover(rows, 9) == ["c", "b", "a", "d"]
    assert cover([r[:4] + (None,) for r in rows], 3) == ["a", "b", "c"]
    assert cover([], 3) == []
    assert cover(rows, 0) == []


def brute_cover(hits, k):
    hits = [h for h in hits if h[5] and len(h[3]) == 1 and (not h[6] or h[6] == h[3])]
    left = [h for h in hits if h[3] == max(x[3] for x in hits)]
    places, names, out = set(), set(), []
    while left and len(out) < k:
        best = max(left, key=lambda h: (len(set(h[4]) - places), len(set(h[5]) - names), -h[2]))
        left.remove(best)
        if set(best[4]) <= places and set(best[5]) <= names:
            continue
        out.append(best[1])
        places |= set(best[4])
        names |= set(best[5])
    return out


def test_seed_cover_catalog(spark):
    s = "query_id long, chunk_id string, rank int, years array<int>, places array<string>, names array<string>, asked_years array<int>"
    rng = random.Random(3)
    some = lambda letters, least: [x for x in letters if rng.random() < 0.4] or letters[:least]
    rows = [(q, f"c{r}", r, [2023] if rng.random() < 0.3 else [2024] if rng.random() < 0.9 else [2023, 2024], some(["n", "s"], 0), some(list("abcdef"), rng.random() < 0.7), [2023] if q % 3 == 0 else []) for q in range(12) for r in range(1, 9)]
    got = catalog_tables.seed_cover_catalog(spark.createDataFrame(rows, s), 4)
    want = {q: brute_cover([r for r in rows if r[0] == q], 4) for q in range(12)}
    assert {q: w for q, w in want.items() if w} == {q: order_of(got.where(F.col("query_id") == q)) for q in range(12) if want[q]} and got.count() == sum(map(len, want.values()))


def test_profile(spark):
    s = "query_id long, campus string, admission_year string, row int, marker int, labels array<string>, cells array<string>, section string, subsection string"
    rows = [(1, "N", "2044", 2, 2, ["name", "code"], ["b", "7"], "I. First", "sub"), (1, "N", "2044", 1, 1, ["name", "code"], ["a", "5"], None, None), (2, "N", "2044", 1, 1, ["name"], ["see <b>"], None, None), (3, "N", "2044", 1, None, ["name"], ["c"], None, None), (4, "N", "2044", 1, 1, ["name"], [], None, None)]
    got = catalog_tables.render_profile(spark.createDataFrame(rows, s)).collect()
    assert [(r.query_id, r.text) for r in got] == [(1, "### Admission 2044, N\n\n| name | code [1] |\n| --- | --- |\n| a | 5 [1] |\n\n**I. First** [2].\n\n**sub** [2].\n\n| name | code [2] |\n| --- | --- |\n| b | 7 [2] |")]


CASE = {"id": "case-1", "category": "c", "difficulty": "easy", "question": "q 1?", "expected_route": "answer", "ground_truth": "the *term* is here", "evidence_ids": ["e1"], "required_terms": ["Term"], "tags": ["t"]}
NEGATIVE = {"id": "n_1", "difficulty": "negative", "expected_route": "abstain", "question": "q 2?", "ground_truth": "no data", "evidence_ids": [], "required_terms": []}
BROKEN = [
    ({"category": None}, "missing_field"), ({"id": "Bad Id"}, "id_not_a_slug"), ({"difficulty": "odd"}, "unknown_difficulty"), ({"question": " * "}, "blank_question"), ({"tags": ["t", ""]}, "blank_tag"),
    ({"evidence_ids": ["e1", "e1"]}, "repeated_evidence"), ({"evidence_ids": ["e1", "e9"]}, "unknown_evidence"), ({"required_terms": []}, "answer_without_terms"), ({"ground_truth": "nothing"}, "term_not_in_truth"),
    ({**NEGATIVE, "ground_truth": "no data at all"}, "negative_without_fallback"), ({**NEGATIVE, "required_terms": ["x"]}, "abstains_with_evidence"), ({**NEGATIVE, "difficulty": "easy"}, "abstains_but_not_negative"),
]


def test_golden_rules(spark):
    kinds = {n: "array<string>" if n in ("evidence_ids", "required_terms", "tags") else "string" for n in evaluation.CASE_FIELDS}
    evidence = spark.createDataFrame([("e1", "a quoted `term`")], "chunk_id string, quote string")

    def found(*changes, least=1):
        rows = [tuple({**CASE, **c}[n] for n in kinds) for c in changes]
        f = evaluation.golden_findings(spark.createDataFrame(rows, ", ".join(map(" ".join, kinds.items()))), evidence, "answer", "abstain", ("easy",), "negative", "no data", least)
        return sorted((r.id or "", r.rule) for r in f.collect())

    assert found({}, NEGATIVE) == []
    assert found({}, least=2) == [("", "number_of_cases")]
    assert found({}, {"question": "Q  1?"}) == [("case-1", "repeated_id")] * 2 + [("case-1", "repeated_question")] * 2
    changed = [c | {"id": c["id"] if c.get("id") == "Bad Id" else f"x{k}", "question": c["question"] if rule == "blank_question" else f"q {k + 5}?"} for k, (c, rule) in enumerate(BROKEN)]
    assert found(*changed) == sorted((c["id"], rule) for c, (_, rule) in zip(changed, BROKEN, strict=True))
    assert {r for _, r in found({"evidence_ids": [], "expected_route": "maybe", "ground_truth": "", "required_terms": [" "]})} == {"unknown_route", "blank_truth", "blank_term", "abstains_but_not_negative", "abstains_with_evidence", "negative_without_fallback"}
    assert {r for _, r in found({"evidence_ids": []})} == {"answer_without_evidence", "term_not_quoted"}


def test_golden_evidence_and_header(spark):
    e = spark.createDataFrame([("a", "d", "t", 1, "u", "q"), ("b", " ", "t", 0, None, "q"), ("c", "d", "t", None, "u", "q"), ("c", "d", "t", 2, "u", "")], "chunk_id string, doc_id string, title string, page int, source_url string, quote string")
    got = sorted((r.chunk_id, r.rule) for r in evaluation.evidence_findings(e).collect())
    assert got == [("b", "blank_doc_id"), ("b", "blank_source_url"), ("b", "page_not_positive"), ("c", "blank_quote"), ("c", "page_not_positive"), ("c", "repeated_id"), ("c", "repeated_id")]
    head = lambda *row: spark.createDataFrame([row], "schema_version int, fingerprint string, evidence long")
    rules = lambda *a: sorted(r.rule for r in evaluation.golden_header_findings(*a).collect())
    manifest = spark.createDataFrame([("b" * 64,)], "corpus_fingerprint string")
    assert rules(head(1, "a" * 64, 3)) == [] and rules(head(1, "a" * 64, 3), manifest) == ["fingerprint_differs"]
    assert rules(head(None, "A", 0), manifest) == ["fingerprint_differs", "fingerprint_not_sha256", "no_evidence", "schema_version"]


def test_metrics(spark):
    run = spark.createDataFrame([("m", 1, "x", None, 1), ("m", 1, "child", "e1", 2), ("m", 2, "e3", None, 1)], "mode string, case_id long, chunk_id string, parent_id string, rank int")
    golden = spark.createDataFrame([(1, "e1"), (1, "e2"), (2, "e3")], "case_id long, chunk_id string")
    cases = spark.createDataFrame([(1, "m"), (2, "m")], "case_id long, mode string")
    got = {r.case_id: (r.recall, r.coverage, r.rr) for r in evaluation.retrieval_metrics(run, golden, cases).collect()}
    assert got == {1: (0.0, 0.5, 0.5), 2: (1.0, 1.0, 1.0)}
    exp = spark.createDataFrame([(1, ["x"]), (2, []), (3, [])], "case_id long, relevant array<string>")
    assert {r.case_id: r.precision for r in evaluation.precision_at_k(run, exp, 2).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    hits = spark.createDataFrame([(1, "d1", "c1", "has Alpha", "b1"), (1, "d1", "c1", "has alpha", "b2"), (1, "d2", "c2", "beta", "b1")], "case_id long, doc_id string, chunk_id string, content string, branch string")
    ents = spark.createDataFrame([(1, "alpha"), (1, "gamma")], "case_id long, entity string")
    r = evaluation.list_metrics(hits, ents).first()
    assert (r.entity_recall, r.source_coverage, r.duplicate_ratio) == (0.5, 2, pytest.approx(1 / 3, abs=1e-6))
    t = {x.branch: (x.found, x.missed) for x in evaluation.terms_by_branch(hits, ents.withColumnRenamed("entity", "term")).collect()}
    assert t["b1"] == (["alpha"], ["gamma"])


def test_answer_log(spark):
    ok = {"status": "answered", "blocks": [{"type": "paragraph", "text": "Hi", "sources": [2, 1]}, {"type": "list", "items": [{"text": "x"}]}, {"type": "table", "columns": ["a"], "rows": [["1|2"]]}]}
    rows = [(1, json.dumps(ok), 2), (2, json.dumps({"status": "abstained", "blocks": []}), 0), (3, '{"status": "answered", "status": "abstained", "blocks": []}', 1), (4, json.dumps({"status": "answered", "blocks": [{"type": "paragraph", "text": "x", "sources": [3]}]}), 2), (5, None, None), (6, "[" * 5000, 1)]
    got = {r.answer_id: r for r in answers.answer_log_audit(spark.createDataFrame(rows, "answer_id long, raw string, source_count int")).collect()}
    assert got[1].text == "Hi [1] [2]\n\n- x\n\n| a |\n| --- |\n| 1\\|2 |" and got[2].status == "abstained"
    assert [got[i].status for i in (3, 4, 5, 6)] == ["invalid"] * 4
    c = answers.clean_answer_log(spark.createDataFrame([("<think>x</think>Yes [1], no [2].",)], "text string"), "no data").first()
    assert (c.public_text, c.abstained) == ("Yes, no.", False)
    m = answers.session_messages(spark.createDataFrame([(1, 4, "q", "a")], "conv_id long, next_turn long, question string, answer string")).collect()
    assert [(r.turn, r.role, r.text) for r in m] == [(4, "user", "q"), (5, "assistant", "a")]


def test_html_pages():
    page = "<title>Tail</title><meta property='og:title' content='OG'><nav>menu</nav><h1>Head</h1><p>Some <a href='/x.pdf?v=1'>file</a> 12</p><table><tr><th colspan=2>A</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3|4</td></tr></table><ul><li>one</ul><script>no</script>"
    r = html_pages.page_facts("https://h.example/a/b", page)
    assert r["title"] == "OG" and r["table_count"] == 1 and r["pdf_links"] == ["https://h.example/x.pdf?v=1"]
    assert "# Head" in r["markdown"] and "| A | A |\n| --- | --- |\n| 1 | 2 |\n| 1 | 3\\|4 |" in r["markdown"] and "- one" in r["markdown"] and "menu" not in r["markdown"]
    assert html_pages.page_facts(None, None)["status"] == "no_text_detected"
    long = "word 12 " * 20
    page = f"<html><head><title>T</title></head><body><nav>menu 7</nav><main>m</main><article><p>short</p><div class='x entry-content'><p>{long}</p><img src=a><table><tr><td>3</table></div ></article><footer>f</footer></body></html>"
    assert html_pages.content_html(page).startswith("<div class='x") and html_pages.content_html(page).endswith("</div >")
    r = html_pages.page_facts("https://h.example/a", page)
    assert (r["source_table_count"], r["table_count"], r["source_numeric_tokens"], r["numeric_tokens"]) == (1, 1, 21, 21) and "short" not in r["markdown"] and "menu" not in r["markdown"]
    assert html_pages.content_html("<p>a</p><body>b<article>c</article></body>") == "<body>b<article>c</article></body>"
    assert html_pages.content_html(f"<i><article>{long}") == f"<article>{long}" and html_pages.content_html("x") == "x" and html_pages.content_html("") == ""
    assert html_pages.plain_lines("<p> a </p><script>x</script>\n\n b<br>c") == "a\nb\nc"


def test_bundles_stages_and_reports(spark, tmp_path):
    d = spark.createDataFrame([("x", {"doc_id": "1", "title": 'say "hi"'}, "First\n\nbody"), ("y", {"doc_id": "2"}, "Second"), ("x", {"title": "no id"}, "Third")], "category string, fields map<string,string>, body string")
    corpus.write_markdown_corpus(d, str(tmp_path / "md"))
    got = corpus.read_markdown_bundles(spark, str(tmp_path / "md")).collect()
    assert sorted((r.category, r.body) for r in got) == [("x", "First\n\nbody"), ("x", "Third"), ("y", "Second")]
    assert {r.body: r.doc_id for r in got if r.category == "y" or r.body[0] == "F"} == {"First\n\nbody": "1", "Second": "2"} and len({r.path for r in got}) == 3
    (tmp_path / "raw").mkdir()
    assert corpus.preferred_folder(spark, str(tmp_path / "none"), "raw") == "raw" and corpus.preferred_folder(spark, str(tmp_path / "raw"), "other") == "other"
    (tmp_path / "raw/a.md").write_text("x")
    assert corpus.preferred_folder(spark, str(tmp_path / "raw"), "other") == str(tmp_path / "raw")
    assert corpus.reusable_stage(spark, str(tmp_path / "s"), "f1") is None
    assert corpus.write_stage(spark.range(3), str(tmp_path / "s"), "f1").count() == 3 == corpus.reusable_stage(spark, str(tmp_path / "s"), "f1").count()
    for n in (2, 1):
        quality.write_report(spark.createDataFrame([("rule", n)] * n, "rule string, n int"), str(tmp_path / "report"))
    assert [(r.rule, r.n) for r in spark.read.json(str(tmp_path / "report")).collect()] == [("rule", 1)]
    c = spark.createDataFrame([("The major list",), ("the list",), (None,), ("MAJOR code",)], "content string")
    assert sorted(r.content for r in quality.tabular_chunks(c, "major", ["list", "CODE"]).collect()) == ["MAJOR code", "The major list"]


def test_guarded_parents(spark):
    from corpusloom.operators import fusion

    hits = spark.createDataFrame([(1, "a", 1, 0.9, "P", "child"), (1, "b", 2, 0.8, "P", "child"), (1, "t", 3, 0.7, "P", "table"), (1, "c", 4, 0.6, None, "child")], "query_id long, chunk_id string, pos int, score double, parent_chunk_id string, chunk_type string")
    parents = spark.createDataFrame([("P", "parent")], "chunk_id string, chunk_type string")
    of = lambda df: sorted((r.chunk_id, r.pos) for r in df.collect())
    assert of(fusion.hydrate_parents(hits, parents)) == [("P", 1), ("c", 4), ("t", 3)]
    assert of(fusion.hydrate_parents(hits, parents, hits.where("chunk_id = 'b'"))) == [("P", 2), ("a", 1), ("c", 4), ("t", 3)]


def test_scalars(spark):
    from corpusloom.functions import text as tx

    rows = spark.createDataFrame([('"a \\"b\\""',), ('"broken"x"',), ("-12",), ("True",), (" ",), (None,), ("12a",)], "v string").select(tx.parsed_scalar(F.col("v")).alias("s")).collect()
    assert [(r.s.kind, r.s.text, r.s.number and int(r.s.number), r.s.truth) for r in rows] == [("json_string", 'a "b"', None, None), ("json_string", '"broken"x"', None, None), ("int", None, -12, None), ("bool", None, None, True), ("null", None, None, None), ("null", None, None, None), ("string", "12a", None, None)]


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text('---\ndoc_id: "one"\ntitle: A: b\nduplicate_of:\n---\nBody\n')
    (tmp_path / "in/sub/b.md").write_text("No block")
    docs = corpus.read_markdown_corpus(spark, str(tmp_path / "in")).orderBy("path").collect()
    assert docs[0].doc_id == "one" and docs[0].fields["title"] == "A: b" and docs[0].body == "Body"
    assert len(docs[1].doc_id) == 24 and docs[1].body == "No block"
    back = corpus.read_markdown_corpus(spark, str(tmp_path / "in")).where("doc_id = 'one'").select(corpus.markdown_document().alias("t")).first().t
    assert back.startswith('---\ndoc_id: "one"\ntitle: "A: b"\n') and back.endswith("---\n\nBody")
    chunks = spark.createDataFrame([("c1", "x", [1.0]), ("c2", "y", [2.0])], "chunk_id string, content string, embedding array<float>")
    path = str(tmp_path / "snap")
    corpus.write_index_snapshot(chunks, path, {"m": 1})
    assert corpus.read_index_snapshot(spark, path, {"m": 1}).count() == 2
    with pytest.raises(corpus.SnapshotError):
        corpus.read_index_snapshot(spark, path, {"m": 2})
    chunks.limit(1).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(corpus.SnapshotError):
        corpus.read_index_snapshot(spark, path, {"m": 1})
    assert corpus.reusable_stage(spark, path, "nothing") is None
    raw = spark.createDataFrame([('[{"raw_file": "r/a.md", "attachments": [{"raw_file": "b.md", "deep": {"er": [{"raw_file": "d.md"}, {"raw_file": "d.md", "n": 2}]}}]}]',)], "json string")
    files = spark.createDataFrame([("./R/a.md",), ("x/b.md",), ("x/c.md",), ("d.md",)], "path string")
    meta = {r.path: r.meta for r in corpus.attach_raw_metadata(files, corpus.flattened_records(raw)).collect()}
    assert meta["./R/a.md"] and meta["x/b.md"] and meta["x/c.md"] is None
    assert '"n":2' in meta["d.md"].replace(" ", "")


def test_pages_without_text_and_sources_with_tables(spark):
    p = spark.createDataFrame([("a", "ok", 2), ("b", "no_text_detected", 0), ("c", None, 0)], "source_url string, extraction_status string, source_table_count int")
    kept, removed = quality.split_no_text_pages(p)
    assert sorted(r.source_url for r in kept.collect()) == ["a", "c"] and [r.source_url for r in removed.collect()] == ["b"]
    assert [r.source_url for r in quality.pages_of_sources_with_tables(p.select("source_url"), p).collect()] == ["a"]


def test_reports_of_hits(spark):
    h = spark.createDataFrame([(1, "c1", 1, 0.5, "t", " a\n b "), (1, "c2", 2, 0.25, "t", None), (1, "c3", 6, 0.1, "t", "x" * 300)], "query_id long, chunk_id string, rank int, score double, title string, content string")
    assert [tuple(r) for r in evaluation.candidate_char_stats(h).collect()] == [(1, 3, 102.0, 300)]
    assert {(r.rank, r.snippet) for r in evaluation.retrieval_report(h).collect()} == {(1, "a b"), (2, None)}
    assert evaluation.retrieval_report(h.limit(0)).count() == 0


def test_a_mode_without_negative_cases_has_a_null_rate(spark):
    cases = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "b", True), (3, "b", False)], "case_id long, mode string, negative boolean")
    run = spark.createDataFrame([("a", 1), ("b", 1), ("b", 3)], "mode string, case_id long")
    assert sorted(map(tuple, evaluation.negative_false_positive_rate(cases, run).collect())) == [("a", None), ("b", 0.5)]
