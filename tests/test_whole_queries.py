"""Registered queries over whole texts and all seeds, against loops over the given tables."""

import pytest

from corpusloom.plans import corpus_queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_missing_pages_of_long_documents(spark, texts):
    want = set()
    for d, r in texts.items():
        shown = sum(1 for at in range(0, len(r.text), 1000) if r.text[at : at + 1000].strip())
        want |= {(d, p) for p in range(1, -(-r.n_chars // 1000) + 1) if p > shown or (d + p) % 6 == 0}
    got = [tuple(r) for r in corpus_queries.missing_pages(spark, SF).select("doc_id", "page_number").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(p for _, p in got) > 20


@pytest.fixture(scope="module")
def chunks(spark):
    """(chunk_index -> chunk_id) of every document whose id is divisible by 50."""
    out = {}
    for r in corpus_queries.chunk_fixed(spark, SF).where("doc_id % 50 = 0").collect():
        out.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk_id
    return out


def test_every_chunk_is_a_seed_for_neighbours(spark, chunks):
    want = {(d, c[k], c[k + s], s, p) for d, c in chunks.items() for k in c for p, s in enumerate((-1, 1, -2, 2)) if k + s in c and k // 6 == (k + s) // 6}
    got = [(r.query_id, r.seed_id, r.chunk_id, r.step, r.place) for r in corpus_queries.neighbor_join(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_every_chunk_is_a_seed_for_siblings(spark, chunks):
    want = {(d, c[k], c[n], n % 5 + 1) for d, c in chunks.items() for k in c for n in range(k // 5 * 5, k // 5 * 5 + 5) if n in c}
    got = [(r.query_id, r.seed_id, r.chunk_id, r.table_part) for r in corpus_queries.table_sibling_join(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_terms_are_sought_in_the_whole_text(spark, texts):
    has = lambda t, terms: any(x in t.lower() for x in terms)
    want = sorted(d for d, r in texts.items() if has(r.text, ("the", "que")) and not has(r.text, ("$", "!!")))
    assert sorted(r.doc_id for r in corpus_queries.term_filter(spark, SF).collect()) == want


def test_citation_details_searches_once(spark, monkeypatch):
    from corpusloom.operators import sparse
    from corpusloom.plans import step_queries

    calls, search = [], sparse.bm25_topk
    monkeypatch.setattr(sparse, "bm25_topk", lambda *a: calls.append(1) or search(*a))
    step_queries.citation_details(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_golden_pairs_move_only_near_texts(spark, monkeypatch, tmp_path):
    from corpusloom.plans import search_queries

    docs = [(0, "xone two three four five six sevenx"), (1, "one two three four five six eight"), (2, "to be or not"), (3, "a.b"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' source", "'en' lang").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "one two three four five six seven"), (2, "o be or no"), (3, "."), (4, "two three four"), (5, "one two three four five six nine")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near, keep = [], search_queries.checkpointed
    monkeypatch.setattr(search_queries, "checkpointed", lambda df: near.append(keep(df)) or near[-1])
    got = search_queries.golden_pairs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 2), (3, 3), (4, 0), (4, 1)]
    # only ids of what shares a key with an item are kept and joined with the texts
    assert near[0].columns == ["chunk_id", "case_id"] and near[0].count() == 7


def test_only_named_chunks_meet_the_evidence(spark, monkeypatch):
    from corpusloom.operators import quality

    chunks = spark.range(50).selectExpr("id AS chunk_id", "id AS doc_id", "'t' title", "1 page_number", "'u' source_url", "concat('text ', id) content")
    e = spark.createDataFrame([(1, 1, "t", 1, "u", "TEXT 1"), (1, 1, "t", 1, "u", "other"), (2, 3, "t", 1, "u", "text"), (99, 99, "t", 1, "u", "text")], "chunk_id long, doc_id long, title string, page int, source_url string, quote string")
    named, hint = [], quality.broadcast_if_small
    monkeypatch.setattr(quality, "broadcast_if_small", lambda df, n: named.append(n) or hint(df, n))
    assert sorted(map(tuple, quality.evidence_membership(e, chunks).collect())) == [(1, "ok"), (1, "quote_missing"), (2, "field_differs"), (99, "no_chunk")]
    assert named == [3]
