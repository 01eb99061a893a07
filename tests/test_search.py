"""Keyword and vector search, fusion, expansion, reranking."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dense, fusion, rerank, sparse


def chunks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")


def found(spark, query, *texts, k=20):
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    return [(r.chunk_id, r.score) for r in sparse.bm25_topk(q, chunks(spark, *texts), k).orderBy("rank").collect()]


def test_bm25_against_the_formula(spark):
    texts = ["alpha beta beta gamma", "alpha delta", "alpha alpha epsilon zeta eta theta", "unrelated words here now"]
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    vocabulary = {w for d in docs for w in d}
    raw = {w: math.log(n - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5) for w in vocabulary}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    query = ["alpha", "beta", "beta", "zeta"]
    score = {i: round(sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query), 6) for i, d in enumerate(docs) if set(query) & set(d)}
    assert found(spark, "Alpha beta, BETA zeta!", *texts) == sorted(score.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_edges(spark):
    assert found(spark, "rare", "rare word", "other") == [(0, found(spark, "rare", "rare word", "other")[0][1])]
    assert found(spark, "none", "rare word") == [] and found(spark, " ?", "rare") == [] and found(spark, "x", "!!", "..") == []
    assert found(spark, "only", "only one chunk")[0][1] <= 0
    assert [i for i, _ in found(spark, "same", "same", "same", "same", "b", "c", "d", "e", k=2)] == [0, 1]


def test_bm25_pairs_stay_in_their_tasks(spark, monkeypatch):
    words = "aa bb cc dd ee ff gg".split()
    texts = [" ".join(words[(i * j) % 7] for j in range(1, 4 + i % 5)) + " all" for i in range(300)] + ["all", "", None]
    q = spark.createDataFrame([(i, f"{w} {words[i - 3]} all") for i, w in enumerate(words)], "query_id long, query string")
    stored = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").coalesce(1)
    reached, ranked = [], sparse.top_k
    monkeypatch.setattr(sparse, "top_k", lambda found, *a: reached.append(found.count()) or ranked(found, *a))
    want = sparse.bm25_topk(q, stored, 3).orderBy("query_id", "rank").collect()
    # of 2,107 pairs that share a term only the best leave the task
    assert len(want) == 21 and reached == [21]
    named = stored.withColumn("chunk_id", F.format_string("n%04d", "chunk_id"))
    for postings, queries, terms, rows in ((50, 2, 4_000_000, 1_000_000), (7, 3, 0, 0)):
        monkeypatch.setattr(sparse, "POSTINGS_AT_ONCE", postings)
        monkeypatch.setattr(sparse, "QUERIES_AT_ONCE", queries)
        monkeypatch.setattr(sparse, "BROADCAST_TERMS", terms)
        monkeypatch.setattr(sparse, "BROADCAST_ROWS", rows)
        assert sparse.bm25_topk(q, stored, 3).orderBy("query_id", "rank").collect() == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a chunk's postings come in many batches
    got = sparse.bm25_topk(q, named, 3).orderBy("query_id", "rank").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.query_id, int(r.chunk_id[1:]), r.score, r.rank) for r in got] == [tuple(r) for r in want]


def vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.8, 0.6], 2), (2, [0.0, 1.0], 3), (3, [0.0, 0.0], 3), (4, [float("nan"), 1.0], 3)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, page int")


def test_dense(spark, monkeypatch):
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, None)], "query_id long, embedding array<float>")
    want = [(7, 0, 1.0), (7, 1, 0.8), (8, 2, 1.0), (8, 1, 0.6)]
    for at_once in (4096, 1):
        monkeypatch.setattr(dense, "QUERIES_AT_ONCE", at_once)
        got = dense.dense_topk(q, vectors(spark).repartition(3), 2).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.vec_id, r.score) for r in got] == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a partition's best come from many batches
    got = dense.dense_topk(q, vectors(spark).coalesce(1), 2).orderBy("query_id", "rank").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.query_id, r.vec_id, r.score) for r in got] == want
    only = dense.dense_topk(q, vectors(spark), 5, spec={"page": {"gte": 2, "lt": 3}}).collect()
    assert {r.vec_id for r in only} == {1}
    assert dense.dense_topk(q, vectors(spark), 0).count() == 0
    with pytest.raises(Exception, match="wrong length"):
        dense.dense_topk(q, vectors(spark), 1, strict=True, dim=2).collect()
    for bad in ({"page": []}, {"page": {}}, {"page": {"near": 1}}):
        with pytest.raises(ValueError):
            dense.metadata_filter(vectors(spark), bad)


def test_upkeep(spark):
    s = "chunk_id string, pos long, content string, source_file string"
    now = spark.createDataFrame([("a", 1, "old", "f"), ("b", 2, "b", None), ("c", 3, "c", "g")], s)
    new = spark.createDataFrame([("a", 1, "new", "f"), ("a", 2, "newest", "f"), ("d", 3, "d", "h")], s)
    up = dense.upsert(now, new)
    assert sorted((r.chunk_id, r.pos, r.content) for r in up.collect()) == [("a", 1, "newest"), ("b", 2, "b"), ("c", 3, "c"), ("d", 3, "d")]
    assert sorted(r.chunk_id for r in dense.delete_by_source(now, "f").collect()) == ["b", "c"]
    assert sorted(r.chunk_id for r in dense.delete_by_ids(now, new).collect()) == ["b", "c"]
    assert [(r.chunk_id, r.pos, r.content) for r in dense.last_write_wins(new, "chunk_id").orderBy("chunk_id").collect()] == [("a", 1, "newest"), ("d", 3, "d")]
    bad = spark.createDataFrame([("a", "x"), ("a", "y"), (" ", "z"), ("b", " "), ("c", "ok")], "chunk_id string, content string")
    assert sorted(str(r.reject) for r in dense.validated_batch(bad).collect()) == ["None", "blank_content", "blank_id", "repeated_id", "repeated_id"]


def branches(spark):
    rows = [(1, "dense", i, c) for i, c in enumerate("abc")] + [(1, "sparse", i, c) for i, c in enumerate("bbcd")]
    return spark.createDataFrame(rows, "query_id long, branch string, pos int, chunk_id string")


def test_rrf(spark):
    got = [(r.chunk_id, r.score) for r in fusion.rrf_fuse(branches(spark)).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("c", round(1 / 63 + 1 / 62, 9)), ("a", round(1 / 61, 9)), ("d", round(1 / 63, 9))]
    zero = {r.chunk_id: r.score for r in fusion.rrf_fuse(branches(spark), 60, {"sparse": 0}).collect()}
    assert zero["d"] == 0.0 and zero["b"] == round(1 / 62, 9)
    for bad in (-1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            fusion.rrf_fuse(branches(spark), bad)


def test_expansion(spark):
    c = spark.createDataFrame([(f"c{i}", "d", i, ["h"] if i < 4 else ["g"], "text", i, None, None) for i in range(6)] + [("t1", "d", 9, ["h"], "table", 9, 0, 1), ("t2", "d", 10, ["h"], "table", 10, 0, 2)], "chunk_id string, doc_id string, chunk_index int, heading_path array<string>, chunk_type string, corpus_pos int, table_index int, table_part int")
    hits = spark.createDataFrame([(1, "c2", 0, 0.9, 5), (1, "t1", 1, 0.8, 5)], "query_id long, chunk_id string, pos int, score double, limit int")
    near = fusion.neighbor_join(hits, c)
    assert sorted((r.seed_id, r.place, r.chunk_id) for r in near.collect()) == [("c2", 0, "c1"), ("c2", 1, "c3"), ("c2", 2, "c0"), ("t1", 1, "t2")]
    parts = fusion.table_sibling_join(hits, c)
    assert sorted(r.chunk_id for r in parts.collect()) == ["t1", "t2"]
    allowed = near.select("query_id", "seed_id", "chunk_id").union(parts.select("query_id", "seed_id", "chunk_id")).where("chunk_id <> 'c3'")
    out = fusion.expand_guarded(hits, parts, near, allowed).orderBy("rank").collect()
    assert [(r.chunk_id, r.expansion_type) for r in out] == [("c2", "exact"), ("t1", "exact"), ("c1", "neighbor"), ("c0", "neighbor"), ("t2", "table_sibling")]


def test_rerank_and_gates(spark):
    rows = [(1, "red big apple", "x", "a red apple", 0.5), (1, "red big apple", "y", "nothing", 0.5), (1, "red big apple", "z", "big red apple", 0.1)]
    pairs = spark.createDataFrame(rows, "query_id long, query string, chunk_id string, content string, score double")
    assert [r.chunk_id for r in rerank.lexical_rerank(pairs, 2).orderBy("rank").collect()] == ["z", "x"]
    scored = rerank.model_rerank(pairs, lambda q, t: [float(len(x)) for x in t], 2)
    assert [r.chunk_id for r in scored.orderBy("rank").collect()] == ["z", "x"]
    with pytest.raises(Exception, match="finite"):
        rerank.model_rerank(pairs, lambda q, t: [float("nan")] * len(t), 2).collect()
    faults = rerank.check_rerank_output(pairs, scored.unionByName(scored.limit(1)))
    assert "not_a_candidate" in {r.fault for r in faults.collect()}
    gate = {r.query_id: r.passes for r in rerank.lexical_evidence_gate(pairs.select("query_id", "query").distinct(), pairs, 0.9).collect()}
    assert gate == {1: True}
    asked = spark.createDataFrame([(1, "the fee of AB12"), (2, "the fee of AB12"), (3, "2031 of"), (4, "rooms"), (5, "fee")], "query_id long, query string")
    shown = spark.createDataFrame([(1, "fee ab12", "x"), (2, "fee ab1", "x"), (3, "2031 of", "x"), (5, "none", "Fee")], "query_id long, content string, title string")
    gate = {r.query_id: r.passes for r in rerank.lexical_evidence_gate(asked, shown, text_cols=("title", "content"), stopwords=("the", "of")).collect()}
    assert gate == {1: True, 2: False, 3: False, 4: False, 5: True}
    q = spark.createDataFrame([(1, "is there a program data science here?"), (2, "is there a program law here"), (3, "other")], "query_id long, query string")
    h = spark.createDataFrame([(1, "We teach Data  Science."), (2, "lawless")], "query_id long, content string")
    assert {r.query_id: r.passes for r in rerank.named_entity_gate(q, h, r"program (.+?) here").collect()} == {1: True, 2: False, 3: True}
    live = q.select(rerank.asks_live_state(F.lit("Phòng trống hiện tại?"), "hien tai|now", "phong trong").alias("l")).first().l
    assert live


def test_query_variants(spark):
    rows = [(1, "Cutoff of CN1 in 2031", "2031 cutoff for CN1", 0), (1, "Cutoff of CN1 in 2031", "cutoff of CN2 in 2031", 1), (1, "Cutoff of CN1 in 2031", "cutoff  of cn1 in 2031", 2), (1, "Cutoff of CN1 in 2031", "CN1 2031", 3)]
    pairs = spark.createDataFrame(rows, "query_id long, original string, candidate string, candidate_pos int")
    got = rerank.safe_query_variants(pairs, ("of", "in", "for")).orderBy("place").collect()
    assert [r.variant for r in got] == ["Cutoff of CN1 in 2031", "2031 cutoff for CN1", "CN1 2031"]  # two of three topic words and all facts stay
    rows = [(1, "of in", "of in a place", 0), (2, "fee of law", "law fee of year", 0), (2, "fee of law", "deadline fee law", 1), (3, "law school", "school of law deadline", 0)]
    safe = rerank.safe_query_variants(spark.createDataFrame(rows, "query_id long, original string, candidate string, candidate_pos int"), ("of", "in"), intents=(("fee", "cost of study"), ("deadline",)))
    assert sorted((r.query_id, r.variant) for r in safe.collect()) == [(1, "of in"), (2, "fee of law"), (2, "law fee of year"), (3, "law school"), (3, "school of law deadline")]
    accepted = [r.accepted for r in rerank.accepted_rewrite(pairs).orderBy("candidate_pos").collect()]
    assert accepted[1] == accepted[3] == "Cutoff of CN1 in 2031"


def test_medians_and_acceptance(spark):
    from corpusloom.operators import evaluation

    runs = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 4.0), ("c", None), ("d", 5.0), ("d", 5.0), ("d", 5.0), ("d", 7.0), (None, 2.0)]
    got = evaluation.latency_medians(spark.createDataFrame(runs, "case_id string, ms double")).collect()
    assert {r.case_id: r.median_ms for r in got} == {"a": 2.0, "b": 2.5, "c": None, "d": 5.0, None: 2.0}
    answers = [(1, "The  FEE is 40 [1] [2].", "rag", "rag", 1, ["fee"]), (2, "The fee [3].", "rag", "rag", 1, ["fee"]), (3, "No info found", "out", "out", 0, None), (4, "Well.", "out", "out", 0, None), (5, "Plain fee", "rag", "rag", 0, ["fee", "tax"]), (6, "Plain", "rag", "rag", 0, []), (7, "fee", "rag", "rag", 1, ["fee"])]
    cited = [(1, 2, "is *40*", "it is 40"), (1, 1, "fee", "a fee"), (2, 3, "fee", "tax"), (9, 1, "x", "x")]
    a = spark.createDataFrame(answers, "answer_id long, text string, route string, expected_route string, expected_evidence int, required_terms array<string>")
    c = spark.createDataFrame(cited, "answer_id long, marker int, quote string, content string")
    got = {r.answer_id: r for r in evaluation.response_acceptance(a, c, ("no info",), "out").collect()}
    assert {k: r.accepted for k, r in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False}
    assert not got[2].citation_support_valid and got[2].marker_mapping_valid and not got[4].answer_is_abstention and got[7].no_citations


def test_preflight_of_three_indexes(spark):
    from corpusloom.operators import quality

    now = spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, payload string")
    row = lambda df, n: quality.corpus_fingerprint(df, "chunk_id").selectExpr(f"{n} AS chunk_count", "fingerprint AS corpus_fingerprint", f"'{quality.build_fingerprint({})}' AS build_fingerprint")
    none = spark.createDataFrame([], "rule string")
    ids = now.select("chunk_id")

    def found(stored, manifest, golden=none, evidence=ids, config=None, **more):
        return {r.check: r.n for r in quality.preflight_report(now, stored, manifest, config or {}, golden, evidence, **more).collect() if r.n}

    assert found(now, row(now, 2)) == {}
    assert found(now.limit(1), row(now.limit(1), 1)) == {"corpus_changed": 1}
    assert found(now, row(now, 2), config={"size": 1}) == {"build_changed": 1}
    assert found(now.union(now.limit(1)), row(now, 2)) == {"manifest_count": 1, "stored_repeated_ids": 1, "stored_differs": 1}
    lost = spark.createDataFrame([("z",)], "chunk_id string")
    assert found(now, row(now, 2).limit(0), golden=spark.createDataFrame([("r",)], "rule string"), evidence=lost, load_errors=lost) == {"manifest_missing": 1, "golden_findings": 1, "golden_ids_missing": 1, "load_errors": 1}


def test_dense_blocks_of_any_size(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, dense.dense_topk(q, v, 4).collect()))
    for sizes in ((3, 7, 0), (5, 1000, 1 << 30), (1, 1, 0)):
        for name, size in zip(("QUERIES_AT_ONCE", "VECTORS_AT_ONCE", "BROADCAST_BYTES"), sizes, strict=True):
            monkeypatch.setattr(dense, name, size)
        assert sorted(map(tuple, dense.dense_topk(q.limit(20), v.repartition(3), 4).collect())) == [r for r in whole if r[0] in {x.query_id for x in q.limit(20).collect()}]
    monkeypatch.undo()
    with pytest.raises(Exception, match="different lengths"):
        dense.dense_topk(q.withColumn("embedding", F.slice("embedding", 1, 3)), v, 4).collect()
    assert dense.dense_topk(q.limit(0), v, 4).count() == 0 and dense.dense_topk(q, v.limit(0), 4).count() == 0


def test_a_hundred_thousand_queries_in_one_plan(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    n = v.count()
    q = v.crossJoin(spark.range(-(-100_000 // n)).withColumnRenamed("id", "k")).select((F.col("k") * 10_000_000 + F.col("vec_id")).alias("query_id"), "embedding")
    found = dense.dense_topk(q, v, 2).where("rank = 1 AND query_id % 10000000 = vec_id")
    assert found.count() >= 100_000


def test_texts_are_packed_in_the_tasks(spark, monkeypatch):
    texts = ["Aa bb, aa", None, "", "bb", " cc aa ", "?"]
    q = spark.createDataFrame([(1, "aa bb"), (2, "cc"), (3, "none")], "query_id long, query string")
    seen, ranked = [], sparse.best_chunks
    monkeypatch.setattr(sparse, "best_chunks", lambda asked, blocks, k: seen.append(blocks) or ranked(asked, blocks, k))
    got = sparse.bm25_topk(q, chunks(spark, *texts).coalesce(1), 5)
    # one block of six chunks: no posting is a row
    assert [(r.ids, sorted(r.terms)) for r in seen[0].collect()] == [([0, 1, 2, 3, 4, 5], ["", "aa", "bb", "cc"])]
    assert sorted((r.query_id, r.chunk_id) for r in got.collect()) == [(1, 0), (1, 3), (1, 4), (2, 4)]


def test_hashed_grams_stay_in_their_rows(spark, monkeypatch):
    lines = ["a b c d", " b c d ", "c d", None, "", "x a b c", "ab c d"]
    df = spark.createDataFrame(list(enumerate(lines)), "chunk_id long, line string")
    for words_at_once in (1_000_000, 1):
        monkeypatch.setattr(sparse, "POSTINGS_AT_ONCE", words_at_once)
        of = {}
        for r in sparse.hashed_grams(df.coalesce(1), 3).collect():
            of.setdefault(r.gram, []).append(r.chunk_id)
        assert sorted(map(sorted, of.values())) == [[0, 1], [0, 5], [5], [6]]
