"""The pipeline's stages, each on all that the one before kept."""

from collections import Counter

import corpus_pipeline
from corpusloom.llm import mixing, ngram_join, quality_cnn, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_single_steps(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [set(r.doc_id for r in docs.select("doc_id").collect())]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert set(ids) <= kept[-1]
        if i < 4:
            assert docs.columns == columns
        if name == "quality":
            s = quality_cnn.score(before, queries.quality_model(spark, SF)).where("score >= 0.3")
            assert set(ids) == {r.doc_id for r in s.collect()}
        elif name == "toxicity":
            s = toxicity.score(before, queries.toxicity_model(spark, SF)).where("score < 0.7")
            assert set(ids) == {r.doc_id for r in s.collect()}
        elif name == "near_duplicates":
            g = ngram_join.jaccard_components(before).where("doc_id = component_id")
            assert ids == Counter(r.doc_id for r in g.collect())
        elif name == "mixing":
            scored = quality_cnn.score(before, queries.quality_model(spark, SF), output="quality")
            plan = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(scored, quality_col="quality").where("taken > 0").collect()}
            assert ids == Counter(plan)
        else:
            assert ids == last and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
        last = ids
        kept.append(set(ids))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.where("n_tokens is null").count() == 0


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and extra columns with clashing names."""
    long = "many words make a very long text and no end is near " * 20_000
    rows = [(1, long, "en", "web", 5, 1, 2, 3), (2, "", "en", "web", 0, 1, 2, 3), (3, " \n", None, None, 2, 1, 2, 3), (4, None, "en", "web", None, None, None, None), (None, "a text without id", "en", None, 17, 1, 2, 3)]
    rows += [(5, "the same row stands here twice for a test", "en", "web", 40, 1, 2, 3)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, `a.b` int, own_row int").repartition(3)


def test_stages_on_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, SF)
            rows = got.collect()
            assert i == 4 or got.columns == docs.columns
            assert rows == [] or given is docs
    named = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert sorted((r.doc_id for r in named["near_duplicates"](spark, docs, SF).collect()), key=str) == [1, 2, 3, 4, 5, None]
    assert named["mixing"](spark, docs, SF).where("text is null or trim(text) = ''").count() == 0
