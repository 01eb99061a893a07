"""Toxicity and quality: held-out figures on the given labels, and the features by themselves."""

import numpy as np
import pytest

from corpusloom.llm import quality_cnn, queries, toxicity
from corpusloom.llm.training_sample import labelled_sample

SF = "/root/testdata/sf0.1"


def figures(spark, scored, label):
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, p, s = rows[label].to_numpy(), rows.predicted.to_numpy(), rows.score.rank().to_numpy()
    pos = y == 1
    auc = (s[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    return auc, (p[pos] == 1).mean(), (p[~pos] == 0).mean()


def test_toxicity_held_out(spark):
    scored = queries.op2_toxicity(spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    auc, caught, left_alone = figures(spark, scored, "toxic")
    assert auc > 0.93 and caught > 0.75 and left_alone > 0.99


def test_quality_held_out(spark):
    auc, kept, dropped = figures(spark, queries.op6_quality(spark, SF), "quality")
    assert auc > 0.97 and kept > 0.98 and dropped > 0.8


def test_pairs_count_beyond_single_terms():
    rng = np.random.RandomState(1)
    texts, labels = [], []
    for _ in range(1200):
        insult, group = rng.rand() < 0.5, rng.rand() < 0.5
        words = [f"w{rng.randint(300)}" for _ in range(8)] + ["fool"] * insult + ["neighbours"] * group
        texts.append(" ".join(words))
        labels.append(float(insult and group))
    from corpusloom.llm.textbytes import text_bytes

    import pyarrow as pa

    buf, off = text_bytes(pa.array(texts))
    parts = list(toxicity.term_bins(buf, off))
    bins, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    model = toxicity.fit([np.unique(bins[text == k]) for k in range(len(texts))], np.array(labels))
    probe = text_bytes(pa.array(["fool", "neighbours", "fool neighbours", "", None]))
    score = model.scores(*probe)
    assert score[2] > 0.7 > max(score[0], score[1]) and score[3] == score[4]


def test_toxicity_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "doc_id long, text string")
    none = docs.sparkSession.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(labelled_sample(docs, none, "toxic", (3, 1), 10))
    assert [round(r.score, 6) for r in toxicity.score(docs, model).collect()] == [0.0] * 3
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs.withColumnRenamed("doc_id", "score"), model).columns == ["score", "text"]


def test_chunks_cover_every_byte():
    rng = np.random.RandomState(0)
    sizes = [0, 1, 31, 32, 33, 224, 225, 256, 257, 480, 481, 5000]
    off = np.concatenate([[0], np.cumsum(sizes)])
    buf = rng.randint(1, 256, off[-1]).astype(np.uint8)
    chunks, first = quality_cnn.chunked(buf, off)
    bounds = [*first.tolist(), len(chunks)]
    step = quality_cnn.CHUNK - quality_cnn.OVERLAP
    for k, n in enumerate(sizes):
        own = chunks[bounds[k] : bounds[k + 1]]
        covered = np.zeros(len(own) * step + quality_cnn.CHUNK, np.uint8)
        for j, c in enumerate(own):
            covered[j * step : j * step + quality_cnn.CHUNK] = np.maximum(covered[j * step : j * step + quality_cnn.CHUNK], c)
        assert np.array_equal(covered[:n], buf[off[k] : off[k + 1]]) and not covered[n:].any()


def test_network_gradients_learn_a_simple_pattern():
    rng = np.random.RandomState(2)
    samples, labels = [], []
    for k in range(300):
        c = rng.randint(97, 123, (2, quality_cnn.CHUNK)).astype(np.uint8)
        if k % 2:
            at = rng.randint(0, 200)
            c[0, at : at + 12] = 35
        samples.append(c)
        labels.append(float(k % 2 == 0))
    net = quality_cnn.fit(samples[:200], np.array(labels[:200], np.float32))
    flat = np.concatenate([s.reshape(-1) for s in samples[200:]])
    score = net.scores(flat, np.arange(0, len(flat) + 1, 2 * quality_cnn.CHUNK))
    assert ((score > 0.5) == np.array(labels[200:], bool)).mean() > 0.9


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "fit", lambda samples, labels: samples)
    text = "".join(f"{k:07d} " for k in range(2000))
    (chunks,) = quality_cnn.train(spark.createDataFrame([(1, text, 1)], "id long, text string, label int"))
    step = quality_cnn.CHUNK - quality_cnn.OVERLAP
    assert b"".join(c[:step].tobytes() for c in chunks[:-1]) + chunks[-1].tobytes().rstrip(b"\0") == text.encode()


def test_quality_held_out_on_longest_rows(spark):
    longest = spark.read.parquet(f"{SF}/documents.parquet").where("octet_length(text) > 1824").select("doc_id")  # more than 8 chunks
    auc, kept, dropped = figures(spark, queries.op6_quality(spark, SF).join(longest, "doc_id"), "quality")
    print(f"longest rows: auc {auc:.4f} kept {kept:.4f} dropped {dropped:.4f}")
    assert auc > 0.97 and kept > 0.98 and dropped > 0.8


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (3, "x" * 300_000, 3)], "doc_id long, text string, score int")
    one_sided = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    model = quality_cnn.train(labelled_sample(docs, one_sided, "quality", (5, 0), 100))
    got = quality_cnn.score(docs, model).collect()
    assert len(got) == 4 and all(r.score == pytest.approx(1.0) for r in got)
    assert quality_cnn.score(docs.limit(0), model).count() == 0
    assert quality_cnn.keep_good(docs, model).columns == docs.columns
