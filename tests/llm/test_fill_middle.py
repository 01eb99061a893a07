"""Fill-in-the-middle against regular expressions, and a wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import fill_middle as fm
from corpusloom.llm.wavelet import WaveletMatrix


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    one, two = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:one], tokens[one:two], tokens[two:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_ranks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 5, n, dtype=np.uint8)
        matrix, at = WaveletMatrix(symbols, 3), np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == np.concatenate([[0], np.cumsum(symbols == c)]).tolist()


def test_cuts_at_every_token():
    texts = ["", "ab c", "é", "aé日😀b", "  x\n", "abc", "1a2"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    borders = fm.Borders(np.frombuffer(b"".join(raw), np.uint8), off)
    tokens = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert borders.tokens.tolist() == [len(t) for t in tokens]
    for k in range(7):
        expected = [len("".join(t[:k]).encode()) for t in tokens]
        got = borders.cuts(np.full(len(texts), k))
        assert (got - off[:-1]).tolist() == expected
        assert borders.chars(off[:-1], got).tolist() == [len("".join(t[:k])) for t in tokens]


def test_rows_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(["ab", "C", " ", "\n", "é", "日", "😀", "7", "<", "P>", "<S", ">", "\x00"], k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(7, None), (None, "no id here"), (None, None), (3, "same row"), (3, "same row"), (5, "has <M> in it"), (6, "long words " * 150_000), (8, "a" * 1_500_000), (9, "é" * 800_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fm.fill_in_middle(df).withColumn("back", fm.restored(F.col("output"), F.col("form"))).withColumn("text", F.col("text")).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_columns_and_empty(spark):
    df = spark.createDataFrame([("k", 1, "some text", "x", 2)], "`a.b` string, doc_id long, text string, form string, h1 int")
    got = fm.fill_in_middle(df)
    assert got.columns == ["a.b", "doc_id", "text", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got.head().h1 == 2 and fm.fill_in_middle(df.limit(0)).count() == 0
    assert fm.fill_in_middle(df, keep=("doc_id",)).columns[:2] == ["doc_id", "n"]
