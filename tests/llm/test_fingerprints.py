"""Fingerprints against the same definition in plain Python."""

import hashlib
import random
import re

import pytest
import xxhash

from corpusloom.llm.fingerprints import ATTEMPTS, BINS, CHANCE, fingerprint_documents

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_long(x, seed):
    return xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed)


def of_int(x, seed):
    return xxhash.xxh64_intdigest((x & 0xFFFFFFFF).to_bytes(4, "little"), seed)


def bits(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    grams = set()
    for i in range(len(h) - 4) if len(h) >= 5 else [0] if h else []:
        seed = 42
        for x in h[i : i + 5]:
            seed = of_long(x, seed)
        grams.add(signed(seed))
    if not grams:
        return []
    smallest = {}
    for g in sorted(grams):
        smallest.setdefault((g >> 57) + 64, g)
    out = []
    for b in range(BINS):
        if b in smallest:
            out.append(smallest[b] & 255)
            continue
        tries = [signed(of_int(t, of_int(b, 42))) % BINS for t in range(ATTEMPTS)]
        hit = next((t for t in tries if t in smallest), None)
        if hit is None:
            hit = min(smallest, key=lambda j: signed(of_long(j, of_int(b, 42))))
        out.append(smallest[hit] & 255)
    return out


def likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    share = sum(x == y for x, y in zip(a, b, strict=True)) / BINS
    return max(0.0, (share - CHANCE) / (1 - CHANCE))


def brute(rows):
    out = []
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        ahead = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + ahead[:cut]
        a, b = bits(t), bits(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), likeness(a, b), likeness(a, bits(ahead))))
    return sorted(out)


def same(got, expected):
    got = sorted(map(tuple, got))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5:] for g in got] == [pytest.approx(e[5:], abs=1e-12) for e in expected]


def test_same_as_plain_python(spark):
    rng = random.Random(2)
    words = [f"wörd{i}" for i in range(400)] + ["😀", "x"]
    texts = [None, "", " \t\n ", "one", "one two three four", "a b c d e", "日本 語 テ キ ス ト 😀"]
    texts += [" ".join(rng.choices(words, k=rng.choice([1, 3, 5, 7, 20, 60, 300, 3000]))) for _ in range(40)]
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "r", 5) for i, t in rows], "doc_id long, text string, row string, id int").repartition(4)
    same(fingerprint_documents(df).collect(), brute(rows))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same(fingerprint_documents(docs).collect(), brute([tuple(r) for r in docs.collect()]))


def test_single_repeated_null_and_empty(spark):
    schema = "doc_id long, text string"
    assert fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(1, "a b c d e f")], schema)).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 11
    rows = fingerprint_documents(spark.createDataFrame([(2, "p q r s t u"), (2, "p q r s t u"), (1, "v w"), (None, "p q r s t u")], schema)).collect()
    assert len(rows) == 4
    assert len({r.fingerprint for r in rows if r.n_chars == 11}) == 1
    assert [r.near_next for r in rows if r.doc_id == 2] == [0.0, 0.0]
    assert [r.near_next for r in rows if r.doc_id == 1] == [0.0]
