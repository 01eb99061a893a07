"""The similarity join against all pairs in plain Python."""

import random
import re

import pytest

from corpusloom.llm import ngram_join
from corpusloom.llm.components import connected_components


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in members]
    return sorted(out, key=str)


def made_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=50)
    base = rng.choices(words, k=120)
    texts = [None, "", " \n\t", "one two", "One  two", "one two three four five", "ONE two\x0bthree four five", "é é é é é é"]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    for _ in range(60):
        texts.append(" ".join(rng.choices(words, k=rng.randint(0, 25)) + passage + rng.choices(words, k=rng.randint(0, 12))))
    for _ in range(60):
        texts.append(" ".join(rng.choices(words, k=rng.randint(1, 300))))
    texts += [rng.choice(texts) for _ in range(60)]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[9], (None, texts[9]), (None, "only here and nowhere else at all"), (None, texts[9] + " more")]


@pytest.mark.parametrize("listed", [ngram_join.COMMON_LIST, 0, 5])
def test_same_as_all_pairs(spark, monkeypatch, listed):
    monkeypatch.setattr(ngram_join, "COMMON_LIST", listed)
    rows = made_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n int").repartition(5)
    got = ngram_join.jaccard_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(df).count() == 0


def test_same_as_all_pairs_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect()), key=str) == brute(rows)


def test_keep_one_per_group(spark):
    """A null id is last in its group; rows without words stay; clashing and dotted column names come through."""
    text = "a b c d e f g h i j"
    rows = [(3, text, 1, 2), (1, text, 2, 2), (1, text, 2, 2), (2, "other words stand here for good", 4, 2), (None, text, 5, 2)]
    rows += [(1, "one id and another text of its own", 6, 2), (None, "only the null id has this text", 7, 2), (None, None, 8, 2), (9, " ", 9, 2)]
    kept = ngram_join.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string, row int, `a.b` int"))
    assert kept.columns == ["doc_id", "text", "row", "a.b"]
    assert sorted(r["row"] for r in kept.collect()) == [2, 4, 6, 7, 8, 9]


def near_copies(n, rng):
    """Texts from one base, each with so many words of its own that about a third link with none."""
    words = [f"w{i}" for i in range(100_000)]
    base = rng.choices(words, k=130)
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.sample(range(len(t)), rng.randint(1, 5)):
            t[at] = rng.choice(words)
        out.append(" ".join(t))
    return out


def test_filters_leave_few_pairs_of_a_large_group(spark):
    """A group of near copies yields fewer candidates than members, and its components are those of all pairs."""
    rows = list(enumerate(near_copies(400, random.Random(3))))
    counts = {}
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), counts=counts)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert counts["passed"] <= 400 and counts["homes"] <= counts["passed"]
    assert counts["found"] <= counts["pairs"] <= counts["candidates"] < 400


def shared_edit(m, rng, base_words=200, own=16, at=120):
    """A base and m texts that share one edit of eight words and have words of their own at one place: linked with each other, not with the base."""
    words = [f"w{i}" for i in range(100_000)]
    base = rng.choices(words, k=base_words)
    edit = rng.choices(words, k=8)
    return [" ".join(base)] + [" ".join([*base[:20], *edit, *base[28:at], *rng.choices(words, k=own), *base[at + own :]]) for _ in range(m)]


@pytest.mark.parametrize("m", [200, 500])
def test_a_shared_edit_makes_no_pairs_of_the_group(spark, m):
    rows = list(enumerate(shared_edit(m, random.Random(m))))
    counts = {}
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), counts=counts)
    if m < 400:
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    else:
        sets = [shingles(t) for _, t in rows[:3]]
        assert all(100 * len(sets[i] & sets[2]) >= 75 * len(sets[i] | sets[2]) for i in (1, 2)) and 100 * len(sets[0] & sets[1]) < 75 * len(sets[0] | sets[1])
        assert {(r.doc_id, r.component_id) for r in got.collect()} == {(0, 0)} | {(i, 1) for i in range(1, m + 1)}
    assert counts["led"] + counts["candidates"] < 4 * m


def test_groups_without_links_and_two_edits(spark):
    """Texts of one base whose edits set two groups apart, and others that share a passage and link with none."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(100_000)]
    texts = shared_edit(40, rng) + shared_edit(40, rng, own=60)
    base = rng.choices(words, k=160)
    for edit in (rng.choices(words, k=14), rng.choices(words, k=14)):
        texts += [" ".join([*base[:40], *edit, *base[54:100], *rng.choices(words, k=9), *base[109:]]) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_each_filter_keeps_every_link(spark):
    """Candidates of one home and of two homes, from many small groups with common passages and shared edits."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randint(20, 90))]
        variants = [base]
        for _ in range(14):
            t = list(rng.choice(variants))
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            variants.append(t)
        texts += [" ".join(t) for t in variants] + [" ".join(base + base[: rng.randint(1, 15)])]
    rows = list(enumerate(texts))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(2)
    long = [f"x{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:50_000])), (3, " ".join(long[:30_000])), (4, "short text")]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
