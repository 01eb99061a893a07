"""The mix against a plain computation."""

import math

import pytest

from corpusloom.llm import mixing


def water(sizes, most=3):
    """Targets by repeated resharing; sizes: {source: size}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("cells", [1, 7, 4096])
def test_targets_and_taken(spark, cells):
    rows = [(i, "w " * (1 + i * 7 % 50), "big" if i % 3 else f"s{i % 11}") for i in range(600)]
    rows += [(1000, "tiny text", "ab"), (1001, None, None), (1002, "no source at all", None), (1003, "", "empty"), (1002, "no source at all", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int").repartition(6)
    got = mixing.mix_plan(df, cells=cells).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    expected = water(sizes)
    of = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    longest = {}
    for r in got:
        s = of[r.id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
        longest[s] = max(longest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= longest[s] / 2 + 1e-6
        epochs = math.floor(expected[s] / sizes[s] + 1e-9) if sizes[s] else 0
        assert all(r.times >= min(3, epochs) for r in got if of[r.id] == s)


def test_same_draw_in_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans = [sorted(map(tuple, mixing.mix_sources(d).collect())) for d in (docs, docs.repartition(7))]
    assert plans[0] == plans[1]


def test_cells_do_not_change_the_draw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, mixing.mix_plan(docs, cells=3).collect())) == sorted(map(tuple, mixing.mix_plan(docs, cells=900).collect()))


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, f"good words here {i}", f"s{i % 3}", 0.9 if i % 2 else 0.1) for i in range(3000)]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), quality_col="q").collect()
    first = [r for r in got if r.target < r.source_size]
    share = lambda odd: sum(r.times for r in first if r.id % 2 == odd) / sum(1 for r in first if r.id % 2 == odd)
    assert share(1) > 1.3 * share(0)


def test_quality_out_of_range(spark):
    rows = [(i, q) for i, q in enumerate([None, float("nan"), -1.0, 0.0, 0.52, 1.0, 7.0])]
    got = spark.createDataFrame(rows, "i int, q double").select("i", mixing.quality_weight(mixing.F.col("q")).alias("w")).collect()
    assert [round(r.w, 6) for r in sorted(got)] == [0.5, 0.5, 0.5, 0.5, 1.0, 1.5, 1.5]


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "a b c", "s", 7, 8), (1, "a b c", "s", 7, 8), (1, "other text of it", "s", 9, 8), (None, "no id", None, 1, 1), (2, "", "s", 1, 1), (3, None, "t", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, own_row int, `a.b` int")
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns
    assert {r.own_row for r in got.where("doc_id = 1").collect()} <= {7, 9} and got.where("text = '' or text is null").count() == 0


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"host{i % 700}") for i in range(2000)]
    got = mixing.source_targets(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("source", "size(split(trim(text), ' ')) as size")).collect()
    sizes = {r.source: r.source_size for r in got}
    assert len(got) == 700 and {r.source: pytest.approx(r.target) for r in got} == water(sizes)


def test_mixed_rows_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix_sources(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    counts = {}
    for r in rows.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: n for i, n in plan.items() if n}
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0
