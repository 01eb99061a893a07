"""Tables in buckets, the vector sink and the stored keyword index."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import keyword_index as ki
from corpusloom.operators import sparse
from corpusloom.sources import bucketed as bk

VECTORS = "chunk_id string, embedding array<float>, source string"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def test_writing_twice_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "v")
    rows = vectors(spark, [(f"c{i}", [float(i), None], None if i % 3 else "s") for i in range(50)])
    first = bk.write_vectors(rows, folder, buckets=8)
    assert bk.write_vectors(rows.repartition(5), folder).number == first.number == 0
    assert bk.write_vectors(rows.limit(0), folder).number == 0
    assert sorted(map(tuple, bk.read_vectors(spark, folder).collect())) == sorted(map(tuple, rows.collect()))


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "v")
    first = bk.write_vectors(vectors(spark, [(f"c{i}", [float(i)], "s") for i in range(200)]), folder, buckets=16)
    second = bk.write_vectors(vectors(spark, [("c7", [-1.0], "t"), ("new", [0.5], "t"), ("c8", [8.0], "s")]), folder, buckets=99)
    changed = [b for b in second.paths if second.paths[b] != first.paths.get(b)]
    assert 1 <= len(changed) <= 2 and second.told["buckets"] == 16
    got = {r.chunk_id: (list(r.embedding), r.source) for r in bk.read_vectors(spark, folder).collect()}
    assert len(got) == 201 and got["c7"] == ([-1.0], "t") and got["new"] == ([0.5], "t") and got["c8"] == ([8.0], "s")
    old = bk.BucketedTable(spark, folder).read(version=first)
    assert {r.chunk_id: list(r.embedding) for r in old.collect()}["c7"] == [7.0]


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "v")
    bk.write_vectors(vectors(spark, [("a", [1.0], "s")]), folder)
    broken = vectors(spark, [("a", [2.0], "s"), ("b", [1.0], "s")]).withColumn("source", F.when(F.col("chunk_id") == "b", F.raise_error(F.lit("lost")).cast("string")).otherwise("s"))
    with pytest.raises(Exception, match="lost"):
        bk.write_vectors(broken, folder)
    with pytest.raises(Exception, match="no key"):
        bk.write_vectors(vectors(spark, [(None, [2.0], "s")]), folder)
    table = bk.BucketedTable(spark, folder)
    assert table.version().number == 0 and [list(r.embedding) for r in table.read().collect()] == [[1.0]]
    late = bk.Version(0, "x int", {})
    with pytest.raises(RuntimeError, match="another writer"):
        table.commit(late)
    with pytest.raises(ValueError):
        bk.BucketedTable(spark, str(tmp_path / "none")).read()


def test_repeated_keys_in_a_batch(spark, tmp_path):
    one, two = [("a", [1.0], "s"), ("a", [2.0], "s"), ("b", [3.0], None)], [("b", [3.0], None), ("a", [2.0], "s"), ("a", [1.0], "s")]
    for name, rows in (("x", one), ("y", two)):
        bk.write_vectors(vectors(spark, rows), str(tmp_path / name))
    x, y = (sorted(map(tuple, bk.read_vectors(spark, str(tmp_path / n)).collect())) for n in ("x", "y"))
    assert x == y and len(x) == 2


CHUNKS = [(1, "apple banana apple"), (2, "banana cherry"), (3, ""), (4, None), (5, "Date! date, fig"), (6, "apple"), (7, "... !")]
QUERIES = [(10, "apple date date"), (11, "banana"), (12, "zebra"), (13, " "), (14, None), (15, "fig apple cherry")]


def searched(spark, chunks):
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    return sorted(map(tuple, sparse.bm25_topk(q, spark.createDataFrame(chunks, "chunk_id long, content string"), 3).collect()))


def test_index_after_changes_is_the_index_of_the_changed_chunks(spark, tmp_path):
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    folder = str(tmp_path / "k")
    schema = "chunk_id long, content string"
    ki.build_index(spark.createDataFrame(CHUNKS, schema), folder, buckets=4)
    assert sorted(map(tuple, ki.search_index(q, folder, 3).collect())) == searched(spark, CHUNKS)
    state = dict(CHUNKS)
    for new, gone in (([(2, "apple pie"), (8, "fig fig")], []), ([], [1, 99]), ([(3, "cherry")], [5, 6]), ([(1, "")], [])):
        state = {k: v for k, v in (state | dict(new)).items() if k not in gone}
        chunks = spark.createDataFrame(new, schema) if new else None
        ids = spark.createDataFrame([(g,) for g in gone], "chunk_id long") if gone else None
        version = ki.change_index(spark, folder, chunks, ids)
        assert sorted(map(tuple, ki.search_index(q, folder, 3).collect())) == searched(spark, list(state.items()))
        assert version.told["n"] == len(state)
    assert ki.change_index(spark, folder, None, spark.createDataFrame([(99,)], schema.split(",")[0])).number == version.number


def test_a_small_change_touches_few_buckets(spark, tmp_path):
    folder = str(tmp_path / "k")
    chunks = spark.createDataFrame([(i, f"w{i} common") for i in range(300)], "chunk_id long, content string")
    first = ki.build_index(chunks, folder, buckets=32)
    second = ki.change_index(spark, folder, spark.createDataFrame([(5, "w5 other")], "chunk_id long, content string"))
    assert sum(first.paths.get(b) != p for b, p in second.paths.items()) <= 4


def test_empty_index(spark, tmp_path):
    folder = str(tmp_path / "k")
    ki.build_index(spark.createDataFrame([(1, "!")], "chunk_id long, content string"), folder, buckets=4)
    assert ki.search_index(spark.createDataFrame(QUERIES, "query_id long, query string"), folder).count() == 0
    assert ki.term_statistics(spark, folder).count() == 0
