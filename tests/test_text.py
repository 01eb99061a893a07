"""Column expressions over text."""

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


@pytest.fixture(scope="module")
def ask(spark):
    def run(value, expression):
        return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y

    return run


def test_tokens(ask):
    assert ask("Straße, ĐIỂM-chuẩn 2_0!", tx.tokens) == ["strasse", "điểm", "chuẩn", "2_0"]
    assert ask(None, tx.tokens) == [] and ask("?!", tx.tokens) == []
    assert ask("The 10 a cats cats", lambda c: tx.content_tokens(c, ("the",), 2, False)) == ["cats"]


def test_fold(ask):
    for s in ("Điểm chuẩn", "Ångström ÉÈ ñ", "ộ", "Ǭ"):
        expected = "".join(c for c in unicodedata.normalize("NFD", s.casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d")
        assert ask(s, tx.fold) == expected


def test_codes_are_whole_tokens(ask):
    assert ask("CN1 and CN10, A00 A001 7480202 17480202 abcdefg1", tx.codes) == ["7480202", "a00", "a001", "cn1", "cn10"]


@pytest.mark.parametrize("text,kind,values", [("2030-2031", "academic_range", [2030, 2031]), ("2030 – 2032", "multi", [2030, 2032]), ("in 2031", "single", [2031]), ("12031 or 1", "missing", []), (None, "missing", []), ("2030, 2031", "multi", [2030, 2031])])
def test_years(ask, text, kind, values):
    y = ask(text, tx.years)
    assert (y.kind, y["values"]) == (kind, values)


def test_abbreviations_once(ask):
    expand = lambda c: tx.expand_abbreviations(c, {"ai": "artificial intelligence", "ai4": "AI for all (v2)"})
    once = ask("AI, ai4 and mail", expand)
    assert once == "AI (artificial intelligence), ai4 (AI for all (v2)) and mail" or once.startswith("AI (artificial intelligence), ai4 (AI")
    assert ask("ai (artificial intelligence)", expand) == "ai (artificial intelligence)"


def test_ids(ask):
    assert ask("name", tx.point_id) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "name"))
    u = str(uuid.uuid4())
    assert ask(u, tx.point_id) == u
    assert ask("Điểm  chuẩn: 2031!", tx.slug) == "diem-chuan-2031"
    assert ask("t", lambda c: tx.document_id(F.lit("ns"), F.lit(2031), F.lit("cat"), c, F.lit(2), F.lit(7))) == "ns-2031-cat-t-v2-p007"


def test_facts_and_cells(ask):
    assert ask('Is "Data Science" 7480202 at HCM in A00?', tx.facts) == ["7480202", "a00", "data", "hcm", "science"]
    assert ask(r"| a \| b | c |", tx.markdown_cells) == ["a | b", "c"]
    assert ask("1,200 and 3:4 x5 6", tx.numeric_token_count) == 3


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r.a for r in df.select(tx.valid_vector(F.col("v"), 2).alias("a")).collect()] == [True, False, False, False, False]
    c = df.limit(3).select(tx.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(4.0))).alias("c")).collect()
    assert [r.c for r in c] == [1.0, 0.0, 0.0]


def test_scalar_kinds_and_hosts(ask):
    assert [ask(s, tx.scalar_kind) for s in ('"q"', "12", "True", "word", "")] == ["json_string", "int", "bool", "string", "null"]
    assert ask("https://A.example.com:80/x", tx.url_host) == "a.example.com"


def test_page_ids_keep_all_digits(spark):
    d = spark.range(1).select(*(tx.document_id(F.lit("n"), F.lit(2024), F.lit("c"), F.lit("A b"), F.lit(2), F.lit(p).cast("int")).alias(f"p{i}") for i, p in enumerate((7, 1234, None)))).first()
    assert tuple(d) == ("n-2024-c-a-b-v2-p007", "n-2024-c-a-b-v2-p1234", "n-2024-c-a-b-v2")


def test_protected_terms_and_rewrites(spark):
    from corpusloom.operators import rerank

    rows = ["Fee of CN-1 in 2024, 1,5 or 12.5a", 'the "big Room" of ABC and IT', "x I 7", None, "Straße A/B v2.0"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", tx.protected_terms(F.col("t"), ("fee",)).alias("p")).orderBy("i")
    assert [r.p for r in df.collect()] == [["1", "1,5", "12", "12.5a", "2024", "cn-1", "fee"], ["abc", "big", "it", "room"], ["7"], [], ["0", "a/b", "v2.0"]]
    pairs = [("fee of ABC", "the fee of abc"), ("fee of ABC", "fee of it"), ("fee of x", "fee of x in 2024"), ("fee", " "), ("fee", None), ("a-b c", "c a-b d"), ("a-b c", "a b c")]
    got = rerank.accepted_rewrite(spark.createDataFrame(pairs, "original string, candidate string")).collect()
    assert [r.accepted == r.candidate for r in got] == [True, False, False, False, False, True, False]
