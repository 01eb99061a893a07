"""Token counts against dynamic programming without a trie."""

import random
from functools import cache

from corpusloom.llm import token_counts as tc
from corpusloom.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def brute(scores, word):
    @cache
    def best(end):
        if not end:
            return 0, 0
        raw = len(word[end - 1].encode())
        s, n = best(end - 1)
        options = [(s + raw * tc.BYTE_SCORE, -(-n + raw))]
        for start in range(end):
            if word[start:end] in scores:
                s, n = best(start)
                options.append((s + scores[word[start:end]], n - 1))
        return max(options)

    return -best(len(word))[1]


def test_words_against_brute_force():
    rng = random.Random(3)
    scores = tc.piece_scores(MODEL)
    for limit in (tc.NODES, 40):
        trie = tc.Trie(scores, limit)
        for _ in range(400):
            word = "▁" * rng.randint(0, 2) + "".join(rng.choices(["th", "e", "re", "a", "日", "😀", "q", "ing", "\x00", "é"], k=rng.randint(0, 9)))
            if word:
                assert trie.count(word) == brute(scores, word)


def test_long_pre_token():
    scores = {"a": -1, "aa": -1, "b": -5}
    assert tc.Trie(scores).count("a" * 101) == 51
    assert tc.Trie(scores).count("ab" * 50) == 100


def test_unigram_scores_prefer_the_likelier_cut():
    trie = tc.Trie({"a": -10, "b": -10, "ab": -25, "abc": -30, "c": -5})
    assert trie.count("ab") == 2 and trie.count("abc") == 3
    assert trie.text_count("") == 0


def test_columns_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "a thing\n", "y")], "doc_id long, text string, n_tokens string")
    got = tc.count_tokens(df, MODEL).collect()
    trie = tc.Trie(tc.piece_scores(MODEL))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 0), (1, 0), (2, trie.text_count("a thing\n"))]
    assert tc.count_tokens(df.limit(0), MODEL).count() == 0
