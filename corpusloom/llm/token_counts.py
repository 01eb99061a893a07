"""Token counts of a unigram model by dynamic programming shared in a trie of pre-tokens.

A text is cut into pre-tokens (words with the space before them). Distinct pre-tokens are inserted in a trie whose nodes
hold the forward score of their prefix: the best sum of piece scores over all ways to cut it, and how many pieces that
takes. A prefix that several pre-tokens share is scored once; the node where a pre-token ends holds its count. A text's
count is the sum over its pre-tokens.

Scores are integers (micro-nats), so equal inputs give equal counts anywhere. Of equal sums the cut with fewer pieces
counts.

Defined results: a null or empty text has no tokens; a character without a piece costs one byte piece per UTF-8 byte;
rows are counted alone, so ties, repeated rows and empty tables need no rule; columns with an output's name are
replaced, others kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import quoted

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Nodes of a worker's trie before it is begun anew: bounds memory, not results.
NODES = 600_000
#: Pre-tokens longer than this are scored outside the trie.
LONGEST_SHARED = 64
BYTE_SCORE = -14_000_000


def piece_scores(model_path: str) -> dict[str, int]:
    """Unigram scores of a model file's pieces.

    A unigram model's own log-probabilities are taken. A merge-type model stores ranks, for which the log-probability
    of Zipf's law at that rank stands in.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    if min(scores.values()) < -100:
        total = math.log(sum(1 / (k + 10) for k in range(len(plain))))
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        scores = {model.id_to_piece(i): -math.log(k + 10) - total for k, i in enumerate(ranked)}
    return {p: round(s * 1e6) for p, s in scores.items()}


class Trie:
    """Pre-tokens with the forward score and piece count of every prefix."""

    def __init__(self, scores: dict[str, int], nodes: int = NODES):
        self.scores, self.limit = scores, nodes
        sizes: dict[str, set[int]] = {}
        for piece in scores:
            sizes.setdefault(piece[-2:], set()).add(len(piece))
        #: the sizes of pieces that end in two characters
        self.sizes = {ends: tuple(sorted(own - {1})) for ends, own in sizes.items()}
        self.begin()

    def begin(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0], [0]
        self.ends: dict[str, int] = {}

    def forward(self, word: str, end: int, best: list[int], pieces: list[int]) -> tuple[int, int]:
        """The score and count of word[:end] from those of its shorter prefixes (lists by length)."""
        c = word[end - 1]
        raw = 1 if c < "\x80" else len(c.encode())
        top, count = best[end - 1] + raw * BYTE_SCORE, pieces[end - 1] + raw
        scores = self.scores
        score = scores.get(c)
        if score is not None and (score > raw * BYTE_SCORE or (score == raw * BYTE_SCORE and raw > 1)):
            top, count = best[end - 1] + score, pieces[end - 1] + 1
        if end > 1:
            for size in self.sizes.get(word[end - 2 : end], ()):
                if size > end:
                    break
                start = end - size
                score = scores.get(word[start:end])
                if score is not None:
                    total = best[start] + score
                    if total > top or (total == top and pieces[start] + 1 < count):
                        top, count = total, pieces[start] + 1
        return top, count

    def count(self, word: str) -> int:
        """The number of pieces of the best cut."""
        known = self.ends.get(word)
        if known is not None:
            return known
        best, pieces, shared = [0], [0], len(word) <= LONGEST_SHARED
        if shared and len(self.best) + len(word) > self.limit:
            self.begin()
        node = 0
        for end, c in enumerate(word, 1):
            child = self.children.get((node, c)) if shared else None
            if child is None:
                top, n = self.forward(word, end, best, pieces)
                if shared:
                    child = self.children[node, c] = len(self.best)
                    self.best.append(top)
                    self.pieces.append(n)
            else:
                top, n = self.best[child], self.pieces[child]
            best.append(top)
            pieces.append(n)
            node = child
        if shared:
            self.ends[word] = pieces[-1]
        return pieces[-1]

    def text_count(self, text: str) -> int:
        ends, total = self.ends, 0
        for word in PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else ():
            n = ends.get(word)
            if n is None:
                n = self.count(word)
                ends = self.ends
            total += n
        return total


_TRIES: dict[str, Trie] = {}


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] | None = None, output: str = "n_tokens") -> DataFrame:
    """Add every whole text's number of tokens."""
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name != output]
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(text_col)).cast("string").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _TRIES:
            _TRIES[model_path] = Trie(piece_scores(model_path))
        trie = _TRIES[model_path]
        for batch in batches:
            counts = [trie.text_count(text.as_py() or "") for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*(f.name for f in kept), output])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(output, T.LongType())]))
