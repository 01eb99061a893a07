"""Fill-in-the-middle: cut each text at two token borders and write prefix, suffix and middle in another order.

A token is a run of ASCII letters or any other single character. Bytes of a run of texts get one of five classes (``FIRST``
letter of a run, letter ``INSIDE`` one, ``OTHER`` ASCII, ``LEAD`` and ``TAIL`` bytes of longer characters), kept in a
wavelet matrix. Ranks of the classes that begin a token sum to the token borders before a position; the total gives a
text's number of tokens, bisection on these sums finds where the k-th token begins, for all cuts of the run at once, and
the rank of TAIL turns bytes into characters.

Where the cuts lie is decided by SHA-256 of a seed and the row's id, so reruns agree. The sentinels' texts can't overlap
one another, so a form without a sentinel in its text is read back exactly (``restored``).

Defined results: a null or empty text, a text that contains a sentinel and a share ``PLAIN_PERCENT`` of the others stay as they are
(form "plain", null lengths); a null id hashes as an empty one; rows are cut alone, so rows equal in id and text give
equal results, and empty tables empty ones; a whole text is cut, however long; columns with an output's name are
replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.textbytes import slices
from corpusloom.llm.wavelet import WaveletMatrix
from corpusloom.runtime import quoted

#: What begins the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those left plain, and of the others those written suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20

INSIDE, TAIL, OTHER, LEAD, FIRST = range(5)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[_LETTER] = INSIDE
_CLASS[0x80:0xC0] = TAIL
_CLASS[0xC0:] = LEAD

OUTPUTS = {
    "n": (pa.int64(), T.LongType()),
    "form": (pa.string(), T.StringType()),
    "prefix_chars": (pa.int64(), T.LongType()),
    "middle_chars": (pa.int64(), T.LongType()),
    "output": (pa.string(), T.StringType()),
}


class Borders:
    """Token borders of a run of texts laid end to end."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        classes = _CLASS[buf]
        begins = _LETTER[buf]
        begins[1:] &= ~_LETTER[buf[:-1]]
        starts = off[:-1][off[:-1] < off[1:]]
        begins[starts] = _LETTER[buf[starts]]
        classes[begins] = FIRST
        self.matrix, self.off = WaveletMatrix(classes, 3), off
        self.before = self.borders(off)
        #: tokens of each text
        self.tokens = np.diff(self.before)

    def borders(self, at: np.ndarray) -> np.ndarray:
        """Tokens that begin before each position."""
        return sum(self.matrix.rank(c, at) for c in (OTHER, LEAD, FIRST))

    def cuts(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th token (from 0) of each text begins; its end if it has no more than k."""
        low, high, wanted = self.off[:-1].copy(), self.off[1:].copy(), self.before[:-1] + k
        while (low < high).any():
            middle = (low + high) // 2
            past = (self.borders(np.minimum(middle + 1, self.off[-1])) > wanted) & (low < high)
            low, high = np.where(past | (low >= high), low, middle + 1), np.where(past, middle, high)
        return low

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Characters between positions."""
        return end - start - (self.matrix.rank(TAIL, end) - self.matrix.rank(TAIL, start))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output, the rearranged text."""
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in OUTPUTS]
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), *draws, F.col(quoted(text_col)).cast("string").alias("given"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [c.to_numpy(zero_copy_only=False) for c in batch.columns[-5:-1]]
            for a, b, buf, off in slices(batch.column(batch.num_columns - 1)):
                borders, raw = Borders(buf, off), buf.tobytes()
                h1, h2, h3, h4 = (h[a:b] for h in draws)
                one, two = h1 % (borders.tokens + 1), h2 % (borders.tokens + 1)
                first, second = borders.cuts(np.minimum(one, two)), borders.cuts(np.maximum(one, two))
                sizes = borders.chars(off[:-1], first), borders.chars(first, second)
                plain, suffix_first = h3 % 100 >= 100 - PLAIN_PERCENT, h4 % 100 < SUFFIX_FIRST_PERCENT
                forms, outputs = [], []
                for i, (x, y, z, e) in enumerate(zip(off[:-1].tolist(), first.tolist(), second.tolist(), off[1:].tolist(), strict=True)):
                    text = raw[x:e]
                    if x == e or plain[i] or p in text or s in text or m in text:
                        forms.append("plain")
                        outputs.append(text)
                    elif suffix_first[i]:
                        forms.append("spm")
                        outputs.append(b"".join((s, raw[z:e], p, raw[x:y], m, raw[y:z])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((p, raw[x:y], s, raw[z:e], m, raw[y:z])))
                whole = np.array([f == "plain" for f in forms], dtype=bool)
                made = [pa.array(borders.tokens, pa.int64()), pa.array(forms, pa.string()), *(pa.array(n, pa.int64(), mask=whole) for n in sizes), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-5]), *made], names=[*(f.name for f in kept), *OUTPUTS])

    return source.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, (_, k) in OUTPUTS.items())]))


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged, from output and form."""

    def part(text: Column, sentinel: str, n: int) -> Column:
        return F.split_part(text, F.lit(sentinel), F.lit(n))

    def tail(text: Column, sentinel: str) -> Column:
        return F.substr(text, F.lit(len(sentinel) + 1))

    rest = part(output, SUFFIX, 2)
    psm = F.concat(tail(part(output, SUFFIX, 1), PREFIX), part(rest, MIDDLE, 2), part(rest, MIDDLE, 1))
    rest = part(output, PREFIX, 2)
    spm = F.concat(part(rest, MIDDLE, 1), part(rest, MIDDLE, 2), tail(part(output, PREFIX, 1), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
