"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding finds the library's own result without running its merge queue over the text: Aho-Corasick gives the longest
piece at each position, a piece is accepted after another only if re-merging the two yields just these two, and a
bitfield of failed positions cuts the backtracking short. A sequence whose adjacent pieces all pass that check is the
one that merging yields.

Defined results: a null or empty text has no ids and decodes to ""; characters without a piece become byte pieces;
U+2581 in a text is encoded, and decoded, as a space, as the library does. Rows are never merged, so repeated rows and
ties need no rule. Columns of the input are kept unless an output has the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import quoted

SPACE = "▁"
#: Segments, and pairs of pieces, remembered by each worker.
CACHE_ENTRIES = 450_000


class PieceCodec:
    """Encoder and decoder of one merge-type model file, without begin or end ids."""

    def __init__(self, model_path: str, remembered: int = CACHE_ENTRIES):
        self.remembered = remembered
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.known = {c for p in self.ids for c in p if c in self.ids}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.segments = re.compile(self.boundaries(), re.S)
        self.shorter: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.seen: dict[str, tuple[int, str, str | None]] = {}

    def boundaries(self) -> str:
        """A pattern of segments over whose ends no piece reaches, found from the model's own pieces.

        A leader is a character that no piece has after a non-leader, so merging never joins it to what is before.
        """
        leaders = {SPACE, *(chr(c) for c in range(33, 127) if not chr(c).isalnum())}
        while late := {y for p in self.ids for x, y in zip(p, p[1:], strict=False) if y in leaders and x not in leaders}:
            leaders -= late
        if not leaders:
            return ".+"
        lead = "".join(map(re.escape, sorted(leaders)))
        if any("\n" in p for p in self.ids):
            return f"[{lead}]*[^{lead}]+|[{lead}]+"
        return f"[{lead}]*[^{lead}\n]+|[{lead}]+|\n"

    def merged(self, text: str) -> list[str]:
        """The pieces left by merging the best-scored adjacent pair, leftmost first, until none is left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging keeps the boundary between two pieces, and both whole."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.remembered:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def stands(self, piece: str) -> bool:
        """Whether merging a piece's own characters yields the piece."""
        known = self.own.get(piece)
        if known is None:
            known = self.own[piece] = self.merged(piece) == [piece]
        return known

    def next_shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix of this one, or ""."""
        found = self.shorter.get(piece)
        if found is None:
            found = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), "")
            self.shorter[piece] = found
        return found

    def known_run(self, text: str) -> list[str]:
        """Pieces of a text whose characters all are pieces."""
        if len(text) == 1:
            return [text]
        if text in self.ids and self.stands(text):
            return [text]
        longest = [1] * len(text)
        for end, size in self.automaton.iter(text):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        out: list[str] = []
        position, failed, size, pairs = 0, 0, len(text), self.pairs
        piece = text[: longest[0]]
        while position < size:
            end = position + len(piece)
            if failed and failed >> end & 1:
                fits = False
            elif out:
                fits = pairs.get((out[-1], piece))
                if fits is None:
                    fits = self.fits(out[-1], piece)
            else:
                fits = self.stands(piece)
            if fits:
                out.append(piece)
                position = end
                if end < size:
                    piece = text[end : end + longest[end]]
            elif shorter := self.next_shorter(piece):
                piece = shorter
            else:
                failed |= 1 << position
                piece = out.pop()
                position -= len(piece)
        return out

    def encode_segment(self, segment: str) -> list[int]:
        if self.known.issuperset(segment):
            return [self.ids[p] for p in self.known_run(segment)]
        out: list[int] = []
        start = 0
        for i, c in enumerate(segment):
            if c not in self.known:
                out += [self.ids[p] for p in self.known_run(segment[start:i])] if i > start else []
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                start = i + 1
        if start < len(segment):
            out += [self.ids[p] for p in self.known_run(segment[start:])]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library encodes it."""
        out: list[int] = []
        for segment in self.segments.findall(SPACE + text.replace(" ", SPACE)) if text else ():
            out += self.encode_segment(segment)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts before a text is taken off again."""
        first = next((i for i in ids if i not in self.silent), self.unknown)
        return self.surface(ids)[first != self.unknown and self.pieces[first].startswith(SPACE) :]

    def surface(self, ids: list[int]) -> str:
        parts: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                parts.append(utf8_or_replacement(bytes(held)))
                held.clear()
            if i >= 0 and i not in self.silent:
                parts.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(parts)

    def coded(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and their decoded text; segments seen before are looked up."""
        if not text:
            return 0, "", ""
        seen, count, ids, out = self.seen, 0, [], []
        for segment in self.segments.findall(SPACE + text.replace(" ", SPACE)):
            known = seen.get(segment)
            if known is None:
                own = self.encode_segment(segment)
                surface = self.surface(own)
                known = (len(own), ",".join(map(str, own)), None if surface == segment.replace(SPACE, " ") else surface)
                if len(segment) <= 64:
                    if len(seen) >= self.remembered:
                        seen.clear()
                    seen[segment] = known
            count += known[0]
            ids.append(known[1])
            out.append(segment if known[2] is None else known[2])
        return count, ",".join(ids), "".join(out).replace(SPACE, " ")[1:]


def utf8_or_replacement(raw: bytes) -> str:
    """Decode bytes; each byte that is in no valid sequence becomes one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_CODECS: dict[tuple[str, int], PieceCodec] = {}


def codec(model_path: str, remembered: int = CACHE_ENTRIES) -> PieceCodec:
    """The worker's codec of a model file, built once."""
    if (model_path, remembered) not in _CODECS:
        _CODECS[model_path, remembered] = PieceCodec(model_path, remembered)
    return _CODECS[model_path, remembered]


_KINDS = {
    "n_tokens": (pa.int64(), T.LongType()),
    "ids": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    "decoded": (pa.string(), T.StringType()),
    "ids_sha256": (pa.string(), T.StringType()),
    "decoded_sha256": (pa.string(), T.StringType()),
}


def encode_and_decode(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), remembered: int = CACHE_ENTRIES) -> DataFrame:
    """Encode and decode every whole text in one pass; a worker remembers at most ``remembered`` segments, and pairs of pieces.

    ``outputs`` may name n_tokens, ids, decoded, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.
    ``keep`` names the input columns that stay (None: all); of a name that is also an output, the output stays.
    """
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in outputs]
    schema = T.StructType([*kept, *(T.StructField(n, _KINDS[n][1]) for n in outputs)])
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(text_col)).cast("string").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, remembered)
        for batch in batches:
            made: dict[str, list] = {n: [] for n in outputs}
            for text in batch.column(batch.num_columns - 1):
                n, ids, decoded = own.coded(text.as_py() or "")
                for name in outputs:
                    if name == "n_tokens":
                        made[name].append(n)
                    elif name == "ids":
                        made[name].append([int(x) for x in ids.split(",")] if ids else [])
                    elif name == "decoded":
                        made[name].append(decoded)
                    else:
                        made[name].append(hashlib.sha256((ids if name == "ids_sha256" else decoded).encode()).hexdigest())
            arrays = [pa.array(made[n], type=_KINDS[n][0]) for n in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*(f.name for f in kept), *outputs])

    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", output: str = "decoded") -> DataFrame:
    """Decode a column of id arrays (null: ""); other columns stay."""
    kept = [f for f in df.schema.fields if f.name != output]
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(ids_col)).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*(f.name for f in kept), output])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(output, T.StringType())]))
