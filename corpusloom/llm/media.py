"""Media columns: bytes stored losslessly as WebP images, read back as pixel arrays, and features of the pixels.

A payload (zero-padded to a positive multiple of 64 bytes) is laid out four bytes a pixel (red, green, blue, alpha) in
rows of 16 pixels. An image has at most 16,384 rows, 1 MiB of payload; a larger payload is a run of images one after
another, each read back by its own size.

Each image takes one of these forms: plain prefix codes, a palette (tried on at most 1,024 pixels), the difference from the
pixel above or to the left (predictor), colour shifts by green (cross-colour, subtract green), or back-references with a colour
cache. One form is picked by estimates: references where at least REPEATED of the runs of three pixels stand before, else the
form of least entropy, differences only where samples lie within SMOOTH of each other. It is encoded beside the plain
form and kept if it is smaller. This saves time and is not the smallest form: most texts are stored plain, though
references would make them some 5% smaller.

Defined results: a null or empty text is 64 zero bytes; rows are handled alone, so ties, repeated rows and empty tables
need no rule; columns with an output's name are replaced, others kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import webp
from corpusloom.runtime import quoted

ROW = 64
IMAGE = ROW * 16_384


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW if raw else ROW)


#: Share of runs of three pixels that stand before in the image from which references are tried.
REPEATED = 0.2
#: Mean difference of samples below which a transform that takes differences is estimated; letters lie further apart.
SMOOTH = 12
#: Bits of the colour cache that goes with references.
CACHE_BITS = 6
#: Forms by name: what the encoder is asked for.
FORMS = {
    "plain": {"one_code": True},
    "green": {"subtract_green": True},
    "cross": {"cross": (0, 16, 16)},
    "left": {"predictor": 1},
    "above": {"predictor": 2},
    "palette": {"palette": True},  # tried up to 1,024 pixels: more have too many colours
    "references": {"copies": True, "cache_bits": CACHE_BITS},
}


_CHANNEL = np.arange(4) * 256


def code_bits(counts: np.ndarray) -> float:
    """Bits that prefix codes with these symbol counts (codes in rows) take, about: the entropy and some 5 bits a symbol."""
    logs = np.log2(np.maximum(counts, 1))
    total = counts.sum(axis=-1)
    return float((total * np.log2(np.maximum(total, 1))).sum() - (counts * logs).sum() + 5 * np.count_nonzero(counts))


def channel_counts(pixels: np.ndarray) -> np.ndarray:
    return np.bincount((pixels + _CHANNEL).reshape(-1), minlength=1024).reshape(4, 256)


def repeats(flat: np.ndarray) -> bool:
    """Whether many runs of three pixels stand before in the image."""
    if len(flat) < 4:
        return False
    runs = flat[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ flat[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ flat[2:] * np.uint64(0x165667B19E3779F9)
    runs.sort()
    return np.count_nonzero(runs[1:] == runs[:-1]) >= REPEATED * len(runs)


def likely_form(pixels: np.ndarray) -> str:
    """The name of the form that is smallest by estimate; of equal ones the first in FORMS."""
    flat = np.ascontiguousarray(pixels).view("<u4").reshape(-1).astype(np.uint64)
    if repeats(flat):
        return "references"
    bits = {"plain": code_bits(channel_counts(pixels).sum(axis=0))}
    wide = pixels.astype(np.int16)
    by_green = wide[..., [0, 2]] - wide[..., 1:2]
    if np.abs(by_green).mean() < SMOOTH:
        shifted = wide.copy()
        shifted[..., [0, 2]] = by_green
        bits["green"] = code_bits(channel_counts(shifted & 255))
        red, green = ((wide[..., c] ^ 128) - 128 for c in range(2))
        shifted[..., 0] = wide[..., 0]
        shifted[..., 2] = wide[..., 2] - (16 * green >> 5) - (16 * red >> 5)
        bits["cross"] = code_bits(channel_counts(shifted & 255))
    for form, axis in (("left", 1), ("above", 0)):
        rest = np.diff(wide, axis=axis, prepend=np.int16(0))
        if np.abs(rest).mean() < SMOOTH:
            bits[form] = code_bits(channel_counts(rest & 255))
    if len(flat) <= 1024:
        colours, counts = np.unique(flat, return_counts=True)
        if len(colours) <= 256:
            bits["palette"] = 30 * len(colours) + code_bits(counts)
    return min(bits, key=bits.get)


def encoded(pixels: np.ndarray) -> bytes:
    """One image, in its likely form if that is smaller than the plain one."""
    plain = webp.encode(pixels, **FORMS["plain"])
    form = likely_form(pixels)
    if form == "plain":
        return plain
    return min(plain, webp.encode(pixels, **FORMS[form]), key=len)


def stored(payload: bytes) -> bytes:
    """The WebP images of a padded payload."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 4, 4)
    return b"".join(encoded(pixels[i : i + IMAGE // ROW]) for i in range(0, len(pixels), IMAGE // ROW))


def images(media: bytes) -> list[np.ndarray]:
    """The pixel arrays (height, width, 4) of a run of WebP images."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(webp.decode(media[at:end]))
        at = end
    return out


def features(pixels: list[np.ndarray]) -> str:
    """Rows, and of each channel the sum, the least and the largest sample."""
    rows = sum(p.shape[0] for p in pixels)
    sums = sum(p.sum(axis=(0, 1), dtype=np.int64) for p in pixels)
    low = np.min([p.min(axis=(0, 1)) for p in pixels], axis=0)
    high = np.max([p.max(axis=(0, 1)) for p in pixels], axis=0)
    return f"{rows}x{ROW // 4};" + ";".join(f"{c}:{s},{a},{b}" for c, s, a, b in zip("rgba", sums.tolist(), low.tolist(), high.tolist(), strict=True))


_KINDS = {
    "n_bytes": (pa.int64(), T.LongType()),
    "payload_bytes": (pa.int64(), T.LongType()),
    "payload_sha256": (pa.string(), T.StringType()),
    "tail_crc32": (pa.int64(), T.LongType()),
    "media": (pa.binary(), T.BinaryType()),
    "media_bytes": (pa.int64(), T.LongType()),
    "media_sha256": (pa.string(), T.StringType()),
    "feature": (pa.string(), T.StringType()),
}


def through_webp(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None, outputs: tuple[str, ...] = ("media", "feature")) -> DataFrame:
    """Store every whole text as WebP, read it back, and give the named outputs.

    n_bytes is the unpadded size; payload_* and tail_crc32 (of the last 64 bytes) are of the payload read back; media is
    the stored form.
    """
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in outputs]
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(text_col)).cast("string").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {n: [] for n in outputs}
            for text in batch.column(batch.num_columns - 1):
                raw = (text.as_py() or "").encode()
                media = stored(padded(raw))
                pixels = images(media)
                back = b"".join(p.tobytes() for p in pixels)
                row = {
                    "n_bytes": len(raw),
                    "payload_bytes": len(back),
                    "payload_sha256": hashlib.sha256(back).hexdigest(),
                    "tail_crc32": zlib.crc32(back[-ROW:]),
                    "media": media,
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "feature": features(pixels),
                }
                for n in outputs:
                    made[n].append(row[n])
            arrays = [pa.array(made[n], type=_KINDS[n][0]) for n in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*(f.name for f in kept), *outputs])

    return source.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, _KINDS[n][1]) for n in outputs)]))


def read_pixels(df: DataFrame, media_col: str = "media", output: str = "pixels") -> DataFrame:
    """Decode a column of lossless WebP files (null: null) into (height, width, samples) with four bytes a pixel."""
    kept = [f for f in df.schema.fields if f.name != output]
    source = df.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(media_col)).alias("given"))
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("samples", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(batch.num_columns - 1):
                pixels = None if media.as_py() is None else webp.decode(media.as_py())
                rows.append(None if pixels is None else {"height": pixels.shape[0], "width": pixels.shape[1], "samples": pixels.tobytes()})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=[*(f.name for f in kept), output])

    struct_type = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("samples", T.BinaryType())])
    return source.mapInArrow(run, T.StructType([*kept, T.StructField(output, struct_type)]))
