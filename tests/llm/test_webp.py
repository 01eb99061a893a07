"""Lossless WebP: hand-made bits, and round trips through every feature of the format."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from corpusloom.llm import media, webp


def picture(height, width, colours=None, seed=1):
    rng = np.random.RandomState(seed)
    if colours:
        table = rng.randint(0, 256, (colours, 4)).astype(np.uint8)
        return table[rng.randint(0, colours, (height, width))]
    y, x = np.mgrid[:height, :width]
    base = np.stack([x * 3 + y, x + y * 2, x * y, 255 - x], axis=2) + rng.randint(0, 4, (height, width, 4))
    return (base & 255).astype(np.uint8)


def same(pixels, **how):
    assert np.array_equal(webp.decode(webp.encode(pixels, **how)), pixels)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 1), (9, 16), (23, 31)])
def test_plain(shape):
    same(picture(*shape))
    same(picture(*shape), one_code=True)
    same(np.full((*shape, 4), 7, np.uint8))
    same(np.full((*shape, 4), 7, np.uint8), one_code=True)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    same(picture(13, 19), predictor=mode)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    same(picture(11, 21, colours), palette=True)
    same(picture(11, 21, colours), palette=True, copies=True, predictor=4, subtract_green=True)


@pytest.mark.parametrize("cache_bits,copies", itertools.product([0, 1, 5, 11], [False, True]))
def test_references_and_cache(cache_bits, copies):
    for pixels in (picture(20, 24, 6), np.tile(picture(3, 5), (8, 5, 1)), picture(4, 4), np.full((6, 6, 4), 9, np.uint8)):
        same(pixels, cache_bits=cache_bits, copies=copies)
        same(pixels, cache_bits=cache_bits, copies=copies, predictor=11, cross=(-30, 55, 127), subtract_green=True)


@pytest.mark.parametrize("cross", [(0, 0, 0), (127, -128, 64), (-1, 1, -77)])
def test_cross_colour(cross):
    same(picture(17, 18), cross=cross)
    same(picture(17, 18), cross=cross, subtract_green=True, block_bits=2)


def test_neighbour_codes_start_as_the_format_says():
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)] and len(webp.NEAR) == 120


def stream(put):
    out = webp.Writer()
    for value, n in ((0x2F, 8), put.size[0], put.size[1], (1, 1), (0, 3)):
        out.put(value, n)
    put(out)
    raw = out.bytes()
    return webp.decode_stream(raw)


def one_symbol(out, s):
    for value, n in ((1, 1), (0, 1), (1, 1), (s, 8)):
        out.put(value, n)


def test_hand_made_stream_of_one_colour():
    def put(out):
        for value in (0, 0, 0):  # no transform, cache or groups
            out.put(value, 1)
        for s in (200, 10, 30, 255, 0):
            one_symbol(out, s)

    put.size = ((4, 14), (2, 14))
    pixels = stream(put)
    assert pixels.shape == (3, 5, 4) and (pixels == [10, 200, 30, 255]).all()


def test_hand_made_stream_of_two_groups():
    """Left half and right half have prefix codes of their own (blocks of four columns)."""

    def put(out):
        out.put(0, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(0, 3)
        out.put(0, 1)  # the group image: two pixels, green 0 and 1
        for value, n in ((1, 1), (1, 1), (1, 1), (0, 8), (1, 8)):
            out.put(value, n)
        for s in (0, 0, 0, 0):
            one_symbol(out, s)
        out.put(0, 1)
        out.put(1, 1)
        for base in (0, 100):
            for value, n in ((1, 1), (1, 1), (1, 1), (base + 1, 8), (base + 2, 8)):
                out.put(value, n)
            for s in (base + 3, base + 4, 255, 0):
                one_symbol(out, s)
        for bit in (0, 1, 0, 1, 1, 1, 0, 0):
            out.put(bit, 1)

    put.size = ((7, 14), (0, 14))
    assert stream(put)[0, :, 1].tolist() == [1, 2, 1, 2, 102, 102, 101, 101]
    assert stream(put)[0, :, 0].tolist() == [3] * 4 + [103] * 4


@pytest.mark.parametrize("cut", [3, 20, 40, -4])
def test_broken_files_are_errors(cut):
    whole = webp.encode(picture(9, 9), cache_bits=3, copies=True)
    with pytest.raises(webp.WebpError):
        webp.decode(whole[:cut])


def test_media_columns(spark):
    texts = [None, "", "a", "é" * 31 + "xy", "z" * 64, "w" * 65, "lorem ipsum " * 400, "日本語" * 200_000]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    outputs = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "media_bytes", "media_sha256", "feature")
    got = {r.doc_id: r for r in media.through_webp(df, outputs=outputs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
        assert got[i].media_sha256 == hashlib.sha256(bytes(got[i].media)).hexdigest()
        assert got[i].feature.startswith(f"{len(payload) // 64}x16;r:")
    assert media.through_webp(df.limit(0)).count() == 0
    pixels = media.read_pixels(media.through_webp(df.where("doc_id = 3"), outputs=("media",))).collect()[0].pixels
    assert bytes(pixels.samples) == ("é" * 31 + "xy").encode() and (pixels.height, pixels.width) == (1, 16)
