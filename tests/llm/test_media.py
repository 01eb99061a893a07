"""The forms in which texts are stored as images."""

from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import media, webp


def shown(payload):
    return np.frombuffer(media.padded(payload), np.uint8).reshape(-1, media.ROW // 4, 4)


@pytest.mark.parametrize("form", media.FORMS)
@pytest.mark.parametrize("raw", [b"", b"abcd" * 40, "Some text, é and ü, over a few rows. ".encode() * 9, bytes(range(256)) * 3], ids=["zero", "repeat", "text", "bytes"])
def test_every_form_gives_the_pixels_back(form, raw):
    pixels = shown(raw)
    if form == "palette" and len(np.unique(np.ascontiguousarray(pixels).view("<u4"))) > 256:
        pytest.skip("too many colours")
    assert (webp.decode(webp.encode(pixels, **media.FORMS[form])) == pixels).all()


def test_likely_forms():
    rng = np.random.RandomState(1)
    line = rng.randint(0, 256, 64)
    above = np.concatenate([(line + k // 9) % 256 for k in range(40)]).astype(np.uint8).tobytes()
    grey = np.repeat(rng.randint(0, 256, 640), 4).astype(np.uint8).reshape(-1, 4)
    grey[:, 3] = 255
    steps = np.cumsum(rng.randint(0, 3, (40, 16, 4)), axis=1).astype(np.uint8)
    steps += rng.randint(0, 256, (40, 1, 4)).astype(np.uint8)
    few = rng.randint(0, 256, (12, 4)).astype(np.uint8)[rng.randint(0, 12, 512)]
    found = {name: media.likely_form(shown(raw)) for name, raw in (("above", above), ("green", grey.tobytes()), ("left", steps.tobytes()), ("palette", few.tobytes()), ("references", b"a line that comes again and again. " * 40), ("plain", b"".join(bytes([97 + rng.randint(26)]) for _ in range(4000))))}
    assert found["above"] in ("above", "references") and {k: v for k, v in found.items() if k != "above"} == {k: k for k in found if k != "above"}
    for raw in (above, grey.tobytes(), steps.tobytes(), few.tobytes()):
        payload = media.padded(raw)
        kept = media.stored(payload)
        assert b"".join(p.tobytes() for p in media.images(kept)) == payload
        assert len(kept) < len(webp.encode(shown(raw), one_code=True))


def test_forms_that_given_documents_take(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    used = Counter()
    for text in texts:
        pixels = shown((text or "").encode())
        form = media.likely_form(pixels)
        kept, plain = media.encoded(pixels), webp.encode(pixels, one_code=True)
        used[form if len(kept) < len(plain) else "plain"] += 1
        assert len(kept) <= len(plain)
    assert used["references"] > 0 and used["plain"] > 0
