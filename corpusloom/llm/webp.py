"""Lossless WebP (VP8L) in numpy: a full decoder, and an encoder for media columns.

Follows the public WebP Lossless Bitstream Specification. The decoder reads simple and normal prefix codes, several
groups of codes, back-references with the two-dimensional distance codes, the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms, in any order in which a file lists them.

Where one group of codes holds for the whole image, decoding is vectorised: the length of the pixel that would start at
*every* bit is looked up at once, the chain of pixels is then followed, and literal pixels are gathered together. Only
back-references and cache hits are copied one by one. Images with several groups are read pixel by pixel.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format ------------------------------------------------------------------------------------------

#: The order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _near_offsets() -> list[tuple[int, int]]:
    """(x, y) of distance codes 1 to 120: pixels to the left and above, by distance, as the format orders them."""
    found = [(x, y) for y in range(8) for x in range(-7, 9) if (y > 0 or x > 0) and not (y == 0 and x < 1)]
    # by squared distance; of equal ones the larger |y| for |x| >= |y| last, positive x before negative
    return sorted(found, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))[:120]


class WebpError(ValueError):
    """The bytes are not a lossless WebP image that the format allows."""


# Bits ----------------------------------------------------------------------------------------------------------------


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        byte, shift = divmod(self.at, 8)
        self.at += n
        if self.at > 8 * len(self.data):
            raise WebpError("the data end too soon")
        return int.from_bytes(self.data[byte : byte + (shift + n + 7) // 8], "little") >> shift & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        byte, shift = divmod(self.at, 8)
        return int.from_bytes(self.data[byte : byte + (shift + n + 7) // 8], "little") >> shift & ((1 << n) - 1)


class Code:
    """A canonical prefix code as a table from the next 15 bits to (symbol, length)."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise WebpError("a prefix code without symbols")
        self.largest = int(used[-1])
        self.single = int(used[0]) if len(used) == 1 else None
        if self.single is not None:
            self.width, self.symbols, self.lengths = 0, np.array([self.single], np.int32), np.array([0], np.int32)
            return
        widths = lengths[used]
        self.width = int(widths.max())
        if int(np.sum(1 << (self.width - widths))) != 1 << self.width:
            raise WebpError("a prefix code that isn't complete")
        order = used[np.argsort(widths, kind="stable")]
        table_symbols = np.repeat(order, 1 << (self.width - lengths[order]))
        table_lengths = np.repeat(lengths[order], 1 << (self.width - lengths[order]))
        turned = reversed_bits(np.arange(1 << self.width), self.width)
        self.symbols, self.lengths = table_symbols[turned].astype(np.int32), table_lengths[turned].astype(np.int32)

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        i = bits.peek(self.width)
        bits.at += int(self.lengths[i])
        if bits.at > 8 * len(bits.data):
            raise WebpError("the data end too soon")
        return int(self.symbols[i])


def _turned() -> np.ndarray:
    x = np.arange(1 << 15, dtype=np.int32)
    out = np.zeros_like(x)
    for k in range(15):
        out |= (x >> k & 1) << (14 - k)
    return out


_TURNED = _turned()


def reversed_bits(x: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """The low ``width`` (at most 15) bits of each value in reverse order."""
    return _TURNED[x] >> (15 - width)


def read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Code]:
    """The prefix codes of a group; one stored with the same bits as the one before it is read once."""
    out: list[Code] = []
    known = width = 0
    code = None
    for size in sizes:
        if code is None or bits.peek(width) != known or bits.at + width > 8 * len(bits.data):
            start = bits.at
            code, stopped = read_code(bits, size)
            width = bits.at - start
            bits.at = start
            known = bits.peek(width)
            bits.at = start + width
            out.append(code)
            if not stopped:
                code = None
        elif code.largest < size:
            bits.at += width
            out.append(code)
        else:
            raise WebpError("a symbol beyond its alphabet")
    return out


def read_code(bits: Bits, size: int) -> tuple[Code, bool]:
    """A prefix code, and whether its storage ended by its own count rather than by the alphabet's size."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise WebpError("a symbol beyond its alphabet")
        lengths[symbols] = 1
        return Code(lengths), True
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(own)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise WebpError("more code lengths than symbols")
    at, last = 0, 8
    while at < size and left:
        left -= 1
        length = code.read(bits)
        if length < 16:
            lengths[at] = length
            last = length or last
            at += 1
            continue
        value, extra, least = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[length - 16]
        times = least + bits.read(extra)
        if at + times > size:
            raise WebpError("more code lengths than symbols")
        lengths[at : at + times] = value
        at += times
    return Code(lengths), not left and at < size


# Entropy-coded images ------------------------------------------------------------------------------------------------


def extra_of(prefix: int) -> tuple[int, int]:
    """(base, number of extra bits) of a length or distance prefix code; the value is base + extra + 1."""
    if prefix < 4:
        return prefix, 0
    n = (prefix - 2) >> 1
    return (2 + (prefix & 1)) << n, n


_EXTRA = np.array([extra_of(p) for p in range(40)], np.int64)
NEAR = _near_offsets()


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def cache_slot(argb: int, bits: int) -> int:
    return (0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - bits)


def read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as a flat array of ARGB values (uint32)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("a colour cache that is too large")
    groups_of, group_bits, n_groups = None, 0, 1
    if top and bits.read(1):
        group_bits = bits.read(3) + 2
        groups_of = (read_image(bits, -(-width >> group_bits), -(-height >> group_bits), False) >> 8 & 0xFFFF).astype(np.int64)
        n_groups = int(groups_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [read_codes(bits, sizes) for _ in range(n_groups)]
    if groups_of is None:
        return one_group(bits, width, height, groups[0], cache_bits)
    return many_groups(bits, width, height, groups, groups_of, group_bits, cache_bits)


def many_groups(bits: Bits, width: int, height: int, groups: list[list[Code]], groups_of: np.ndarray, group_bits: int, cache_bits: int) -> np.ndarray:
    total = width * height
    out, cache = [0] * total, [0] * (1 << cache_bits)
    across = -(-width >> group_bits)
    at = cached = 0
    while at < total:
        y, x = divmod(at, width)
        green, red, blue, alpha, far = groups[groups_of[(y >> group_bits) * across + (x >> group_bits)]]
        s = green.read(bits)
        if s < 256:
            out[at] = red.read(bits) << 16 | s << 8 | blue.read(bits) | alpha.read(bits) << 24
            at += 1
        elif s < 280:
            base, n = extra_of(s - 256)
            length = base + bits.read(n) + 1
            base, n = extra_of(far.read(bits))
            distance = distance_of(base + bits.read(n) + 1, width)
            if distance > at or at + length > total:
                raise WebpError("a back-reference outside the image")
            for k in range(at, at + length):
                out[k] = out[k - distance]
            at += length
        else:
            while cached < at:
                cache[cache_slot(out[cached], cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def one_group(bits: Bits, width: int, height: int, codes: list[Code], cache_bits: int) -> np.ndarray:
    total = width * height
    green, red, blue, alpha, far = codes
    literal_only = bool((green.symbols < 256).all())
    size = 8 * len(bits.data) - bits.at
    padded = np.frombuffer(bits.data[bits.at // 8 :] + bytes(16), np.uint8)
    first = bits.at % 8
    span = min(size, total * (green.width + red.width + blue.width + alpha.width)) if literal_only else size
    # the 16 bits from every bit position on
    words = padded[:-2].astype(np.uint32) | padded[1:-1].astype(np.uint32) << 8 | padded[2:].astype(np.uint32) << 16
    if green.width + red.width + blue.width + alpha.width == 0:
        return np.full(total, alpha.single << 24 | red.single << 16 | green.single << 8 | blue.single, np.uint32)
    n_ahead = min(span + 64, 8 * len(words) - first)
    ahead = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0xFFFF)).astype(np.int32).reshape(-1)[first : first + n_ahead]

    def looked_up(code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = ahead[at] & ((1 << code.width) - 1)
        return code.symbols[i], code.lengths[i]

    every = np.arange(n_ahead)
    limit = n_ahead - 1
    after_code: dict[int, np.ndarray] = {}

    def after(code: Code) -> np.ndarray:
        """Where a symbol of the code that starts at each bit ends; codes with equal tables share the answer."""
        key = hash((code.width, code.lengths.tobytes()))
        if key not in after_code:
            after_code[key] = np.minimum(every + code.lengths[ahead & ((1 << code.width) - 1)], limit) if code.width else every
        return after_code[key]

    if green is red is blue is alpha:
        twice = after(green)[after(green)]
        end = twice[twice]
    else:
        end = after(alpha)[after(blue)[after(red)[after(green)]]]

    def pixels_at(chain: np.ndarray) -> np.ndarray:
        """The literal pixels that start at these bits."""
        at, samples = chain, []
        for code in (green, red, blue, alpha):
            samples.append(looked_up(code, at)[0])
            at = after(code)[at]
        return argb(samples[3], samples[1], samples[0], samples[2])

    if literal_only:
        chain, last = followed(end, total)
        last = int(end[last])
        if chain[-1] >= size or last > size:
            raise WebpError("the data end too soon")
        bits.at += last
        return pixels_at(chain)
    end = end[:span].copy()
    symbol, step = looked_up(green, every[:span])
    beyond = every[:span] + step
    other = symbol >= 256
    refs = np.flatnonzero(other & (symbol < 280))
    end[other] = np.minimum(beyond[other], limit)
    after_length = np.minimum(beyond[refs] + _EXTRA[symbol[refs] - 256, 1], limit)
    prefix, bits_read = looked_up(far, after_length)
    end[refs] = np.minimum(after_length + bits_read + _EXTRA[prefix, 1], limit)
    return with_references(bits, width, total, codes, cache_bits, symbol.tolist(), end.tolist(), pixels_at, looked_up, size)


def followed(jump: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """The first ``count`` places of the chain 0, jump[0], jump[jump[0]], ..., and its last: by strides of doubled jumps."""
    strides = [jump]
    while len(strides) < 5 and count >> len(strides) > 8:
        strides.append(strides[-1][strides[-1]])
    far, at = strides[-1], 0
    places = np.zeros(-(-count >> (len(strides) - 1)), np.int64)
    for k in range(len(places)):
        places[k] = at
        at = far[at]
    for step in reversed(strides[:-1]):
        places = np.stack([places, step[places]], axis=1).reshape(-1)
    places = places[:count]
    return places, int(places[-1])


def with_references(bits: Bits, width: int, total: int, codes: list[Code], cache_bits: int, symbol: list[int], jump: list[int], pixels_at, looked_up, size: int) -> np.ndarray:
    far = codes[4]
    origin = bits.at
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits)
    at = pixel = cached = 0
    run_at: list[int] = []

    def settle(upto: int) -> None:
        """Write the literals gathered so far; they end at pixel ``upto``."""
        if run_at:
            out[upto - len(run_at) : upto] = pixels_at(np.array(run_at))
            run_at.clear()

    while pixel < total:
        if at >= size:
            raise WebpError("the data end too soon")
        s = symbol[at]
        if s < 256:
            run_at.append(at)
            pixel += 1
        elif s < 280:
            settle(pixel)
            bits.at = origin + at + int(looked_up(codes[0], np.array([at]))[1][0])
            base, n = extra_of(s - 256)
            length = base + bits.read(n) + 1
            base, n = extra_of(far.read(bits))
            distance = distance_of(base + bits.read(n) + 1, width)
            if distance > pixel or pixel + length > total:
                raise WebpError("a back-reference outside the image")
            source = out[pixel - distance : pixel]
            out[pixel : pixel + length] = np.resize(source, length)
            pixel += length
        else:
            settle(pixel)
            for value in out[cached:pixel].tolist():
                cache[cache_slot(value, cache_bits)] = value
            cached = pixel
            out[pixel] = cache[s - 280]
            pixel += 1
        at = jump[at]
    settle(pixel)
    bits.at = origin + at
    if at > size:
        raise WebpError("the data end too soon")
    return out


def argb(a: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.asarray(a, np.uint32) << 24) | (np.asarray(r, np.uint32) << 16) | (np.asarray(g, np.uint32) << 8) | np.asarray(b, np.uint32)


# Transforms ----------------------------------------------------------------------------------------------------------


def channels(flat: np.ndarray) -> np.ndarray:
    """(pixels, 4): blue, green, red, alpha."""
    return flat.astype("<u4").view(np.uint8).reshape(-1, 4)


def from_channels(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c, np.uint8).view("<u4").reshape(-1)


def predicted(mode: int, left, top, top_left, top_right):
    """The predictor of one pixel (four channels each, int)."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode < 11:
        pairs = {6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}
        return half(*pairs[mode]) if mode in pairs else half(half(left, top_left), half(top, top_right))
    if mode == 11:
        guess = left + top - top_left
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + np.fix((mean - top_left) / 2).astype(np.int64), 0, 255)
    return np.array([0, 0, 0, 255])


def neighbours(image: np.ndarray, y: int, x: int, width: int):
    """Left, top, top-left and top-right of a pixel below the first row and right of the first column."""
    flat, at = image.reshape(-1, 4), y * width + x
    return flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1]


def undo_predictor(flat: np.ndarray, width: int, height: int, block_bits: int, modes: np.ndarray) -> np.ndarray:
    residual = channels(flat).astype(np.int64).reshape(height, width, 4)
    across = -(-width >> block_bits)
    first = residual[0].copy()
    first[0, 3] += 255
    out = residual
    out[0] = np.cumsum(first, axis=0) & 255
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        row = modes[(y >> block_bits) * across : (y >> block_bits) * across + across]
        for block in range(across):
            a, b = max(1, block << block_bits), min(width, (block + 1) << block_bits)
            mode = int(row[block])
            if a >= b:
                continue
            if mode == 1:
                out[y, a:b] = (np.cumsum(np.concatenate([out[y, a - 1 : a], out[y, a:b]]), axis=0)[1:]) & 255
            elif mode in (0, 14, 15):
                out[y, a:b] = (out[y, a:b] + predicted(0, None, None, None, None)) & 255
            elif mode in (2, 3, 4, 8, 9):
                above = out.reshape(-1, 4)
                start = (y - 1) * width
                t, tl, tr = (above[start + a + k : start + b + k] for k in (0, -1, 1))
                out[y, a:b] = (out[y, a:b] + predicted(mode, None, t, tl, tr)) & 255
            else:
                for x in range(a, b):
                    out[y, x] = (out[y, x] + predicted(mode, *neighbours(out, y, x, width))) & 255
    return from_channels(out.reshape(-1, 4))


def signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) ^ 128) - 128


def cross_colour(flat: np.ndarray, width: int, block_bits: int, data: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1, inverse) or take off (sign -1, forward) the colour shifts of each block."""
    c = channels(flat).copy()
    y, x = np.divmod(np.arange(len(flat)), width)
    m = channels(data)[(y >> block_bits) * -(-width >> block_bits) + (x >> block_bits)]
    green_to_red, green_to_blue, red_to_blue = signed(m[:, 0]), signed(m[:, 1]), signed(m[:, 2])
    green = signed(c[:, 1])
    new_red = (c[:, 2] + sign * (green_to_red * green >> 5)) & 255
    red = signed(new_red if sign > 0 else c[:, 2])
    new_blue = (c[:, 0] + sign * ((green_to_blue * green >> 5) + (red_to_blue * red >> 5))) & 255
    c[:, 2], c[:, 0] = new_red, new_blue
    return from_channels(c)


def green_shift(flat: np.ndarray, sign: int) -> np.ndarray:
    c = channels(flat).copy()
    c[:, 2] += c[:, 1] if sign > 0 else -c[:, 1]
    c[:, 0] += c[:, 1] if sign > 0 else -c[:, 1]
    return from_channels(c)


def palette_bits(colours: int) -> int:
    """Palette indices share a pixel: 8, 4, 2 or 1 of them by the number of colours; the binary logarithm."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(flat: np.ndarray, packed_width: int, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    bits = palette_bits(len(palette))
    index = (flat >> 8 & 255).astype(np.int64).reshape(height, packed_width)
    x = np.arange(width)
    each = 8 >> bits
    index = index[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each) & ((1 << each) - 1)
    return np.append(palette, np.zeros(256, np.uint32))[index.reshape(-1)]


# Files ---------------------------------------------------------------------------------------------------------------


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: a (height, width, 4) array of red, green, blue, alpha (uint8)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise WebpError("no lossless image")


def decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise WebpError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise WebpError("unknown version")
    undo, seen, packed = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform stands twice")
        seen.add(kind)
        if kind < 2:
            block_bits = bits.read(3) + 2
            extra = read_image(bits, -(-packed >> block_bits), -(-height >> block_bits), False)
            undo.append((kind, packed, block_bits, extra))
        elif kind == 2:
            undo.append((kind, packed, 0, None))
        else:
            colours = bits.read(8) + 1
            steps = channels(read_image(bits, colours, 1, False))
            palette = from_channels(np.cumsum(steps.astype(np.int64), axis=0) & 255)
            undo.append((kind, packed, 0, palette))
            packed = -(-packed >> palette_bits(colours))
    flat, now = read_image(bits, packed, height, True), packed
    for kind, before, block_bits, extra in reversed(undo):
        if kind == 0:
            flat = undo_predictor(flat, before, height, block_bits, extra >> 8 & 15)
        elif kind == 1:
            flat = cross_colour(flat, before, block_bits, extra, 1)
        elif kind == 2:
            flat = green_shift(flat, 1)
        else:
            flat = undo_palette(flat, now, before, height, extra)
            now = before
    out = channels(flat).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]
    if not has_alpha:
        out = out.copy()
        out[:, :, 3] = 255
    return out


# Encoder -------------------------------------------------------------------------------------------------------------


class Writer:
    """Collects (value, number of bits) and packs them lowest bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(np.array([value], np.int64))
        self.counts.append(np.array([n], np.int64))

    def put_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values.append(values)
        self.counts.append(counts)

    def bytes(self) -> bytes:
        values, counts = np.concatenate(self.values), np.concatenate(self.counts)
        start = np.cumsum(counts) - counts
        # what falls into each run of 32 bits is added up: the bits are disjoint, and floats hold 53 of them exactly
        runs = np.bincount(start >> 5, values << (start & 31)).astype(np.int64)
        words = np.append(runs & 0xFFFFFFFF, 0)
        words[1:] += runs >> 32
        return words.astype("<u4").tobytes()[: -(-int(start[-1] + counts[-1]) // 8)]


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths up to a limit; counts are flattened until the limit holds."""
    import heapq

    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 2:
        lengths[used] = 1
        return lengths
    weight = counts[used].astype(np.int64)
    while True:
        heap = [(int(w), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, n = {}, len(heap)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = n
            heapq.heapreplace(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        weight = (weight >> 1) + 1


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words, bits turned as the stream has them; a lone symbol's word is empty."""
    words = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return words
    order = used[np.argsort(lengths[used], kind="stable")]
    widths = lengths[order]
    top = int(widths.max())
    size = np.int64(1) << (top - widths)
    words[order] = (np.cumsum(size) - size) >> (top - widths)
    return reversed_bits(words, lengths)


def write_code(out: Writer, lengths: np.ndarray) -> np.ndarray:
    """Write a prefix code; returns the number of bits of each symbol's word."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return lengths if len(symbols) == 2 else np.zeros_like(lengths)
    out.put(0, 1)
    symbols, extras, n_extra = [], [], []
    at, end, stored = 0, int(used[-1]) + 1, lengths.tolist()
    while at < end:
        if stored[at]:
            symbols.append(stored[at])
            extras.append(0)
            n_extra.append(0)
            at += 1
            continue
        run = at
        while run < end and not stored[run] and run - at < 138:
            run += 1
        run -= at
        if run < 3:
            symbols += [0] * run
            extras += [0] * run
            n_extra += [0] * run
        else:
            symbols.append(17 if run < 11 else 18)
            extras.append(run - 3 if run < 11 else run - 11)
            n_extra.append(3 if run < 11 else 7)
        at += run
    symbols = np.array(symbols)
    own = code_lengths(np.bincount(symbols, minlength=19), 7)
    stored_own = [int(own[s]) for s in LENGTH_ORDER]
    count = max(4, max(k for k, x in enumerate(stored_own) if x) + 1)
    out.put(count - 4, 4)
    out.put_all(np.array(stored_own[:count]), np.full(count, 3))
    if end < len(lengths):
        out.put(1, 1)
        n = len(symbols) - 2
        half = max(1, -(-max(1, n.bit_length()) // 2))
        if n < 0:
            symbols, extras, n_extra, n, half = np.append(symbols, 0), [*extras, 0], [*n_extra, 0], 0, 1
            if not own[0]:
                raise WebpError("a code of one stored length")
        out.put(half - 1, 3)
        out.put(n, 2 * half)
    else:
        out.put(0, 1)
    words, widths = code_words(own), own if np.count_nonzero(own) > 1 else np.zeros(19, np.int64)
    out.put_all(words[symbols] | np.array(extras) << widths[symbols], widths[symbols] + np.array(n_extra))
    return lengths if len(used) > 1 else np.zeros_like(lengths)


def write_image(out: Writer, tokens: list[tuple] | None, flat: np.ndarray, cache_bits: int, top: bool, one_code: bool = False) -> None:
    """Write an image: literal pixels only, or (symbol, length, distance code) tokens, see ``references``."""
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    if tokens is None:
        c = channels(flat)
        samples = np.ascontiguousarray(c[:, [1, 2, 0, 3]])
        if one_code:
            lengths = code_lengths(np.bincount(samples.reshape(-1), minlength=256), 11)
            words = code_words(lengths)
            before = len(out.values)
            if lengths[-1]:
                widths = write_code(out, np.append(lengths, np.zeros(sizes[0] - 256, np.int64)))[:256]
                before = len(out.values)
                write_code(out, lengths)
                again = 2
            else:
                widths, again = write_code(out, lengths), 3
            out.values += again * out.values[before:]
            out.counts += again * out.counts[before:]
            write_code(out, np.zeros(40, np.int64))
            out.put_all(words[samples.reshape(-1)], widths[samples.reshape(-1)])
            return
        codes = []
        for k, n in enumerate(sizes[:4]):
            lengths = code_lengths(np.bincount(samples[:, k], minlength=n))
            codes.append((code_words(lengths), write_code(out, lengths)))
        write_code(out, np.zeros(40, np.int64))
        values = np.stack([w[samples[:, k]] for k, (w, _) in enumerate(codes)], axis=1)
        counts = np.stack([n[samples[:, k]] for k, (_, n) in enumerate(codes)], axis=1)
        out.put_all(values.reshape(-1), counts.reshape(-1))
        return
    greens = np.bincount([t[0] if t[0] < 256 or len(t) == 1 else 256 + prefix_of(t[1])[0] for t in tokens], minlength=sizes[0])
    raw = [np.zeros(n, np.int64) for n in sizes]
    raw[0] = greens
    for t in tokens:
        if len(t) == 4:
            raw[1][t[1]] += 1
            raw[2][t[2]] += 1
            raw[3][t[3]] += 1
        elif len(t) == 3:
            raw[4][prefix_of(t[2])[0]] += 1
    codes = []
    for counts in raw:
        lengths = code_lengths(counts)
        codes.append((code_words(lengths), write_code(out, lengths)))

    words = [w.tolist() for w, _ in codes]
    widths = [n.tolist() for _, n in codes]
    values: list[int] = []
    counts: list[int] = []

    def word(k: int, s: int) -> None:
        values.append(words[k][s])
        counts.append(widths[k][s])

    for t in tokens:
        if len(t) == 4:
            for k in range(4):
                word(k, t[k])
        elif len(t) == 3:
            for k, value in ((0, t[1]), (4, t[2])):
                p, extra, n = prefix_of(value)
                word(k, 256 + p if k == 0 else p)
                values.append(extra)
                counts.append(n)
        else:
            word(0, t[0])
    out.put_all(np.array(values, np.int64), np.array(counts, np.int64))


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix code, extra value, extra bits) of a length or distance code of 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def references(flat: np.ndarray, width: int, cache_bits: int) -> list[tuple]:
    """Tokens of an image: (g, r, b, a) literals, (256, length, distance code) copies, (280 + slot,) cache hits."""
    values = flat.tolist()
    seen: dict[tuple, int] = {}
    cache: list[int | None] = [None] * (1 << cache_bits)
    near = {distance_of(k, width): k for k in range(120, 0, -1)}
    tokens, at = [], 0

    def passed(a: int, b: int) -> None:
        for k in range(a, b):
            if cache_bits:
                cache[cache_slot(values[k], cache_bits)] = values[k]
            if k + 3 <= len(values):
                seen[tuple(values[k : k + 3])] = k

    while at < len(values):
        back = seen.get(tuple(values[at : at + 3])) if at + 3 <= len(values) else None
        if back is not None:
            length = 3
            while length < 4096 and at + length < len(values) and values[back + length] == values[at + length]:
                length += 1
            distance = at - back
            tokens.append((256, length, near.get(distance, distance + 120)))
        else:
            length, v = 1, values[at]
            if cache_bits and cache[cache_slot(v, cache_bits)] == v:
                tokens.append((280 + cache_slot(v, cache_bits),))
            else:
                tokens.append((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
        passed(at, at + length)
        at += length
    return tokens


def encode(pixels: np.ndarray, palette: bool = False, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, cache_bits: int = 0, copies: bool = False, block_bits: int = 3, one_code: bool = False) -> bytes:
    """A lossless WebP file of (height, width, 4) red, green, blue, alpha samples.

    The transforms are applied in the order palette, predictor, cross-colour (green to red, green to blue, red to blue),
    subtract green. The plain form, prefix codes over literal pixels alone, is vectorised; ``one_code`` gives its four
    channels the same prefix code, as suits samples that are text.
    """
    height, width = pixels.shape[:2]
    if not (0 < width <= 1 << 14 and 0 < height <= 1 << 14):
        raise WebpError("an image has 1 to 16384 rows and columns")
    flat = from_channels(np.ascontiguousarray(pixels[:, :, [2, 1, 0, 3]]).reshape(-1, 4))
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    packed = width
    if palette:
        colours, index = np.unique(flat, return_inverse=True)
        if len(colours) > 256:
            raise WebpError("a palette holds 256 colours")
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(colours) - 1, 8)
        steps = channels(colours).astype(np.int64)
        steps[1:] -= steps[:-1].copy()
        write_image(out, None, from_channels(steps & 255), 0, False)
        bits = palette_bits(len(colours))
        each = 8 >> bits
        packed = -(-width >> bits)
        grid = np.zeros((height, packed << bits), np.int64)
        grid[:, :width] = index.reshape(height, width)
        grid = grid.reshape(height, packed, 1 << bits) << (np.arange(1 << bits) * each)
        flat = (grid.sum(axis=2).reshape(-1).astype(np.uint32) << 8) | np.uint32(0xFF000000)
    blocks = -(-packed >> block_bits) * -(-height >> block_bits)
    if predictor is not None:
        out.put(1, 1)
        out.put(0, 2)
        out.put(block_bits - 2, 3)
        write_image(out, None, np.full(blocks, 0xFF000000 | predictor << 8, np.uint32), 0, False)
        image = channels(flat).astype(np.int64).reshape(height, packed, 4)
        rest = image.copy()
        if predictor in (1, 2):
            rest[0] -= np.concatenate([[[0, 0, 0, 255]], image[0, :-1]])
            rest[1:, 0] -= image[:-1, 0]
            rest[1:, 1:] -= image[1:, :-1] if predictor == 1 else image[:-1, 1:]
            rest &= 255
        for y in range(height if predictor not in (1, 2) else 0):
            for x in range(packed):
                if y == 0:
                    guess = np.array([0, 0, 0, 255]) if x == 0 else image[0, x - 1]
                else:
                    guess = image[y - 1, 0] if x == 0 else predicted(predictor, *neighbours(image, y, x, packed))
                rest[y, x] = (image[y, x] - guess) & 255
        flat = from_channels(rest.reshape(-1, 4))
    if cross is not None:
        out.put(1, 1)
        out.put(1, 2)
        out.put(block_bits - 2, 3)
        g2r, g2b, r2b = (v & 255 for v in cross)
        data = np.full(blocks, 0xFF000000 | r2b << 16 | g2b << 8 | g2r, np.uint32)
        write_image(out, None, data, 0, False)
        flat = cross_colour(flat, packed, block_bits, data, -1)
    if subtract_green:
        out.put(1, 1)
        out.put(2, 2)
        flat = green_shift(flat, -1)
    out.put(0, 1)
    write_image(out, references(flat, packed, cache_bits) if copies or cache_bits else None, flat, cache_bits, True, one_code)
    stream = out.bytes()
    size = len(stream)
    return b"RIFF" + struct.pack("<I", 12 + size + (size & 1)) + b"WEBPVP8L" + struct.pack("<I", size) + stream + bytes(size & 1)
