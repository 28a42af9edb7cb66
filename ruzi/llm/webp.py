"""Lossless WebP in numpy: a decoder for the whole bit stream and an encoder for it.

The decoder reads prefix codes, back-references and the colour cache, with or
without an image of code groups, and inverts the predictor, cross-colour,
subtract-green and palette transforms.  Runs of literals are decoded for all bit
positions at once: the step from every position to that of the next pixel is
looked up as a vector, composed to steps of eight pixels, and only every eighth
position is followed one by one.

Pixels are unsigned 32-bit numbers, alpha in the highest byte, then red, green
and blue.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Offsets (x, y) that the distance codes 1 to 120 stand for.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_MULTIPLIER = np.uint32(0x1E35A7BD)
OPAQUE_BLACK = 0xFF000000
LONGEST_CODE, LONGEST_RUN, LARGEST_SIDE = 15, 4096, 16384
#: Bits of the largest block of a transform.
LARGEST_BLOCK = 9
#: How far back the encoder refers; the extra bits of what is nearer fit the writer's numbers.
FARTHEST = (1 << 16) - 1

#: Bits looked at together when literals are decoded.
SPAN = 1 << 17


def blocks_over(size: int, bits: int) -> int:
    """Blocks of 1 << bits that cover ``size``."""
    return (size + (1 << bits) - 1) >> bits


# Reading


class Bits:
    """Reads numbers from the lowest bit on."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(40), 0
        raw = np.frombuffer(self.data, np.uint8).astype(np.uint32)
        self.words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        self.end = 8 * len(data)

    def read(self, count: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << count) - 1)
        self.at += count
        if self.at > self.end + 64:
            raise ValueError("the bit stream ends too early")
        return value

    def windows(self, start: int, count: int) -> np.ndarray:
        """The next 15 bits from each of ``count`` positions on."""
        first = start >> 3
        words = self.words[first : (start + count + 7 >> 3) + 1]
        every = (words[:, None] >> np.arange(8, dtype=np.uint32)) & 0x7FFF
        every = every.ravel()[start & 7 :]
        return every[:count]


class Code:
    """A prefix code as a table over its longest code's bits: symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        if self.single is not None:
            self.width, self.symbols, self.steps = 0, np.array([self.single]), np.zeros(1, np.int64)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        length = lengths[order].astype(np.int64)
        self.width = int(length[-1])
        span = 1 << (self.width - length)
        if span.sum() != 1 << self.width:
            raise ValueError("a prefix code isn't complete")
        # In order of the code's first bit the codes fill the table one after another; the stream has that bit lowest.
        turned = TURNED[: 1 << self.width] >> (LONGEST_CODE - self.width)
        self.symbols = np.repeat(order, span)[turned]
        self.steps = np.repeat(length, span)[turned]

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        at = bits.at
        word = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << self.width) - 1)
        bits.at = at + int(self.steps[word])
        return int(self.symbols[word])


def _turned() -> np.ndarray:
    """Each number of LONGEST_CODE bits the other way round."""
    values = np.arange(1 << LONGEST_CODE)
    return sum((values >> i & 1) << (LONGEST_CODE - 1 - i) for i in range(LONGEST_CODE))


TURNED = _turned()


def reversed_bits(values: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Each value's lowest ``width`` bits the other way round."""
    return TURNED[values] >> (LONGEST_CODE - widths)


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        token = code.read(bits)
        if token < 16:
            lengths[at] = token
            at, before = at + 1, token or before
        else:
            times = 3 + bits.read(2) if token == 16 else 3 + bits.read(3) if token == 17 else 11 + bits.read(7)
            lengths[at : at + times] = before if token == 16 else 0
            at += times
    return Code(lengths)


def prefix_value(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def cache_slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (pixels.astype(np.uint32) * CACHE_MULTIPLIER) >> np.uint32(32 - cache_bits)


class Literals:
    """Decodes runs of literals; what it looked up for a span of bits serves all runs that begin in it."""

    def __init__(self, bits: Bits, codes: list[Code]):
        self.bits, self.codes, self.begin, self.size = bits, codes[:4], 0, 0

    def look(self) -> None:
        """Steps from each bit position of the span to the next pixel; none from what isn't a literal or ends beyond."""
        bits, (green, *others) = self.bits, self.codes
        self.begin, self.size = bits.at, min(SPAN, bits.end + 256 - bits.at)
        self.windows = bits.windows(bits.at, self.size)
        here = np.arange(self.size)
        word = (self.windows & ((1 << green.width) - 1)).astype(np.intp)
        after = here + green.steps.take(word)
        for code in others:
            if code.width:
                after += code.steps[self.windows[np.minimum(after, self.size - 1)] & ((1 << code.width) - 1)]
        self.one = np.where((green.symbols.take(word) < LITERALS) & (after < self.size - 64), after, here)
        self.two = self.one.take(self.one)
        self.four = self.two.take(self.two)
        self.eight = memoryview(self.four.take(self.four))

    def run(self, most: int) -> np.ndarray:
        """Pixels of the literals from here on, at most ``most``, as far as they reach before another kind of symbol."""
        bits = self.bits
        if most < 8 or bits.at >= bits.end:
            return np.zeros(0, np.uint32)
        if not self.begin <= bits.at < self.begin + self.size - 256:
            self.look()
        look, at, follow = self.eight, bits.at - self.begin, []
        for _ in range(-(-most // 8)):
            follow.append(at)
            to = look[at]
            if to == at:
                break
            at = to
        places = np.array(follow)
        for step in (self.four, self.two, self.one):
            places = np.stack([places, step.take(places)], axis=-1).ravel()
        still = np.flatnonzero(self.one.take(places) == places)
        spot = places[: min(most, int(still[0]) if len(still) else len(places))]
        if not len(spot):
            return np.zeros(0, np.uint32)
        bits.at = self.begin + int(self.one[spot[-1]])
        pixels, same = np.zeros(len(spot), np.int64), 0
        for code, shift in zip(self.codes, (8, 16, 0, 24)):
            if code.single is not None:
                same |= code.single << shift
                continue
            word = self.windows.take(spot) & ((1 << code.width) - 1)
            pixels |= code.symbols.take(word) << shift
            spot = spot + code.steps.take(word)
        return (pixels | same).astype(np.uint32)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; only the main one may have an image of code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups = None
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        group_image = read_pixels(bits, blocks_over(width, group_bits), blocks_over(height, group_bits), False)
        groups = (group_image >> 8 & 0xFFFF).astype(np.int64).reshape(blocks_over(height, group_bits), -1)
    count = int(groups.max()) + 1 if groups is not None else 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [[read_code(bits, size) for size in sizes] for _ in range(count)]
    total = width * height
    out = np.zeros(total, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32)
    at = cached = 0
    literals = Literals(bits, codes[0]) if groups is None else None
    while at < total:
        if literals is not None:
            group = codes[0]
            run = literals.run(total - at)
            out[at : at + len(run)] = run
            at += len(run)
            if at == total:
                break
        else:
            group = codes[groups[at // width >> group_bits, at % width >> group_bits]]
        symbol = group[0].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = (code.read(bits) for code in group[1:4])
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < LITERALS + LENGTHS:
            length = prefix_value(symbol - LITERALS, bits)
            distance = distance_of(prefix_value(group[4].read(bits), bits), width)
            if distance > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            out[at : at + length] = np.resize(out[at - distance : at], length) if distance < length else out[at - distance : at - distance + length]
            at += length
        else:
            fresh = out[cached:at]
            cache[cache_slots(fresh, cache_bits)] = fresh  # of equal slots the last stays
            cached = at
            out[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
    return out


# Inverse transforms; channels are arrays (rows, columns, 4) of alpha, red, green, blue.


def channels_of(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(">u4").view(np.uint8).reshape(*pixels.shape, 4)


def pixels_of(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view(">u4")[..., 0].astype(np.uint32)


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """What a mode predicts from the pixels to the left, above, above left and above right (signed arrays, channels last)."""
    if mode == 11:
        guess = left + top - corner
        nearer = np.abs(guess - left).sum(-1, keepdims=True) < np.abs(guess - top).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    simple = {
        1: lambda: left,
        2: lambda: top,
        3: lambda: beyond,
        4: lambda: corner,
        5: lambda: average(average(left, beyond), top),
        6: lambda: average(left, corner),
        7: lambda: average(left, top),
        8: lambda: average(corner, top),
        9: lambda: average(top, beyond),
        10: lambda: average(average(left, corner), average(top, beyond)),
        12: lambda: np.clip(left + top - corner, 0, 255),
        13: lambda: np.clip((half := average(left, top)) + np.sign(half - corner) * (np.abs(half - corner) >> 1), 0, 255),
    }
    return simple[mode]() if mode in simple else channels_of(np.array([OPAQUE_BLACK], np.uint32)).astype(np.int64)[0]


def neighbours(image: np.ndarray, y: int, x: int) -> tuple[np.ndarray, ...]:
    beyond = image[y - 1, x + 1] if x + 1 < image.shape[1] else image[y, 0]
    return image[y, x - 1], image[y - 1, x], image[y - 1, x - 1], beyond


def undo_predictor(rest: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    out = rest.astype(np.int64)
    out[0, 0] += channels_of(np.array([OPAQUE_BLACK], np.uint32))[0]
    out[0] = out[0].cumsum(axis=0) & 255
    above_only, left_only = np.isin(modes, (0, 2, 3, 4, 8, 9)), modes == 1
    for y in range(1, out.shape[0]):
        row = modes[y >> bits]
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        if left_only[y >> bits].all():
            out[y] = out[y].cumsum(axis=0) & 255
        elif above_only[y >> bits].all():
            # The pixel above and to the right of the last one is the first of this row.
            before, width = out[y - 1], out.shape[1]
            beyond = np.concatenate([before[2:], out[y, :1]]) if width > 1 else before[:0]
            mode = np.repeat(row, 1 << bits)[1:width]
            for kind in np.unique(mode):
                here = np.flatnonzero(mode == kind)
                guess = predicted(int(kind), before[here], before[1:][here], before[:-1][here], beyond[here])
                out[y, 1:][here] = (out[y, 1:][here] + guess) & 255
        else:
            for x in range(1, out.shape[1]):
                out[y, x] = (out[y, x] + predicted(int(row[x >> bits]), *neighbours(out, y, x))) & 255
    return out.astype(np.uint8)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint8).view(np.int8).astype(np.int64)


def colour_shift(factor: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (signed(factor) * signed(value)) >> 5


def spread(blocks: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """Each block's element at each of its pixels."""
    return blocks[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def cross_colour(image: np.ndarray, factors: np.ndarray, sign: int) -> np.ndarray:
    """Take away (-1) or give back (1) what green says of red and blue, and red of blue."""
    out = image.copy()
    red_to_blue, green_to_blue, green_to_red = factors[..., 1], factors[..., 2], factors[..., 3]
    green, red = image[..., 2], image[..., 1]
    out[..., 1] = (red + sign * colour_shift(green_to_red, green)) & 255
    true_red = out[..., 1] if sign > 0 else red
    out[..., 3] = (image[..., 3] + sign * (colour_shift(green_to_blue, green) + colour_shift(red_to_blue, true_red))) & 255
    return out


def unbundle(pixels: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Colours of the indices in the green channel, of which 1 << bits share a pixel."""
    index = (pixels >> 8 & 255).astype(np.int64)
    if bits:
        each = 8 >> bits
        shifts = np.arange(1 << bits) * each
        index = (index[:, :, None] >> shifts & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    padded = np.zeros(256, np.uint32)
    padded[: len(palette)] = palette
    return padded[index]


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels (rows, columns) of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            blocks = read_pixels(bits, blocks_over(inner, size), blocks_over(height, size), False).reshape(blocks_over(height, size), -1)
            undo.append((kind, inner, size, blocks))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            steps = channels_of(read_pixels(bits, colours, 1, False))
            palette = pixels_of(steps.astype(np.int64).cumsum(axis=0) & 255)
            undo.append((kind, inner, bundle_bits(colours), palette))
            inner = blocks_over(inner, bundle_bits(colours))
        else:
            undo.append((kind, inner, 0, None))
    pixels = read_pixels(bits, inner, height, True).reshape(height, inner)
    for kind, columns, size, detail in reversed(undo):
        if kind == PALETTE:
            pixels = unbundle(pixels, detail, size, columns)
        elif kind == PREDICTOR:
            pixels = pixels_of(undo_predictor(channels_of(pixels), (detail >> 8 & 15).astype(np.int64), size))
        elif kind == CROSS_COLOUR:
            image = channels_of(pixels).astype(np.int64)
            pixels = pixels_of(cross_colour(image, spread(channels_of(detail), size, height, columns), 1))
        else:
            both = (pixels & 0xFF00FF) + (pixels >> 8 & 255) * np.uint32(0x10001)
            pixels = pixels & 0xFF00FF00 | both & 0xFF00FF
    return pixels


# Writing


class Writer:
    """Collects numbers of at most 16 bits with their bit counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.counts: list[int] = []

    def put(self, value: int, count: int) -> None:
        self.values.append(value)
        self.counts.append(count)

    def put_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.parts += [(np.array(self.values, "<u2"), np.array(self.counts, np.uint8)), (values.astype("<u2"), counts.astype(np.uint8))]
        self.values, self.counts = [], []

    def data(self) -> bytes:
        """All numbers one after another: two by two, each pair added to the bytes that it reaches into."""
        self.put_all(np.zeros(0), np.zeros(0, np.int64))
        values = np.concatenate([part for part, _ in self.parts]).astype(np.int64)
        counts = np.concatenate([part for _, part in self.parts]).astype(np.int64)
        if len(values) & 1:
            values, counts = np.append(values, 0), np.append(counts, 0)
        values, counts = values[::2] | values[1::2] << counts[::2], counts[::2] + counts[1::2]
        ends = np.cumsum(counts)
        begins = ends - counts
        first, size = begins >> 3, int(ends[-1] + 7 >> 3)
        values <<= begins & 7
        out = np.zeros(size + 5)
        for i in range(5):
            out += np.bincount(first + i, values >> 8 * i & 255, size + 5)
        return out[:size].astype(np.uint8).tobytes()


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a prefix code for the counts; rarer symbols count for more until no code is too long."""
    used = np.flatnonzero(counts).tolist()
    lengths, weights = np.zeros(len(counts), np.int64), counts[used].tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        heap = [(weight, i) for i, weight in enumerate(weights)]
        heapq.heapify(heap)
        above: dict[int, int] = {}
        fresh = len(used)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            above[i] = above[j] = fresh
            heapq.heappush(heap, (a + b, fresh))
            fresh += 1
        depth = {fresh - 1: 0}
        for node in range(fresh - 2, -1, -1):
            depth[node] = depth[above[node]] + 1
        found = [depth[i] for i in range(len(used))]
        if max(found) <= longest:
            lengths[used] = found
            return lengths
        weights = [weight // 2 + 1 for weight in weights]


def codes_for(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes, first bit lowest, as the stream has them."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    length = lengths[order]
    top = int(length[-1])
    before = np.concatenate([[0], np.cumsum(1 << (top - length))[:-1]])
    out[order] = reversed_bits(before >> (top - length), length)
    return out


def put_code(out: Writer, counts: np.ndarray, longest: int = LONGEST_CODE) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for the counts; return codes and lengths by symbol."""
    used = np.flatnonzero(counts).tolist() or [0]
    if len(used) == 1 and used[0] < 256:
        for value, count in ((1, 1), (0, 1), (1, 1), (used[0], 8)):
            out.put(value, count)
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts, longest)
    if len(used) == 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(1, 1)
        out.put(1, 1)
        for symbol in used:
            out.put(symbol, 8)
        return codes_for(lengths), lengths
    out.put(0, 1)
    tokens = []  # token, extra bits, their count
    zeros = 0
    for length in [*lengths.tolist(), -1]:
        if length == 0:
            zeros += 1
            continue
        while zeros:
            times = min(zeros, 138)
            if times < 3:
                tokens += [(0, 0, 0)] * times
            else:
                tokens.append((17, times - 3, 3) if times < 11 else (18, times - 11, 7))
            zeros -= times
        tokens.append((length, 0, 0))
    tokens.pop()
    token_lengths = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    last = max(i for i, symbol in enumerate(CODE_LENGTH_ORDER) if token_lengths[symbol])
    out.put(max(last - 3, 0), 4)
    for symbol in CODE_LENGTH_ORDER[: max(last + 1, 4)]:
        out.put(int(token_lengths[symbol]), 3)
    out.put(0, 1)
    codes, alone = codes_for(token_lengths).tolist(), np.count_nonzero(token_lengths) == 1
    for token, extra, count in tokens:
        if not alone:
            out.put(codes[token], int(token_lengths[token]))
        if count:
            out.put(extra, count)
    single = len(used) == 1
    return codes_for(lengths), np.zeros_like(lengths) if single else lengths


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their count for lengths or distance codes."""
    less = values.astype(np.int64) - 1
    high = np.frexp(np.maximum(less, 1).astype(float))[1] - 1
    second = less >> np.maximum(high - 1, 0) & 1
    small = less < 4
    extra = np.where(small, 0, high - 1)
    return np.where(small, less, 2 * high + second), np.where(small, 0, less & ((1 << extra) - 1)), extra


def runs_of(pixels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of what repeats the pixel before it, ``least`` times or more, cut to the longest run."""
    edges = np.flatnonzero(np.concatenate([[True], pixels[1:] != pixels[:-1], [True]]))
    starts, lengths = edges[:-1] + 1, np.diff(edges) - 1
    long = lengths >= least
    starts, lengths = starts[long], lengths[long]
    pieces = -(-lengths // LONGEST_RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + nth * LONGEST_RUN
    return starts, np.minimum(LONGEST_RUN, np.repeat(lengths, pieces) - nth * LONGEST_RUN)


def copies_of(samples: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of what was there before, ``least`` samples or more, none overlapping.

    Every position looks back to the last one with the same eight samples; positions in a row that look back as far are one copy.
    """
    none = np.zeros(0, np.int64)
    count = len(samples) - 7
    if count < 2:
        return none, none, none
    raw = samples.tobytes()
    words = np.empty(count, np.uint64)
    for i in range(min(8, count)):
        words[i::8] = np.frombuffer(raw, "<u8", (count - i + 7) // 8, i)
    keys = np.sort(((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) << np.uint64(32)) | np.arange(count, dtype=np.uint64))
    place, top = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), keys >> np.uint64(32)
    later, earlier = place[1:], place[:-1]
    same = (top[1:] == top[:-1]) & (words[later] == words[earlier])
    back = np.zeros(count + 1, np.int64)
    back[later[same]] = later[same] - earlier[same]
    back[back > FARTHEST] = 0
    edges = np.flatnonzero(np.diff(back, prepend=0))
    ends = np.append(edges[1:], count)
    far = back[edges]
    long = (far > 0) & (ends - edges + 7 >= least)
    out, until = [], 0
    for start, end, distance in zip(edges[long].tolist(), (ends[long] + 7).tolist(), far[long].tolist()):
        start = max(start, until)
        while end - start >= least:
            length = min(end - start, LONGEST_RUN)
            out.append((start, length, distance))
            start += length
            until = start
    return tuple(np.array(column, np.int64) for column in zip(*out)) if out else (none, none, none)


def put_pixels(
    out: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, least_run: int = 8, longest: int = LONGEST_CODE,
    copies: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> None:
    """An entropy-coded image of literals, back-references and colours from the cache.

    Without ``copies`` given, runs are the back-references, by one pixel.
    """
    if copies is None:
        starts, lengths = runs_of(pixels, least_run)
        distances = np.ones(len(starts), np.int64)
    else:
        starts, lengths, distances = copies
    kind = np.zeros(len(pixels), np.int8)  # 0 literal, 1 start of a run, 2 cached, 3 inside a run
    for start, length in zip(starts.tolist(), lengths.tolist()):
        kind[start : start + length] = 3
    kind[starts] = 1
    slots = cache_slots(pixels, cache_bits).astype(np.int64) if cache_bits else None
    if cache_bits:
        cache: dict[int, int] = {}
        for i, (slot, pixel) in enumerate(zip(slots.tolist(), pixels.tolist())):
            if kind[i] == 0 and cache.get(slot, 0) == pixel:
                kind[i] = 2
            cache[slot] = pixel
    keep = kind != 3
    kinds, chosen = kind[keep], pixels[keep].astype(np.int64)
    length_symbols, length_extra, length_bits = prefix_of(lengths)
    green = chosen >> 8 & 255
    green[kinds == 1] = LITERALS + length_symbols
    if cache_bits:
        green[kinds == 2] = LITERALS + LENGTHS + slots[keep][kinds == 2]
    literal = kinds == 0
    # The pixel to the left and the one above are near ones; all others are told by how far they are.
    far = np.where(distances == 1, NEAR.index((1, 0)) + 1, np.where(distances == width, NEAR.index((0, 1)) + 1, distances + len(NEAR)))
    distance_symbols, distance_extra, distance_bits = prefix_of(far)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    alphabet = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    tables = [put_code(out, np.bincount(green, minlength=alphabet), longest)]
    single = ((chosen ^ chosen[0]) & 0xFFFF00FF).any() == 0
    for shift in (16, 0, 24):
        used = chosen[:1] if single else chosen[literal]
        tables.append(put_code(out, np.bincount(used >> shift & 255, minlength=LITERALS)))
    far_codes, far_lengths = put_code(out, np.bincount(distance_symbols, minlength=DISTANCES))
    columns = [(tables[0][0][green], tables[0][1][green])]
    for shift, (codes, code_bits) in zip((16, 0, 24), tables[1:]):
        if code_bits.any():
            symbols = chosen >> shift & 255
            columns.append((np.where(literal, codes[symbols], 0), np.where(literal, code_bits[symbols], 0)))
    if len(starts):
        for values, counts in ((length_extra, length_bits), (far_codes[distance_symbols], far_lengths[distance_symbols]), (distance_extra, distance_bits)):
            if counts.any():
                extra, extra_bits = np.zeros(len(green), np.int64), np.zeros(len(green), np.int64)
                extra[kinds == 1], extra_bits[kinds == 1] = values, counts
                columns.append((extra, extra_bits))
    out.put_all(*(np.stack(part, axis=1).ravel() for part in zip(*columns)))


def container(data: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def begin(width: int, height: int) -> Writer:
    if not 0 < width <= LARGEST_SIDE or not 0 < height <= LARGEST_SIDE:
        raise ValueError("a side is 1 to 16384 pixels")
    out = Writer()
    for value, count in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, count)
    return out


def bits_of(samples: np.ndarray) -> float:
    """Bits that the samples take at least, coded one by one."""
    counts = np.bincount(samples.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(samples.size / counts)).sum())


def steps_of(samples: np.ndarray, mode: int) -> np.ndarray:
    """What grey samples differ by from the one to the left (mode 1) or above (mode 2); where there is none, from the other."""
    steps = samples.copy()
    steps[1:, 0] -= samples[:-1, 0]
    steps[0, 1:] -= samples[0, :-1]
    steps[1:, 1:] -= samples[1:, :-1] if mode == 1 else samples[:-1, 1:]
    return steps


def encode_grey(samples: np.ndarray, least_copy: int = 24, longest: int = 12) -> bytes:
    """Rows and columns of 8-bit samples as greys: by a palette where some share a pixel, else by their green alone.

    The green is predicted from the left or from above where that takes fewer bits, and what
    ``least_copy`` samples or more repeat is a back-reference.  Codes of at most ``longest`` bits keep the
    reader's tables small.  A cache or cross-colour never saves a grey image anything: its
    colours are no more than the literals, and its red and blue are nought.
    """
    height, width = samples.shape
    out = begin(width, height)
    present = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    bits = bundle_bits(len(present))
    out.put(1, 1)
    if not bits:
        mode, least = 0, 0.97 * bits_of(samples)
        for other in (1, 2):
            if (need := bits_of(steps_of(samples, other))) < least:
                mode, least = other, need
        alpha = OPAQUE_BLACK
        if mode:
            blocks = (blocks_over(height, LARGEST_BLOCK), blocks_over(width, LARGEST_BLOCK))
            out.put(PREDICTOR, 2)
            out.put(LARGEST_BLOCK - 2, 3)
            put_pixels(out, np.full(blocks[0] * blocks[1], OPAQUE_BLACK | mode << 8, np.uint32), blocks[1], False)
            out.put(1, 1)
            # Opaque is what is predicted of alpha, so nothing is left of it.
            samples, alpha = steps_of(samples, mode), 0
        # Less green, a grey pixel has no red and no blue.
        out.put(SUBTRACT_GREEN, 2)
        out.put(0, 1)
        flat = samples.ravel()
        put_pixels(out, alpha | flat.astype(np.uint32) << 8, width, True, longest=longest, copies=copies_of(flat, least_copy))
        return container(out.data())
    palette = (OPAQUE_BLACK + present * 0x10101).astype(np.uint32)
    steps = np.diff(channels_of(palette).astype(np.int64), axis=0, prepend=0) & 255
    out.put(PALETTE, 2)
    out.put(len(palette) - 1, 8)
    put_pixels(out, pixels_of(steps), len(palette), False)
    out.put(0, 1)
    place = np.zeros(256, np.uint32)
    place[present] = np.arange(len(present))
    index = np.pad(place[samples], ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
    index = (index << (np.arange(1 << bits, dtype=np.uint32) * (8 >> bits))).sum(-1, dtype=np.uint32)
    put_pixels(out, (index << 8).ravel(), index.shape[1], True, 0, 24, longest)
    return container(out.data())


def encode(pixels: np.ndarray, mode: int | None = None, factors: int | None = None, subtract_green: bool = False, cache_bits: int = 0, block_bits: int = 3) -> bytes:
    """Any pixels, with a predictor mode, cross-colour factors (a pixel) or green subtracted, and a colour cache, if asked for."""
    height, width = pixels.shape
    out = begin(width, height)
    blocks = (blocks_over(height, block_bits), blocks_over(width, block_bits))
    image = channels_of(pixels).astype(np.int64)
    if mode is not None:
        rest = image.copy()
        for y in range(height):
            for x in range(width):
                if y and x:
                    guess = predicted(mode, *neighbours(image, y, x))
                elif x or y:
                    guess = image[y, x - 1] if x else image[y - 1, x]
                else:
                    guess = channels_of(np.array([OPAQUE_BLACK], np.uint32))[0]
                rest[y, x] = (image[y, x] - guess) & 255
        image = rest
        for value, count in ((1, 1), (PREDICTOR, 2), (block_bits - 2, 3)):
            out.put(value, count)
        put_pixels(out, np.full(blocks[0] * blocks[1], OPAQUE_BLACK | mode << 8, np.uint32), blocks[1], False)
    if factors is not None:
        image = cross_colour(image, np.broadcast_to(channels_of(np.array([factors], np.uint32)), (height, width, 4)), -1)
        for value, count in ((1, 1), (CROSS_COLOUR, 2), (block_bits - 2, 3)):
            out.put(value, count)
        put_pixels(out, np.full(blocks[0] * blocks[1], factors, np.uint32), blocks[1], False)
    if subtract_green:
        image[..., 1] = (image[..., 1] - image[..., 2]) & 255
        image[..., 3] = (image[..., 3] - image[..., 2]) & 255
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
    out.put(0, 1)
    put_pixels(out, pixels_of(image).ravel(), width, True, cache_bits)
    return container(out.data())
