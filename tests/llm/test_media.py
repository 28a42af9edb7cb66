from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from cases import DOC_SCHEMA, EDGE_TEXTS, edge_rows

from ruzi.llm import media, webp


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (5, 13), (17, 33)])
def test_every_transform_round_trips(shape):
    rng = np.random.default_rng(sum(shape))
    steps = rng.integers(0, 3, (*shape, 4)).cumsum(axis=1) & 255
    kinds = [
        rng.integers(0, 2**32, shape, dtype=np.uint32),
        webp.pixels_of(steps),
        np.array([1, 2, 0xFF00FF00], np.uint32)[rng.integers(0, 3, shape)],
        np.full(shape, 7, np.uint32),
    ]
    for pixels in kinds:
        for mode in (None, *range(14)):
            for more in ({}, {"factors": 0xFF1234E5}, {"subtract_green": True}, {"cache_bits": 4}):
                assert np.array_equal(webp.decode(webp.encode(pixels, mode=mode, **more)), pixels)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes_and_bundles(colours):
    rng = np.random.default_rng(colours)
    samples = rng.integers(0, colours, (9, 37)).astype(np.uint8)
    samples.ravel()[:colours] = np.arange(colours)
    assert np.array_equal(media.samples_of(webp.decode(webp.encode_grey(samples))), samples)


def plain_pixels(data):
    """A second reader, bit by bit, for files with one group, no cache and no transform."""
    body = data[20:]
    stream = "".join(f"{byte:08b}"[::-1] for byte in body)
    at = 0

    def take(count):
        nonlocal at
        at += count
        return int(stream[at - count : at][::-1] or "0", 2)

    def table(lengths):
        used = sorted((length, symbol) for symbol, length in enumerate(lengths) if length)
        if len(used) == 1:
            return {"": used[0][1]}
        out, code, last = {}, 0, 0
        for length, symbol in used:
            code <<= length - last
            out[f"{code:0{length}b}"] = symbol
            code, last = code + 1, length
        return out

    def symbol(codes):
        nonlocal at
        word = ""
        while word not in codes:
            word += stream[at]
            at += 1
        return codes[word]

    def code(size):
        lengths = [0] * size
        if take(1):
            count, wide = take(1) + 1, take(1)
            lengths[take(8 if wide else 1)] = 1
            if count == 2:
                lengths[take(8)] = 1
            return table(lengths)
        order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
        own = [0] * 19
        for i in range(take(4) + 4):
            own[order[i]] = take(3)
        codes, at_symbol, before = table(own), 0, 8
        assert take(1) == 0
        while at_symbol < size:
            token = symbol(codes)
            if token < 16:
                lengths[at_symbol] = token
                before, at_symbol = token or before, at_symbol + 1
            elif token == 16:
                for _ in range(take(2) + 3):
                    lengths[at_symbol] = before
                    at_symbol += 1
            else:
                at_symbol += take(3) + 3 if token == 17 else take(7) + 11
        return table(lengths)

    assert take(8) == 0x2F
    width, height = take(14) + 1, take(14) + 1
    assert (take(1), take(3), take(1), take(1), take(1)) == (1, 0, 0, 0, 0)
    green, red, blue, alpha, far = code(280), code(256), code(256), code(256), code(40)
    pixels = []
    while len(pixels) < width * height:
        g = symbol(green)
        if g < 256:
            r, b, a = symbol(red), symbol(blue), symbol(alpha)
            pixels.append(a << 24 | r << 16 | g << 8 | b)
        else:
            g -= 256
            length = g + 1 if g < 4 else ((2 + (g & 1)) << (g - 2 >> 1)) + take(g - 2 >> 1) + 1
            assert symbol(far) == 1
            pixels += [pixels[-1]] * length
    return np.array(pixels, np.uint32).reshape(height, width)


def test_two_readers_agree():
    rng = np.random.default_rng(3)
    for skew in (2, 40, 250):
        grey = (rng.integers(0, 256, (40, 50)) * rng.integers(0, skew, (40, 50)) // skew).astype(np.uint32)
        grey[10:14] = 9
        data = webp.encode(0xFF000000 + grey * 0x010203)
        assert np.array_equal(webp.decode(data), plain_pixels(data))


def test_back_references_to_near_and_far_pixels():
    """A stream put together by hand: four literals, then copies from three pixels back and from above."""
    out = webp.begin(8, 2)
    for value, count in ((0, 1), (0, 1), (0, 1)):
        out.put(value, count)
    counts = np.zeros(280, np.int64)
    counts[[1, 2, 3, 4, 256 + 3, 256 + 4]] = 1
    codes, lengths = webp.put_code(out, counts)
    for _ in range(3):
        webp.put_code(out, np.bincount([0], minlength=256))
    # Distance codes: 123 is three pixels back, symbol 13 with five extra bits; 1 is the pixel above, symbol 0.
    symbol, extra, bits = (int(x[0]) for x in webp.prefix_of(np.array([123])))
    far = np.zeros(40, np.int64)
    far[[0, symbol]] = 1
    far_codes, far_lengths = webp.put_code(out, far)
    for green in (1, 2, 3, 4):
        out.put(int(codes[green]), int(lengths[green]))
    out.put(int(codes[259]), int(lengths[259]))
    out.put(int(far_codes[symbol]), int(far_lengths[symbol]))
    out.put(extra, bits)
    for _ in range(2):
        out.put(int(codes[259]), int(lengths[259]))
        out.put(int(far_codes[0]), int(far_lengths[0]))
    found = webp.decode(webp.container(out.data())) >> 8
    row = [1, 2, 3, 4, 2, 3, 4, 2]
    assert found.tolist() == [row, row]


def test_damaged_files_are_refused():
    good = webp.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for bad in (b"", b"RIFF", good[:25], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, struct.error, IndexError)):
            webp.decode(bad)


def test_long_payloads_take_several_images():
    rng = random.Random(1)
    payload = media.payload_of(bytes(rng.choices(b"abcdefgh \n", k=media.ROW * media.ROWS + 5)))
    stored = media.store(payload)
    found = list(media.images(stored))
    assert [pixels.shape for pixels in found] == [(media.ROWS, media.ROW), (1, media.ROW)]
    assert b"".join(media.samples_of(pixels).tobytes() for pixels in found) == payload


def test_query_on_awkward_rows(spark):
    rows = edge_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOC_SCHEMA + ", feature string")
    got = media.digests(docs).collect()
    assert len(got) == len(rows)
    texts = {i: text for i, text in enumerate(EDGE_TEXTS)}
    for r in got:
        if r.doc_id in texts:
            raw = (texts[r.doc_id] or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
            assert r.tail_crc32 == zlib.crc32(payload[-32:])
    stored = {r.doc_id: r.media for r in media.stored_media(docs).collect()}
    for r in got:
        if r.doc_id in texts:
            assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
    assert len({tuple(r)[1:] for r in got if r.doc_id in (0, 1)}) == 1
    assert media.digests(docs.where("false")).count() == 0


def test_pixel_arrays(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc"), (2, "x" * 2000), (3, None)], "doc_id long, text string")
    rows = media.pixel_arrays(media.stored_media(docs)).collect()
    assert sorted((r.doc_id, r.image, r.height, r.width) for r in rows) == [(1, 0, 1, 576), (2, 0, 4, 576), (3, 0, 1, 576)]
    found = {r.doc_id: np.frombuffer(r.pixels, "<u4") for r in rows}
    assert found[1][:4].tolist() == [0xFF616161, 0xFF626262, 0xFF636363, 0xFFFFFFFF]
    coloured = webp.encode(np.arange(12, dtype=np.uint32).reshape(3, 4), mode=11, cache_bits=3)
    stored = spark.createDataFrame([(7, bytearray(coloured * 2)), (8, None)], "doc_id long, media binary")
    assert [(r.image, np.frombuffer(r.pixels, "<u4").tolist()) for r in media.pixel_arrays(stored).collect()] == [(0, [*range(12)]), (1, [*range(12)])]
    assert media.pixel_arrays(stored.where("false")).count() == 0


def greys():
    """Samples for which each way of storing them is the smallest."""
    rng = np.random.default_rng(4)
    line = rng.integers(0, 256, 200).astype(np.uint8)
    return {
        "plain": rng.integers(60, 120, (6, 576)).astype(np.uint8),
        "left": (rng.integers(0, 3, (6, 576)).cumsum(1) & 255).astype(np.uint8),
        "above": (rng.integers(0, 3, (9, 576)).cumsum(0) + rng.integers(0, 256, 576) & 255).astype(np.uint8),
        "copies": np.concatenate([line, rng.integers(0, 256, 77).astype(np.uint8), line, line, rng.integers(0, 256, 475).astype(np.uint8)]).reshape(-1, 576),
        "row above": np.tile(rng.integers(0, 256, 576).astype(np.uint8), (5, 1)),
        "run": np.full((4, 576), 255, np.uint8),
        "one": np.array([[7]], np.uint8),
        "column": rng.integers(0, 256, (40, 1)).astype(np.uint8),
    }


def test_greys_are_stored_the_smaller_way():
    found = greys()
    for name, samples in found.items():
        stored = webp.encode_grey(samples)
        assert np.array_equal(media.samples_of(webp.decode(stored)), samples), name
    size = lambda name: len(webp.encode_grey(found[name]))
    assert size("left") < found["left"].size / 3 and size("above") < found["above"].size / 2
    assert size("copies") < found["copies"].size - 300
    assert size("row above") < 576 + 300


def test_copies_are_what_was_there_before():
    rng = np.random.default_rng(8)
    for _ in range(60):
        parts = [rng.integers(0, 4 if rng.random() < 0.5 else 256, int(rng.integers(1, 60))).astype(np.uint8) for _ in range(4)]
        samples = np.concatenate([parts[int(i)] for i in rng.integers(0, 4, 30)])
        starts, lengths, distances = webp.copies_of(samples, 10)
        until = 0
        for start, length, distance in zip(starts, lengths, distances):
            assert start >= until and 10 <= length <= webp.LONGEST_RUN and 0 < distance <= start
            assert all(samples[start + i] == samples[start + i - distance] for i in range(length))
            until = start + length
    assert all(len(part) == 0 for part in webp.copies_of(np.zeros(3, np.uint8), 10))
