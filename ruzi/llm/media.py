"""Media columns: payloads stored as lossless WebP and read back as pixel arrays.

A payload is cut into images of at most ``ROWS`` rows of ``ROW`` grey samples; the
stored form is their files one after another, each of which names its size.

Scale: one pass without a shuffle; a task holds one Arrow batch and one image.

Defined results: a null or empty text is one row of bytes 255; equal texts give
equal values; an empty table gives an empty result; other columns don't matter.
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

from ruzi.llm.common import map_batches
from ruzi.llm.webp import decode, encode_grey

ROW, ROWS, FILL, TAIL = 576, 1024, 255, 32

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)

PIXELS = "doc_id long, image int, height int, width int, pixels binary"
#: Bytes of pixels after which a task hands its rows on.
HELD = 8 << 20


def payload_of(raw: bytes) -> bytes:
    """The bytes filled up to a positive multiple of ROW."""
    return raw + bytes([FILL]) * (-len(raw) % ROW if raw else ROW)


def store(payload: bytes) -> bytes:
    """WebP files one after another."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(encode_grey(samples[i : i + ROWS]) for i in range(0, len(samples), ROWS))


def images(stored: bytes) -> Iterator[np.ndarray]:
    """The pixel array of each file."""
    at = 0
    while at < len(stored):
        size = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        yield decode(stored[at : at + size])
        at += size


def samples_of(pixels: np.ndarray) -> np.ndarray:
    return (pixels >> 8 & 255).astype(np.uint8)


def feature_of(samples: np.ndarray) -> str:
    """Mean, spread, mean steps to the right and down, and entropy of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    values = samples.astype(np.int16)
    right = np.abs(np.diff(values, axis=1)).mean()
    down = np.abs(np.diff(values, axis=0)).mean() if len(values) > 1 else 0.0
    levels = np.arange(256)
    mean = (counts * levels).sum() / samples.size
    spread = np.sqrt((counts * (levels - mean) ** 2).sum() / samples.size)
    return ",".join(f"{x:.4f}" for x in (mean, spread, right, down, -(share * np.log2(share)).sum()))


def row_of(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    payload = payload_of(raw)
    stored = store(payload)
    samples = np.concatenate([samples_of(pixels) for pixels in images(stored)])
    back = samples.tobytes()
    if back != payload:
        raise ValueError("the stored image doesn't give back its payload")
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]),
        len(stored), hashlib.sha256(stored).hexdigest(), feature_of(samples),
    )


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id and the stored form (media, binary) of each document's payload."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            stored = [store(payload_of((value.as_py() or "").encode("utf-8", "surrogatepass"))) for value in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(stored, pa.binary())], names=["doc_id", "media"])

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """The pixels of stored images: doc_id, image (counted from 0), height, width and pixels, for each image.

    ``pixels`` are little-endian unsigned 32-bit numbers, alpha highest, row by
    row.  Any lossless WebP files do; a null or empty media has no images.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, stored in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, pixels in enumerate(images(stored.as_py() or b"")):
                    rows.append((doc_id, number, *pixels.shape, pixels.astype("<u4").tobytes()))
                    held += pixels.nbytes
                    if held >= HELD:
                        yield pixel_batch(rows)
                        rows, held = [], 0
        if rows:
            yield pixel_batch(rows)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, PIXELS)


def pixel_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=[f.split()[0] for f in PIXELS.split(", ")])


def digests(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA per document: stored, read back and measured."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*[row_of(value.as_py() or "") for value in batch.column(1)])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(column, kind) for column, kind in zip(rows, kinds)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[field.split()[0] for field in SCHEMA.split(", ")])

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA)
