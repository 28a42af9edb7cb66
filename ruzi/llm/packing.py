"""Sum-of-squares online packing of tokenized documents into fixed windows.

Every document is cut into whole windows and a rest.  The rests arrive one by
one and are placed by the sum-of-squares rule: of all windows with room, and a
new one, take the fill level for which the sum over levels of the squared number
of partially filled windows grows least.  A level array holds those numbers, so
a placement is a few vector operations over at most 2048 levels.  When a task's
documents end, or when it holds ``max_open`` partially filled windows, the
emptiest windows are dissolved into the gaps of the fullest, cutting as needed,
so that at most one window of the lot stays partially filled.  ``settled`` marks their windows: the rule
needs many documents to close windows by itself, so their share falls as a task's documents grow.

Scale: tokenizing, packing and checksums happen in one pass over the input's own
partitions: no shuffle, no key, nothing to be skewed.  A task holds one batch, the ids of one document,
a bounded cache of words and at most ``max_open`` windows.  It costs less than
one padded window per input partition.

Defined results: a null or empty text is the single end token; repeated rows are
packed each; the order within a window is that of arrival; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END = 1
MAX_OPEN = 4096
#: Words whose ids are kept; when there are so many, they are kept as the older ones and a new lot begins.
CACHED_WORDS = 200_000
WIDTH = 4  # bytes of an id

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, settled boolean"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if visible, else the next above 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Little-endian unsigned 32-bit ids by word.

    The vocabulary's pre-tokenizer never joins text across white space, so the
    ids of a text are those of its words one after another.  Words of visible
    Latin letters, for which lower case is all that normalizing does, are split by
    the vocabulary's own pattern, and only their parts go to its model; any other
    word goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"[!-~\u00C0-\u017F]+")

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.older, self.parts, self.letters = self.tokenizer.model, {}, {}, byte_letters()
        self.split = self.own_pattern()

    def own_pattern(self):
        """The pre-tokenizer's pattern, or None for a vocabulary that works in another way."""
        parts = json.loads(self.tokenizer.to_str())
        normal = [part["type"] for part in (parts["normalizer"] or {}).get("normalizers", [])]
        before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [part["type"] for part in before] != ["Split", "ByteLevel"]:
            return None
        known = (before[0]["behavior"], before[0]["invert"], before[1]["add_prefix_space"], before[1]["use_regex"])
        return regex.compile(before[0]["pattern"]["Regex"]) if known == ("Removed", True, False, False) else None

    def part(self, text: str) -> bytes:
        if (found := self.parts.get(text)) is None:
            letters = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
            found = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
            if len(self.parts) >= self.limit:
                self.parts.clear()
            self.parts[text] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        if (found := self.older.get(word)) is None:
            text = word.decode("utf-8", "surrogatepass")
            if self.split and (text.isascii() and text.isalpha() or self.PLAIN.fullmatch(text) and "<|" not in text):
                text = text.lower()
                found = self.part(text) if text.isalpha() else b"".join(map(self.part, self.split.findall(text)))
            else:
                found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


class Piece:
    """A run of one document's ids, from ``start`` on."""

    __slots__ = ("doc", "ids", "start")

    def __init__(self, doc: tuple, start: int, ids: bytes | memoryview):
        self.doc, self.start, self.ids = doc, start, ids

    def __len__(self) -> int:
        return len(self.ids) // WIDTH

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: at * WIDTH]), Piece(self.doc, self.start + at, self.ids[at * WIDTH :])


class Lot(list):
    """The pieces of one window; ``settled`` if they met by cutting and not by the rule."""

    settled = False


class Packer:
    """Takes documents, hands out closed windows as lists of pieces."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN):
        self.length, self.max_open, self.n_open = length, max_open, 0
        self.levels = np.zeros(length + 1, np.int64)
        self.windows: dict[int, list[Lot]] = {}
        self.closed: list[Lot] = []

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, by which the sum of squares grows least; the fullest of equals."""
        levels, top = self.levels, self.length - size
        cost = 2 * (levels[size : self.length + 1] - levels[: top + 1]) + 2
        cost[0] = 2 * levels[size] + 1
        cost[top] = 1 - 2 * levels[top]
        if top == 0:
            return 0
        cost[1:][levels[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, doc: tuple, ids: bytes) -> None:
        count = len(ids) // WIDTH
        whole, view = count // self.length * self.length, memoryview(ids)
        for at in range(0, whole, self.length):
            self.closed.append(Lot([Piece(doc, at, view[at * WIDTH : (at + self.length) * WIDTH])]))
        if size := count - whole:
            # Bytes of its own, so that the rest of a long document doesn't hold all of it.
            piece = Piece(doc, whole, ids[whole * WIDTH :])
            level = self.level_for(size)
            window = self.windows[level].pop() if level else Lot()
            window.append(piece)
            if level:
                self.levels[level] -= 1
                self.n_open -= 1
            if level + size == self.length:
                self.closed.append(window)
            else:
                self.levels[level + size] += 1
                self.windows.setdefault(level + size, []).append(window)
                self.n_open += 1
            if self.n_open >= self.max_open:
                self.settle()

    def settle(self) -> None:
        """Dissolve the emptiest windows into the gaps of the fullest; all but one get full."""
        lot = [[level, window] for level in sorted(self.windows) for window in self.windows[level]]
        self.windows, self.n_open = {}, 0
        self.levels[:] = 0
        for _, window in lot:
            window.settled = True
        low, high = 0, len(lot) - 1
        while low < high:
            gap = self.length - lot[high][0]
            piece = lot[low][1].pop()
            if len(piece) > gap:
                moved, rest = piece.cut(gap)
                lot[low][1].append(rest)
            else:
                moved = piece
            lot[high][1].append(moved)
            lot[high][0] += len(moved)
            lot[low][0] -= len(moved)
            if lot[high][0] == self.length:
                self.closed.append(lot[high][1])
                high -= 1
            if low <= high and not lot[low][1]:
                low += 1
        if low == high:
            self.closed.append(lot[low][1])

    def taken(self) -> list[Lot]:
        out, self.closed = self.closed, []
        return out


def rows_of(windows: list[Lot], first: int) -> pa.RecordBatch:
    """One row per piece; windows are numbered from ``first``."""
    rows = []
    for number, window in enumerate(windows, first):
        offset = 0
        for piece in window:
            doc_id, tokens = piece.doc
            rows.append((doc_id, piece.start, len(piece), zlib.crc32(piece.ids), tokens, number, offset, window.settled))
            offset += len(piece)
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    *numbers, settled = zip(*rows)
    columns = [*(pa.array(column, pa.int64()) for column in numbers), pa.array(settled, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece, with the columns of SCHEMA.

    ``path`` is the vocabulary's file, the same on every executor; by default
    each executor finds its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(path or vocabulary_path()), Packer(length, max_open)
        number = TaskContext.get().partitionId() << 32
        end = np.asarray([END], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of.of(text.as_py() or "") + end
                packer.add((doc_id, len(ids) // WIDTH), ids)
                if len(packer.closed) >= 1000:
                    windows = packer.taken()
                    yield rows_of(windows, number)
                    number += len(windows)
        packer.settle()
        if windows := packer.taken():
            yield rows_of(windows, number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
