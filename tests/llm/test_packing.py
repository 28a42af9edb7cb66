from __future__ import annotations

import random
import time
import zlib

import numpy as np
from cases import DOC_SCHEMA, EDGE_TEXTS, edge_rows, noisy_texts
from tokenizers import Tokenizer

from ruzi.llm import packing


def by_tokenizer(tokenizer, text):
    return [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_words_give_the_tokenizers_ids():
    tokenizer, ids_of = Tokenizer.from_file(packing.vocabulary_path()), packing.WordIds(packing.vocabulary_path(), limit=50)
    pieces = ["the ", "they'", "re ", "Σ", "ΑΣ ", "é", " ́", " ", " ", "\x85", "\x1c", "42 ", "#$ ", "<|endoftext|>", "é", "İ", "日本", "👩‍👩", "\n", "\x00", "'s", "ﬁ"]
    for text in noisy_texts(pieces, 3000, 12) + [t or "" for t in EDGE_TEXTS if len(t or "") < 1000]:
        assert np.frombuffer(ids_of.of(text), "<u4").tolist() == by_tokenizer(tokenizer, text)[:-1], repr(text)


def test_level_for_minimises_the_sum_of_squares():
    rng = random.Random(5)
    packer = packing.Packer(length=16, max_open=10**6)
    for _ in range(2000):
        size = rng.randint(1, 15)
        level = packer.level_for(size)

        def after(h):
            n = packer.levels.copy()
            n[h] -= h > 0
            if h + size < 16:
                n[h + size] += 1
            n[0] = n[16] = 0
            return int((n**2).sum())

        options = [0] + [h for h in range(1, 17 - size) if packer.levels[h]]
        assert level in options and after(level) == min(map(after, options))
        packer.add((0, size), bytes(4 * size))
        assert packer.n_open == packer.levels.sum()


def test_settling_leaves_one_window_open():
    rng = random.Random(6)
    for count in (0, 1, 2, 3, 50, 500):
        packer, total = packing.Packer(length=32, max_open=40), 0
        for i in range(count):
            size = rng.randint(1, 90)
            packer.add((i, size), np.full(size, i, "<u4").tobytes())
            total += size
        packer.settle()
        sizes = [sum(map(len, window)) for window in packer.taken()]
        assert sum(sizes) == total and max(sizes, default=32) <= 32
        assert sum(size < 32 for size in sizes) <= 1 + total // (32 * 20)


def test_the_rule_closes_more_windows_of_more_documents():
    rng = random.Random(3)
    shares = []
    for count in (1000, 20_000):
        packer = packing.Packer()
        for i in range(count):
            size = int(min(20_000, rng.lognormvariate(5.5, 1))) + 1
            packer.add((i, size), bytes(4 * size))
        packer.settle()
        windows = packer.taken()
        shares.append(sum(w.settled for w in windows) / len(windows))
    assert shares[1] < shares[0] / 2


def test_a_long_document_is_cut_in_linear_time():
    packer, size = packing.Packer(), 5_000_000
    began = time.perf_counter()
    packer.add((1, size), bytes(4 * size))
    assert time.perf_counter() - began < 2
    assert len(packer.taken()) == size // 2048
    assert len(packer.windows[size % 2048][0][0].ids) == 4 * (size % 2048)


def test_each_id_lies_in_one_piece(spark):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = [(i, *row[1:]) for i, row in enumerate(edge_rows())]
    got = packing.pack(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)).collect()
    want = {row[0]: by_tokenizer(tokenizer, row[1] or "") for row in rows}
    windows, pieces = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == want.keys()
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in windows.values()) <= 3


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA + ", start string, length string")
    assert packing.pack(docs).count() == 0
    nameless = spark.createDataFrame([(None, "x y", 1), (None, None, 2)], "doc_id long, text string, offset int")
    assert {(r.doc_id, r.length) for r in packing.pack(nameless).collect()} == {(None, 3), (None, 1)}


def test_plain_words_give_the_tokenizers_ids():
    tokenizer, ids_of = Tokenizer.from_file(packing.vocabulary_path()), packing.WordIds(packing.vocabulary_path(), limit=500)
    assert ids_of.split is not None
    pieces = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x180)]] + ["the", "'ll", "'S", "ing", "<|endoftext|>", "ßE", "İ", "1999"]
    for word in noisy_texts(pieces, 6000, 9, seed=11):
        assert np.frombuffer(ids_of.of(word), "<u4").tolist() == by_tokenizer(tokenizer, word)[:-1], repr(word)
