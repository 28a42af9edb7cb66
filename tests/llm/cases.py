"""Awkward documents that every operator has to get through, and random texts."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "a b",
    "one two three",
    "ONE two Three",
    "one two three",
    "é\u00a0ß\u2003x 日本語 👩‍👩‍👧 e\u0301",
    "nul\x00byte and \x1c separators \x85 here",
    "word " * 40_000,
    "x" * 300_000,
    "line\nline\nline\n\nline \n",
    "mail me: a.b@c-d.example.org, +1 (499) 555-6503, 4111 1111 1111 1111 and 10.0.0.1.",
]


def edge_rows():
    """Rows with nulls in every column, ties and repeats."""
    rows = [(i, text, "en", f"s{i % 3}", None) for i, text in enumerate(EDGE_TEXTS)]
    rows += [(100, "repeated row of text", "en", "s0", 20)] * 3
    rows += [(None, "row without an id", None, None, None), (None, None, None, None, None)]
    return rows


def noisy_texts(pieces: list[str], count: int, longest: int = 14, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(count)]
