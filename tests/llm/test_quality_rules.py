from __future__ import annotations

import re
from collections import Counter

from cases import DOC_SCHEMA, EDGE_TEXTS, edge_rows, noisy_texts

from ruzi.llm import quality_rules as qr


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    earlier, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup, lines = dup + (line in earlier), lines + 1
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), lines


def test_counts_equal_a_plain_count():
    pieces = ["a ", "b ", "ab ", "é ", "a b a b a ", "\n", "\t", "#", "| ", "日", "\x1c", "\u00a0", "x\ny\n"]
    for text in noisy_texts(pieces, 4000, 40) + [t or "" for t in EDGE_TEXTS]:
        assert qr.measure(text) == plain(text), text[:80]


def test_documents_get_base_and_host_verdicts(spark):
    good, bad = "a clean text of eleven words that nobody would ever refuse", "too short"
    rows = [(i, good, "en", "fine", None) for i in range(50)] + [(100 + i, bad, "en", "junk", None) for i in range(50)]
    rows += [(200, good, "en", "junk", None), (201, bad, "en", "small", None), (202, good, "en", None, None)]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert got[0].kept and not got[100].kept and got[100].base_failed
    assert not got[200].base_failed and not got[200].kept
    assert got[201].base_failed and got[202].kept


def test_hosts_are_held_against_the_corpus(spark):
    good, bad = "a clean text of eleven words that nobody would ever refuse", "\n".join(["one two", "three four"] * 4)
    assert qr.measure(bad) == (16, 60, 0, 6, 16, 8) and qr.measure(good)[3] == 0

    def refused(rates):
        rows = [(1000 * h + i, bad if i < rate else good, "en", f"h{h}", None) for h, rate in enumerate(rates) for i in range(100)]
        found = qr.refused_hosts(qr.document_counts(spark.createDataFrame(rows, DOC_SCHEMA))).collect()
        return {r.host: sorted(r.refused_for) for r in found}

    assert refused([0] * 7 + [70]) == {"h7": ["lines", "repeats"]}
    assert refused([0] * 7 + [40]) == {}
    for rate in (5, 60, 100):
        assert refused([rate] * 8) == {}


def test_prior_follows_the_hosts():
    a, b = qr.beta_prior(2, 100, 50, 50.0)
    assert abs(a / (a + b) - 0.5) < 1e-9 and a + b < 2
    a, b = qr.beta_prior(10, 1000, 100, 10.0)
    assert a + b == 1e6
    assert qr.beta_prior(1, 10, 0, 0.0) == (0.0, 1.0)
    assert qr.beta_prior(0, 0, 0, 0.0) == (0.0, 1.0)


def test_awkward_rows(spark):
    rows = edge_rows()
    got = qr.judge(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, *(r[c] for c in qr.COUNTS)) for r in got), key=key) == sorted(((r[0], *plain(r[1] or "")) for r in rows), key=key)
    extra = spark.createDataFrame([], DOC_SCHEMA + ", host string, kept string, refused string")
    assert qr.judge(extra).count() == 0
