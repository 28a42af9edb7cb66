from __future__ import annotations

import hashlib
import re

from cases import DOC_SCHEMA, EDGE_TEXTS, edge_rows, noisy_texts

from ruzi.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = list("0123456789") + ["4111 1111 1111 1111", "41", "11-", " ", "-", "--", ".", "..", "@", "a", "b@", "c.d", "+", "+1", "(", ")", "é", "\n", "255", "256.", "1.2.3", "x_y%", "https://", "IBAN ", "u:p@h.io"]


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def by_search(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "email" and "@" not in text:  # the plain search takes quadratic time
            continue
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn_ok(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_spans_equal_a_plain_search():
    for text in noisy_texts(PIECES, 20_000, 24) + [t or "" for t in EDGE_TEXTS]:
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == by_search(text), text


def test_added_kinds():
    assert ("login", 8, 23) in pii.spans("https://user:pw@host.io/x")
    text = "IBAN: GB82 WEST 1234 5698 7654 32."
    assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == ["GB82 WEST 1234 5698 7654 32"]
    assert not [s for s in pii.spans("IBAN: GB83 WEST 1234 5698 7654 32.") if s[0] == "account"]
    assert [s[0] for s in pii.spans("your account number: 123456789 is")] == ["account"]
    assert pii.spans("on account of 12 people in 2024") == []


IBANS = ["GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]


def test_account_numbers_end_where_their_country_says():
    spaced = lambda n: " ".join(n[i : i + 4] for i in range(0, len(n), 4))
    for number in IBANS:
        for written in (number, spaced(number)):
            for cue in ("IBAN", "iban:", "iBaN ", "Account no. "):
                for after in ("", " OK", " AND MORE", ".", "\nNEXT LINE 12", " 99"):
                    text = f"pay to {cue} {written}{after}"
                    assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == [written], text
        broken = number[:-1] + ("1" if number[-1] != "1" else "2")
        assert not [s for s in pii.spans(f"IBAN {broken} x") if s[0] == "account"]
        assert not [s for s in pii.spans(f"IBAN {number}A") if s[0] == "account"]
        assert not [s for s in pii.spans(f"number {number}") if s[0] == "account"]
    assert not [s for s in pii.spans("IBAN ZZ82WEST12345698765432") if s[0] == "account"]


def test_schemes_in_any_case():
    for scheme in ("HTTP", "Https", "ftp", "sSh", "SFTP"):
        text = f"see {scheme}://a:b@c.d/x"
        assert [text[a:b] for k, a, b in pii.spans(text) if k == "login"] == ["a:b@c.d"]
    assert not [s for s in pii.spans("http://a@c.d http://c.d:80/x@y") if s[0] == "login"]


def test_redaction_leaves_no_span():
    text = EDGE_TEXTS[-1]
    clean = pii.redact_text(text)
    assert clean == "mail me: [EMAIL], [PHONE], [CARD] and [IP]."
    assert pii.spans(clean) == []


def test_query_on_awkward_rows(spark):
    rows = edge_rows()
    got = pii.find(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    want = []
    for doc_id, text, *_ in rows:
        base = by_search(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((doc_id, *(sum(s[0] == k for s in base) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA + ", spans string, n_email string")
    assert pii.find(docs).count() == 0
    one = spark.createDataFrame([(1, "a@b.cd", "x", "y")], "doc_id int, text string, spans string, n_email string")
    assert pii.find(one).first().n_email == 1
    assert one.select(pii.redacted(one.text).alias("t")).first().t == "[EMAIL]"
