"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``+digit``, digits
beside a dot, digit pairs, schemes and identifier cues.  A deterministic local
parser expands each anchor to its boundaries and validates it.  The four base
kinds give exactly what a leftmost non-overlapping search of these patterns
gives, with failing matches dropped and not retried:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

The method adds two kinds: ``login`` (user information in an address after a
scheme) and ``account`` (an IBAN of its country's length with right check digits, or 8 to 17 digits, after
a cue such as ``IBAN`` or ``account number``).  Schemes and cues count in any case.

Scale: one pass, no shuffle, whole texts, memory of one Arrow batch.

Defined results: a null or empty text has no spans; offsets count code points;
repeated rows get equal spans; an empty table gives an empty result; other
columns of the input don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruzi.llm.common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")
ORDER = {kind: i for i, kind in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Matched in any case.
SCHEMES, CUES = ("http://", "https://", "ftp://", "sftp://", "ssh://"), ("iban", "account", "acct")
#: How long the account numbers of a country are (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER = re.compile(r"[A-Za-z0-9._%+~-]+:[^\x20\x09-\x0D@/?#]+@[A-Za-z0-9.-]+")
#: A country, and after it characters with at most one space before each; how many there are, its length says.
IBAN = re.compile(r"(?:\x20(?:number|no\.?|nr\.?))?[\x20:#=]{0,4}([A-Z]{2})(?=[0-9]{2})", re.ASCII)
ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|id))?[\x20:#=]{1,4}([0-9]{8,17})(?![0-9A-Za-z])", re.ASCII | re.IGNORECASE)

Span = tuple[str, int, int]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Anchors, each with its family and its length."""
    found = ahocorasick.Automaton()
    digits = sorted(DIGITS)
    for a in digits:
        found.add_word(f"+{a}", ("phone", 2))
        for b in digits:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", ("card", 2 + len(between)))
    found.add_word("@", ("email", 1))
    for family, words in (("login", SCHEMES), ("account", CUES)):
        for word in words:
            for either in itertools.product(*[sorted({c.lower(), c.upper()}) for c in word]):
                found.add_word("".join(either), (family, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit)
        total += value if i % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


@functools.cache
def rest_of_iban(country: str) -> re.Pattern:
    """The check digits and as many more characters as the country's numbers have, not followed by another."""
    return re.compile(rf"[0-9]{{2}}(?:\x20?[A-Z0-9]){{{IBAN_LENGTHS[country] - 4}}}(?![A-Za-z0-9])")


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """Start and end of the account number that a cue ending at ``at`` announces."""
    if (match := IBAN.match(text, at)) and match[1] in IBAN_LENGTHS:
        if (rest := rest_of_iban(match[1]).match(text, match.end())) and iban(match[1] + rest[0].replace(" ", "")):
            return match.start(1), rest.end()
    match = ACCOUNT.match(text, at)
    return match.span(1) if match else None


def chain_start(text: str, at: int, low: int, between: str) -> int:
    """Left end of a chain of digits joined by at most one of ``between``, from a digit on."""
    while at > low:
        if text[at - 1] in DIGITS:
            at -= 1
        elif at - 1 > low and text[at - 1] in between and text[at - 2] in DIGITS:
            at -= 2
        else:
            break
    return at


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then by kind in the order of KINDS."""
    found: list[Span] = []
    email_end = ip_end = card_end = login_end = account_end = 0
    for last, (family, length) in automaton().iter(text):
        at = last + 1 - length
        if family == "card":
            if at < card_end:
                continue
            start = chain_start(text, at, card_end, " -")
            card_end = DIGIT_CHAIN.match(text, start).end()
            digits = text[start:card_end].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", start, card_end))
        elif family == "ip":
            if at < ip_end:
                continue
            start = chain_start(text, at, ip_end, ".")
            while match := ADDRESS.match(text, start):
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
                    found.append(("ip", start, match.end()))
                start = match.end() + 1
                ip_end = match.end()
            ip_end = max(ip_end, at + 2)
        elif family == "email":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (match := DOMAIN.match(text, at + 1)):
                email_end = match.end()
                found.append(("email", start, email_end))
        elif family == "phone":
            if (match := PHONE.match(text, at)) and 9 <= sum(c in DIGITS for c in match[0]) <= 15:
                found.append(("phone", at, match.end()))
        elif family == "login":
            if at >= login_end and (match := USER.match(text, last + 1)):
                login_end = match.end()
                found.append(("login", last + 1, login_end))
        elif at >= account_end:
            if span := account_at(text, last + 1):
                account_end = span[1]
                found.append(("account", *span))
    return sorted(found, key=lambda span: (span[1], ORDER[span[0]]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans for each document."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for value in batch.column(1):
                every = spans(value.as_py() or "")
                base = [span for span in every if span[0] in BASE]
                counts = [sum(span[0] == kind for span in base) for kind in BASE]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            *counts, digests, strings = zip(*rows)
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests), pa.array(strings)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans"])

        return work

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


def redact_text(text: str) -> str:
    """The text with each span, overlapping ones joined, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted(text: Column) -> Column:
    """A text column with personal data replaced; null stays null."""

    @F.pandas_udf("string")
    def replace(values: pd.Series) -> pd.Series:
        return values.map(redact_text, na_action="ignore")

    return replace(text)
