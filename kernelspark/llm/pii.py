"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Four kinds are always reported as their patterns and validators find them (``base``):
e-mail addresses, IPv4 addresses, payment card numbers (Luhn) and international phone
numbers. Beyond them candidates with a score of at least ``THRESHOLD`` are reported:

* ``card``: a run of 13 to 19 digits that passes Luhn inside a longer row of numbers,
* ``iban``: country code and length agree and the number is 1 modulo 97,
* ``ssn``: three, two and four digits; counts only with a word for it nearby,
* ``secret``: 20 or more characters of letters and digits after a word such as "token".

A score starts with the kind's prior. Words of the kind within ``NEAR`` characters raise it,
words for other numbers (version, order, ...) lower it. Every search is linear in the text:
patterns are possessive, and e-mail addresses are found from their at signs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Kinds in the order in which spans of one start are listed; the first four are base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = KINDS[:4]
THRESHOLD, NEAR = 0.5, 40
#: What a candidate is worth without context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "secret": 0.2}
#: Words that speak for a kind.
FOR = {
    "email": {"email", "mail", "e-mail", "contact", "address"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment", "cvv", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "bic", "swift", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "secret": {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "bearer", "auth", "credential"},
}
#: Words that speak for some other number.
AGAINST = {"version", "release", "order", "invoice", "isbn", "issn", "doi", "commit", "sha", "md5", "checksum", "revision"}
#: Lengths of bank account numbers by country (fixed values of the published registry).
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22,
               "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")
_WORD = re.compile(r"[^\W\d]+(?:[_-][^\W\d]+)*")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    start = 0                                    # nothing before this belongs to the at sign's local part
    while at >= 0:
        before = len(text[start:at].rstrip(_LOCAL)) + start
        found = _DOMAIN.match(text, at + 1) if before < at else None
        if found:
            done = found.end()
            yield before, done
        start = max(done, at + 1)
        at = text.find("@", start)


def _digits(piece: str) -> str:
    return "".join(_RUN.findall(piece))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
            yield m.span()


def _phones(text: str):
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_digits(m.group())) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def _cards(text: str):
    """(start, end, base): base matches, and runs that pass inside a longer match."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield *m.span(), True
        elif len(digits) >= 13:
            for r in _RUN.finditer(text, *m.span()):
                own = r.group()
                if 13 <= len(own) <= 19 and own[0] in "3456" and luhn(own):
                    yield *r.span(), False


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        size, seen = IBAN_LENGTH.get(text[m.start():m.start() + 2], 0), 0
        for at in range(m.start(), m.end()):
            seen += text[at] != " "
            if seen == size:
                after = text[at + 1:at + 2]
                if not (after.isascii() and after.isalnum()) and mod97(text[m.start():at + 1].replace(" ", "")):
                    yield m.start(), at + 1
                break


def _secrets(text: str):
    for m in _SECRET.finditer(text):
        piece = m.group()
        if _DIGIT.search(piece) and any(c.isalpha() for c in piece):
            n = len(piece)
            if -sum(k / n * math.log2(k / n) for k in Counter(piece).values()) >= 3:
                yield m.span()


def context(text: str, start: int, end: int, kind: str) -> float:
    """The score of a candidate: prior, raised and lowered by words nearby."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR):start]) + _WORD.findall(text[end:end + NEAR])}
    score = PRIOR[kind] + (0.4 if near & FOR[kind] else 0.0) - (0.3 if near & AGAINST else 0.0)
    return round(min(1.0, max(0.0, score)), 2)


def spans(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by start, then kind; offsets in code points, end exclusive."""
    out = []
    if not text:
        return out
    if "@" in text:
        out += [("email", *s, context(text, *s, "email"), True) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *s, context(text, *s, "ip"), True) for s in _ips(text)]
        out += [("phone", *s, context(text, *s, "phone"), True) for s in _phones(text)]
        more = [("card", *s) for s in _cards(text)]
        more += [(kind, *s, False) for kind, find in (("iban", _ibans), ("ssn", _SSN.finditer), ("secret", _secrets))
                 for s in (x.span() if isinstance(x, re.Match) else x for x in find(text))]
        for kind, a, b, base in more:
            score = context(text, a, b, kind)
            if base or score >= THRESHOLD:
                out.append((kind, a, b, score, base))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = "array<struct<kind: string, start: long, stop: long, score: double, base: boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``pii``, the spans of each whole text.

    A null or empty text has none; repeated rows are taken as they come; other columns pass
    through. A column named pii raises ValueError. An empty table stays empty.
    """
    return _with(docs, text, T.StructField("pii", T._parse_datatype_string(SPAN)), _SPAN, lambda t: [dict(zip(("kind", "start", "stop", "score", "base"), s, strict=True)) for s in spans(t)])


def masked(text: str | None) -> str | None:
    """The text with each span as its kind in brackets; of overlapping spans the earlier, then longer one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, _, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``redacted``, the whole text without its personal data; null stays null."""
    return _with(docs, text, T.StructField("redacted", T.StringType()), pa.string(), masked)


def _with(docs: DataFrame, text: str, field: T.StructField, kind: pa.DataType, made) -> DataFrame:
    if field.name in {c.lower() for c in docs.columns}:
        raise ValueError(f"column exists already: {field.name}")
    at = docs.columns.index(text)

    def run(batches):
        for got in batches:
            found = pa.array([made(t) for t in got.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*got.columns, found], [*got.schema.names, field.name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, field]))


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
