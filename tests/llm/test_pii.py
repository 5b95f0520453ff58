import hashlib
import random
import re
import time

import pytest

from kernelspark.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain(text):
    """The four base kinds by the contract's own patterns."""
    text = text or ""
    size = lambda m: len(re.sub("[^0-9]", "", m.group()))
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m.group().split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 12 <= size(m) <= 19 and passes(re.sub("[^0-9]", "", m.group()))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= size(m) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


PIECES = ["a.b@c.de", "x@y", "@", "@@", "é@é.com", "a@b-c.d_e@f.g.h", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.0002.3.255", "4111 1111 1111 1111", "4111111111111111",
          "4111-1111-1111-1112", "5 5 5", "1", "12345678901234567890", "7536784127813050 4845168114407329", "+1 (555) 555-0100", "+49 30 1234567", "+1", "+1 ((((", "+1234567890123456", " ", " ", "-",
          ".", "+", "\n", "日本", "é", "card ", "token = ", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "0"]


@pytest.mark.parametrize("seed", range(4))
def test_base_kinds_against_the_plain_patterns(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) if rng.random() < 0.8 else rng.choice("@.+- 0123456789aZ_%(") for _ in range(rng.randint(1, 12)))
        assert [s[:3] for s in P.spans(text) if s[4]] == plain(text), text


def kinds(text):
    return [(k, text[a:b], base) for k, a, b, _, base in P.spans(text)]


def test_added_spans_need_a_checksum_or_context():
    assert kinds("7536784127813050 4845168114407329") == [("card", "4845168114407329", False)]
    assert kinds("pay to DE89370400440532013000 now") == [("iban", "DE89370400440532013000", False)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32", False) in kinds("GB82 WEST 1234 5698 7654 32")
    assert [k for k, *_ in kinds("DE88370400440532013000")] == []
    hexa = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'token = "{hexa}"') == [("secret", hexa, False)] and kinds(f"commit {hexa}") == [] and kinds(hexa) == []
    assert kinds("ssn 219-09-9999") == [("ssn", "219-09-9999", False)] and kinds("219-09-9999") == []


def test_context_moves_the_score():
    score = lambda t: P.spans(t)[0][3]
    assert score("version 1.2.3.4") < score("see 1.2.3.4") < score("server 1.2.3.4")


def test_linear_on_long_texts():
    start = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" + "(" * 400_000, "1 " * 200_000, "A1" * 200_000, "a.b@" + "c" * 400_000, "+" * 300_000):
        P.spans(text)
    assert time.time() - start < 30


def test_masking():
    assert P.masked("Write a.b@c.de or +49 30 1234567.") == "Write [EMAIL] or [PHONE]."
    assert P.masked(None) is None and P.masked("") == ""


def test_query_and_awkward_tables(spark, rows, no_docs, tmp_path):
    rng = random.Random(1)
    data = [(i, None if t is None else f"{t} {rng.choice(PIECES)} {t[:9]}{rng.choice(PIECES)} {rng.choice(PIECES)}", "x", 3) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, spans string, N_EMAIL int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in P.op12_pii(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, *_ in data:
        own, every = plain(t), P.spans(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        want.append((i, *[sum(s[0] == k for s in own) for k in ("email", "ip", "card", "phone")], hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in every)))
        assert set(own) <= {s[:3] for s in every}
    assert got == sorted(want, key=str)
    assert P.scan(no_docs).collect() == [] and P.redact(no_docs).collect() == []
    with pytest.raises(ValueError):
        P.scan(no_docs.withColumnRenamed("lang", "PII"))
