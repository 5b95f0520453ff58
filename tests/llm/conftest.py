"""Shared fixtures: a small documents table with the awkward rows."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words):
    parts = ["the", "of", "and", "ther", "ing", "ation", "en", "der", "ung", "lich", "que", "ment", "eau", "ción"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty, white space, long, exact and near copies, shared passages, repeated ids."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    passage = prose(rng, 40)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[0]) for i in range(6)]
    out += [(200 + i, base[1] + f" tail{i}") for i in range(6)]
    out += [(300 + i, f"{prose(rng, 8)} {passage} {prose(rng, 8)}") for i in range(12)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "123 456 $$$ !!!"), (404, "x" * 5000), (405, "ab " * 4000), (406, "é" * 60), (407, "\0" * 70),
            (408, "a\nb\n a\nb\nb"), (409, prose(rng, 9000)), (410, "日本語" * 40), (5, base[7]), (5, base[7]), (None, base[3]), (None, base[3]), (None, prose(rng, 30)), (-7, passage)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en" if t else None, "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
