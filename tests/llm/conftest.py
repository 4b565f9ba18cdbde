"""Small documents with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest

# The columns after n_chars have names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, weight double, _gone int, size int, spans string, m long"
WORDS = "the of and to in is was for with on thand ening retion anle bleor".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "ing", "er", "st", "ly"]) + str(r.randrange(40)) for _ in range(n)) + "."


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, len(text) if text else None, 1, 2.0, 3, 4, "x", 5)


@pytest.fixture(scope="session")
def rows():
    base = prose(1, 80)
    near = base.replace("the", "thy", 1)
    out = [row(i, prose(i, 20 + 7 * i), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(10, 30)]
    out += [row(1, base), row(2, base), row(3, near), row(4, None), row(5, ""), row(6, "!!! ???"), row(7, "one two"), row(8, "one two"), row(9, "é" * 300, None, None)]
    out += [row(40, prose(40, 30_000)), row(41, None, None, None), row(11, prose(11, 97), "en", "s2"), row(None, prose(99, 50))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
