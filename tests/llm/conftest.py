import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, kept string, _id int, n int, trusted string"
WORDS = [a + b for a in "bcdfgklmnprst" for b in ("a", "en", "is", "or")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def sentences():
    return sentence


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: copies, near copies, shared passages, ties, short, empty and null
    texts, repeated rows, null ids, other white space, non-ASCII words, one very long text."""
    rng = random.Random(5)
    base = [sentence(rng, rng.choice([3, 12, 40, 90])) for _ in range(60)]
    passage = sentence(rng, 60)
    out = []
    for i, t in enumerate(base):
        out.append((2 * i, t))
        if i % 3 == 0:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            out.append((1000 + i, " ".join(w)))
        if i % 4 == 0:
            out.append((2000 + i, t))
        if i % 5 == 0:
            out.append((3000 + i, f"{sentence(rng, 20)} {passage}\n{sentence(rng, 20)}"))
    long = sentence(rng, 40_000)
    out += [(4000, None), (4001, ""), (4002, " \t\n\x0b\x0c\r "), (4003, "one"), (4004, "One"), (4005, "a b c d"),
            (4006, "A B c d"), (4007, long), (4008, long + " end"), (4009, "x y  z été"), (4010, "été  été \u0085 a"),
            (None, passage), (None, None), (None, base[1]), (0, base[0]), (0, base[0]), (4011, "same " * 200), (4011, "same " * 200)]
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns, named like some of the operators' own."""
    from quarry.session import ship_package
    ship_package(spark)
    rows = [(i, t, "en", f"s{n % 3}" if n % 7 else None, None if t is None else len(t), "x", 1, "y", 2, 3, "z") for n, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def split():
    return words
