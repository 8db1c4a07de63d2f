import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""
    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "src0"][len(r) - 2:]),
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, a long one, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "a b c " * 40),
            (7, "a b c " * 40), (8, "a b c " * 40), (8, "a b c " * 40), (9, long),
            (10, long + " end"), (None, "a b c " * 40), (None, None), (11, "x" * 70_000),
            (12, "İstanbul ẞ é   token=Abcdefgh12", None, None), (-3, "one two three")]


@pytest.fixture(scope="session")
def prose():
    """Random texts with near copies, shared passages and repeated lines."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, base, passage = [], say(150), say(60)
    for i in range(160):
        kind = i % 4
        if kind == 0:
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 1:
            w = say(40) + passage + say(rng.randint(0, 60))
        else:
            w = say(rng.randint(0, 120))
        rows.append((1000 - 3 * i, " ".join(w)))
    return rows
