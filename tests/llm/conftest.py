import random

import pytest

from ..conftest import spark  # noqa: F401  (the session fixture)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, n int"


def make_rows():
    """Nulls, empty and very long texts, exact and near copies, repeated rows and ids, shared passages."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéï ſ日'9".replace(" ", "")) for _ in range(rng.randint(1, 7)))
    vocab = [word() for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, rows = prose(60), []
    for i in range(40):
        rows.append([i, prose(rng.choice([1, 3, 4, 5, 9, 34, 35, 36, 90, 200]))])
    for i in range(40, 48):  # a shared passage
        rows.append([i, prose(20) + "\n" + passage + "\t " + prose(15)])
    base = prose(150).split()
    for i in range(48, 60):  # near copies, chained by edits
        w = list(base)
        for _ in range(i - 48):
            w[rng.randrange(150)] = rng.choice(vocab)
        rows.append([i, " ".join(w)])
    rows += [[60, None], [61, ""], [62, " \t\n "], [63, "A b c's  D!!'s <|endoftext|> x"], [64, prose(6000)],
             [65, rows[7][1]], [66, rows[41][1].upper()], [None, rows[9][1]], [None, None], [3, "other text of a known id"],
             [5, rows[5][1]], [5, rows[5][1]]]
    return [(i, t, "en", "src0", len(t or ""), "k", 1, None) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):  # noqa: F811
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)
