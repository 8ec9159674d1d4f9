import random

import pytest

EXTRA = "k1 string, k2 string, a string, fp string, span string, t string, doc string, key string, runs string, rank string, task string, rules_measures string, spans string, n_words string, block string, train string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randint(0, 400)}" for _ in range(n)]
    return " ".join(w if i % 5 else r.choice(("the", "of", "and", "la")) for i, w in enumerate(words))


def edge_rows() -> list[tuple]:
    long = prose(99, 60_000)
    shared = prose(7, 120)
    texts = [
        (1, prose(1, 200)), (2, prose(1, 200)), (3, None), (4, ""), (5, " \n\t "), (6, "één woord"), (7, long), (8, prose(2, 90) + " " + shared + " " + prose(3, 90)),
        (9, prose(4, 70) + "\n" + shared), (None, prose(5, 80) + " " + shared), (10, prose(6, 100)), (10, prose(6, 100)), (11, "ab " * 400), (12, shared + " é" + prose(8, 60)), (13, "x" * 700),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in texts]


@pytest.fixture
def rows():
    return edge_rows()


@pytest.fixture
def docs(spark, rows):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    names = [x.split()[0] for x in EXTRA.split(", ")]
    data = [(*r, *["!"] * len(names)) for r in rows]
    return spark.createDataFrame(data, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}").repartition(3)


@pytest.fixture
def nothing(docs):
    return docs.limit(0)
