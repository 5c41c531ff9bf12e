from __future__ import annotations

import random

import pytest

SYLLABLES = ["ta", "ko", "ri", "mun", "élo", "sab", "ver", "ist", "on", "gra"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, repeats in a text, short and empty and null texts, odd characters, ties."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(60, 200)) for _ in range(12)]
    passage = words(rng, 50)
    docs = [" ".join(b) for b in base]
    for b in base[:6]:
        for k in range(4):
            c = list(b)
            for _ in range(k):
                c[rng.randrange(len(c))] = "other"
            docs.append(" ".join(c))
    docs += [docs[0].upper(), docs[1].replace(" ", "\n"), docs[2].replace(" ", "  ")]
    docs += [" ".join(words(rng, 30) + passage + words(rng, 40)) for _ in range(6)]
    docs += [" ".join(passage * 3), " ".join(["same"] * 90), " ".join(["a", "b", "c"] * 40), "one two three", "One TWO three", "x", "x", "", None, "   \t\n", "é" * 300, "a b c d e f g", "\x00 \x7f | # a b"]
    docs += [" ".join(words(rng, 20_000)), "\n".join(["a line of words"] * 9 + ["another line"] * 2 + ["", " "])]
    rows = [(k, t) for k, t in enumerate(docs)]
    return rows + [rows[3], rows[3], (None, docs[4]), (None, None), (None, "alone in the world without an id at all")]


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, texts):
    """With extra columns that have the operators' names."""
    rows = [(i, t, "src0" if k % 3 else None, 1.5, True, "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, SCORE double, kept boolean, component_id string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)
