from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("s", "n", "ra", "vel", "tion", "é")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: own texts, exact and near copies, shared passages, null, empty, blank and very long texts."""
    rng = random.Random(7)
    passage = sentence(rng, 70)
    rows = [(i, "\n".join(sentence(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6)))) for i in range(10, 60)]
    rows += [(100 + i, sentence(rng, 20) + " " + passage + " " + sentence(rng, 15)) for i in range(8)]
    rows += [(200 + i, rows[3][1] + "\n" + rows[4][1]) for i in range(3)]
    edited = (rows[3][1] + " " + passage + " " + passage + " " + passage).split()
    rows += [(300, " ".join(edited)), (301, " ".join([*edited[:20], "changed", *edited[21:]]))]
    rows += [(1, None), (2, ""), (3, "   \n\t "), (4, "eins"), (5, "eins zwei"), (6, "ab " * 200), (7, "ab " * 120), (8, "x" * 200), (9, "x" * 180)]
    rows.append((400, " ".join(rng.choice(WORDS) for _ in range(30_000))))
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The same with the columns of ``documents`` and some that operators use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), i, "x", "y", i) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block_id long, payload string, rank string, q long").repartition(3)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and repeated rows."""
    long = " ".join(f"w{i % 61}" for i in range(120))
    rows = [(None, long), (None, None), (7, long), (7, long), (8, long), (9, "")]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
