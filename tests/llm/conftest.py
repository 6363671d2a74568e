import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, node long, _row long, size int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(known) + ("." if r.random() < 0.08 else "") for _ in range(words))


def rows_of(texts):
    return [(i, t, "en", "src", None if t is None else len(t), 0.5, 1, 7, 9, 3) for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    base = prose(1, 300)
    texts = [(0, base), (1, base), (1, base), (2, None), (3, ""), (4, "."), (5, "mot"), (6, base.replace("a", "e", 3)), (7, prose(2, 60_000)), (8, "日本語 テキスト ßé\n\n  x"), (9, "\0\x1c\t <|endoftext|>"),
             (None, prose(3, 80)), (None, None), (10, base + " " + prose(4, 40)), (5, "other text of one id")]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
