import random

import pytest

#: Names that the operators use themselves.
CLASHING = (
    "id", "hash", "fp", "k", "s", "t", "n", "quality", "words", "windows", "item", "place", "pos", "spans", "label",
    "of", "component", "core", "first", "__id", "__hash", "__drop", "__kept", "__k", "ids_", "site", "line", "keys",
)


def prose(rnd: random.Random, words: int) -> str:
    letters = ["the", "of", "and", "ab", "cde", "fgh", "ijk", "lm", "nop", "qrs", "tu", "vwx", "yz", "é", "ß"]
    return " ".join("".join(rnd.choices(letters, k=rnd.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties of ids."""
    rnd = random.Random(5)
    base = prose(rnd, 120)
    return [
        (1, base, "en", "a", 1), (2, base, None, "a", None), (2, base, None, "a", None), (3, None, "en", None, 1),
        (4, "", "en", "b", 1), (None, base + " more", "en", "b", 1), (None, None, None, None, None),
        (5, " \t\n\x0b ", "en", "b", 1), (6, prose(rnd, 40_000), "en", "c", 1), (7, "one", "en", "c", 1),
        (7, prose(rnd, 60), "en", "c", 1), (8, "\n".join(["a line of text"] * 30), "en", "a", 1),
        (9, "\x00 \x01\x1f control 　 wide 😀", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
