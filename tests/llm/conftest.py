import random

import pytest

from tabwright.llm.columns import bounded_batches

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, node int, found string, spans int, ids string"
LONG = " ".join(f"long{i % 977} text{i}" for i in range(30_000))


def rows_of(texts):
    """Rows with every column of documents and columns whose names operators use inside."""
    return [(i, text, lang, "s", None, "x", 1, None, 0, "y") for i, text, lang in texts]


@pytest.fixture(scope="session")
def make(spark):
    bounded_batches(spark)
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def messy(make):
    """Nulls in every column, empty and long texts, equal texts, repeated rows, equal ids."""
    return make(
        [
            (1, "the quick brown fox jumps over the lazy dog. again and again", "en"),
            (2, "the quick brown fox jumps over the lazy dog. again and again", "en"),
            (2, "the quick brown fox jumps over the lazy dog. again and again", "en"),
            (3, None, "en"),
            (4, "", None),
            (5, "  \n ", "de"),
            (6, LONG, "en"),
            (None, "mail a.b@example.com or +1 (555) 123-4567 é日本", "fr"),
            (None, None, None),
            (7, "12345 --- 678", "en"),
            (7, "une autre phrase très différente avec des mots", "fr"),
        ]
    )


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def documents(spark):
    bounded_batches(spark)
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
