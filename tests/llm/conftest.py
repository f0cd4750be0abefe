import pytest

#: What every operator has to stand: nulls, empty and blank texts, repeated rows, non-ASCII, a long text.
EDGE = [
    (1, None, "en", "s"), (2, "", None, None), (3, " \t\n ", "en", "s"), (4, "Word", "en", "s"), (4, "Word", "en", "s"),
    (5, "été naïve   straße 　 x", "fr", "t"), (6, "a b c d e f g h i j k l", "en", "s"), (7, "a b  c d e f g h\ti j k l", "en", "s"),
    (8, "lorem ipsum dolor " * 3000, "en", "s"), (9, "Lorem ipsum DOLOR " * 2999 + "end", None, "s"), (10, "!!! 123 ???", "en", None), (None, "Word", "en", "s"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(*r, 0, "clash") for r in EDGE], "doc_id long, text string, lang string, source string, fp long, score string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
