import pytest

#: Rows that every operator on documents has to bear: nulls in any column, empty and blank texts, repeated
#: rows, ids shared by different texts, a long text, columns with clashing names.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    words = "the quick brown fox jumps over the lazy dog near the river bank while seven small birds watch from a tall tree and sing".split()
    prose = " ".join(words * 4)
    return [
        (None, None, None, None, None),
        (None, "a text without an id", "en", None, 3),
        (0, None, "en", "s", 0),
        (1, "", "en", "s", 0),
        (2, " \n\t ", "de", "s", 0),
        (3, prose, "en", "s", 1),
        (4, prose, "en", "s", 1),
        (4, prose, "en", "s", 1),
        (5, prose + " indeed", "en", None, 1),
        (6, "Zwei Zeilen\nüber Straßen\nZwei Zeilen", "de", "s", None),
        (7, "x" * 30_000, None, "s", 1),
        (8, " ".join(f"{w}{i}" for i in range(900) for w in words), "en", "s", 1),
        (9, "日本語 テスト 😀 123 !!", None, "s", 1),
        (9, "another text with the same id", None, "s", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
