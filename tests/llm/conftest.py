import pytest

#: Null, empty, repeated and long texts, ties, and a column whose name clashes with the operators' own.
ODD = [
    (1, "The quick brown fox, and the lazy dog.\nIt's 42 < 43  \t twice"),
    (2, None),
    (3, ""),
    (None, "no id here"),
    (4, "x" * 30_000),
    (5, "été naïve \U0001f600 é <|endoftext|>\n\n\r\nend "),
    (6, "The quick brown fox, and the lazy dog.\nIt's 42 < 43  \t twice"),
    (6, "The quick brown fox, and the lazy dog.\nIt's 42 < 43  \t twice"),
    (2**60 + 1, "a b c " * 2000),
    (7, "0\x000 nul"),
    (8, " "),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", 0) for i, t in ODD], "doc_id bigint, text string, source string, start int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, start int")


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
