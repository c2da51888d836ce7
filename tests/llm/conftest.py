import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return dict(docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, a column with a taken name."""
    long_text = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "some words without an id", "en", "a", 1),
            (3, long_text, "en", "b", 2), (4, long_text, "en", "b", 2), (5, "one", "en", "b", 2), (5, "one", "en", "b", 2),
            (6, " \t\n ", "en", "a", 3), (7, "ü€ 日本 " * 30, "ja", "c", 4), (8, "same line\nsame line\nsame line", "en", None, 5)]
    return spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", size string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
