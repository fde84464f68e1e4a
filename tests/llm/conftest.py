import pytest

# Null, empty, blank, long and repeated texts, null and repeated ids.
LONG = "ein langer Satz mit vielen Wörtern ohne Ende. " * 4000
EDGE = [
    (1, "the same text over and over again, at least a hundred bytes of it, so that it counts as a passage that repeats"),
    (2, "the same text over and over again, at least a hundred bytes of it, so that it counts as a passage that repeats"),
    (2, "the same text over and over again, at least a hundred bytes of it, so that it counts as a passage that repeats"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "x" * 70_000),
    (8, "short"),
    (8, "another text under the same id"),
    (None, "no id"),
    (None, None),
    (9, "Ünïcödé 漢字 \U0001f600 \x00 control"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Awkward documents with extra columns named like those the operators use."""
    rows = [(i, t, "en", "s", -1, [1], {"a": 1}, b"k", 1.5, 7, "x") for i, t in EDGE]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, "
        "row map<string,int>, key binary, x double, d long, start string",
    )


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
