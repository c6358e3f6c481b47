import pytest

FOLDER = "/root/testdata/sf0.001"

#: Extra columns whose names operators use, or once used, themselves.
CLASHING = ["_mark", "_id", "_spans", "_learned", "_turn", "_words", "_kept_id", "_kept_mark", "_mix_key", "_mix_copy", "_mix_times",
            "mark", "id", "own", "spans", "learned", "turn", "words", "times", "label", "_row", "a.b", "features", "raw"]
COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, class string, size int, m map<string,int>, "
    + ", ".join(f"`{c}` string" for c in CLASHING)
)


def odd(rows):
    """Rows of documents with extra columns whose names operators use themselves."""
    return [(i, t, "en", s, None if t is None else len(t), 0.5, "r", None, 7, {"k": 1}, *[f"v {c}" for c in CLASHING]) for i, t, s in rows]


PROSE = "The reentry of thisher and the ondered is a wheath, then the ster of anonter was there for all to see. "

ODD_ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "b"), (5, "one two", "b"), (5, "one two", "b"),
    (None, "one two three", None), (None, None, None), (6, PROSE * 3, "a"), (7, PROSE * 3, "b"), (8, PROSE * 2500, "a"),
    (9, "é \U0001f600 naïve   café 　 x", "b"), (9, "another text under the same id as the last one", "c"),
    (10, "A" * 200_000, "c"), (11, "% \\u %zz %E9 \\x41 == ::", None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd(ODD_ROWS), COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
