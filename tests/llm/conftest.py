import pytest

PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = "\n".join(" ".join(f"t{i}x{k}" for k in range(40)) for i in range(2000))
#: Nulls, empty and very long texts, repeated rows, ties, odd characters, near and exact copies, a shared passage.
DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "x"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "x"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi", None),
    (4, None, None),
    (5, "", "y"),
    (6, " \n\t ", "y"),
    (7, "one two", "y"),
    (8, "one two one", "y"),
    (9, "日本語 text \U0001f600 <|endoftext|> naïve  double  spaces\r\n end ", "y"),
    (10, f"start of ten\n{PASSAGE}\nend of ten", "y"),
    (11, f"start of eleven\n{PASSAGE}\nend of eleven", "y"),
    (12, LONG, "z"),
    (13, "same row", "z"),
    (13, "same row", "z"),
    (14, "one two", "z"),
    (None, "no id here", "z"),
    (15, "\x00\x01 control \x1f characters", "z"),
]


@pytest.fixture(scope="session")
def rows():
    return DOCS


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names clash with those that operators use inside."""
    clash = "doc_id long, text string, source string, score double, n int, key string, row int, start long, length long, salt int, rank long, label int, cid long, token long"
    return spark.createDataFrame([(*r, 0.5, 1, "k", 2, 3, 4, 5, 6, 7, 8, 9) for r in DOCS], clash)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
