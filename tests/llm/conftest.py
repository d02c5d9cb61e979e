import pytest

from gleaner.llm import common

#: Extra columns whose names operators also use for themselves or their results.
EXTRA = "kept string, score string, n_words string, chunk string, word string, component_id string, `bin` string"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


def texts() -> list[tuple]:
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    many = " ".join(f"{base} number{i}" for i in range(4))
    return [
        (1, many, "en", "s0", 10), (2, many, "en", "s0", 10), (2, many, "en", "s0", 10), (3, many.upper() + " END", "en", None, 10), (4, None, None, None, None), (5, "", "en", "s0", 0), (6, " \n\t ", "en", "s1", 4),
        (7, "short text", "en", "s1", 10), (8, LONG, "en", "s0", len(LONG)), (9, LONG[: len(LONG) // 2] + " changed here", "de", "s0", 0), (None, "a row without an id " * 20, "fr", "s1", 1), (10, "Ünïcödé çà et là " * 30, "fr", "s1", 3),
        (11, "same line of boilerplate\nsame line of boilerplate\n" + base, "en", "s0", 5),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, long and equal texts, repeated rows, and clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts(), SCHEMA).repartition(3)
    return df.withColumns({c.split()[0].strip("`"): F.lit("extra") for c in EXTRA.split(", ")})


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, small):
    return common.table(spark, small, "documents")
