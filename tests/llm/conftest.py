import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, media string, ids string, fp string, tokens string"
LONG = "The council met on Monday. " * 3000


def rows():
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    base = [
        (0, "The council met on Monday and voted for the new road plan at last.\nA second line of it stands here for good.", "en", "a"),
        (1, "The council met on Monday and voted for the new road plan at last.\nA second line of it stands here for good.", "en", "a"),
        (2, "The council met on Monday and voted for the new road plan at last!\nOther words.", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t ", "fr", "b"),
        (6, LONG, "en", "a"),
        (7, "Le conseil a vote lundi pour le nouveau plan. 日本語 🙂   12345", "fr", "b"),
        (7, "Le conseil a vote lundi pour le nouveau plan. 日本語 🙂   12345", "fr", "b"),
        (None, "A row without an id <|endoftext|> it's here.", "en", None),
        (8, "x" * 64, "en", "b"),
    ]
    return [(i, t, lang, s, None, "s", "h", "m", "i", "f", "k") for i, t, lang, s in base]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
