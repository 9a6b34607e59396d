import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, score string, key string, n string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, a very long text, repeated rows, and columns that clash."""
    words = "the cat sat on the mat and the dog ran home with a bone in its mouth while all of us slept".split()
    prose = " ".join(f"{w}{i % 17}" if i % 5 == 0 else w for i, w in enumerate(words * 6))
    texts = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (6, "x" * 200_000), (7, prose * 40), (None, "no id here"), (8, "1234 5678"), (9, "ÀÉ ΣΑΣ <|endoftext|> 漢字 🙂")]
    return spark.createDataFrame([(i, t, "en" if i != 9 else None, None, None, "a", "b", "c", "d", "e") for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
