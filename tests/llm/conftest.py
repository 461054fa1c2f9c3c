import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, key string, node string, fp string, score double, side string"


def awkward(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash", None, "x", 1.0, "y") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    plain = " ".join(f"plain{i}" for i in range(60))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, plain), (5, plain), (6, plain + " more"), (None, "no id here at all"), (7, long), (8, "Ünïcode wörds ça va l'été"), (4, "another text with the same id")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return awkward(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
