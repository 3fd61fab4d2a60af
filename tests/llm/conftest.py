import pytest


@pytest.fixture(scope="session")
def strange(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns with names that operators use inside."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(None, "some text without id"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one"), (6, "one"), (7, "two words"), (None, None), (8, "¿Qué? — ñandú 🙂"), (9, "\n\n\n")]
    return spark.createDataFrame([(*r, 1, 2, "k", 3.0, "src", "en", 4) for r in rows], "doc_id long, text string, id int, h int, key string, k double, source string, lang string, n_chars long")
