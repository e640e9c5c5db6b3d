import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like those that the operators add."""
    long = "wort " * 40_000 + "ende"
    rows = [
        (1, "the cat sat on the mat and the dog lay on the rug", "en", "s", 10),
        (1, "the cat sat on the mat and the dog lay on the rug", "en", "s", 10),
        (2, "the cat sat on the mat and the dog lay on the rug", "en", None, None),
        (3, None, "en", "s", 0),
        (4, "", None, "s", 0),
        (5, "!!! ??? ...", "en", "s", 11),
        (6, long, "de", "s", None),
        (7, "kurz", "de", None, 4),
        (8, "der hund und die katze liegen auf dem teppich im haus", "de", "s", 50),
        (None, "eine zeile ohne nummer steht hier ganz allein", "de", "s", 40),
        (9, "x" * 5000, "en", "s", 5000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    clash = ["score", "lang_pred", "size", "shard", "slot", "law", "n_words", "n_hit", "items", "spans", "start", "length", "ids", "offset", "key", "component_id", "seq", "tokens", "p_toxic", "license", "own_license", "text_crc32"]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("taken") for c in clash})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([Row(doc_id=k, quality=k % 2, toxic=int(k == 2)) for k in range(1, 9)] + [Row(doc_id=None, quality=1, toxic=1), Row(doc_id=3, quality=None, toxic=None)], "doc_id long, quality int, toxic int")
