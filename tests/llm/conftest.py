import pytest

SF = "/root/testdata/sf0.001"

ODD = [
    (0, "Plain words, and more of them.\nA second line here.\nA third one.", "s1"),
    (1, None, "s1"),
    (2, "", None),
    (3, "   \n\n ", "s2"),
    (4, "one", "s2"),
    (4, "one", "s2"),
    (5, "É é 日本語 🎉🎉 <|endoftext|> a b \x1c tail ", "s3"),
    (6, "long " * 30_000, "s3"),
    (7, "Plain words, and more of them.\nA second line here.\nA third one.", "s1"),
    (None, "nobody's text with some words", "s1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"n": F.lit(1), "key": F.lit("x"), "cell": F.lit("y"), "span": F.lit(2), "size": F.lit("z"), "target": F.lit(0), "part": F.lit("p"), "label": F.lit("l")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
