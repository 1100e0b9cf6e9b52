import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeats, and columns whose names operators use inside."""
    data = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (3, LONG, "en", "a", 1),
        (3, LONG, "en", "a", 1),
        (None, "no id here at all, just words", "de", "b", 2),
        (5, "one", "en", "b", 3),
        (6, "  \t\n ", "en", "b", 4),
        (7, "a longer text with more than eight words in it, so that units exist. And one more sentence.", "en", "c", 5),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("fp", "size", "h", "units", "row", "score", "component_id", "order", "shard", "label", "all"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
