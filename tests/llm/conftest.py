import pytest

TEXT = (
    "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing "
    "about the long warm summer that never seems to end in this quiet green valley of ours today and "
    "tomorrow and every other day that follows after the first snow has melted from the high hills"
)
LINES = "alpha line one\nbeta line two\ngamma line three\ndelta line four"
BENCH = "what is the name of the tall mountain that stands behind the red house of the miller"


def rows():
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    near = TEXT.replace("lazy", "sleepy")
    return [
        (1, TEXT, "en", "a"), (2, near, "en", "a"), (3, TEXT, "en", "b"), (3, TEXT, "en", "b"),
        (4, "", "en", "b"), (5, None, None, None), (6, "one two three", "en", None), (7, "ONE two\tthree", "de", "c"),
        (8, LINES, "de", "c"), (9, "intro\n" + LINES + "\nend", "de", "c"), (10, "x " + BENCH + " y", "de", "d"),
        (11, " \t\n ", None, "d"), (12, "12 345 !!", "en", "d"), (13, "word " * 500, "en", "e"),
        (14, " ".join(f"w{i}" for i in range(3000)), "en", "e"), (None, TEXT.upper(), "en", "e"), (None, None, None, None),
        (15, "größe café naïve " * 5, "de", "a"), (16, BENCH, "en", "a"),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that the operators use inside.
CLASHING = ("block", "bucket", "key", "found", "left_text", "n_lines", "data", "kind", "cls", "size", "rank", "starts")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name in CLASHING:
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, BENCH), (2, "one two three"), (2, "one two three"), (3, None), (4, "!!"), (None, "gamma line three")], "item_id bigint, text string")
