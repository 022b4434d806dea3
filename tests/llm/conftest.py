import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Rows with every awkward case: nulls, empty and very long texts, ties, repeated rows.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "1234 5678 !!", "en", None),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (5, "another text with the same number", "en", "b"),
    (6, "word " * 30000, "en", "c"),
    (7, "\U0001f600 émoji ñ ß 語", "fr", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(AWKWARD, "doc_id bigint, text string, lang string, source string")
    # further columns with names that operators use themselves
    return d.select("*", F.lit(0).alias("n_chars"), F.lit("x").alias("shard"), F.lit("y").alias("fingerprint"), F.lit("z").alias("_part"), F.lit(1).alias("rate"), F.lit(1).alias("t"), F.lit("h").alias("_hash"))
