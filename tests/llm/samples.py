"""Odd documents that every corpus operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("length", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)

LONG = " ".join(f"w{i % 977} of{i % 31}" for i in range(30000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog " * 3,
    "",
    None,
    "   \n\t ",
    "one",
    "Éa ïn x y z",
    LONG,
    LONG + " tail",
    "same text for a tie here now",
    "same text for a tie here now",
    "line one\nline two\nline one\n\nline one",
    "a # b * c $ d % e & f | g < h > i",
    "<|endoftext|> [INST] x [/INST] </s>",
]


def odd_rows():
    return [(i, t, None, None, None, "x", "y", "z") for i, t in enumerate(TEXTS)]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(spark, path, **tables):
    """Write the tables where a query looks for them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
