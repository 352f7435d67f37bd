"""Rows that hold every odd case, with column names that clash with those of the operators."""

from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # further columns named like those that operators make
        T.StructField("shard", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("n_words", T.StringType()),
    ]
)


def documents(spark, rows):
    """A table of documents from (doc_id, text, lang)."""
    return spark.createDataFrame(
        [(i, t, lang, None, None, "x", "y", "z", "w") for i, t, lang in rows], DOCUMENTS
    )


LONG = " ".join(f"word{k % 977} token={k:016x}" for k in range(20_000))
ODD = [
    (0, None, "en"), (1, "", "en"), (2, " \n\t", None), (3, "a", "en"), (3, "a", "en"),
    (None, "the house is on the hill", "en"), (None, "the house is on the hill", "en"),
    (4, LONG, "en"), (5, "Été \U0001f600 \x1c  x", None), (6, "12345 !!!", "en"),
    (7, "the cat and the dog", "en"), (7, "le chat et le chien", "fr"), (8, "a\x00b", "fr"),
]
