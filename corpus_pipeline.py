"""The corpus pipeline: documents in, shards of clean, distinct, well-mixed documents out.

Each stage takes (spark, docs, sf_dir) and returns a table; the next stage reads it from Parquet.
All but the last return the columns of documents. Texts and ids may be null, rows may repeat and
further columns may have any name; what each stage does with them is told by its operator.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from aeromosaic import ship
from aeromosaic.functions.ordering import shared_dir
from aeromosaic.llm import decontaminate, language, mixing, sharding, simhash
from aeromosaic.llm.texts import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near a centroid of some language; rejected ones go."""
    return language.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are worth half of wanted text or more by the rates solved for no toxic tokens."""
    return mixing.wanted_documents(docs, table(spark, sf_dir, "labels"))


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document that is left."""
    return sharding.sharded(docs)


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("language", _shipped(identify_language)),
    ("near_duplicates", _shipped(drop_near_duplicates)),
    ("decontamination", _shipped(drop_contaminated)),
    ("mixing", _shipped(mix_to_targets)),
    ("sharding", _shipped(deal_to_shards)),
]
#: Centroids, hashes and the classifier can't be written in SQL; tests hold the rows against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
