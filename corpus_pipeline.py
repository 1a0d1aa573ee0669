"""A corpus pipeline over `documents`: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written as
Parquet and read again. All but the last return the columns of `documents`.

Cases: a null or empty text fails the quality rules; null, equal or repeated doc_ids are rows like others until the second
stage, which keeps one row of each class of texts and, of equal rows, one; ties are settled by doc_id and hashes; texts of
any length are worked on whole; further columns, whatever their names, go through all stages but the last; without labels
all documents share one posterior and are mixed at one rate; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import mixing, ngram_join, packing, pii, quality
from quillgrid.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers outlive a stage, and their memory is shared with the stages after: a smaller cache than by default
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, cache_words=200_000))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: Compression, exact set similarity and tokenizers are beyond SQL; the pipeline is tested against plain Python.
ORACLE_SQL = None


def _removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the cluster's shared folder and read again; a stage's table is removed
    when the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}")
        docs = spark.read.parquet(path)
        if before:
            _removed(spark, before)
        before = path
    return docs
