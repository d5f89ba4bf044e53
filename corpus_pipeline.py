"""A training corpus in five stages, from raw documents to packed sequences.

Each stage takes what the one before it kept; the runner writes a stage's rows as Parquet
and reads them for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenbar.llm import exact_dedup, mixing, packing, quality_rules, similar
from lumenbar.session import checkpoint_folder
from lumenbar.sources.testdata import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.drop_duplicates(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word similarity of 0.8 or more) the smallest id stays.

    Anchor SimHash finds the candidates; every link is confirmed on the whole shingle sets.
    """
    return similar.keep_one(docs, words=5, alike=(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for."""
    return mixing.write_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL can express the trained rules, fingerprints or the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

