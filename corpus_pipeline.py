"""The corpus pipeline: rules, exact and near duplicates, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before has kept; the result is written as Parquet and read again. All stages but
the last return the columns of ``documents``. Rows and columns that come in null
pass through as the stage's operator defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import bytebpe, cuckoo, minhash, packing, pii, rules, simhash
from kinweave.llm.common import documents
from kinweave.sources.deploy import ship
from kinweave.sources.scratch import scratch_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    ship(spark)
    return rules.keep_good(docs, documents(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one that stays."""
    ship(spark)
    return cuckoo.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a 5-word Jaccard similarity of 0.8 or more the document with the smallest id.

    SimHash fingerprints of the same shingles give candidates by multi-index
    hashing; every link is verified on the whole sets. Pairs beyond the radius of
    the fingerprints are found by MinHash, see the README.
    """
    ship(spark)
    return minhash.drop_near_duplicates(docs, simhash.links(docs.where("doc_id IS NOT NULL"), minhash.WIDTH))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in angle brackets."""
    ship(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    ship(spark)
    return packing.pack_documents(docs, bytebpe.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The certified cutoffs, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
